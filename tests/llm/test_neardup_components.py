import random

from sonograin.llm.neardup import near_duplicates, one_of_each


def text(seed, n=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def kept(spark, rows):
    return sorted((str(x.doc_id), x.text) for x in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_components_with_one_smallest_doc_id_stay_apart(spark):
    a, b = text(1), text(2)
    rows = [(5, a), (7, a), (5, b), (9, b), (5, a)]
    assert kept(spark, rows) == [("5", a), ("5", b)]


def test_one_stays_of_near_copies_without_doc_ids(spark):
    a = text(3)
    for k in range(40):
        near = a.rsplit(" ", 1)[0] + f" other{k}"
        found = near_duplicates(spark.createDataFrame([(None, a), (None, near)], "doc_id long, text string")).collect()
        if found[0].fp != found[1].fp and found[0].root == found[1].root:
            break
    assert found[0].fp != found[1].fp and found[0].root == found[1].root
    got = kept(spark, [(None, a), (None, near), (None, text(4))])
    assert len(got) == 2 and ("None", text(4)) in got
