import random

import pytest

from sonograin.llm import lines


def maximal_deletions(docs, least):
    """Line numbers per document inside any run of ``least`` words or more, of whatever length, that stands earlier too."""
    seqs = [(i, [(p, x) for p, x in enumerate(t.split("\n")) if x.split()]) for i, t in docs]
    gone, seen = {i: set() for i, _ in docs}, set()
    for i, s in sorted(seqs):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(len(x.split()) for _, x in s[a:b]) >= least:
                    run = tuple(x for _, x in s[a:b])
                    if run in seen:
                        gone[i] |= {p for p, _ in s[a:b]}
                    seen.add(run)
    return {i: sorted(g) for i, g in gone.items()}


@pytest.mark.parametrize("sizes", [(30, 30, 10), (15, 15, 3), (25, 1, 1, 1), (1, 30, 1), (7, 7, 7, 2, 2)])
def test_the_tail_of_a_repeat_goes_too(spark, sizes):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate(sizes))
    docs = [(i, f"own head {i}\n{passage}\nown tail {i}") for i in range(3)]
    got = {x.doc_id: x.deleted for x in lines.deletions(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: [], 1: [*range(1, len(sizes) + 1)], 2: [*range(1, len(sizes) + 1)]} == maximal_deletions(docs, 20)


@pytest.mark.parametrize("least", [1, 5, 20])
def test_maximal_repeats_against_brute_force(spark, least):
    r = random.Random(least + 50)
    pool = [" ".join("abcdefg"[r.randrange(7)] for _ in range(r.randint(1, 8))) for _ in range(9)] + ["", " ".join("long" for _ in range(25))]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(40)]
    a = "\n".join(r.choice(pool) for _ in range(14))
    docs += [(100 + i, f"{a}\nx{i}\n{a}") for i in range(3)]
    got = {x.doc_id: x.deleted for x in lines.deletions(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()}
    assert got == maximal_deletions(docs, least)


def test_matched_runs_equal_kept_lines_and_make_up_the_deletions(spark):
    r = random.Random(31)
    pool = [" ".join("abcdefg"[r.randrange(7)] for _ in range(r.randint(1, 8))) for _ in range(9)] + [""]
    passage = [f"passage line {i} of some words" for i in range(12)]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(30)]
    docs += [(100 + i, "\n".join([f"head {i}", *passage, f"tail {i}"])) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    full = {i: [x for x in t.split("\n") if x.split()] for i, t in docs}
    numbers = {i: [p for p, x in enumerate(t.split("\n")) if x.split()] for i, t in docs}
    gone = {i: set() for i, _ in docs}
    rows = lines.matched_runs(df, 10).collect()
    for x in rows:
        assert full[x.doc_id][x.pos : x.pos + x.n_lines] == full[x.first_doc_id][x.first_pos : x.first_pos + x.n_lines]
        assert (x.first_doc_id, x.first_pos) < (x.doc_id, x.pos) and x.n_copies > 1
        gone[x.doc_id] |= set(numbers[x.doc_id][x.pos : x.pos + x.n_lines])
    assert {i: sorted(g) for i, g in gone.items()} == maximal_deletions(docs, 10)
    assert {(x.doc_id, x.pos, x.n_lines, x.first_doc_id, x.first_pos, x.n_copies) for x in rows if x.doc_id >= 100} == {(100 + i, 1, 12, 100, 1, 4) for i in (1, 2, 3)}
