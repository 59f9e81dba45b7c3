import random

from sonograin.llm import licenses


def test_worse_notices_before_the_best_keep_their_spans():
    joined = " under teh mit license under the mit license "
    got = [x[1:4] for x in licenses.fuzzy_places(joined, licenses._compiled(licenses.NOTICES)) if x[0] == "mit"]
    assert len(got) == 2 and got[1] == (23, 44, 0) and got[0][0] <= 1 and 22 <= got[0][1] + 1 and got[0][2] in (1, 2)


def test_all_of_several_close_notices_are_found():
    r, compiled = random.Random(12), licenses._compiled(licenses.NOTICES)
    for notice, label in licenses.NOTICES.items():
        for _ in range(10):
            parts = []
            for _ in range(5):
                w = list(notice)
                if r.random() < 0.7:
                    w[r.randrange(1, len(w) - 1)] = "x"
                parts.append("".join(w))
            joined, places = " ", []
            for x in parts:
                places.append((len(joined), len(joined) + len(x)))
                joined += x + r.choice([" ", " zz "])
            spans = licenses.fuzzy_places(joined, compiled)  # another notice may be nearer, or longer, at such a place
            assert all(any(s < hi and lo < e for _, s, e, _, _ in spans) for lo, hi in places), (joined, spans)
            assert all(a[2] <= b[1] or a[4] != b[4] for a, b in zip(spans, spans[1:]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        left, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (c != d)))
    return row[-1]


def brute_spans(text, notices):
    """All spans between blanks within the allowed edits of a notice, chosen by the stated rule."""
    blanks, found = [i for i, c in enumerate(text) if c == " "], []
    for notice, label in notices.items():
        k = licenses._edits(notice)
        for a in blanks:
            for z in blanks:
                if abs(z - a - 1 - len(notice)) <= k and (e := distance(text[a + 1 : z], notice)) <= k:
                    found.append((label, a + 1, z, e, len(notice)))
    return found


def test_labels_and_score_against_brute_force(spark):
    r = random.Random(21)
    notices = dict(list(licenses.NOTICES.items())[::9])
    filler = ["under", "the", "license", "public", "words", "general", "é", "version"]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            w = list(r.choice(list(notices)))
            for _ in range(r.randint(0, 4)):
                at = r.randrange(1, len(w) - 1)
                w[at : at + 1] = r.choice([[], ["x"], [w[at], "x"]])
            parts += ["".join(w), *(r.choice(filler) for _ in range(r.randint(0, 4)))]
        docs.append((i, " ".join(parts)))
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), {}, notices).collect()}
    for i, t in docs:
        text = " " + " ".join(x.decode() for x in licenses.words_of(t)) + " "
        every = brute_spans(text, notices)
        chosen = {tuple(x) for x in got[i].spans}
        assert chosen <= {x[:4] for x in every}
        assert got[i].labels == ",".join(sorted({x[0] for x in chosen})) and (got[i].score > 0) == bool(every)
        best = min((x[3] / x[4] for x in every), default=1.0)
        assert got[i].score <= 1 - best + 1e-12
        for x in every:  # what isn't chosen shares characters with a find that has no more edits
            assert any(s < x[2] and x[1] < e and d <= x[3] for _, s, e, d in chosen), (text, x, chosen)


def test_many_repeats_and_edges(spark):
    import time

    compiled = licenses._compiled(licenses.NOTICES)
    took = []
    for n in (1000, 4000):
        began = time.time()
        assert len(licenses.fuzzy_places(" under teh mit license" * n + " ", compiled)) == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1
    docs = spark.createDataFrame([(None, "under the mit license", 1), (None, "under the mit license", 1), (3, None, 2), (4, "word " * 100_000 + "apache license version 2", 3)], "doc_id long, text string, spans int")
    got = licenses.scan(docs).collect()
    assert [x.labels for x in got] == ["mit", "mit", "", "apache-2"] and got[3].first_word == 100_000 and licenses.scan(docs.limit(0)).count() == 0
