import random
import re
from collections import Counter

import pytest
from pyspark.sql import Row

from sonograin.llm import licenses, lines, token_counts

BLANK = re.compile("[^\x20\x09-\x0d]+")


def brute_deletions(docs, least):
    """Line numbers deleted per document: lines in any run of ``least`` words or more that stands earlier too."""
    seqs = [(i, [(p, x) for p, x in enumerate((t or "").split("\n")) if BLANK.search(x)]) for i, t in docs]
    seen, gone = set(), {i: set() for i, _ in docs}
    for i, s in sorted(seqs):
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += len(BLANK.findall(s[b][1]))
                if n >= least:
                    run = tuple(x for _, x in s[a : b + 1])
                    if run in seen:
                        gone[i] |= {p for p, _ in s[a : b + 1]}
                    seen.add(run)
    return {i: sorted(g) for i, g in gone.items()}


@pytest.mark.parametrize("least", [1, 5, 20])
def test_line_dedup_against_brute_force(spark, least):
    r = random.Random(least)
    pool = [" ".join("abcdefg"[r.randrange(7)] for _ in range(r.randint(1, 6))) for _ in range(12)] + ["", " \t", " ".join("long" for _ in range(25))]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(60)] + [(100, None), (101, ""), (102, "a b c\n" * 12)]
    got = lines.deletions(spark.createDataFrame([(i, t, 1) for i, t in docs + docs[:2]], "doc_id long, text string, pos int"), least).collect()
    want = brute_deletions(docs, least)
    assert len(got) == len(docs) + 2 and {x.doc_id: x.deleted for x in got} == want
    assert any(want.values()) and all(x.n_deleted == len(want[x.doc_id]) for x in got)


def test_line_dedup_edges(spark):
    assert lines.deletions(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    run = "one two three four five six seven eight nine ten\n" * 2
    docs = spark.createDataFrame([(1, "head\n" + run + "tail", "en"), (2, run + "own", "en"), (None, run, "de")], "doc_id long, text string, lang string")
    out = {x.doc_id: x.text for x in lines.without_repeats(docs).collect()}
    assert out[1] == "head\n" + run + "tail" and out[2] == "own" and out[None] == ""


def test_license_base_against_brute_force(spark):
    r = random.Random(6)
    bits = ["Under the MIT License,", "apache license version 2", "CC-BY-NC", "cc by", "under the", "mit license", "É", "\n", "word"]
    docs = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "CC BY NC cc by nc")]
    got = licenses.scan(spark.createDataFrame([(i, t, "x") for i, t in docs + docs[:1]], "doc_id long, text string, labels string")).collect()
    assert len(got) == len(docs) + 1
    texts = dict(docs)
    for x in got:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[x.doc_id] or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (x.n_words, x.n_base) == (len(w), len(at)) and x.base_labels == ",".join(sorted({b for _, b in at}))
        assert (x.first_word, x.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, left = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (c != d)))
    return row[-1]


def test_fuzzy_notices_have_bounded_edits(spark):
    docs = [(1, "released undr the mit lisense today"), (2, "GNU General Publik License!"), (3, "nothing here"), (4, "permission is hereby granted, free of charge"), (5, "gxx gxnxrxl pxblxc lxcxnsx")]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["mit", "gpl", "", "mit", ""] and 0.85 < got[1].score < 1 and got[4].score == 1 and got[3].score == 0
    for i, t in docs:
        joined = " " + " ".join(re.findall("[a-z]+", t.lower())) + " "
        for s in got[i].spans:
            assert min(edit_distance(joined[s.start : s.end], n) for n, label in licenses.NOTICES.items() if label == s.label) <= s.edits <= licenses.MOST


def test_every_placed_notice_with_few_edits_is_found():
    r, compiled = random.Random(2), licenses._compiled(licenses.NOTICES)
    for notice, label in licenses.NOTICES.items():
        for _ in range(20):
            w = list(notice)
            for _ in range(r.randint(0, licenses._edits(notice))):
                p = r.randrange(1, len(w) - 1)
                w[p : p + 1] = r.choice([[], ["x"], [w[p], "x"]])
            text = " zz " + "".join(w) + " yy "
            least = min(edit_distance("".join(w), notice), licenses._edits(notice))
            # a look-alike notice may be as near or nearer
            assert any(x[0] == label or (x[3] <= least and x[4] >= len(notice) - licenses.MOST) for x in licenses.fuzzy_places(text, compiled)), (notice, text)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_offsets(spark, rule):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [None, "", "\n", "a\n\n\nb", "Über größe\nzwei  \n \n drei <|endoftext|>", "it's\n\n  99 bottles\n", "日本\n🙂\n" * 3, "x " * 5000]
    got = token_counts.section_tokens(spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, section int"), rule=rule).collect()
    by = {(x.doc_id, x.section): x for x in got}
    for i, t in enumerate(texts):
        t = t or ""
        ends = [m.end() for m in re.finditer("\n", t)] + [len(t)]
        where = [sum(e <= c for e in ends[:-1]) for c in range(len(t))]
        counts = Counter()
        enc = tok.encode(t, add_special_tokens=False)
        for a, b in enc.offsets:
            share = Counter(where[a:b] or [where[a]])
            counts[where[a] if rule == "start" else max(share, key=lambda s: (share[s], -s))] += 1
        assert sum(x.n_tokens for (d, _), x in by.items() if d == i) == len(enc.ids)
        assert len([1 for d, _ in by if d == i]) == len(ends)
        if t.isascii():
            assert {s: by[i, s].n_tokens for s in range(len(ends))} == {s: counts[s] for s in range(len(ends))}
    assert token_counts.section_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts_of_wide_characters_nulls_and_repeats(spark):
    """Bytes of lines, crossing tokens and attribution rebuilt from the tokens' own bytes."""
    enc = token_counts.load_encoding(token_counts.VOCABULARY)
    texts = ["日本\n🙂\n語\n" * 5, "é\n\nüber alles \n\n\n x", "word\n" * 40 + "long " * 3000, "\r\n\r\n", None]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[1], 1), (1, texts[1], 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for rule in token_counts.RULES:
        got = sorted(map(str, token_counts.section_tokens(docs, rule=rule).collect()))
        want = []
        for i, t, _ in rows:
            raw = (t or "").encode()
            line_of = [raw[:k].count(b"\n") for k in range(len(raw))]
            starts = [0, *(k + 1 for k, c in enumerate(raw) if c == 10)]
            n, crossing, at, total = Counter(), Counter(), 0, 0
            for piece in enc.decode_tokens_bytes(enc.encode_ordinary(t or "")):
                lines_in = line_of[at : at + len(piece)]
                share = Counter(lines_in)
                n[lines_in[0] if rule == "start" else max(share, key=lambda x: (share[x], -x))] += 1
                crossing[lines_in[0]] += lines_in[-1] > lines_in[0]
                at, total = at + len(piece), total + 1
            want += [str(Row(doc_id=i, section=k, start_byte=a, end_byte=z, n_tokens=n[k], doc_tokens=total, n_crossing=crossing[k])) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(raw)]))]
        assert got == sorted(want)
