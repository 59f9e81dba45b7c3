import hashlib
import random
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonograin.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"abe \n1!='", "the", "  ", "'s", "'re", "--", "23", "é", "ß", "漢", "😀", "🏽", " ", "　", "\x1c", "\x85", "\t", "ation", "<|endoftext|>", "<|endof", "text|>", "͸", "\U0001e900", "٣", "½", "‍", "e" * 50, "-" * 30, " " * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def through(encoder, text, size):
    got, at = [], 0
    while at < len(text):
        k = size()
        got += encoder.feed(text[at : at + k])
        at += k
    return b"".join(got + encoder.finish())


def same(library, v, text, size):
    want = library.encode(text, add_special_tokens=False).ids
    got = through(bpe.Encoder(v), text, size)
    assert list(array("I", got)) == want, text[:200]
    decoder = bpe.Decoder(v)
    cuts = [got[i : i + 12] for i in range(0, len(got), 12)]
    assert "".join(map(decoder.feed, cuts)) + decoder.finish() == library.decode(want, skip_special_tokens=False)


def test_texts_fed_in_pieces_of_any_size(library):
    r, v = random.Random(1), bpe.load(PATH)
    for _ in range(800):
        same(library, v, "".join(r.choice(PARTS) for _ in range(r.randrange(60))), lambda: r.choice([1, 2, 3, 7, 999]))


def test_long_words_go_through_a_bounded_window(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 16)
    r, v = random.Random(2), bpe.load(PATH)
    for base in ["a", "ab", "=", "-", " ", "\n", "é", "in", "ation", "aaab", "!", "😀", "1", "　"]:
        for _ in range(6):
            text = base * r.randrange(1, 3000) + "".join(r.choice(PARTS) for _ in range(5)) + "".join(r.choice("abeinot") for _ in range(r.randrange(3000)))
            same(library, v, text, lambda: r.choice([50, 333, 1000]))
    encoder = bpe.Encoder(v)
    for _ in range(50):
        encoder.feed("ab" * 5000)
        assert len(encoder.raw) <= v.window and not encoder.tail and not encoder.held  # what is held does not grow with the word


def test_lookahead_settles_tokens():
    v, r = bpe.load(PATH), random.Random(3)
    assert 0 < v.lookahead < 1000
    for _ in range(200):
        word = "".join(r.choice(r.choice(["ab", "aeinot", "-=", "abcdefgh"])) for _ in range(900)).encode()
        ends = lambda ids: [sum(v.sizes[i] for i in ids[: k + 1]) for k in range(len(ids))]
        whole, part = v.merge(word), v.merge(word[:600])
        final = [i for i, e in zip(part, ends(part)) if e <= 600 - v.lookahead]
        assert whole[: len(final)] == final


def test_lookahead_of_a_small_list():
    # a b c d: (c d), then (b c) only if no d follows, then (a b) only if (b c) did not apply: d settles what a becomes
    sizes = dict.fromkeys(range(4), 1) | {4: 2, 5: 2, 6: 2}
    assert bpe.sufficient_lookahead([(2, 3, 4), (1, 2, 5), (0, 1, 6)], sizes) == 3
    assert bpe.sufficient_lookahead([(0, 1, 6), (1, 2, 5), (2, 3, 4)], sizes) == 1
    assert bpe.sufficient_lookahead([], sizes) == 0


def test_other_kinds_of_files_are_an_error():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_tables(spark, library, tmp_path):
    texts = [(1, "Hello  world's\n\n"), (2, None), (3, ""), (None, "x" * 200_000), (1, "Hello  world's\n\n"), (5, "a <|endoftext|> b"), (6, "é" * 70_000)]
    docs = spark.createDataFrame([(i, t, "u", "v") for i, t in texts], "doc_id long, text string, ids string, raw string")
    out = bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()
    assert [(r.doc_id, list(array("I", r.ids)), r.text) for r in out] == [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in texts]
    assert bpe.encoded(docs.limit(0), PATH).count() == 0
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62E282' as string)").alias("text"))
    assert bpe.decoded(bpe.encoded(broken, PATH), PATH).head().text == "a�b�"
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_bpe(spark, str(tmp_path)).where("doc_id = 5").collect():
        ids = library.encode("a <|endoftext|> b", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(b"a <|endoftext|> b").hexdigest())


def test_ids_that_are_no_tokens_and_cut_characters():
    v = bpe.load(PATH)
    d = bpe.Decoder(v)
    halves = [i for i in v.first if v.bytes[i] in (b"\xc3", b"\xa9")]
    assert d.feed(bpe.packed(sorted(halves, key=lambda i: v.bytes[i], reverse=True))) == "é"
    assert d.feed(bpe.packed([10**6])) == "" and d.feed(bpe.packed([v.first[0xC3]])) == "" and d.finish() == "�"
