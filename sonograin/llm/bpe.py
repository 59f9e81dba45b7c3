"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse as an incremental state machine.

A text passes three machines, none of which holds more than a bounded piece of it.  The first looks for special tokens and
holds back what may be the beginning of one.  The second cuts words: a match that ends three characters before the end of
what has been read cannot change any more; a word longer than LONG goes on as a run of one class of characters.  The third
merges bytes: tokens that end a sufficient lookahead before the end of what has been read are final and leave.

The sufficient lookahead comes from the merge list.  Compare the merging of w with that of a longer text: after each rule both
agree up to some common boundary, at first the end of w.  A rule (u, v) moves that boundary left only by merging across it, so
by the length of u, and only if v begins there; v then has the left part of the rule that moved it before on its left spine,
and rules come in the order of the list.  The longest sum of such lengths over chains of ever later rules bounds how far a
longer text can reach back.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import sys
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters read at a time, characters of a word that goes on as a run, and words in each half of the memory of words.
READ, LONG, CACHE = 1 << 16, 1 << 12, 1 << 17
_SWAP = sys.byteorder == "big"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, iter(range(256, 512))
    return [out[b] if b in out else chr(next(extra)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], sizes: dict[int, int]) -> int:
    """Bytes after a token's end that settle it.  merges: (left, right, result) in order of rank; sizes: bytes of each token."""
    left_of = {new: u for u, _, new in merges}
    furthest: dict[int, int] = {}  # by the left part of a rule: the most bytes that a chain up to this rule moves a boundary
    for u, v, _ in merges:
        before, spine = 0, v
        while spine is not None:
            before, spine = max(before, furthest.get(spine, 0)), left_of.get(spine)
        furthest[u] = max(furthest.get(u, 0), before + sizes[u])
    return max(furthest.values(), default=0)


def _ranges(found) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


@lru_cache
def word_patterns() -> tuple[dict[str, re.Pattern], dict[str, re.Pattern]]:
    """Patterns of words and of the rest of a run, by class (L letters, N numbers, S blanks, O others); classes as the library has them.

    ``words`` has a pattern for texts of the basic plane and one for all, since wide classes are slow to look up.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    blocks = [range(a, a + 2048) for a in range(0, 0x110000, 2048) if a != 0xD800]  # long texts take the library more than linear time
    classes = {}
    for name, pattern in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
        outside, found = Split(Regex(pattern), "removed"), []
        for block in blocks:
            at = 0
            for _, (a, b) in [*outside.pre_tokenize_str("".join(map(chr, block))), ("", (len(block), 0))]:
                if a > at:
                    found.append((block[at], block[a - 1]))
                at = b
        classes[name] = found
    words = {}
    for plane, top in (("basic", 0xFFFF), ("all", 0x10FFFF)):
        L, N, S = (_ranges((a, min(b, top)) for a, b in classes[k] if a <= top) for k in "LNS")
        words[plane] = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
    return words, {"L": re.compile(f"[{L}]*"), "N": re.compile(f"[{N}]*"), "S": re.compile(f"[{S}]*"), "O": re.compile(f"[^{S}{L}{N}]*")}


_WIDE = re.compile("[\U00010000-\U0010ffff]")


class Vocabulary:
    """Merges, ids and bytes of tokens from a tokenizer file of byte-level BPE; other kinds of files are an error."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, splitter = file["model"], file["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or file["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        vocab, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        known = set(self.first)
        for u, v, new in rules:
            if u not in known or v not in known or new in known:
                raise ValueError("a merge needs a token that no earlier one makes, or makes one again")
            known.add(new)
        self.wide, self.made = max(vocab.values()) + 1, [new for _, _, new in rules]
        self.ranks = {u * self.wide + v: rank for rank, (u, v, _) in enumerate(rules)}
        self.bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {}
        for t in file["added_tokens"]:
            if not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("only plain special tokens are known")
            self.special[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        self.sizes = {i: len(b) for i, b in self.bytes.items()}
        self.lookahead = sufficient_lookahead(rules, self.sizes)
        self.window = 4 * self.lookahead + 2 * max(self.sizes.values())
        self.recent, self.older = {}, {}  # packed ids of words; the recent half becomes the older one when it is full

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of a word that is looked at as a whole: the earliest rule first, its leftmost place first."""
        ids, rank, wide, made = [self.first[b] for b in raw], self.ranks.get, self.wide, self.made
        if len(ids) > 64:
            return self._merge_long(ids)
        none = len(made)
        ranks = [rank(u * wide + v, none) for u, v in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * wide + ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * wide + ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks, wide = len(ids), self.ranks, self.wide
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(u * wide + v for u, v in zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] * wide + ids[j] != pair:  # one of both has been merged meanwhile
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pair := ids[a] * wide + ids[b]) in ranks:
                    heapq.heappush(heap, (ranks[pair], a, pair))
        return [x for x in ids if x >= 0]

    def settled(self, raw: bytes, ended: bool) -> tuple[list[int], bytes]:
        """Final tokens of a word's bytes, and the bytes that are not settled yet (none if the word has ended)."""
        out, at = [], 0
        while len(raw) - at > self.window:
            part, end = raw[at : at + self.window], 0
            for token in self.merge(part):
                if end + self.sizes[token] > self.window - self.lookahead:
                    break
                out.append(token)
                end += self.sizes[token]
            at += end
        return (out + self.merge(raw[at:]), b"") if ended else (out, raw[at:])


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if _SWAP:
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Feeds of text in, packed ids out, each as soon as it is final; ``finish`` ends the text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words, self.runs = word_patterns()
        self.specials = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.held, self.tail, self.run, self.raw, self.blank = "", "", None, b"", ""

    def feed(self, text: str) -> list[bytes]:
        text, out, at = self.held + text, [], 0
        self.held = ""
        if self.specials is None:
            return self._text(text)
        for m in self.specials.finditer(text):
            out += [*self._text(text[at : m.start()]), *self._end(), packed([self.v.special[m[0]]])]
            at = m.end()
        rest = text[at:]
        keep = max((k for t in self.v.special for k in range(1, min(len(t), len(rest) + 1)) if rest.endswith(t[:k])), default=0)
        self.held = rest[len(rest) - keep :]
        return out + self._text(rest[: len(rest) - keep])

    def finish(self) -> list[bytes]:
        held, self.held = self.held, ""
        return [*self._text(held), *self._end()]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        get, new = self.v.recent.get, self._new
        return [get(p) or new(p) for p in pieces]

    def _new(self, piece: str) -> bytes:
        v = self.v
        out = v.recent.get(piece) or v.older.get(piece) or packed(v.settled(piece.encode(), True)[0])
        if len(piece) < 64:
            if len(v.recent) >= CACHE:
                v.recent, v.older = {}, v.recent
            v.recent[piece] = out
        return out

    def _cut(self, text: str) -> list[str]:
        return self.words["all" if _WIDE.search(text) else "basic"].findall(text)

    def _text(self, text: str) -> list[bytes]:
        out = []
        if self.run:
            if self.run == "S":  # the last blank of a run goes with what follows
                text, self.blank = self.blank + text, ""
            took = self.runs[self.run].match(text).end()
            ended = took < len(text)
            if self.run == "S":
                took -= 1
            if took > 0:
                self.raw += text[:took].encode()
            tokens, self.raw = self.v.settled(self.raw, ended)
            out.append(packed(tokens))
            if not ended:
                self.blank = text[max(0, took) :]
                return out
            self.run, text = None, text[max(0, took) :]
        pieces, keep = self._cut(self.tail + text), 0
        last = len(pieces)
        while last and keep < 3:
            last -= 1
            keep += len(pieces[last])
        self.tail = "".join(pieces[last:])
        out += self._encode(pieces[:last])
        if last == len(pieces) - 1 and keep > LONG:
            piece, self.tail = self.tail, ""
            self.run = next(k for k in "LNSO" if self.runs[k].fullmatch(piece[-1]))
            if self.run == "S":
                piece, self.blank = piece[:-1], piece[-1]
            tokens, self.raw = self.v.settled(piece.encode(), False)
            out.append(packed(tokens))
        return out

    def _end(self) -> list[bytes]:
        if self.run:
            tokens = self.v.settled(self.raw + self.blank.encode(), True)[0]
            self.run, self.raw, self.blank = None, b"", ""
            return [packed(tokens)]
        tail, self.tail = self.tail, ""
        return self._encode(self._cut(tail))


class Decoder:
    """Feeds of packed ids in, text out, each character as soon as its bytes are complete; ids without a token are passed over."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes, self.state = vocabulary.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        got = array("I", ids)
        if _SWAP:
            got.byteswap()
        return self.state.decode(b"".join([self.bytes.get(i, b"") for i in got]))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


def _encoding(path: str):
    def run(batches):
        encoder = Encoder(load(path))
        for batch in batches:
            out = []
            for text in batch.column(1):
                text, got = text.as_py() or "", []
                for at in range(0, len(text), READ):
                    got += encoder.feed(text[at : at + READ])
                out.append(b"".join(got + encoder.finish()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return run


def _decoding(path: str):
    def run(batches):
        decoder = Decoder(load(path))
        for batch in batches:
            out = []
            for ids in batch.column(1):
                ids = ids.as_py() or b""
                out.append("".join([*(decoder.feed(ids[at : at + 4 * READ]) for at in range(0, len(ids), 4 * READ)), decoder.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    return run


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of docs: doc_id and ids, the text's tokens as packed little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens; bytes that are not UTF-8 count as U+FFFD.  Special tokens of the vocabulary are
    found in texts.  Repeated rows stay, an empty table gives no rows, texts may be of any length, other columns are
    ignored.  The vocabulary file must be readable at this path on every executor.
    """
    d = docs.select("doc_id", F.make_valid_utf8("text").alias("text"))
    return d.mapInArrow(_encoding(vocabulary), f"doc_id {dict(d.dtypes)['doc_id']}, ids binary")


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of tokens: doc_id, ids and the text that the ids (packed, null: none) stand for."""
    d = tokens.select("doc_id", "ids")
    return d.mapInArrow(_decoding(vocabulary), f"doc_id {dict(d.dtypes)['doc_id']}, ids binary, text string")
