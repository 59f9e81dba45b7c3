"""Token counts of a document's sections by offset-mapped attribution.

A whole document is encoded once, since cutting it first would change the tokens at the cuts.  Tokens and sections are
both runs of the text's UTF-8 bytes; joining the two sorted lists of intervals tells which sections a token touches.
The rule for a token that crosses a boundary is explicit: ``start`` gives it to the section that holds its first byte,
``most`` to the section that holds most of its bytes (the earlier one in a tie).  Every token belongs to one section, so
a document's section counts sum to its number of tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import valid_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-split of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "most")


def load_encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(vocabulary: str) -> np.ndarray:
    ranks = {int(b): len(base64.b64decode(a)) for a, b in (line.split() for line in open(vocabulary, "rb") if line.strip())}
    out = np.zeros(max(ranks) + 1, np.int64)
    out[list(ranks)] = list(ranks.values())
    return out


def section_starts(raw: bytes) -> np.ndarray:
    """Lines: each begins after a newline byte; a text has at least one section."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate([[0], breaks])


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str) -> np.ndarray:
    """Tokens per section, for tokens [starts, ends) and sections that begin at ``sections`` and reach to the next or to size."""
    first = np.searchsorted(sections, starts, side="right") - 1
    if rule == "start":
        return np.bincount(first, minlength=len(sections))
    last = np.searchsorted(sections, np.maximum(starts, ends - 1), side="right") - 1
    edges = np.append(sections, size)
    for i in np.flatnonzero(first != last):
        part = np.arange(first[i], last[i] + 1)
        first[i] = part[np.argmax(np.minimum(edges[part + 1], ends[i]) - np.maximum(edges[part], starts[i]))]
    return np.bincount(first, minlength=len(sections))


def _counter(vocabulary: str, rule: str):
    def run(batches):
        encoding, lengths = load_encoding(vocabulary), token_lengths(vocabulary)
        for batch in batches:
            ids, section, start, end, counts, totals, crossing = [], [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                size = lengths[np.asarray(encoding.encode_ordinary(text or ""), np.int64)]
                ends = np.cumsum(size)
                sections = section_starts(raw)
                n = attribute(ends - size, ends, sections, len(raw), rule)
                cross = np.bincount(np.searchsorted(sections, ends - size, side="right") - 1, weights=np.searchsorted(sections, np.maximum(ends - size, ends - 1), side="right") - np.searchsorted(sections, ends - size, side="right") > 0, minlength=len(sections))
                ids.append(np.full(len(n), k))
                section.append(np.arange(len(n)))
                start.append(sections)
                end.append(np.append(sections[1:], len(raw)))
                counts.append(n)
                totals.append(np.full(len(n), len(ends)))
                crossing.append(cross.astype(np.int64))
            if ids:
                columns = [np.concatenate(x).astype(np.int64) for x in (section, start, end, counts, totals, crossing)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(ids))), *map(pa.array, columns)], names=["doc_id", "section", "start_byte", "end_byte", "n_tokens", "doc_tokens", "n_crossing"])

    return run


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "most") -> DataFrame:
    """One row per line of each row of docs: doc_id, section, start_byte, end_byte, n_tokens, doc_tokens, n_crossing.

    A section reaches up to and includes its newline.  n_crossing counts the tokens that begin in the section and reach
    into a later one.  Null and empty texts have one empty section without tokens.  Repeated rows are counted each.
    Bytes that are not UTF-8 count as U+FFFD, of three bytes.  An empty table gives no rows; a text of any length is encoded whole, in one row; other columns are ignored.
    The vocabulary file must be readable at this path on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    d = docs.select("doc_id", valid_text())
    return d.mapInArrow(_counter(vocabulary, rule), f"doc_id {dict(d.dtypes)['doc_id']}, section long, start_byte long, end_byte long, n_tokens long, doc_tokens long, n_crossing long")
