"""License scans: exact phrases, and short notices with bounded errors.

A notice that stands in a text with at most k edits leaves at least one of its k + 1 pieces untouched (pigeonhole), so
only texts and places where a piece is found can hold it.  One pass over a text looks for the pieces of all notices.  Around
each such place, in a window just long enough for the notice, the regex library searches the best match with at most k
errors and reports its span and edits.  A find gives way to another one that shares characters with it if that has fewer
edits, or as many and more length, an earlier start or a smaller label, and its notice isn't shorter by more than a few
characters; so of look-alike notices the nearest is named, of an exact one and an exact one inside it the longer, and a
worse find of a long notice stays beside a better one of a short notice inside it.  The work grows with the text and the
pieces found in it.

Texts are compared as their lower-cased words with one blank between them, so punctuation and line breaks don't count.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import valid_text

#: Phrases whose exact places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def read_notices(path: Path) -> dict[str, str]:
    """notice -> label, of lines 'label: notice'; lines that begin with # are remarks."""
    pairs = (line.split(": ", 1) for line in path.read_text().splitlines() if line and not line.startswith("#"))
    return {notice: label for label, notice in pairs}


#: Short notices searched with errors, with their labels; any other table of this form may be given.
NOTICES = read_notices(Path(__file__).with_name("notices.txt"))
#: One edit is allowed for so many characters of a notice, and at most MOST.
PER_EDIT, MOST = 10, 3

_KEPT = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


def _edits(notice: str) -> int:
    return min(MOST, len(notice) // PER_EDIT)


def _seeds(notice: str) -> list[tuple[int, str]]:
    n = _edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def _compiled(notices: dict[str, str]) -> tuple:
    """(label, edits, length, pattern) of each notice, and an automaton over all pieces with (notice, place in it) of each."""
    found, pieces = [], defaultdict(list)
    for i, (notice, label) in enumerate(notices.items()):
        k = _edits(notice)
        pattern = regex.compile(f"(?b)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?= )")
        found.append((label, k, len(notice), pattern))
        for at, piece in _seeds(notice):
            pieces[piece].append((i, at, len(piece)))
    automaton = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        automaton.add_word(piece, uses)
    automaton.make_automaton()
    return found, automaton


def _places(haystack, needle):
    at = haystack.find(needle)
    while at >= 0:
        yield at
        at = haystack.find(needle, at + 1)


def _settled(found: list[tuple]) -> list[tuple]:
    """Of (label, start, end, edits, length) those that give way to none that stays, by place."""
    starts, kept = [], []
    longest = max((x[2] - x[1] for x in found), default=0)
    for x in sorted(found, key=lambda x: (x[3], -x[4], x[1], x[0])):
        near = kept[bisect.bisect_right(starts, x[1] - longest) : bisect.bisect_left(starts, x[2])]
        if not any(y[2] > x[1] and y[4] >= x[4] - MOST for y in near):
            i = bisect.bisect_left(starts, x[1])
            starts.insert(i, x[1])
            kept.insert(i, x)
    return kept


def fuzzy_places(text: str, compiled: tuple) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, edits, notice length) in characters of the joined words, which begin and end with a blank."""
    notices, automaton = compiled
    windows = {(i, max(0, end + 1 - size - at - notices[i][1] - 1)) for end, uses in automaton.iter(text) for i, at, size in uses}
    found = set()
    for i, lo in windows:
        label, k, n, pattern = notices[i]
        m = pattern.search(text, lo, min(len(text), lo + n + 3 * k + 2))
        if m:
            found.add((label, m.start(), m.end(), sum(m.fuzzy_counts), n))
    return _settled(sorted(found))


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def _scanner(phrases: dict[str, str], notices: dict[str, str]):
    def run(batches):
        compiled = _compiled(notices)
        exact = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                starts, base = [], set()
                for phrase, label in exact:
                    for at in _places(joined, phrase):
                        starts.append(at)
                        base.add(label)
                # the number of blanks before a phrase is that of its first word
                places = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), starts).tolist() if starts else []
                fuzzy = fuzzy_places(joined.decode(), compiled) if words else []
                labels = base | {x[0] for x in fuzzy}
                score = 1.0 if base else max((1 - e / n for _, _, _, e, n in fuzzy), default=0.0)
                spans = [dict(zip(("label", "start", "end", "edits"), x)) for x in fuzzy]
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    return run


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of all phrases; score is 1 with an exact phrase, else the best 1 - edits / length of a
    notice, else 0.  spans are characters of the lower-cased words joined by blanks, the leading blank counted.  Null and
    empty texts have no words, bytes that are not UTF-8 count as U+FFFD; repeated rows are scanned each.  An empty table gives no rows.  A text of any length is
    scanned whole, in one row.  Other columns, of whatever names, are ignored.
    """
    d = docs.select("doc_id", valid_text())
    schema = f"doc_id {dict(d.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:long>>"
    return d.mapInArrow(_scanner(phrases, notices), schema)
