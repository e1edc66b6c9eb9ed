"""Quality rules with suffix-array repetition.

Words are maximal runs without ASCII white space. All documents of a slice share one suffix array over word numbers;
numbers differ between documents, so no common prefix leaves a document. It is built by prefix doubling that sorts only
positions whose order is still open, and the rank of every round is kept: adjacent suffixes are compared from the
longest round down, which gives the longest common prefixes without a scan of the text.

The intervals of adjacent suffixes with a common prefix of at least `min_words` words are the maximal repeated
substrings; the occurrence of the longest one at a suffix is as long as the larger of its two neighbouring prefixes, so
the union of all their spans is the union of those. The method drops a document if the spans cover more than
`max_covered` of its words or the longest repeat has more than `max_repeat` words. A base rule comes first (see `judge`).

Memory: a slice holds about `slice_bytes` of text, or one document. No shuffle.
Defined cases: null or blank text has no words and fails the base rule; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_WORDS = 8
MAX_COVERED = 0.5
MAX_REPEAT = 100
SLICE_BYTES = 2_000_000
SYMBOLS = b"#*$%&|<>"
_CONTINUES = bytes(range(0x80, 0xC0))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and, for k = 0, 1, ..., ranks that are equal where 2**k symbols are equal.

    A rank is the place of the first suffix of its group."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = symbols[order][1:] != symbols[order][:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    open_ = order[_tied(new)]
    step = 1
    while len(open_):
        ahead = np.zeros(len(open_), dtype=np.int64)
        inside = open_ + step < n
        ahead[inside] = rank[open_[inside] + step] + 1
        base = rank[open_]
        by = np.argsort(base * (n + 1) + ahead, kind="stable")
        open_, base, ahead = open_[by], base[by], ahead[by]
        head = np.ones(len(open_), dtype=bool)
        head[1:] = base[1:] != base[:-1]
        new = head.copy()
        new[1:] |= ahead[1:] != ahead[:-1]
        at = np.arange(len(open_))
        rank[open_] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        levels.append(rank.astype(np.int32))
        open_ = open_[_tied(new)]
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, levels


def _tied(new: np.ndarray) -> np.ndarray:
    """Which sorted elements share their group with another."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return ~alone


def adjacent_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[k]: the common prefix of the suffixes at places k and k + 1."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        ok = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        for x in (a, b, lcp):
            x[ok] += 1 << k
    return lcp


def repeat_lengths(symbols: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that starts elsewhere too."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    order, levels = suffix_array(symbols)
    lcp = adjacent_prefixes(order, levels)
    both = np.zeros(n, dtype=np.int64)
    both[:-1] = lcp
    both[1:] = np.maximum(both[1:], lcp)
    out = np.empty(n, dtype=np.int64)
    out[order] = both
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered, longest."""
    numbers: list[int] = []
    n_words = np.zeros(len(texts), dtype=np.int64)
    chars, symbols, lines = [], [], []
    for k, text in enumerate(texts):
        own: dict[bytes, int] = {}
        base = len(numbers)
        words = text.split()
        n_words[k] = len(words)
        numbers.extend([base + own.setdefault(w, len(own)) for w in words])
        chars.append(len(text.translate(None, common.SPACE + _CONTINUES)))
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        full = [x for x in text.split(b"\n") if x and not x.isspace()]
        lines.append(len(full) - len(set(full)))
    # numbers of a document start at its first word's place, so they differ from those of the other documents
    n = len(numbers)
    ends = np.cumsum(n_words)
    reps = repeat_lengths(np.asarray(numbers, dtype=np.int64))
    per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[np.concatenate(([0], ends))])
    three = np.flatnonzero(reps >= 3)
    long_ = np.flatnonzero(reps >= min_words)
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, np.searchsorted(ends, long_, side="right"), reps[long_])
    return {
        "n_words": n_words,
        "word_chars": np.asarray(chars, dtype=np.int64),
        "n_symbols": np.asarray(symbols, dtype=np.int64),
        "n_dup_lines": np.asarray(lines, dtype=np.int64),
        "n_repeat_words": per(_covered(three, np.full(len(three), 3), n)),
        "covered": per(_covered(long_, reps[long_], n)),
        "longest": longest,
    }


def judge(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
    slice_bytes: int = SLICE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, the counts, base_failed (under 50 words, or over half of them in repeated 3-word windows), kept, and the
    method's covered_words and longest_repeat."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)]
    fields += [T.StructField(x, T.LongType()) for x in names]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    fields += [T.StructField("covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, slice_bytes):
            m = measure(common.texts(batch), min_words)
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            drop = (m["covered"] > max_covered * m["n_words"]) | (m["longest"] > max_repeat)
            cols = [common.column(batch, "doc_id"), *(pa.array(m[x]) for x in names)]
            cols += [pa.array(failed), pa.array(~failed & ~drop), pa.array(m["covered"]), pa.array(m["longest"])]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidied(run), T.StructType(fields))
