"""Benchmark decontamination: BM25 over an inverted index of the test items, block-max WAND, and an overlap check.

Items are the indexed side: postings of (item, impact) in item order, in blocks with their largest impact. An impact is
the BM25 weight of a term in the item divided by the item's score for its own text, so scores run from 0 to 1 for every
item and one threshold serves all. Every training document is cut into passages of two strides of words that overlap by
one stride; the stride is no shorter than the longest item, so an item that occurs whole lies whole in some passage.
Each passage is a query (the set of its words): block-max WAND returns all items at or above the threshold. Blocks are
fixed ranges of items, which are in order of length so that impacts within a block are alike. The block test, whether
the block maxima of the passage's terms reach the threshold, is one vector step for all passages of a slice; the pivot
walk then runs in the blocks that pass it.

Retrieved pairs are verified: the question and the answer of the item must each have `overlap` of their five-word
shingles in the passage (a shorter part: the whole part as one shingle). An item without an answer column is split after
its first question mark or first line, else in the middle.

Size: items are indexed in blocks of about `block_bytes` of text, each block is one pass over the documents with its
items in the closure, so a task never holds more than a block. Document frequencies, the number of items, their mean and
greatest length are counted once over all items, so scores and results don't depend on the blocks. No shuffle of
documents, no collection of them.
Defined cases: null or wordless documents and items match nothing; repeated rows match alike; equal items are all
returned; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP = 0.8
STRIDE = 64
ITEM_BLOCK = 8
SLICE_BYTES = 2_000_000
BLOCK_BYTES = 8_000_000
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8."""
    return text.lower().encode().translate(_TO_SPACE).split()


def parts_of(text: str, answer: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Question words and answer words of an item."""
    if answer is not None:
        return words_of(text), words_of(answer)
    for mark in ("?", "\n"):
        head, found, tail = text.partition(mark)
        if found and words_of(head) and words_of(tail):
            return words_of(head), words_of(tail)
    words = words_of(text)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


class Stats(NamedTuple):
    """Of all items: their number, mean and greatest length in words, and (word, items that hold it)."""

    items: int
    mean: float
    longest: int
    df: tuple[tuple[bytes, int], ...]


class Index:
    """Inverted index of items [(id, text, answer or None)]; stats: of all items, where these are a block of them."""

    def __init__(self, items: list[tuple], stats: Stats | None = None):
        parts = [parts_of(text, answer) for _, text, answer in items]
        kept = sorted((k for k, p in enumerate(parts) if p[0] or p[1]), key=lambda k: len(parts[k][0] + parts[k][1]))
        self.ids = [items[k][0] for k in kept]
        self.parts = [parts[k] for k in kept]
        words = [q + a for q, a in self.parts]
        if stats is None:
            df = Counter(w for ws in words for w in set(ws))
            stats = Stats(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), tuple(df.items()))
        self.longest, mean, n = stats.longest, stats.mean, len(words)
        idf = {w: math.log(1 + (stats.items - d + 0.5) / (d + 0.5)) for w, d in stats.df}
        self.term = {w: k for k, w in enumerate(sorted(idf))}
        rows = defaultdict(list)
        for item, ws in enumerate(words):
            norm = K1 * (1 - B + B * len(ws) / mean)
            weight = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(ws).items()}
            own = sum(weight.values())
            for w, x in weight.items():
                rows[self.term[w]].append((item, x / own))
        self.items = [[i for i, _ in rows[t]] for t in range(len(self.term))]
        self.impacts = [[x for _, x in rows[t]] for t in range(len(self.term))]
        self.most = [max(x) for x in self.impacts]
        # block postings of term t: places first[t] to first[t + 1] of (block, largest impact)
        tops = [sorted(self._tops(rows[t]).items()) for t in range(len(self.term))]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in tops]))).astype(np.int64)
        self.block = np.array([k for x in tops for k, _ in x], dtype=np.int64)
        self.top = np.array([v for x in tops for _, v in x])
        self.blocks = -(-n // ITEM_BLOCK)
        self._shingles: dict[int, tuple[set[bytes], set[bytes]]] = {}

    @staticmethod
    def _tops(row: list[tuple[int, float]]) -> dict[int, float]:
        out: dict[int, float] = {}
        for item, x in row:
            out[item // ITEM_BLOCK] = max(x, out.get(item // ITEM_BLOCK, 0.0))
        return out

    def search(self, terms: list[int], threshold: float, block: int) -> list[tuple[int, float]]:
        """All (item, score) of a block with score >= threshold for a set of terms, by the pivot walk."""
        threshold -= 1e-9
        low, high = block * ITEM_BLOCK, (block + 1) * ITEM_BLOCK
        found, lists = [], []  # current item, its place, term, largest impact of the term in the block
        for t in terms:
            at = bisect_left(self.items[t], low)
            if at < len(self.items[t]) and self.items[t][at] < high:
                k = self.first[t] + np.searchsorted(self.block[self.first[t] : self.first[t + 1]], block)
                lists.append([self.items[t][at], at, t, self.top[k]])
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, _, _, top) in enumerate(lists):
                total += top
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            if lists[0][0] == item:
                score = sum(self.impacts[t][at] for i, at, t, _ in lists if i == item)
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            moved = []
            for i, at, t, top in lists:
                if i < target:
                    at = bisect_left(self.items[t], target, at)
                    if at == len(self.items[t]) or self.items[t][at] >= high:
                        continue
                    i = self.items[t][at]
                moved.append([i, at, t, top])
            lists = moved
        return found

    def overlaps(self, item: int, passage: set[bytes]) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles in the passage; 1 for an empty part."""
        if item not in self._shingles:
            self._shingles[item] = tuple(shingles(p) for p in self.parts[item])
        return tuple(sum(map(self.has, repeat(passage), s)) / len(s) if s else 1.0 for s in self._shingles[item])

    @staticmethod
    def has(passage: set[bytes], shingle: bytes) -> bool:
        return shingle in passage

    def matches(self, texts: list[str], threshold: float, overlap: float, stride: int) -> list[dict[int, tuple[float, float, float]]]:
        """Of each text: item -> (score, question overlap, answer overlap) of its best verified passage."""
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        stride = max(stride, self.longest)
        rows = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        get = self.term.get
        ids = np.fromiter((get(w, -1) for r in rows for w in r), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passages = np.maximum(1, -(-(sizes - stride) // stride))
        base = np.cumsum(passages) - passages
        known = ids >= 0
        ids, doc, part = ids[known], doc[known], (place // stride)[known]
        # a word is in the passage that begins with its stride and in the one before
        keys = [(base[doc] + part - d)[ok] * len(self.term) + ids[ok] for d in (0, 1) for ok in ((part >= d) & (part - d < passages[doc]),)]
        pairs = np.unique(np.concatenate(keys))
        passage, term = np.divmod(pairs, max(1, len(self.term)))
        for p, block in self.open_blocks(passage, term, threshold, int(passages.sum())):
            k = int(np.searchsorted(base, p, side="right")) - 1
            at = (p - int(base[k])) * stride
            terms = term[np.searchsorted(passage, p) : np.searchsorted(passage, p, side="right")].tolist()
            hits = self.search(terms, threshold, block)
            if not hits:
                continue
            own = rows[k][at : at + 2 * stride]
            grams = {b" ".join(own[i : i + n]) for n in self.lengths() for i in range(len(own) - n + 1)}
            for item, score in hits:
                q, r = self.overlaps(item, grams)
                if q >= overlap and r >= overlap and (item not in found[k] or found[k][item][0] < score):
                    found[k][item] = (score, q, r)
        return found

    def open_blocks(self, passage: np.ndarray, term: np.ndarray, threshold: float, passages: int) -> Iterator[tuple[int, int]]:
        """(passage, block) whose block maxima of the passage's terms reach the threshold."""
        most = max(1, 4_000_000 // max(1, self.blocks))
        for low in range(0, passages, most):
            a, b = np.searchsorted(passage, [low, low + most])
            sums = np.zeros(min(most, passages - low) * self.blocks)
            for c in range(a, b, 200_000):
                p, t = passage[c : min(b, c + 200_000)] - low, term[c : min(b, c + 200_000)]
                n = self.first[t + 1] - self.first[t]
                at = np.repeat(self.first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                sums += np.bincount(np.repeat(p, n) * self.blocks + self.block[at], self.top[at], len(sums))
            for x in np.flatnonzero(sums >= threshold - 1e-6).tolist():
                yield low + x // self.blocks, x % self.blocks

    def lengths(self) -> list[int]:
        """Shingle lengths that occur: five, and those of shorter parts."""
        if not hasattr(self, "_lengths"):
            self._lengths = sorted({min(SHINGLE, len(p)) for q in self.parts for p in q if p})
        return self._lengths


_indexes: dict[tuple, Index] = {}


def index_of(items: tuple, stats: Stats) -> Index:
    """The index of a block, built once a process; only the last one is kept."""
    if (items, stats) not in _indexes:
        _indexes.clear()
        _indexes[items, stats] = Index(list(items), stats)
    return _indexes[items, stats]


def _blocks(items: DataFrame, block_bytes: int, item_col: str, item_text: str, answer_col: str | None) -> Iterator[tuple[tuple, Stats]]:
    """The blocks of items (item_id, text, answer), each with the statistics of all items for its words."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    base = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"), answer.alias("answer")).where(F.col("text").isNotNull())
    size = base.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)) + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    if not blocks:
        return

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, text, given in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = [w for part in parts_of(text, given) for w in part]
                own = sorted(set(words))
                if own:  # the first row of an item carries its length
                    lengths = [len(words)] + [None] * (len(own) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.binary()), pa.array(lengths, pa.int64())], ["block", "word", "n"])

    block_of = F.pmod(F.xxhash64("text"), F.lit(blocks))
    base = base.withColumn("block", block_of)
    rows = base.select("block", "text", "answer").mapInArrow(common.tidied(counted), "block long, word binary, n long")
    by_word = rows.groupBy("word").agg(F.count("*").alias("df"), F.collect_set("block").alias("blocks"), F.count("n").alias("items"), F.sum("n").alias("sum"), F.max("n").alias("longest"))
    by_word = common.cut(by_word)
    total = by_word.agg(F.sum("items"), F.sum("sum"), F.max("longest")).first()
    n, mean, longest = total[0] or 0, (total[1] or 0) / max(1, total[0] or 0), total[2] or 0
    for k in range(blocks):
        block = tuple(sorted((tuple(r) for r in base.where(F.col("block") == k).drop("block").collect()), key=repr))
        df = by_word.where(F.array_contains("blocks", k)).select("word", "df").collect()
        yield block, Stats(n, mean, longest, tuple(sorted((bytes(r["word"]), r["df"]) for r in df)))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, stride: int = STRIDE, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, that hold no item; each block of items is one pass without a shuffle."""
    for block, stats in _blocks(items, block_bytes, item_col, item_text, answer_col):

        def run(batches: Iterator[pa.RecordBatch], block=block, stats=stats) -> Iterator[pa.RecordBatch]:
            index = index_of(block, stats)
            for batch in common.slices(batches, SLICE_BYTES, text_col):
                found = index.matches([x.decode() for x in common.texts(batch, text_col)], threshold, overlap, stride)
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(common.tidied(run), docs.schema)
    return docs


def find(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    overlap: float = OVERLAP,
    stride: int = STRIDE,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    answer_col: str | None = None,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each verified pair."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_col].dataType)]
        + [T.StructField(x, T.DoubleType()) for x in ("score", "question_overlap", "answer_overlap")]
    )
    to_arrow = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block, stats in _blocks(items, block_bytes, item_col, item_text, answer_col):

        def run(batches: Iterator[pa.RecordBatch], block=block, stats=stats) -> Iterator[pa.RecordBatch]:
            index = index_of(block, stats)
            for batch in common.slices(batches, SLICE_BYTES):
                rows, found = [], []
                for row, hits in enumerate(index.matches([x.decode() for x in common.texts(batch)], threshold, overlap, stride)):
                    for item, values in hits.items():
                        rows.append(row)
                        found.append((index.ids[item], *values))
                if rows:
                    cols = [common.column(batch, "doc_id").take(pa.array(rows))]
                    cols += [pa.array(x, type=f) for x, f in zip(zip(*found, strict=True), to_arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

        found = texts.mapInArrow(common.tidied(run), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out
