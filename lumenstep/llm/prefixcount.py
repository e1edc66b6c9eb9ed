"""Exact subword token counts at every prefix of a text, by dynamic programming over prefixes.

For a merge-by-score (BPE) vocabulary the encoding of a prefix is the encoding of a shorter prefix plus one last token,
and a token row is the encoding of its text exactly if every two neighbours are: encode(a + b) == [a, b]. So the last
token of each prefix is the one vocabulary token that ends there and fits the last token of the prefix before it, and
count[i] = count[i - len(token)] + its cost. Fitting of a pair is merged once and remembered. Characters outside the
vocabulary cost their UTF-8 bytes (byte fallback).

No token has a space mark after another character, so a text is a row of chunks (space marks, then other characters),
whose counts add up. A chunk is walked once; the count at every one of its prefixes is stored, so the count at a prefix
of a text is the sum of the chunks before it plus one stored value. Chunks in sorted order continue from the prefix they
share with the one before. `count`, `prefix_counts` and `longest_prefix` only read these tables. `prefix_table` stores
the counts at every prefix of every text as a column, and `truncate` and `fits` answer budgets from that column alone.

Memory: stored chunks are dropped when their tables reach a fixed number of bytes, pairs at a fixed number (a pair is two
vocabulary tokens, so of bounded length); results don't depend on it. No shuffle.
Defined cases: null is empty, 0 bytes and 0 tokens, one prefix; very long texts are counted whole; repeated rows count
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE_MARK = "▁"
LIMIT = 4096
TABLE_BYTES = 200_000_000
PAIRS_KEPT = 1_000_000
_CHUNK = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}\n]*|\n[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+")


class PrefixCounter:
    """Counts for one sentencepiece BPE model file with identity normalization, dummy prefix and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        pieces = [p for p in model.pieces if p.type == 1]
        if spec.model_type != 2 or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalization and dummy prefix is needed")
        if len(pieces) + sum(p.type in (2, 3, 6) for p in model.pieces) != len(model.pieces) or not spec.byte_fallback:
            raise ValueError("a model with byte fallback and without user-defined pieces is needed")
        if any(SPACE_MARK in p.piece.lstrip(SPACE_MARK) or "\n" in p.piece for p in pieces):
            raise ValueError("a piece spans words or lines")
        self.score = {p.piece: p.score for p in pieces}
        # by its last two characters, the lengths that a token can have
        tails: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 1:
                tails.setdefault(piece[-2:], set()).add(len(piece))
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}  # count of a chunk
        self.tables: dict[str, bytes] = {}  # counts at its prefixes, as numbers of four bytes, or one where they are small
        self.held = 0
        self.word, self.last, self.counts = "", [""], [0]

    def merge(self, text: str) -> list[str]:
        """Plain merging: the pair of the best score, leftmost first, until none is in the vocabulary."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def walk(self, chunk: str) -> list[int]:
        """The counts of all prefixes of a chunk; continues from the prefix shared with the chunk walked before."""
        start, most, word = 0, min(len(self.word), len(chunk)), self.word
        while start < most and word[start] == chunk[start]:
            start += 1
        last, counts = self.last, self.counts
        del last[start + 1 :], counts[start + 1 :]
        score, fits, tails = self.score, self.fits, self.tails
        for end in range(start + 1, len(chunk) + 1):
            for size in (*tails.get(chunk[end - 2 : end], ()), 1) if end > 1 else (1,):
                begin = end - size
                token = chunk[begin:end]
                if size > 1 and (begin < 0 or token not in score):
                    continue
                before = last[begin]
                if before:
                    pair = (before, token)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= PAIRS_KEPT:
                            fits.clear()
                        ok = fits[pair] = self.merge(before + token) == [before, token]
                else:
                    pair = ("", token)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = size == 1 or self.merge(token) == [token]
                if ok:
                    last.append(token)
                    counts.append(counts[begin] + (1 if token in score else len(token.encode())))
                    break
            else:
                raise AssertionError("no token fits")
        self.word = chunk
        return counts

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or " \n" in text or text[0] == " " or text[-1] == " " or text[0] == "\n" or SPACE_MARK in text:
            return _CHUNK.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
        return [x if x[0] == "\n" else SPACE_MARK + x for x in text.replace("\n", " \n").split(" ")]

    def learn(self, chunks: set[str]) -> None:
        """Walk the chunks that aren't known, in order."""
        known, tables = self.known, self.tables
        if self.held > TABLE_BYTES:
            known.clear()
            tables.clear()
            self.held = 0
        for chunk in sorted(chunks if not known else chunks.difference(known)):
            counts = self.walk(chunk)
            known[chunk] = counts[-1]
            table = tables[chunk] = bytes(counts) if counts[-1] < 256 else array("I", counts).tobytes()
            self.held += len(table) + 4 * len(chunk) + 200  # with what the entries themselves take

    def stored(self, chunk: str) -> memoryview:
        """The stored counts of all prefixes of a learned chunk."""
        table = memoryview(self.tables[chunk])
        return table if len(table) == len(chunk) + 1 else table.cast("I")

    def count_all(self, texts: list[str]) -> list[int]:
        rows = [self.chunks(t) for t in texts]
        self.learn(set().union(*rows))
        get = self.known.__getitem__
        return [sum(map(get, row)) for row in rows]

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def prefix_counts(self, text: str) -> list[int]:
        """counts[i] is the exact number of tokens of text[:i]."""
        row = self.chunks(text)
        self.learn(set(row))
        out, base = [0], 0
        for k, chunk in enumerate(row):
            counts = self.stored(chunk).tolist()
            out += [base + c for c in counts[1 + (k == 0) :]]
            base += counts[-1]
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        row = self.chunks(text)
        self.learn(set(row))
        base = at = 0
        starts = []
        for chunk in row:
            starts.append((base, at))
            base += self.known[chunk]
            at += len(chunk)
        if base <= budget:
            return len(text)
        # every started chunk has a token at least, so the last chunk that can begin within the budget holds the cut
        for k in range(len(row) - 1, -1, -1):
            base, at = starts[k]
            if base < budget:
                counts = self.stored(row[k])
                for i in range(len(row[k]), 0, -1):
                    if base + counts[i] <= budget:
                        return at + i - 1  # without the dummy prefix
        return 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a process and model."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, slice_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix within the limit)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
            T.StructField("fit_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in common.slices(batches, slice_bytes):
            raw = common.texts(batch)
            texts = [x.decode() for x in raw]
            counts = own.count_all(texts)
            fit = [len(t) if n <= limit else own.longest_prefix(t, limit) for t, n in zip(texts, counts, strict=True)]
            cols = [common.column(batch, "doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(counts, pa.int64())]
            cols += [pa.array([n > limit for n in counts]), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidied(run), schema)


def prefix_table(docs: DataFrame, model_path: str, slice_bytes: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, prefix_tokens): element k (from 0) of prefix_tokens is the exact token count of the text's first k
    characters. To be written once; `truncate` and `fits` read it."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([*base.schema.fields, T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in common.slices(batches, slice_bytes):
            tables = [own.prefix_counts(x.decode()) for x in common.texts(batch)]
            cols = [common.column(batch, "doc_id"), common.column(batch, "text"), pa.array(tables, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return base.mapInArrow(common.tidied(run), schema)


def truncate(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text): each text cut to its longest prefix of at most `budget` tokens; nothing is encoded."""
    allowed = F.array_max(F.transform("prefix_tokens", lambda n, k: F.when(n <= budget, k).otherwise(F.lit(0))))
    return table.select("doc_id", F.expr("text").substr(F.lit(1), allowed).alias("text"))


def fits(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_tokens, fits): the whole text's count, and whether it is within the budget."""
    total = F.element_at("prefix_tokens", -1)
    return table.select("doc_id", total.cast("long").alias("n_tokens"), (total <= budget).alias("fits"))
