"""Language-model scoring: the marginal probability of a document over all subword segmentations, and a word baseline.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per document. Training rows are those whose
crc32(id as text) mod 5 is not 1. Everything learned covers all of them:

* word counts: the distinct-word shuffle of `blocks`; each bucket's owner sums the counts of its words over all blocks;
* piece scores: an existing subword vocabulary, whose pieces get log probabilities from the training words (each
  distinct word's own segmentation, weighted by its count, half a count added to every piece). The installed vocabulary
  carries merge ranks and no probabilities of its own. The table is bounded by the vocabulary.

A word's probability sums over every segmentation of it into pieces: the forward recursion over the lattice of its
prefixes in log space, once for each distinct word; a character outside the vocabulary takes its byte pieces. A document
is its words and the end: score = sum of log10 P(word) + log10 P(end).
Baseline: sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))).

Defined cases: null is an empty text, one end token; null ids are not held out; no training row at all gives uniform
scores; repeated rows score alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks, common
from .crossparse import held_out

FOLDS = 5
BLOCK_BYTES = 6_000_000
REDUCERS = 8
SPACE_MARK = "▁"


class Vocabulary:
    """Pieces of a sentencepiece model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pieces = {self.model.id_to_piece(k): k for k in range(self.size) if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k))}
        self.longest = max(map(len, self.pieces))

    def count(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, dtype=np.int64)
        for k in range(0, len(words), 10_000):
            part = self.model.encode([w.decode() for w in words[k : k + 10_000]], num_threads=1)
            size = np.fromiter(map(len, part), np.int64, len(part))
            ids = np.fromiter((x for row in part for x in row), np.int64, int(size.sum()))
            np.add.at(out, ids, np.repeat(counts[k : k + 10_000], size))
        return out

    def forward(self, word: str, table: dict[str, float], byte_scores: list[float]) -> float:
        """Natural log of the sum over all segmentations of the space mark and the word."""
        text = SPACE_MARK + word
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            terms = []
            for begin in range(max(0, end - self.longest), end):
                score = table.get(text[begin:end])
                if score is not None:
                    terms.append(alpha[begin] + score)
            if text[end - 1] not in table:
                terms.append(alpha[end - 1] + sum(byte_scores[b] for b in text[end - 1].encode()))
            top = max(terms)
            alpha.append(top if len(terms) == 1 else top + math.log(sum(math.exp(x - top) for x in terms)))
        return alpha[-1]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(common.LOWER_BYTES).split()


def _pack_floats(x: np.ndarray) -> bytes:
    return blocks.squeeze(x.astype("<f8").tobytes())


def _unpack_floats(data: bytes) -> np.ndarray:
    return np.frombuffer(blocks.unsqueeze(data), dtype="<f8")


def merge_buckets(dictionary: DataFrame, buckets: int, path: str) -> DataFrame:
    """One row a bucket: its distinct words with their counts over all blocks, sums, and the counts of their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, dict[bytes, int]] = {}
        for batch in batches:
            for bucket, tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = total.setdefault(bucket, {})
                for w, c in zip(blocks.unpack_tokens(tokens.as_py()), blocks.unpack_numbers(counts.as_py()).tolist(), strict=True):
                    own[w] = own.get(w, 0) + c
        names = ["bucket", "tokens", "counts", "n", "v", "pieces"]
        for bucket in sorted(total):
            own = total.pop(bucket)
            words = sorted(own)
            counts = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
            known = np.flatnonzero(counts)
            pieces = vocabulary(path).count([words[k] for k in known], counts[known])
            values = [bucket, blocks.pack_tokens(words), blocks.squeeze(counts.astype("<i8").tobytes()), int(counts.sum()), len(known), blocks.squeeze(pieces.astype("<i8").tobytes())]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    schema = "bucket int, tokens binary, counts binary, n long, v long, pieces binary"
    return dictionary.select("bucket", "tokens", "counts").repartition(buckets, "bucket").mapInArrow(common.tidied(run), schema)


def piece_counts(merged: DataFrame, size: int) -> np.ndarray:
    """The buckets' piece counts added up: packed vectors meet in a few tasks, one vector of each comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(blocks.unsqueeze(data.as_py()), dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["pieces"])

    rows = merged.select("pieces").repartition(REDUCERS).mapInArrow(common.tidied(run), "pieces binary").collect()
    return sum((np.frombuffer(r["pieces"], dtype=np.int64) for r in rows), np.zeros(size, dtype=np.int64))


def _answers(dictionary: DataFrame, merged: DataFrame, buckets: int, path: str, scores: np.ndarray) -> DataFrame:
    """(bucket, block, mark, answer): counts and log10 probabilities of each dictionary row's words, in order.

    A bucket's merged words are scored in its task and come before the rows that ask for them."""
    asked = dictionary.select("bucket", F.lit(1).alias("kind"), "block", "tokens", F.lit(None).cast("binary").alias("counts"), "mark")
    known = merged.select("bucket", F.lit(0).alias("kind"), F.lit("").alias("block"), "tokens", "counts", F.lit(None).cast("binary").alias("mark"))
    rows = known.unionByName(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        table = {p: float(scores[k]) for p, k in own.pieces.items()}
        byte_scores = [float(scores[k]) for k in own.bytes]
        place: dict[bytes, int] = {}
        counts = logs = np.zeros(0)
        for batch in batches:
            out: list[tuple] = []
            for bucket, kind, block, tokens, own_counts, mark in zip(*(batch.column(k) for k in range(6)), strict=True):
                words = blocks.unpack_tokens(tokens.as_py())
                if kind.as_py() == 0:
                    place = {w: k for k, w in enumerate(words)}
                    counts = np.frombuffer(blocks.unsqueeze(own_counts.as_py()), dtype="<i8")
                    logs = np.array([own.forward(w.decode(), table, byte_scores) for w in words]) / math.log(10)
                else:
                    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                    answer = pickle.dumps((blocks.squeeze(counts[at].tobytes()), _pack_floats(logs[at])))
                    out.append((bucket.as_py(), block.as_py(), mark.as_py(), answer))
            if out:
                cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "mark", "answer"])

    return rows.mapInArrow(common.tidied(run), "bucket int, block string, mark binary, answer binary")


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    buckets = blocks.buckets_of(docs)
    out = held_out(F.col(id_col), FOLDS)
    base = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), out.alias("held_out"), (~out).alias("_train"))
    packed = common.written(blocks.pack(base, ["doc_id", "held_out"], lambda text: words_of(text), "_train", buckets, BLOCK_BYTES, split=True), "lm-blocks")
    dictionary = blocks.parts(packed)
    merged = common.written(merge_buckets(dictionary, buckets, path), "lm-words")
    ends = base.where("_train").count()
    n, v = merged.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    counts = piece_counts(merged, vocabulary(path).size)
    whole = counts.sum() + ends + 0.5 * (len(counts) + 1)
    scores = np.log((counts + 0.5) / whole)
    end_log = math.log10((ends + 0.5) / whole)
    end_base = math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    answers = _answers(dictionary, merged, buckets, path, scores)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, stream, found in blocks.opened(batches):
            both = [pickle.loads(x) for x in found]
            c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(blocks.unsqueeze(x), dtype="<i8") for x, _ in both)])
            logs = np.concatenate([np.zeros(0), *(_unpack_floats(x) for _, x in both)])
            words = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            at, done = 0, []
            for doc_id, held, size in rows:
                mine = stream[at : at + size]
                at += size
                known = int((c[mine] > 0).sum()) + (ends > 0)
                done.append((doc_id, held, size + 1, known, n, float(words[mine].sum()) + end_base, float(logs[mine].sum()) + end_log))
            for k in range(0, len(done), 5000):
                cols = [pa.array(list(col), kind) for col, kind in zip(zip(*done[k : k + 5000], strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return blocks.gather(packed.select("block", "pack"), answers, 2 * buckets).mapInArrow(common.tidied(run), schema)
