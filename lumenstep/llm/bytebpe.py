"""Byte-level BPE encoding and decoding over a distinct-word shuffle.

Texts are exploded to pre-tokens with their positions; each distinct pre-token of the whole table is encoded once, in
the task that owns its bucket, by merging the adjacent pair of the lowest rank until none is left; ids are joined back
to the blocks and reassembled by position. An owner reads its buckets one after the other and holds the distinct
pre-tokens of one, whose number `blocks.buckets_of` keeps bounded by raising the buckets with the input.

Decoding joins the ids of each distinct pre-token with the token-byte table (one row an id, so bounded by the
vocabulary), `decoded` as a vector take over Arrow arrays, `decode` as a join of the exploded ids of a DataFrame, and
reassembles by position. What a task holds of a block's distinct pre-tokens (ids, bytes, decimal ids) is a few buffers. See `blocks` for the packing: the shuffles carry each distinct pre-token of a block, not each
occurrence, and a very frequent one is one entry for each block.

Defined cases: null is an empty text (0 tokens, digests of the empty string); repeated rows are encoded alike; an empty
table gives an empty result; a very long text is a block of its own; extra columns are ignored unless kept by name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks, common

#: Ids in a batch of results after which it is handed on.
BATCH_IDS = 1_000_000


class Codec:
    """Ranks of one vocabulary file: lines of a base64 token and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        table: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            table[rank] = token
        self.table = pa.array(table, pa.large_binary())  # the token-byte table: row k is the bytes of id k
        self.names = pa.array([b"%d," % k for k in range(size)], pa.large_binary())

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge(piece)

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) > 400:
            return self._merge_long(piece)
        ranks, get = self.ranks, self.ranks.get
        parts = [piece[k : k + 1] for k in range(len(piece))]
        none = 1 << 62
        pairs = [get(parts[k] + parts[k + 1], none) for k in range(len(parts) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            k = pairs.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap, for pieces of many bytes."""
        import heapq

        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # end of the part that begins here; 0: merged away
        before = list(range(-1, n - 1))
        heap = []

        def push(a: int) -> None:
            b = end[a]
            if b < n:
                rank = get(piece[a : end[b]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, end[b]))

        for a in range(n - 1):
            push(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        out, a = [], 0
        while a < n:
            out.append(self.ranks[piece[a : end[a]]])
            a = end[a]
        return tuple(out)

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of rows of ids (row after row, of the sizes): ids join the token-byte table, rows are cut by length."""
        return self.plain(ids, sizes).to_pylist()

    def plain(self, ids: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
        """The same as an array."""
        return _rows_of(self.table, ids, sizes)

    def shown(self, ids: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
        """The decimal ids of rows of ids, a comma after each."""
        return _rows_of(self.names, ids, sizes)


def _rows_of(table: pa.LargeBinaryArray, ids: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """The entries of table at ids, those of a row joined. One buffer for all rows, no object for each."""
    found = table.take(pa.array(ids, pa.int64()))
    if found.null_count:
        raise ValueError("an id is not in the token-byte table")
    _, offsets, data = found.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64, count=len(found) + 1) if len(found) else np.zeros(1, dtype=np.int64)
    cuts = edges[np.concatenate(([0], np.cumsum(sizes)))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), data if len(found) else pa.py_buffer(b"")])


def _joined(rows: pa.LargeBinaryArray, places: pa.Array) -> memoryview:
    """The bytes of the rows at places, one after the other."""
    if not len(places):
        return memoryview(b"")
    _, offsets, data = rows.take(places).buffers()
    return memoryview(data)[: int(np.frombuffer(offsets, dtype=np.int64, count=len(places) + 1)[-1])]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def splitter(pattern: str):
    """text bytes -> its pre-tokens as bytes."""
    compiled: list = []

    def split(text: bytes) -> list[bytes]:
        if not compiled:
            compiled.append(regex.compile(pattern))
        return [x.encode() for x in compiled[0].findall(text.decode())]

    return split


def _packed(docs: DataFrame, columns: list[str], pattern: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    split = splitter(pattern)
    packed = blocks.pack(docs, columns, lambda text: split(text), None, buckets).repartition(buckets // 2, "block")
    return packed, blocks.parts(packed)


def _answers(dictionary: DataFrame, path: str, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = codec(path), None
        known: dict[bytes, tuple[int, ...]] = {}  # the distinct pre-tokens of the bucket at hand
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                ids = []
                for w in blocks.unpack_tokens(data.as_py()):
                    found = known.get(w)
                    if found is None:
                        found = known[w] = own.encode(w)
                    ids.append(found)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((x for row in ids for x in row), np.int64, int(size.sum()))
                out.append(blocks.pickle.dumps((blocks.pack_numbers(size), blocks.pack_numbers(flat))))
            cols = [batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "mark", "answer"])

    owned = dictionary.select("bucket", "block", "tokens", "mark").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return owned.mapInArrow(common.tidied(run), "bucket int, block string, mark binary, answer binary")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes): one row for each token of the vocabulary."""
    ranks = codec(path).ranks
    return spark.createDataFrame([(k, token) for token, k in ranks.items()], "id int, bytes binary")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): the bytes of each row's array of ids, joined with the token-byte table by position. Null and
    empty arrays give empty bytes; an id outside the table raises; repeated rows stay apart."""
    tagged = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.coalesce(ids_col, F.expr("array()")).alias("_ids"))
    places = tagged.select("_row", F.posexplode("_ids").alias("at", "id"))
    known = places.join(F.broadcast(token_table(rows.sparkSession, path)), "id", "left")  # bounded by the vocabulary
    checked = F.coalesce("bytes", F.raise_error(F.lit("an id is not in the token-byte table")).cast("binary"))
    lists = known.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", checked.alias("b")))).alias("parts"))
    flat = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["b"]))
    return tagged.join(lists, "_row", "left").select(id_col, F.coalesce(F.when(F.col("parts").isNotNull(), flat), F.lit(b"")).alias("decoded"))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = (), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns of keep, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256; with_ids adds
    the array ids."""
    columns = list(dict.fromkeys((id_col, *keep)))
    base = docs.select(F.col(text_col).alias("_text"), *columns)
    fields = [T.StructField("doc_id" if c == id_col else c, docs.schema[c].dataType) for c in columns]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    buckets = blocks.buckets_of(docs)
    packed, dictionary = _packed(base, columns, pattern, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, stream, answers in blocks.opened(batches):
            sizes_of, ids_of = [], []
            for data in answers:
                size, found = (blocks.unpack_numbers(x) for x in blocks.pickle.loads(data))
                sizes_of.append(size)
                ids_of.append(found)
            none = np.zeros(0, dtype=np.int64)
            count, flat = (np.concatenate([none, *x]) for x in (sizes_of, ids_of))
            plain, shown = own.plain(flat, count), own.shown(flat, count)
            flat = flat.astype(np.int32)
            first = np.cumsum(count) - count
            at, out, lists, held = 0, [], [], 0
            for row in rows:
                mine = stream[at : at + row[-1]]
                at += row[-1]
                places = pa.array(mine, pa.int64())
                sizes = count[mine]
                size = int(sizes.sum())
                ids_digest = hashlib.sha256(_joined(shown, places)[:-1]).hexdigest()
                out.append([*row[:-1], size, ids_digest, hashlib.sha256(_joined(plain, places)).hexdigest()])
                if with_ids:
                    lists.append(flat[np.repeat(first[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(size)])
                    held += size
                if len(out) == 500 or held >= BATCH_IDS:
                    yield batch_of(out, lists)
                    out, lists, held = [], [], 0
            if out:
                yield batch_of(out, lists)

    def batch_of(out: list[list], lists: list[np.ndarray]) -> pa.RecordBatch:
        cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
        if with_ids:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))))
        return pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return blocks.gather(packed, _answers(dictionary, path, buckets).repartition(buckets // 2, "block")).mapInArrow(common.tidied(run), schema)
