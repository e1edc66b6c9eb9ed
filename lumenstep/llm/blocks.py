"""A distinct-word shuffle: documents are exploded to tokens with positions, every distinct token is looked up once in
the task that owns it, and the answers come back to the documents.

Rows are packed so that the shuffles stay small. Documents are gathered in blocks of bounded text. A block's token
stream (in document and position order) is an array of numbers into the block's own dictionary, more frequent tokens
first; the dictionary is dealt over `buckets` by a hash of the token, sorted within each. One packed row is a block;
one (bucket, block) row carries that bucket's part of a block's dictionary to the task that owns the bucket. A token in
every document is one entry for each block, so hot tokens are pre-aggregated where they are read. Buckets and gather
tasks grow with the input's bytes.

Recovery: each bucket's part of a dictionary has a mark, the XXH64 of its sorted tokens, kept in the block's row and in
the answer to the part. A block that is packed again from a re-ordered input has other marks than the answers to its
first packing, and the task that opens it raises instead of joining answers to the wrong tokens.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 12_000_000
#: Bytes of input (as stored) for each gather task and bucket, where that gives more than the session's partitions.
TASK_BYTES = 8_000_000


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**32, as byte planes."""
    return squeeze(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_tokens(tokens: list[bytes]) -> bytes:
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return pickle.dumps((pack_numbers(size), squeeze(b"".join(tokens))))


def unpack_tokens(data: bytes) -> list[bytes]:
    size, flat = pickle.loads(data)
    flat, ends = unsqueeze(flat), np.cumsum(unpack_numbers(size)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def bucket_of(token: bytes, buckets: int) -> int:
    return zlib.crc32(token) % buckets


def mark_of(words: list[bytes]) -> bytes:
    """A digest of a sorted list of tokens."""
    mark = xxhash.xxh64()
    for w in words:
        mark.update(len(w).to_bytes(4, "big") + w)
    return mark.digest()


class Block:
    """Gathers documents; `pack` gives the row's bytes."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.stream = array("I")
        self.counted = array("I")
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, tokens: list[bytes], counted: bool, size: int) -> None:
        numbers = self.numbers
        new = [numbers.setdefault(w, len(numbers)) for w in tokens]
        self.stream.extend(new)
        self.rows.append((*row, len(new)))
        if counted:
            self.counted.extend(new)
        self.bytes += size

    def pack(self, buckets: int) -> tuple[bytes, bytes]:
        """What the block keeps, and its dictionary by bucket."""
        n = len(self.numbers)
        stream = np.array(self.stream, dtype=np.int64)
        count = np.bincount(np.array(self.counted, dtype=np.int64), minlength=n)
        place = np.empty(n, dtype=np.int64)
        place[np.argsort(-np.bincount(stream, minlength=n), kind="stable")] = np.arange(n)
        parts: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
        for w, k in self.numbers.items():
            parts[zlib.crc32(w) % buckets].append((w, k))
        dictionary, order = {}, []
        for k, part in enumerate(parts):
            if part:
                part.sort()
                own = np.array([i for _, i in part], dtype=np.int64)
                words = [w for w, _ in part]
                dictionary[k] = (pack_tokens(words), pack_numbers(count[own]), mark_of(words))
                order.append(place[own])
        order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        kept = {"rows": self.rows, "n": n, "stream": pack_numbers(place[stream]), "order": pack_numbers(order), "marks": {k: d[2] for k, d in dictionary.items()}}
        return pickle.dumps(kept), pickle.dumps(dictionary)


def pack(docs: DataFrame, columns: list[str], tokens_of: Callable[[bytes], list[bytes]], counted_col: str | None, buckets: int, block_bytes: int = BLOCK_BYTES, split: bool = False) -> DataFrame:
    """(block, pack): docs with `_text` gathered in blocks; `columns` are carried in the pack. With split the dictionary
    is a column of its own (for a table that is read once for each); without it both readers share one exchange."""
    fields = ["block", "pack", "dictionary"] if split else ["block", "pack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, block = TaskContext.get().partitionId(), 0, Block()

        def flush() -> pa.RecordBatch:
            both = block.pack(buckets)
            cols = both if split else (pickle.dumps(both),)
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{k}"]), *(pa.array([x], pa.binary()) for x in cols)], fields)

        for batch in batches:
            names = batch.schema.names
            carried = [batch.column(names.index(c)).to_pylist() for c in columns]
            counted = batch.column(names.index(counted_col)).to_pylist() if counted_col else None
            texts = batch.column(names.index("_text")).cast(pa.binary())
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                if block.rows and block.bytes + len(text) > block_bytes:
                    yield flush()
                    k, block = k + 1, Block()
                block.add(tuple(c[i] for c in carried), tokens_of(text), bool(counted and counted[i]), len(text))
        if block.rows:
            yield flush()

    return docs.mapInArrow(common.tidied(run), "block string, pack binary" + ", dictionary binary" * split)


def parts(packed: DataFrame) -> DataFrame:
    """(bucket, block, tokens, counts, mark): the dictionary rows of packed blocks."""
    split = "dictionary" in packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = pickle.loads(data.as_py() if split else pickle.loads(data.as_py())[1])
                if found:
                    cols = [pa.array(list(found), pa.int32()), pa.array([block] * len(found))]
                    cols += [pa.array(x, pa.binary()) for x in zip(*found.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "tokens", "counts", "mark"])

    return packed.select("block", "dictionary" if split else "pack").mapInArrow(common.tidied(run), "bucket int, block string, tokens binary, counts binary, mark binary")


def gather(packed: DataFrame, answers: DataFrame, partitions: int | None = None) -> DataFrame:
    """(block, pack, answers): each block with its (bucket, mark, answer) list; answers: (bucket, block, mark, answer)."""
    if partitions:  # more and smaller tasks than the session's number
        packed, answers = packed.repartition(partitions, "block"), answers.repartition(partitions, "block")
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "mark", "answer")).alias("answers"))
    return packed.join(lists, "block", "left").select("block", "pack", "answers")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray, list[bytes]]]:
    """Of each gathered block: rows (the carried values and the number of tokens), the stream as places in the order of
    the answers, and the answers by bucket. Raises if the answers don't fit the block."""
    for batch in batches:
        for data, found in zip(batch.column(1), batch.column(2), strict=True):
            block = pickle.loads(data.as_py())
            block = pickle.loads(block[0]) if isinstance(block, tuple) else block
            got = {r["bucket"]: r["answer"] for r in (found.as_py() or [])}
            if {r["bucket"]: r["mark"] for r in (found.as_py() or [])} != block["marks"]:
                raise RuntimeError("a block was packed again in another way: its input isn't deterministic")
            order = unpack_numbers(block["order"])
            back = np.empty(block["n"], dtype=np.int64)
            back[order] = np.arange(block["n"])
            yield block["rows"], back[unpack_numbers(block["stream"])], [got[k] for k in sorted(got)]


def buckets_of(df: DataFrame) -> int:
    return 2 * tasks_of(df)


def tasks_of(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for df's bytes by the optimizer's estimate, at least the session's shuffle partitions; an input of unknown
    size (such as a checkpoint) takes those."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // task_bytes))
