"""Suffix-array deduplication: removes every byte covered by a `length`-byte string that starts anywhere else too.

Texts are UTF-8 bytes; matches stay within documents and are judged on the input. Every window of `length` bytes has an
anchor: the k-gram in it with the smallest hash (leftmost on ties). The anchor depends on the window's bytes alone, so
equal windows have equal anchors at equal offsets, and only suffixes at anchors need sorting, about two in `length`.
The windows of an anchor are a range of starts; their bytes are its context.

1. Anchors with their k-gram hash (class) and context digest are written once. Classes that occur once are done.
2. Equal contexts are one row with a count (combined before the shuffle); one that occurs twice is repeated in full.
3. The contexts of a class are ordered: right sides (from the anchor on) and reversed left sides are sorted by
   deep-shallow sorting (multikey quicksort to a shallow depth, blind tries below), and the longest-common-prefix
   intervals of the right sides, with the neighbours by left side in each, give the exact starts whose window occurs
   elsewhere.
4. A class of more than `most_contexts` contexts, as around a passage in a third of all documents, is split by longer
   keys before it is sorted: its windows are dealt by offset from the anchor in eight ranges. All windows of a range
   share their middle, so only contexts with an equal middle meet, each reduced to the bytes of its range, equal ones
   again one row with a count. A group that is still too large is split again in the same way; a range of one offset
   leaves nothing but the window, so the splitting ends and no window is decided in another way.
5. Starts come back to the texts that hold the context, and covered bytes are cut out.

Decisions belong to distinct texts (by SHA-256), so copies are one row in every grouping; hot keys occur in joins of
narrow rows only, where AQE splits them. Texts are shuffled once, combined by key: both joins with distinct texts read
the same exchange (the key is never null, so neither join adds a filter below it).

Defined cases: null is an empty text; texts shorter than `length` stay whole; very long texts go piece by piece;
repeated rows count as occurrences of each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, deepshallow

LENGTH = 400
GRAM = 32
SORTED_TOGETHER = 256  # contexts that one sort takes; larger groups are split by longer keys first
SPLIT = 8
SLICE_BYTES = 2_000_000
_BITS = 22  # of a place in a slice, in the packed (hash, place) order


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each place (length - 31 values)."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    n = len(data) - GRAM + 1
    out = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        out ^= x[8 * k : 8 * k + n] * np.uint64(c)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor, hash of its k-gram) of the windows of documents that lie at
    [starts, ends) of data."""
    n = len(data)
    width = length - GRAM + 1
    none = (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    if n < length or not np.any(ends - starts >= length):
        return none
    hashes = gram_hashes(np.frombuffer(data, dtype=np.uint8))
    mask = np.uint64((1 << _BITS) - 1)
    packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    pad = -len(packed) % width
    whole = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(whole, axis=1).ravel()
    back = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & mask).astype(np.int64)
    own = np.zeros(n + 1, dtype=np.int64)
    held = ends - starts >= length
    np.add.at(own, starts[held], 1)
    np.add.at(own, ends[held] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(own)[:windows] > 0)
    first = np.ones(len(at), dtype=bool)
    first[1:] = (anchor[at][1:] != anchor[at][:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(first)
    tail = np.concatenate([head[1:], [len(at)]]) - 1
    low, high, place = at[head], at[tail], anchor[at[head]]
    return low, high, place, hashes[place]


def _entries(text: bytes, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first start, last start, anchor, class, context digest) of one text; long texts go piece by piece."""
    piece = (1 << _BITS) - length
    for base in range(0, max(1, len(text) - length + 1), piece):
        part = text[base : base + piece + length - 1]
        low, high, place, hashes = anchors(part, np.array([0]), np.array([len(part)]), length)
        yield from _rows(part, base, low, high, place, hashes, length)


def _rows(data: bytes, base: int, low: np.ndarray, high: np.ndarray, place: np.ndarray, hashes: np.ndarray, length: int):
    view = memoryview(data)
    for a, b, p, h in zip(low.tolist(), high.tolist(), place.tolist(), hashes.view(np.int64).tolist(), strict=True):
        yield base + a, base + b, base + p, h, _digest(p - a, view[a : b + length])


def _digest(place: int, data: bytes | memoryview) -> bytes:
    """128 bits of bytes and of a place in them."""
    return hashlib.blake2b(data, digest_size=16, salt=place.to_bytes(8, "big")).digest()


def entries(texts: DataFrame, length: int) -> DataFrame:
    """(key, fp, ch, lo, hi, p) of texts (key, text)."""
    schema = "key binary, fp long, ch binary, lo int, hi int, p int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, SLICE_BYTES):
            rows = common.texts(batch)
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            if sizes.sum() >= 1 << _BITS:
                owner, found = [], []
                for k, text in enumerate(rows):
                    mine = list(_entries(text, length))
                    owner += [k] * len(mine)
                    found += mine
            else:
                data, ends = b"".join(rows), np.cumsum(sizes)
                starts = ends - sizes
                low, high, place, hashes = anchors(data, starts, ends, length)
                doc = np.searchsorted(ends, low, side="right")
                found = list(_rows(data, 0, low, high, place, hashes, length))
                owner = doc.tolist()
                shift = starts[doc].tolist()
                found = [(a - s, b - s, p - s, h, c) for (a, b, p, h, c), s in zip(found, shift, strict=True)]
            if found:
                lo, hi, p, fp, ch = zip(*found, strict=True)
                cols = [common.column(batch, "key").take(pa.array(owner)), pa.array(fp, pa.int64()), pa.array(ch, pa.binary())]
                cols += [pa.array(x, pa.int32()) for x in (lo, hi, p)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "fp", "ch", "lo", "hi", "p"])

    return texts.select("key", "text").mapInArrow(common.tidied(run), schema)


def repeated_offsets(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For contexts of one class, by (left of the anchor reversed, right from the anchor on): the ranges (least, most)
    of offsets d such that the window that starts d bytes before the anchor is in another context too."""
    found: list[list[tuple[int, int]]] = [[] for _ in lefts]
    order, lcp = deepshallow.sort(rights)
    by_left, left_lcp = deepshallow.sort(lefts)
    rank = {k: n for n, k in enumerate(order)}
    stack = [(0, len(order), [(k, left_lcp[n]) for n, k in enumerate(by_left)])]
    while stack:
        a, b, members = stack.pop()  # places a to b of the right order; members by left, with the prefix shared with the one before
        depth = min(lcp[a + 1 : b])
        for n, (k, before) in enumerate(members):
            best = max(before if n else 0, members[n + 1][1] if n + 1 < len(members) else 0)
            if best >= length - depth:
                found[k].append((length - depth, best))
        cuts = [a, *(n for n in range(a + 1, b) if lcp[n] == depth), b]
        if len(cuts) == b - a + 1:
            continue
        part_of = {}
        for n in range(len(cuts) - 1):
            for place in range(cuts[n], cuts[n + 1]):
                part_of[place] = n
        parts: list[list[tuple[int, int]]] = [[] for _ in cuts[1:]]
        shared = [1 << 30] * len(parts)
        for k, before in members:
            shared = [min(x, before) for x in shared] if len(parts) <= 4 else _lower(shared, before)
            n = part_of[rank[k]]
            parts[n].append((k, shared[n] if parts[n] else 0))
            shared[n] = 1 << 30
        stack += [(cuts[n], cuts[n + 1], part) for n, part in enumerate(parts) if len(part) > 1]
    return found


def _lower(shared: list[int], bound: int) -> list[int]:
    return [x if x < bound else bound for x in shared]


def _sorted_classes(contexts: DataFrame, length: int) -> DataFrame:
    """(ch, ranges) of contexts (fp, ch, n, cut, body), class by class."""

    def of_class(rows: list[tuple]) -> Iterator[tuple[bytes, list]]:
        lefts = [body[:cut][::-1] for _, _, cut, body in rows]
        rights = [body[cut:] for _, _, cut, body in rows]
        for (ch, n, _, _), ranges in zip(rows, repeated_offsets(lefts, rights, length), strict=True):
            if n == 1 and ranges:
                yield ch, ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> pa.RecordBatch | None:
            done = list(of_class(rows)) if len(rows) > 1 else []
            return _range_batch(done) if done else None

        for batch in batches:
            for fp, *rest in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if fp != now:
                    if (out := flush()) is not None:
                        yield out
                    now, rows = fp, []
                rows.append(tuple(rest))
        if (out := flush()) is not None:
            yield out

    ordered = contexts.select("fp", "ch", "n", "cut", "body").repartition("fp").sortWithinPartitions("fp")
    return ordered.mapInArrow(common.tidied(run), _RANGES)


_RANGES = "ch binary, ranges array<struct<least:int,most:int>>"


def _range_batch(done: list[tuple[bytes, list]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("least", pa.int32()), ("most", pa.int32())]))
    ranges = [[{"least": a, "most": b} for a, b in r] for _, r in done]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.binary()), pa.array(ranges, kind)], ["ch", "ranges"])


_PARTS = "ch binary, n long, grp binary, red binary, low int, high int"


def _dealt(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """(ch, n, grp, red, low, high) of contexts (fp, ch, n, cut, body, low, high): their windows by offset from the
    anchor in ranges of `width`; grp is a key of the middle that all windows of a range share, red one of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for fp, ch, n, cut, body, low, high in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                for part in range(low // width, high // width + 1):
                    first, last = part * width, (part + 1) * width - 1
                    own = max(low, first), min(high, last)
                    middle = body[cut - first : cut + length - last]
                    grp = _digest(part, fp.to_bytes(8, "big", signed=True) + middle)
                    done.append((ch, n, grp, _digest(own[1], body[cut - own[1] : cut - own[0] + length]), *own))
            if done:
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                cols = [pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["ch", "n", "grp", "red", "low", "high"])

    return contexts.select("fp", "ch", "n", "cut", "body", "low", "high").mapInArrow(common.tidied(run), _PARTS)


def _split_classes(contexts: DataFrame, length: int, most: int) -> list[DataFrame]:
    """[(ch, ranges)] of the contexts of very large classes, split by longer keys until a sort can take each group."""
    width = length - GRAM + 1
    reach = (F.octet_length("body") - length).cast("int")
    bodies = common.written(contexts.withColumn("high", F.col("cut")).withColumn("low", F.col("cut") - reach), "hot-contexts")
    todo, out = bodies, []
    while not todo.isEmpty():
        width = -(-width // SPLIT)
        parts = common.written(_dealt(todo, width, length), "hot-parts")
        reds = parts.groupBy("grp", "red").agg(F.sum("n").alias("n"), F.min(F.struct("ch", "low", "high")).alias("rep"))
        reds = common.written(reds.select("grp", "red", "n", "rep.*"), "hot-reduced")
        again = reds.where("n > 1").select(F.col("grp").alias("g"), F.col("red").alias("r"))
        all_of = F.array(F.struct(F.col("low").alias("least"), F.col("high").alias("most"))).alias("ranges")
        twice = parts.where("n = 1").join(again, (F.col("grp") == F.col("g")) & (F.col("red") == F.col("r")))
        out.append(twice.select("ch", all_of))
        sizes = common.written(reds.groupBy("grp").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("grp", "k"), "hot-groups")
        if sizes.isEmpty():
            break
        base = bodies.select("fp", F.col("ch").alias("of"), "cut", "body")
        open_ = reds.join(sizes, "grp").join(base, F.col("ch") == F.col("of")).drop("of")
        body = F.substring("body", F.col("cut") - F.col("high") + 1, F.col("high") - F.col("low") + length)
        small = open_.where(F.col("k") <= most).select(F.col("grp").alias("fp"), "ch", "n", F.col("high").alias("cut"), body.alias("body"))
        out.append(_sorted_classes(small, length))
        if width == 1:
            break  # every reduced context is one window, equal ones are counted together
        todo = common.written(open_.where(F.col("k") > most).select("fp", "ch", "n", "cut", "body", "low", "high"), "hot-rest")
    return out


def _contexts(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(fp, ch, n, cut, body): the bytes of contexts, from distinct texts. asked: key, reps (the contexts whose bytes
    its text gives)."""
    joined = texts.join(asked.hint("shuffle_hash"), "key").select("key", "text", "reps")
    schema = "fp long, ch binary, n long, cut int, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, SLICE_BYTES):
            done = []
            for text, reps in zip(common.texts(batch), common.column(batch, "reps").to_pylist(), strict=True):
                done += [(r["fp"], r["ch"], r["n"], r["p"] - r["lo"], text[r["lo"] : r["hi"] + length]) for r in reps]
            if done:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
                cols = [pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["fp", "ch", "n", "cut", "body"])

    return joined.mapInArrow(common.tidied(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, most_contexts: int = SORTED_TOGETHER, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds spans (start, end in bytes) and kept
    (bytes)."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select(F.coalesce(F.unhex(F.sha2("text", 256)), F.unhex(F.lit(""))).alias("key"), "doc_id", "text")
    every = common.written(entries(texts.where(F.octet_length("text") >= length), length), "anchors")
    # written, so that both sides of the join are plain shuffles: AQE splits a hot class only then
    shared = common.written(every.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").select("fp"), "classes")
    found = every.join(shared, "fp").groupBy("key", "fp", "ch", "lo", "hi", "p").agg(F.count("*").alias("n"))
    found = common.written(found, "shared-anchors")
    context = found.groupBy("fp", "ch").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo", "hi", "p")).alias("rep"))
    classes = common.written(context.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1"), "open-classes")
    open_ = context.join(classes, "fp")
    unique = texts.groupBy("key").agg(F.first("text").alias("text"))

    def bodies(of: DataFrame) -> DataFrame:
        reps = F.collect_list(F.struct("fp", "ch", "n", "rep.lo", "rep.hi", "rep.p")).alias("reps")
        return _contexts(unique, of.groupBy("rep.key").agg(reps), length)

    ranges = _sorted_classes(bodies(open_.where(F.col("k") <= most_contexts)), length)
    if not classes.where(F.col("k") > most_contexts).isEmpty():
        for part in _split_classes(bodies(open_.where(F.col("k") > most_contexts)), length, most_contexts):
            ranges = ranges.unionByName(part)
    twice = context.where("n > 1").select("ch", F.lit(None).cast("array<struct<least:int,most:int>>").alias("ranges"))
    decided = ranges.unionByName(twice)
    whole = F.array(F.struct((F.col("p") - F.col("hi")).alias("least"), (F.col("p") - F.col("lo")).alias("most")))
    held = found.select("key", "ch", "lo", "hi", "p").join(decided, "ch").select("key", "p", F.explode(F.coalesce("ranges", whole)).alias("r"))
    spans = held.select("key", F.struct((F.col("p") - F.col("r.most")).alias("a"), (F.col("p") - F.col("r.least") + length).alias("b")).alias("s"))
    cover = spans.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("cover"))
    joined = unique.join(cover.hint("shuffle_hash"), "key", "left").select("key", "text", "cover")
    fields = [T.StructField("of", T.BinaryType())]
    fields += [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    if with_text:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        fields += [T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, cover in zip(common.texts(batch), common.column(batch, "cover").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in cover or ():
                    if runs and s["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["b"])
                    else:
                        runs.append([s["a"], s["b"]])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = [len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()]
                done.append(row + ([[{"start": a, "end": b} for a, b in runs], kept] if with_text else []))
            cols = [common.column(batch, "key")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            if with_text:
                kinds += [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            cols += [pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)] if done else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    judged = joined.mapInArrow(common.tidied(run), schema)
    return texts.select("key", "doc_id").join(judged, F.col("key") == F.col("of")).select("doc_id", *schema.fieldNames()[1:])
