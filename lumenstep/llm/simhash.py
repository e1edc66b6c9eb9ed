"""SimHash near-duplicate classes.

Fingerprints: A-Z lower-cased, words separated by ASCII white space, space-joined 3-word shingles with repeats (fewer
words: the whole sequence), XXH64 with seed 42 over their UTF-8 bytes; a bit is set if over half of the hashes have it.
No word at all gives fingerprint zero, and null counts as an empty text.

Linking (segment-popcount embedding): a fingerprint maps to the popcounts of its 32 two-bit segments. Flipping a bit
changes one popcount by one, so the Manhattan distance of two such vectors is a lower bound of the Hamming distance. A
pair within 3 bits therefore has a half (16 segments) whose vectors differ by at most 1. The half vectors are the cells
of a grid: every fingerprint is stored in its two cells and probes them and the neighbours one step up (the step down
is the other fingerprint's step up). Candidates of a cell are verified by exact popcount of the XOR inside the join, so
only true links leave it. Links are made between distinct fingerprints only; copies never meet.

Components: alternating large-star and small-star rounds on the links, each round checkpointed in the shared folder,
until the star forest is stable. No join here broadcasts a side: links and fingerprints grow with the input. The driver
is handed the hubs of a round only, nodes with over 1/256 of all links (fewer than 256 at either end, by counting), whose
links are dealt over many tasks; components with so many fingerprints likewise.

Defined cases: null ids are never a component's id (a component of null ids only has a null id); repeated rows keep
their rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: A node with over 1 / SHARES of the links is a hub; its links are dealt over SHARES parts.
SHARES = 256
_EVEN_BITS = 0x55555555
_HALF = 0xFFFFFFFF


def fingerprint(text: bytes) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.translate(common.LOWER_BYTES).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    else:
        view = memoryview(flat)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: 1 - SHINGLE - 1] + 1))
        spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            fps = []
            for text in common.texts(batch):
                fp = known.get(text)
                if fp is None:
                    fp = known[text] = fingerprint(text)
                fps.append(fp)
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidied(run), schema)


def _cells(fp: Column) -> tuple[Column, Column]:
    """The popcounts of the two-bit segments, two bits each: the low and the high half of the embedding."""
    halves = fp.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(fp, 32)
    return tuple(x - F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_EVEN_BITS)) for x in halves)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints within max_bits (3 at most) bits of each other."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the half-cell argument holds for at most 3 bits")
    halves = fps.select("fp", F.posexplode(F.array(*_cells(F.col("fp")))).alias("half", "cell"))
    # a half is a cell; half 1 cells are moved behind the half 0 ones
    tagged = halves.select("fp", (F.col("cell") * 2 + F.col("half")).alias("key"), "cell")
    # a step up of segment j, where it has fewer than two bits, adds 4**j to the cell and twice that to the key
    near = F.expr(
        "concat(array(0L), transform(filter(sequence(0, 15), j -> (shiftrightunsigned(cell, 2 * j) & 3) < 2),"
        " j -> shiftleft(2L, 2 * j)))"
    )
    probes = tagged.select(F.col("fp").alias("other"), F.col("key").alias("at"), F.explode(near).alias("step"))
    probes = probes.select("other", (F.col("at") + F.col("step")).alias("near_key"))
    pairs = tagged.select("fp", "key").join(
        probes.hint("merge"),
        (F.col("key") == F.col("near_key"))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)
        & (F.col("fp") != F.col("other")),
    )
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge (a, b), both 64-bit integers: root is the smallest node of its component.

    Large-star and small-star alternate on edges (u, v), u > v. Large-star takes u to the smallest neighbour of v, small-star
    the neighbours v of u and u itself to the smallest of them. Minima are combined before the shuffle, and the joins deal
    the edges of hubs over many tasks."""
    now = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        hubs = _hubs(now, ("u", "v"), mark[0])
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        large = _dealt_join(now, low.select(F.col("u").alias("v"), "m"), "v", hubs["v"]).select("u", F.coalesce("m", "v").alias("v")).distinct()
        # u has no more neighbours in large than in now, so its hubs are among those of now
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _dealt_join(large, low, "u", hubs["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _hubs(rows: DataFrame, names: tuple[str, ...], total: int) -> dict[str, list[int]]:
    """For each named column its values with over total / SHARES of the total rows: fewer than SHARES by counting."""
    ends = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("node")) for c in names])).alias("end"))
    often = ends.groupBy("end.side", "end.node").count().where(F.col("count") * SHARES > total).collect()
    return {c: sorted(r["node"] for r in often if r["side"] == c) for c in names}


def _dealt_join(rows: DataFrame, per_key: DataFrame, key: str, hubs: list[int]) -> DataFrame:
    """rows left-joined with per_key (at most one row for a key); rows of the hubs are dealt over SHARES parts each, for
    which the hub's one row is repeated."""
    if not hubs:
        return rows.join(per_key.hint("merge"), key, "left")
    hub = F.col(key).isin(hubs)
    share = F.when(hub, F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES).cast("long"))).otherwise(F.lit(0).cast("long"))
    shares = F.when(hub, F.expr(f"sequence(0L, {SHARES - 1}L)")).otherwise(F.expr("array(0L)"))
    copies = per_key.withColumn("_share", F.explode(shares))
    return rows.withColumn("_share", share).join(copies.hint("merge"), [key, "_share"], "left").drop("_share")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links, the row's own included."""
    prints = common.written(fingerprints(docs, id_col, text_col), "simhash")
    known = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(known.select("fp"), max_bits))
    classed = known.join(roots.hint("merge"), known["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    hubs = _hubs(roots, ("root",), roots.count())["root"]
    by_print = _dealt_join(classed, ids, "root", hubs).select(F.col("fp").alias("known_fp"), "component_id")
    return prints.join(by_print.hint("merge"), prints["fp"] == by_print["known_fp"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, all columns, one for each component: that of the smallest id, of the first row on ties."""
    names = docs.columns
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[docs[c] for c in names]).alias("_all"))
    ids = rows.select(F.struct(F.col("_all").getField(id_col).alias("id"), F.col("_row").alias("row")).alias("doc_id"), F.col("_all").getField(text_col).alias("text"))
    found = near_duplicates(ids, max_bits=max_bits).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias("_row"))
    return rows.join(found.hint("merge"), "_row", "left_semi").select(*[F.col("_all").getField(c).alias(c) for c in names])
