import numpy as np
import xxhash
from corpus import SCHEMA, frame, rows

from lumenstep.llm import simhash


def brute_print(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(data):
    prints = [(r[0], brute_print(r[1])) for r in data]
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    low = {}
    for d, f in prints:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return sorted(((d, f, low.get(find(f))) for d, f in prints), key=repr)


def test_against_brute_force(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=repr) == brute(rows())


def test_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = set(map(int, base))
    for f in base.tolist():
        for _ in range(6):
            g = f
            for b in rng.integers(0, 63, rng.integers(1, 5)).tolist():
                g ^= 1 << b
            fps.add(g)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    order = sorted(fps)
    assert got == {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(50)]
    hub = [(1000, k) for k in range(1001, 1200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(51)) and all(got[k] == 1000 for k in range(1000, 1200))


def test_components_with_hubs_at_both_ends(spark):
    """Hubs that are the least, the greatest and a middle node of their links, beside many nodes of few links."""
    rng = np.random.default_rng(5)
    pairs = [(0, k) for k in range(10, 400)] + [(9000, k) for k in range(700, 1000)] + [(2000, k) for k in range(1800, 2200) if k != 2000]
    pairs += [tuple(map(int, p)) for p in rng.integers(3000, 9000, (1500, 2))]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert got == {k: find(k) for k in linked}
    edges = spark.createDataFrame(pairs, "u long, v long")
    hubs = simhash._hubs(edges, ("u", "v"), len(pairs))
    assert hubs["u"] == [0, 2000, 9000] and hubs["v"] == []


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_keeps_columns(spark):
    df = frame(spark).coalesce(1)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    classes = {(r[2]) for r in brute(rows())}
    assert kept.count() == len(classes)
