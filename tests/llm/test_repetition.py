import collections
import random

from corpus import SCHEMA, frame, rows

from lumenstep.llm import repetition


def brute(text, min_words):
    w = (text or "").encode().split()
    n = len(w)
    win = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    mark = {j for i in range(n - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    covered, longest = set(), 0
    places = collections.defaultdict(list)
    for i, x in enumerate(w):
        places[x].append(i)
    for i in range(n):
        best = 0
        for j in places[w[i]]:
            if j != i:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
        if best >= min_words:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(mark), len(covered), longest


def test_against_brute_force(spark):
    got = collections.Counter(tuple(r[x] for x in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")) for r in repetition.judge(frame(spark), slice_bytes=3000).collect())
    assert got == collections.Counter((r[0], *brute(r[1], repetition.MIN_WORDS)) for r in rows())


def test_verdicts(spark):
    for r in repetition.judge(frame(spark)).collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        dropped = r["covered_words"] > repetition.MAX_COVERED * r["n_words"] or r["longest_repeat"] > repetition.MAX_REPEAT
        assert r["base_failed"] == failed and r["kept"] == (not failed and not dropped)


def test_random_symbols():
    rng = random.Random(2)
    for _ in range(200):
        texts = [b" ".join(rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        m = repetition.measure(texts, 4)
        for k, t in enumerate(texts):
            want = brute(t.decode(), 4)
            assert (m["n_repeat_words"][k], m["covered"][k], m["longest"][k]) == want[4:]


def test_empty_table(spark):
    assert repetition.judge(spark.createDataFrame([], SCHEMA)).count() == 0
