import collections
import hashlib
import random

import pytest
from corpus import SCHEMA, frame, rows

from lumenstep.llm import deepshallow, substrings


def brute(data, length):
    texts = [(r[0], (r[1] or "").encode()) for r in data]
    seen = collections.Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = collections.Counter()
    for d, t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        out[d, len(t), len(t) - len(kept), sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


def made(seed):
    rng = random.Random(seed)
    letters = "abcdé "
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(30, 200))) for _ in range(5)]
    data = []
    for k in range(50):
        t = ""
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(pool)
                t += p[rng.randint(0, len(p) // 3) : len(p) - rng.randint(0, len(p) // 3)]
            else:
                t += "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        data.append((k, t))
    return [*data, data[3], data[4], (None, None), (77, ""), (78, "ab" * 300), (79, "x" * 500)]


@pytest.mark.parametrize("most", [256, 2])
@pytest.mark.parametrize("length", [40, 90])
def test_against_brute_force(spark, length, most):
    data = made(length)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = collections.Counter(tuple(r) for r in substrings.remove_repeats(df, length, most).collect())
    assert got == brute(data, length)


def test_a_hot_class_is_split_by_longer_keys(spark):
    rng = random.Random(12)
    letter = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    passage = letter(120)
    data = [(k, letter(rng.randint(0, 60)) + passage[rng.randint(0, 9) : 120 - rng.randint(0, 9)] + letter(rng.randint(0, 60))) for k in range(120)]
    df = spark.createDataFrame([*data, data[5]], "doc_id long, text string").repartition(3)
    got = collections.Counter(tuple(r) for r in substrings.remove_repeats(df, 60, 3).collect())
    assert got == brute([*data, data[5]], 60)


def test_corpus_with_the_production_length(spark):
    got = collections.Counter(tuple(r)[:5] for r in substrings.remove_repeats(frame(spark), with_text=True).collect())
    assert got == brute(rows(), substrings.LENGTH)


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(5000))
    whole = {(a, b, p) for a, b, p, _, _ in substrings._entries(text, 100)}
    monkeypatch.setattr(substrings, "_BITS", 10)
    parts = [(a, b, p) for a, b, p, _, _ in substrings._entries(text, 100)]
    starts = lambda x: sorted((i, p) for a, b, p in x for i in range(a, b + 1))
    assert starts(parts) == starts(whole) and len(starts(whole)) == 4901


def test_sort():
    rng = random.Random(4)
    for _ in range(500):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 80)))
        strings = [base[: rng.randint(0, len(base))] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 12))]
        order, lcp = deepshallow.sort(strings)
        assert [strings[k] for k in order] == sorted(strings)
        for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
            assert n == deepshallow.common(strings[a], strings[b])


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
