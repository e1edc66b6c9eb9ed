import collections
import random

from corpus import SCHEMA, frame, rows, sentence

from lumenstep.llm import decontaminate

ITEMS = [(k, sentence(random.Random(100 + k), "en", 30).replace("the", f"rare{k}") + "? " + f"answer{k} " + sentence(random.Random(k), "fr", 8)) for k in range(30)] + [(98, None), (99, "")]


def items(spark, data=None):
    return spark.createDataFrame(ITEMS if data is None else data, "item_id long, text string")


def planted():
    data = rows()
    data.append((500, data[0][1] + " " + ITEMS[3][1].upper() + " " + data[1][1], "en", "s", 1, "k", 1, 1.0))
    data.append((501, ITEMS[4][1], "en", "s", 1, "k", 1, 1.0))
    data.append((501, ITEMS[4][1], "en", "s", 1, "k", 1, 1.0))
    data.append((502, ITEMS[5][1].partition("?")[0], "en", "s", 1, "k", 1, 1.0))  # the question alone
    return data


def test_finds_what_was_planted(spark):
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find(frame(spark, planted()), items(spark)).collect())
    assert got == {(500, 3): 1, (501, 4): 2}
    blocks = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find(frame(spark, planted()), items(spark), block_bytes=900).collect())
    assert blocks == got
    rows = lambda **k: sorted(tuple(r) for r in decontaminate.find(frame(spark, planted()), items(spark), **k).collect())
    assert rows() == rows(block_bytes=900)  # scores too: the statistics are of all items


def test_clean_keeps_rows_and_columns(spark):
    df = frame(spark, planted())
    kept = decontaminate.clean(df, items(spark))
    assert kept.columns == df.columns and kept.count() == len(planted()) - 3


def test_search_against_all_scores():
    index = decontaminate.Index([(k, t, None) for k, t in ITEMS if t])
    rng = random.Random(1)
    terms = list(range(len(index.term)))
    for _ in range(200):
        base = rng.randrange(len(index.ids))
        query = sorted({t for t in terms if base in index.items[t] and rng.random() < 0.7} | set(rng.sample(terms, 10)))
        scores = collections.defaultdict(float)
        for t in query:
            for i, x in zip(index.items[t], index.impacts[t], strict=True):
                scores[i] += x
        got = {i: s for b in range(index.blocks) for i, s in index.search(query, 0.3, b)}
        assert set(got) == {i for i, s in scores.items() if s >= 0.3 - 1e-9}


def test_empty(spark):
    assert decontaminate.find(spark.createDataFrame([], SCHEMA), items(spark)).count() == 0
    assert decontaminate.find(frame(spark), items(spark, [])).count() == 0
    assert decontaminate.clean(frame(spark), items(spark, [])).count() == len(rows())
