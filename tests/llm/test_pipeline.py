import hashlib

import public_tokenizers
from corpus import SCHEMA, rows

import corpus_pipeline
from lumenstep.llm import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def folder(spark, tmp_path, data, items):
    spark.createDataFrame(data, SCHEMA).select(*COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    item = "which of these rare words leaked into the corpus? it was the zebra answer of all"
    data = rows()
    data.append((700, "before it " + item + " after that and there", "en", "s", 1, "k", 1, 1.0))
    data.append((701, "please write to some.body@mail.example.com about the water there", "en", "s", 1, "k", 1, 1.0))
    d = folder(spark, tmp_path, data, [(1, item)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    counts = [df.count() for df in seen.values()]
    assert counts[0] == len(data) - 4 and counts[0] > counts[1] and counts[2] == counts[1] - 1 and counts[3] == counts[4] == counts[2]
    assert 700 not in [r["doc_id"] for r in seen["benchmark decontamination"].collect()]
    texts = {r["doc_id"]: r["text"] for r in seen["PII surrogates"].collect()}
    assert "some.body@mail.example.com" not in texts[701] and texts[701].startswith("please write to ")
    last = {r["doc_id"]: r for r in seen["byte-level BPE"].collect()}
    assert all(last[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items())
    ran = corpus_pipeline.run(spark, d)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids_sha256"]) for r in ran.collect()) == sorted((k is None, k or 0, r["ids_sha256"]) for k, r in last.items())
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken") and decontaminate.SHINGLE == 5


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [])).count() == 0
