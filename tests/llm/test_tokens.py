import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from corpus import SCHEMA, frame, rows

from lumenstep.llm import bytebpe, prefixcount

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_round_trip(spark, encoding):
    got = bytebpe.encode(frame(spark), BPE, public_tokenizers.PATTERN, keep=("key",), with_ids=True).collect()
    want = Counter()
    for r in rows():
        text = r[1] or ""
        ids = encoding.encode_ordinary(text)
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == want


def test_pieces_match_the_library(encoding):
    own, split = bytebpe.codec(BPE), bytebpe.splitter(public_tokenizers.PATTERN)
    rng = random.Random(1)
    for t in ["", "a" * 900, "é" * 600, "<|endoftext|>", "don't \x1c\x85 x", *("".join(chr(rng.choice([97, 98, 32, 10, 0x301, 0x4E2D, 0x1F600, 48])) for _ in range(60)) for _ in range(200))]:
        assert [i for w in split(t.encode()) for i in own.encode(w)] == encoding.encode_ordinary(t)
        ids = encoding.encode_ordinary(t)
        assert own.decoded(np.array(ids), np.array([len(ids)])) == [t.encode()]


def test_empty_tables(spark):
    assert bytebpe.encode(spark.createDataFrame([], SCHEMA), BPE, public_tokenizers.PATTERN).count() == 0
    assert prefixcount.count_tokens(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter(tuple(r)[:4] for r in prefixcount.count_tokens(frame(spark), PIECES, 500).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 500) for r in rows())


def test_prefixes_and_budgets():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = prefixcount.PrefixCounter(PIECES)
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("abcthe ing  \n\t.,éñ▁😀漢") for _ in range(rng.randint(0, 40)))
        want = [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        assert own.prefix_counts(t) == want
        budget = rng.randint(0, 20)
        assert own.longest_prefix(t, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_prefix_table_answers_budgets(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["", "the other there", "été\n and  more\n", "漢字 " * 20, "x" * 700]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    table = prefixcount.prefix_table(df, PIECES).cache()
    for r in table.collect():
        assert r["prefix_tokens"] == [len(sp.encode((r["text"] or "")[:k])) for k in range(len(r["text"] or "") + 1)]
    for budget in (0, 3, 10, 1000):
        want = {k: max((t[:n] for n in range(len(t) + 1) if len(sp.encode(t[:n])) <= budget), key=len) for k, t in enumerate(texts)}
        assert {r["doc_id"]: r["text"] for r in prefixcount.truncate(table, budget).collect() if r["doc_id"] != 9} == want
        assert all(r["fits"] == (r["n_tokens"] <= budget) for r in prefixcount.fits(table, budget).collect())
    table.unpersist()


def test_stored_chunks_are_dropped_by_bytes(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(prefixcount, "TABLE_BYTES", 2000)
    own, rng = prefixcount.PrefixCounter(PIECES), random.Random(6)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 400))) for _ in range(4))
        assert own.count(t) == len(sp.encode(t)) and own.held < 20_000


def test_many_blocks(spark, monkeypatch):
    from lumenstep.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 500)
    monkeypatch.setattr(blocks.pack, "__defaults__", (500, False))
    got = bytebpe.encode(frame(spark), BPE, public_tokenizers.PATTERN).collect()
    want = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == want


def test_a_block_of_other_input_raises():
    from lumenstep.llm import blocks

    def pack(texts):
        block = blocks.Block()
        for k, t in enumerate(texts):
            block.add((k,), t, False, 1)
        return block.pack(3)

    (one, first), (_, other) = pack([[b"a", b"b"], [b"c"]]), pack([[b"a", b"b"], [b"d"]])
    load = blocks.pickle.loads
    marks = {k: d[2] for k, d in load(first).items()}
    assert load(one)["marks"] == marks and {k: d[2] for k, d in load(other).items()} != marks
    import pyarrow as pa

    answers = [{"bucket": k, "mark": d[2], "answer": b""} for k, d in load(other).items()]
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("mark", pa.binary()), ("answer", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["0-0"]), pa.array([one], pa.binary()), pa.array([answers], kind)], ["block", "pack", "answers"])
    with pytest.raises(RuntimeError):
        list(blocks.opened(iter([batch])))


def test_decoding_joins_the_token_table(spark, encoding):
    texts = ["", "don't stop", "漢字 😀 é", "a" * 50]
    df = spark.createDataFrame([*((k, encoding.encode_ordinary(t)) for k, t in enumerate(texts)), (9, None), (1, encoding.encode_ordinary(texts[1]))], "doc_id long, ids array<int>")
    got = Counter((r["doc_id"], bytes(r["decoded"])) for r in bytebpe.decode(df, BPE).collect())
    assert got == Counter([*((k, t.encode()) for k, t in enumerate(texts)), (9, b""), (1, texts[1].encode())])


def test_reassembly_holds_no_object_for_each_pre_token(spark, encoding, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from lumenstep.llm import blocks

    grabbed = []
    monkeypatch.setattr(blocks, "gather", lambda *a: type("Frame", (), {"mapInArrow": lambda self, f, schema: grabbed.append(f)})())
    bytebpe.encode(spark.createDataFrame([], "doc_id long, text string"), BPE, public_tokenizers.PATTERN, with_ids=True)
    words = [b" %dw" % (k * 7919) for k in range(40_000)]
    block = blocks.Block()
    block.add((5,), words, False, 1)
    block.add((6,), [], False, 1)
    one, found = block.pack(1)
    _, _, mark = blocks.pickle.loads(found)[0]
    ids = [encoding.encode_ordinary(w.decode()) for w in sorted(words)]
    answer = blocks.pickle.dumps((blocks.pack_numbers(np.array([len(x) for x in ids])), blocks.pack_numbers(np.array([i for x in ids for i in x]))))
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("mark", pa.binary()), ("answer", pa.binary())]))
    cols = [pa.array(["0-0"]), pa.array([one], pa.binary()), pa.array([[{"bucket": 0, "mark": mark, "answer": answer}]], kind)]
    batch = pa.RecordBatch.from_arrays(cols, ["block", "pack", "answers"])
    del found, ids
    list(grabbed[0](iter([batch])))  # the vocabulary is kept
    tracemalloc.start()
    out = list(grabbed[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    text = b"".join(words)
    want = [i for w in words for i in encoding.encode_ordinary(w.decode())]
    assert out[0].column(4).to_pylist() == [want, []]
    assert out[0].column(2)[0].as_py() == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert out[0].column(3).to_pylist() == [hashlib.sha256(x).hexdigest() for x in (text, b"")]
    assert most < 450 * len(words)
