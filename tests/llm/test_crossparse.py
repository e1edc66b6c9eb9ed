import random
import zlib

from corpus import SCHEMA, WORDS, frame, rows, sentence

from lumenstep.llm import crossparse


def phrases(text, sample):
    """A plain greedy parse of the whole text: the longest match that occurs in the sample, again and again."""
    n = i = 0
    while i < len(text):
        k = 0
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        i += max(1, k)
        n += 1
    return n


def test_phrases_of_whole_texts_against_brute_force(monkeypatch):
    rng = random.Random(2)
    samples = {lang: sentence(rng, lang, 200) for lang in WORDS}
    own = crossparse.Parser(samples)
    texts = [sentence(rng, rng.choice(list(WORDS)), rng.randint(0, 60)) for _ in range(40)]
    texts += ["ab" * 60, "漢字 漢", "zzz", "", samples["en"], samples["de"][:700] + samples["fr"], sentence(rng, "en", 1500)]
    rows = [crossparse.normal(t) for t in texts]
    want = [[phrases(t, crossparse.normal(samples[x])) for x in own.names] for t in rows]
    for least in (1, 16, 1000):  # in lockstep only, both ways, one by one only
        monkeypatch.setattr(crossparse, "LEAST_ALIVE", least)
        assert own.phrases(rows).tolist() == want
    en = own.names.index("en")
    assert own.phrases([crossparse.normal(samples["en"])])[0, en] == 1  # one phrase covers many words


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    data = [(k, sentence(rng, lang := rng.choice(list(WORDS)), rng.randint(8, 60)), lang, "s", 1, "k", 1, 0.1) for k in range(400)]
    truth = {r[0]: r[2] for r in data}
    got = crossparse.identify(frame(spark, data)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)


def test_edges(spark):
    got = {r["doc_id"]: r for r in crossparse.identify(frame(spark)).collect()}
    for k in (900, 901, 902, 903):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    assert got[None]["held_out"] is False and got[None]["lang_pred"] != "und"
    kept = crossparse.keep_known(frame(spark), crossparse.learn(frame(spark)))
    assert kept.columns == frame(spark).columns and kept.count() == len(rows()) - 4
    assert crossparse.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rng = random.Random(8)
    data = [(k, sentence(rng, "en", 30), "en" if zlib.crc32(str(k).encode()) % 3 != 1 else "secret", "s", 1, "k", 1, 0.1) for k in range(60)]
    assert [lang for lang, _ in crossparse.learn(frame(spark, data))] == ["en"]


def test_language_of_long_texts_is_learned(spark):
    long = "der hund und die katze gehen heute nicht in den garten " * 8
    rows = [(k, long + str(k), "de") for k in range(20)] + [(100 + k, f"the dog and the cat {k}", "en") for k in range(20)]
    samples = crossparse.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), doc_chars=200)
    assert [name for name, _ in samples] == ["de", "en"]
    assert all(x == long[:200] for x in dict(samples)["de"].split("\n"))
