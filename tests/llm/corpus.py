"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, score double"
WORDS = {
    "en": "the of and to in that was his with for these there where water other which their would about".split(),
    "de": "der die und das nicht mit sich auf für eine werden schön straße über können müssen größe weiß".split(),
    "fr": "le la les des une est dans qui sur avec être où très déjà français même après élève".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        text = sentence(rng, lang, rng.randint(3, 120))
        out.append([k, text if k % 7 else text + "\n" + text.upper(), lang if k % 5 else None, f"s{k % 3}", len(text), "x", k, 0.5])
    out[3][1] = out[2][1]
    out[4][1] = out[2][1] + " end"
    extra = [
        [None, "no id here the of and", "en", "s", 1, "y", None, None],
        [900, None, "en", "s", None, None, None, None],
        [901, "", None, None, None, None, None, None],
        [902, " \n\t ", "en", "s", 3, None, 1, 1.0],
        [903, "12345 67890 !!! ???", "en", "s", 3, None, 1, 1.0],
        [904, "x" * 3000, "en", "s", 3, None, 1, 1.0],
        [905, sentence(rng, "en", 4000), "en", "s", 3, None, 1, 1.0],
        [906, "漢字 かな 😀 émigré\x0b\x0c tail", None, "s", 3, None, 1, 1.0],
        list(out[5]),
        list(out[5]),
    ]
    return [tuple(r) for r in out + extra]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
