"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A text is parsed greedily into the
longest phrases that occur in the sample (a character the sample lacks is a phrase of its own); with `z` phrases over `n`
characters and a sample of `m` characters the entropy estimate is z * log2(m) / n, and the language with the smallest
one wins (ties: the first by name). The score is 1 - best / second, 1 if only one language is known.

Texts are read as runs of letters, lower-cased, each after one space. The parse runs over the whole text, so a phrase
may cover many words; it starts anew only after a phrase has ended. All texts of a slice walk the automata of all
languages in lockstep, longest first; once fewer than `LEAST_ALIVE` texts are left, the rest of each is walked by itself.

Sample (a documented bound): per language up to `sample_docs` distinct labelled texts, each with its first `doc_chars` characters,
those with the smallest hash, cut to `sample_chars` characters together; all languages share `total_chars`. Everything
that is learned comes from rows whose crc32(id as text) mod 3 is not 1. No shuffle of texts; the driver gets the sample.

Defined cases: null text or a text without a letter is `und` with score 0; null ids are not held out; no labelled row at
all makes every text `und`; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE_DOCS = 40
DOC_CHARS = 20_000
SAMPLE_CHARS = 32_000
TOTAL_CHARS = 320_000
SLICES = 64
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
LEAST_ALIVE = 48
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def automaton(text: str) -> tuple[dict[str, int], np.ndarray]:
    """The suffix automaton of text as (column of a character, dense next-state table); state 0 is the root and as a
    target means that there is no transition."""
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in text:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                to.append(dict(to[q]))
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    chars = {c: k + 1 for k, c in enumerate(sorted(set(text)))}
    table = np.zeros((len(to), len(chars) + 1), dtype=np.int32)
    for s, row in enumerate(to):
        for c, t in row.items():
            table[s, chars[c]] = t
    return chars, table


def normal(text: str) -> str:
    """The runs of letters, lower-cased, a space before each: digits, marks and white space don't tell languages apart."""
    words = _WORD.findall(text.lower())
    return " " + " ".join(words) if words else ""


class Parser:
    """Phrase counts of texts for every language.

    The transitions of all languages are one flat table: a state is the place of its row, -1 means no transition."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.bits = np.array([math.log2(max(2, len(samples[x]))) for x in self.names])
        self.codes = np.zeros((0x110000, len(self.names)), dtype=np.int16)  # columns of a character, one a language
        roots, tables, base = [], [], 0
        for k, name in enumerate(self.names):
            chars, table = automaton(normal(samples[name]))
            width = table.shape[1]
            tables.append(np.where(table > 0, base + table * width, -1).astype(np.int32).ravel())
            self.codes[[ord(c) for c in chars], k] = list(chars.values())
            roots.append(base)
            base += table.size
        self.roots = np.array(roots, dtype=np.int32)
        self.flat = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) phrase counts of normal texts."""
        languages, flat = len(self.names), self.flat
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        starts = (np.cumsum(size) - size)[order]
        codes = self.codes[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
        alive = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
        steps = int(np.searchsorted(-alive, -LEAST_ALIVE, side="right"))
        # one row after the other: the languages of a text
        root = np.tile(self.roots, len(texts))
        state, count = root.copy(), np.zeros(len(root), dtype=np.int64)
        for t, n in enumerate(alive[:steps].tolist()):
            c = codes[starts[:n] + t].ravel()
            s = state[: n * languages]
            to = flat[s + c]
            fail = np.flatnonzero(to < 0)
            first = root[fail]
            again = flat[first + c[fail]]
            unknown = again < 0
            count[fail] += (s[fail] != first) + unknown.astype(np.int8)
            to[fail] = np.where(unknown, first, again)
            state[: n * languages] = to
        view = memoryview(flat)
        for k in range(int(alive[steps]) if steps < len(alive) else 0):
            rest = codes[starts[k] + steps : starts[k] + size[order[k]]]
            for lang, first in enumerate(self.roots.tolist()):
                now, ended = int(state[k * languages + lang]), 0
                for c in rest[:, lang].tolist():
                    to = view[now + c]
                    if to < 0:
                        ended += now != first
                        to = view[first + c]
                        if to < 0:
                            ended += 1
                            to = first
                    now = to
                state[k * languages + lang] = now
                count[k * languages + lang] += ended
        count += state != root
        out = np.empty((len(texts), languages), dtype=np.int64)
        out[order] = count.reshape(-1, languages)
        return out

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        rows = [normal(t) for t in texts]
        rate = self.phrases(rows) * self.bits / np.maximum(1, np.fromiter(map(len, rows), np.int64, len(rows)))[:, None]
        best = rate.argmin(axis=1)
        out = []
        for k, row in enumerate(rows):
            if not row:
                out.append((UNKNOWN, 0.0))
                continue
            low = rate[k, best[k]]
            second = np.partition(rate[k], 1)[1] if len(self.names) > 1 else 0.0
            out.append((self.names[best[k]], 1.0 if len(self.names) < 2 else float(1 - low / second) if second > 0 else 0.0))
        return out


_parsers: dict[tuple, Parser] = {}


def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """The parser of these samples, built once a process; only the last one is kept."""
    if samples not in _parsers:
        _parsers.clear()
        _parsers[samples] = Parser(dict(samples))
    return _parsers[samples]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, doc_chars: int = DOC_CHARS, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> tuple[tuple[str, str], ...]:
    """((language, sample text), ...) from the labelled rows outside the held-out fold."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") >= 1))
    # a long text gives its first doc_chars characters, so a language of long texts alone is learned too
    rows = rows.select("lang", F.substring("text", 1, doc_chars).alias("text"), F.xxhash64("text").alias("h"))
    # the smallest of each language, first within slices of it, so no task sees a language's rows of all partitions
    keys = rows.select("lang", "h").distinct()
    for part in (Window.partitionBy("lang", F.pmod("h", F.lit(SLICES))), Window.partitionBy("lang")):
        keys = keys.withColumn("k", F.row_number().over(part.orderBy("h"))).where(F.col("k") <= sample_docs).drop("k")
    picked = [(r["lang"], r["h"]) for r in keys.collect()]
    if not picked:
        return ()
    found = rows.where(F.col("h").isin(sorted({h for _, h in picked}))).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    names = sorted({lang for lang, _ in picked})
    most = max(1, min(sample_chars, total_chars // len(names)))
    chosen, out = set(picked), []
    for name in names:
        texts = [r["text"] for r in sorted(found, key=lambda r: r["h"]) if r["lang"] == name and (name, r["h"]) in chosen]
        out.append((name, "\n".join(texts)[:most]))
    return tuple(out)


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], keep: tuple[str, ...] = (), slice_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the columns named in keep."""
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType()}
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"), *keep)
    schema = T.StructType([f for f in base.schema if f.name != "_text" or "_text" in keep] + [T.StructField(k, v) for k, v in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(samples) if samples else None
        for batch in common.slices(batches, slice_bytes, "_text"):
            texts = [x.decode() for x in common.texts(batch, "_text")]
            found = own.judge(texts) if own else [(UNKNOWN, 0.0)] * len(texts)
            cols = [common.column(batch, x) for x in schema.fieldNames()[:-2]]
            cols += [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    return base.mapInArrow(common.tidied(run), schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from docs and predict every row of docs."""
    return predict(docs, learn(docs, id_col, text_col, lang_col), keep, id_col=id_col, text_col=text_col)


def keep_known(docs: DataFrame, samples: tuple[tuple[str, str], ...], min_score: float = 0.0, slice_bytes: int = 4_000_000, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known: not `und`, and a score of at least min_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(samples) if samples else None
        for batch in common.slices(batches, slice_bytes, text_col):
            texts = [x.decode() for x in common.texts(batch, text_col)]
            found = own.judge(texts) if own else [(UNKNOWN, 0.0)] * len(texts)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(common.tidied(run), docs.schema)
