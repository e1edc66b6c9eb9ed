import collections
import math
import zlib

import public_tokenizers
from corpus import SCHEMA, frame, rows

from lumenstep.llm import common, lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_scores_against_brute_force(spark):
    data = rows()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    words = lambda t: (t or "").encode().translate(common.LOWER_BYTES).split()
    counts, ends = collections.Counter(), 0
    for r in data:
        if not held(r[0]):
            counts.update(words(r[1]))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    own = lattice.vocabulary(MODEL)
    pieces = collections.Counter()
    for w, c in counts.items():
        for k in own.model.encode(w.decode()):
            pieces[k] += c
    whole = sum(pieces.values()) + ends + 0.5 * (own.size + 1)
    prob = lambda k: (pieces[k] + 0.5) / whole

    def marginal(word):
        text = "▁" + word
        ways = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(end):
                if text[begin:end] in own.pieces:
                    ways[end] += ways[begin] * prob(own.pieces[text[begin:end]])
            if text[end - 1] not in own.pieces:
                ways[end] += ways[end - 1] * math.prod(prob(own.bytes[b]) for b in text[end - 1].encode())
        return ways[-1]

    want = collections.defaultdict(list)
    for r in data:
        ws = words(r[1])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        long_ = any(len(w) > 500 for w in ws)
        score = None if long_ else sum(math.log10(marginal(w.decode())) for w in ws) + math.log10((ends + 0.5) / whole)
        want[r[0]].append((held(r[0]), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, base, score))
    got = lattice.score(frame(spark), MODEL).collect()
    assert len(got) == len(data)
    for r in got:
        h, tokens, known, total, base, score = want[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, tokens, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert score is None or math.isclose(r["score"], score, rel_tol=1e-9)


def test_empty(spark):
    assert lattice.score(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
