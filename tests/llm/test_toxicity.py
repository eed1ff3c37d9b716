"""The toxicity score against a plain reckoning of odds, segments, calibration and logistic curve."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from quotecurve.llm import toxicity

LETTERS = re.compile(r"[^\W\d_]+")


def found(text):
    return LETTERS.findall((text or "").lower())


def place(token, bits):
    return xxhash.xxh64_intdigest(token, 7) >> (64 - bits)


def best_segments(scores):
    """Maximal segments by their definition: the best one (earliest, shortest), then left and right of it."""

    def split(a, b):
        sums = [(sum(scores[i:j]), -i, i - j) for i in range(a, b) for j in range(i + 1, b + 1)]
        if not sums or max(sums)[0] <= 0:
            return []
        value, first, length = max(sums)
        return [*split(a, -first), value, *split(-first - length, b)]

    return split(0, len(scores))


class Plain:
    """The model by dictionaries and loops."""

    def __init__(self, texts):
        """`texts` are (text, toxic, counted) of the learnt documents; those not counted calibrate."""
        self.counts = {bits: (Counter(), Counter()) for bits in (toxicity.TOKEN_BITS, toxicity.STEM_BITS)}
        for text, toxic, counted in texts:
            for token in found(text) if counted else ():
                self.counts[toxicity.TOKEN_BITS][toxic][place(token, toxicity.TOKEN_BITS)] += 1
                self.counts[toxicity.STEM_BITS][toxic][place(token[: toxicity.STEM], toxicity.STEM_BITS)] += 1
        totals = [sum(c.values()) for c in self.counts[toxicity.TOKEN_BITS]]
        self.base = math.log((totals[1] + 1) / (totals[0] + 1))
        apart = [(self.segments(t), len(found(t)), toxic) for t, toxic, counted in texts if not counted]
        clean = [(max(values, default=0.0), n) for values, n, toxic in apart if not toxic]
        self.rate = 1.0
        for _ in range(100):
            left = [best - math.log(max(n, 1)) / self.rate for best, n in clean]
            mean = sum(left) / len(left)
            spread = max(math.sqrt(sum((x - mean) ** 2 for x in left) / len(left)), 1e-6)
            self.rate = 0.5 * self.rate + 0.5 * math.pi / (math.sqrt(6) * spread)
        self.log_k = sum(self.rate * best - math.log(max(n, 1)) for best, n in clean) / len(clean) - 0.5772156649015329
        self.rows = [((1.0, *self.features(values, n)), toxic) for values, n, toxic in apart]

    def odds(self, token, bits, weight, centre):
        clean, toxic = (c[place(token, bits)] for c in self.counts[bits])
        share = 1 / (1 + math.exp(-(self.base + centre)))
        return math.log((toxic + weight * share) / (clean + weight * (1 - share))) - self.base

    def segments(self, text):
        scores = []
        for token in found(text):
            stem = self.odds(token[: toxicity.STEM], toxicity.STEM_BITS, toxicity.STEM_WEIGHT, 0.0)
            scores.append(self.odds(token, toxicity.TOKEN_BITS, toxicity.TOKEN_WEIGHT, stem) - toxicity.DRIFT)
        return best_segments(scores)

    def features(self, values, n):
        told = [-math.log(max(-math.expm1(-math.exp(self.log_k + math.log(max(n, 1)) - self.rate * v)), 1e-300)) for v in values]
        return math.log1p(max(told, default=0.0)), math.log1p(sum(x for x in told if x > -math.log(toxicity.SIGNIFICANT)))

    def slope(self, beta):
        """Slope of the penalised likelihood, which is zero at the fitted coefficients."""
        left = [-1e-3 * b for b in beta]
        for x, y in self.rows:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, beta))))
            left = [s + a * (y - p) for s, a in zip(left, x)]
        return left


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    plain, foul = [f"{a}{b}" for a in ("river", "meadow", "lantern") for b in "abcdefg"], ["vilest", "vilely", "scumbag", "scummy"]
    out = []
    for k in range(400):
        text = [rng.choice(plain) for _ in range(rng.randint(3, 25))]
        toxic = int(rng.random() < 0.4)
        if toxic or rng.random() < 0.1:
            at = rng.randint(0, len(text))
            text[at:at] = [rng.choice(foul) for _ in range(rng.randint(1, 5) if toxic else 1)]
        out.append((k, " ".join(text), toxic))
    return out


def test_score_by_a_plain_reckoning(spark, rows):
    docs = spark.createDataFrame([*((k, t) for k, t, _ in rows), (900, ""), (901, None), (902, "vilest 12 scummy_x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, toxic) for k, _, toxic in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    # the part that calibrates, by the published hash: a long by seed 42, then the integer 5 by that hash
    def counted(k):
        seed = xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed=42)
        value = xxhash.xxh64_intdigest((5).to_bytes(4, "little"), seed=seed)
        return (value - (value >> 63 << 64)) % 4 != 0

    learnt = [(t, toxic, counted(k)) for k, t, toxic in rows if zlib.crc32(str(k).encode()) % 5]
    plain = Plain(learnt)
    assert {c for _, _, c in learnt} == {True, False}
    assert model.base == pytest.approx(plain.base, rel=1e-12)
    assert (model.rate, model.log_k) == pytest.approx((plain.rate, plain.log_k), rel=1e-9)
    assert plain.slope(model.curve.tolist()) == pytest.approx([0, 0, 0], abs=1e-6)
    told = {k: t for k, t in ((r["doc_id"], r["text"]) for r in docs.collect())}
    for row in toxicity.score(docs, labels, model=model).collect():
        x = (1.0, *plain.features(plain.segments(told[row["id"]]), len(found(told[row["id"]]))))
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.curve.tolist()))))
        assert row["score"] == pytest.approx(want, rel=1e-9)
        assert row["predicted"] == int(row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(row["id"]).encode()) % 5 == 0)


def test_labels_that_contradict_or_are_invalid(spark, rows):
    """The highest label of an id counts; other values and null ids teach nothing."""
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    told = [(k, toxic) for k, _, toxic in rows]
    odd = [*told, *((k, 0) for k, toxic in told if toxic), *((k, 2) for k, _ in told), (None, 1), (5000, 1), *((k, None) for k, _ in told)]
    plain = toxicity.fit(docs, spark.createDataFrame(told, "doc_id long, toxic int"))
    same = toxicity.fit(docs, spark.createDataFrame(odd, "doc_id long, toxic int"))
    assert same.curve.tolist() == pytest.approx(plain.curve.tolist()) and same.rate == pytest.approx(plain.rate)
    assert (same.toxic == plain.toxic).all() and (same.clean == plain.clean).all()
