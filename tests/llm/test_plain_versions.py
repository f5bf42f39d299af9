"""Language model, differencing and best fit against plain versions of their definitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from small_tables import docs_of
from moodtide.llm import language, packing, sharding

# language


def plain_grams(text):
    folded = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    return Counter(folded[i : i + n] for n in range(1, 4) for i in range(len(folded) - n + 1))


class PlainFtrl:
    """Follow the regularised leader, one number at a time, over n-grams as they are."""

    def __init__(self, classes):
        self.classes, self.z, self.n = classes, defaultdict(float), defaultdict(float)
        like = language.Ftrl(classes)
        self.alpha, self.beta, self.l1, self.l2 = like.alpha, like.beta, like.l1, like.l2

    def weight(self, gram, c):
        z = self.z[gram, c]
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n[gram, c])) / self.alpha + self.l2)

    def logits(self, x):
        return [sum(v * self.weight(gram, c) for gram, v in x.items()) for c in range(self.classes)]

    def learn(self, x, y):
        p = plain_softmax(self.logits(x))
        for c in range(self.classes):
            for gram, v in x.items():
                g, w, n = v * (p[c] - (c == y)), self.weight(gram, c), self.n[gram, c]
                self.z[gram, c] += g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
                self.n[gram, c] = n + g * g


def plain_softmax(logits):
    top = max(logits)
    e = [math.exp(v - top) for v in logits]
    return [v / sum(e) for v in e]


def test_language_model_against_plain_regression(spark):
    draw = random.Random(21)
    alphabets = {"aa": "abc é", "bb": "abd é", "cc": "bcd 1"}
    rows = [("".join(draw.choices(alphabets[k], k=draw.randint(6, 40))), k) for k in alphabets for _ in range(12)]
    rows += rows[:1] * 5  # copies count for the IDF and are learned once
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(df, seed=7)

    labels = sorted(alphabets)
    met = Counter(gram for text, _ in rows for gram in plain_grams(text))
    features = {f for text, _ in rows for at, _ in language.counts_of(pa.array([text])) for f in at}
    assert len(features) == len(met)  # no two n-grams share a hash here

    def vector(text):
        grams = plain_grams(text)
        total = sum(grams.values())
        x = {g: language.SCALE * n / total * (math.log((1 + len(rows)) / (1 + met[g])) + 1) for g, n in grams.items()}
        return x | {"": 1.0}

    drawn = df.distinct().select("text", "lang", F.xxhash64(F.lit(7), "text").alias("draw")).orderBy("draw").collect()
    held = int(len(drawn) * language.CALIBRATION_SHARE)
    plain, order = PlainFtrl(3), np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(len(drawn) - held) + held:
            plain.learn(vector(drawn[i]["text"]), labels.index(drawn[i]["lang"]))

    at = int(np.abs(model.bias).argmax())
    t = plain.weight("", at) / model.bias[at]
    kept = [(plain.logits(vector(r["text"])), labels.index(r["lang"])) for r in drawn[:held]]

    def loss(t):
        return -sum(math.log(max(1e-12, plain_softmax([v / t for v in logits])[y])) for logits, y in kept) / held

    assert loss(t) <= min(loss(math.exp(step / 200)) for step in range(-600, 601)) + 1e-6

    texts = [text for text, _ in rows] + ["zzz", "a b", "é1d!", "c" * 500]
    for text, found in zip(texts, model.predict(pa.array(texts)).to_pylist()):
        p = plain_softmax([v / t for v in plain.logits(vector(text))])
        assert found["score"] == pytest.approx(max(p), abs=1e-9)
        if sorted(p)[-1] - sorted(p)[-2] > 1e-9:
            assert found["lang"] == labels[p.index(max(p))]


# sharding


def plain_differencing(sums):
    """The subset of the result for each input and subset: whole partitions are kept and combined."""
    k = len(sums[0])
    parts = []  # (spread, order of arrival, subsets from the largest)

    def arrive(number, subsets):
        subsets = sorted(subsets, key=lambda x: -x[0])
        parts.append((subsets[0][0] - subsets[-1][0], number, subsets))

    for i, own in enumerate(sums):
        arrive(i, [(s, [(i, j)]) for j, s in enumerate(own)])
    number = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        a, b = parts.pop(0)[2], parts.pop(0)[2]
        arrive(number, [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))])
        number += 1
    placed = [[0] * k for _ in sums]
    for shard, (_, members) in enumerate(parts[0][2]):
        for i, j in members:
            placed[i][j] = shard
    return placed


@pytest.mark.parametrize("k", [2, 3, 8])
def test_differencing_against_whole_partitions(k):
    draw = random.Random(22)
    for _ in range(40):
        n = draw.randint(1, 60)
        most = draw.choice([3, 50, 10**6])  # small sizes tie often
        single = [[draw.randint(1, most)] + [0] * (k - 1) for _ in range(n)]
        partial = [[draw.randint(0, most) for _ in range(k)] for _ in range(n)]
        for sums in (single, partial):
            assert sharding.differencing(sums) == plain_differencing(sums)


def test_shards_against_plain_differencing(spark):
    draw = random.Random(23)
    texts = ["t" * draw.randint(0, 90) + str(i % 150) for i in range(300)]
    rows = docs_of(spark, texts)
    keys = rows.select("doc_id", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2")).collect()
    sizes = Counter()
    for r in keys:
        sizes[r["k1"], r["k2"]] += len(texts[r["doc_id"]]) + 1
    groups = sorted(sizes)
    want = dict(zip(groups, plain_differencing([[sizes[g]] + [0] * 7 for g in groups])))
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(rows, 8).collect()}
    assert got == {r["doc_id"]: want[r["k1"], r["k2"]][0] for r in keys}


# packing


def plain_pack(lengths, capacities, costs, by_filling):
    of_size = dict(zip(capacities, costs))

    def least(n):
        return min(c for c in capacities if c >= n)

    bins, where = [], []
    for t, length in enumerate(lengths):

        def per_token(c):
            if not by_filling:
                return of_size[c] / min(c, sum(lengths[t:]))
            filled = length
            for n in lengths[t + 1 :]:
                filled += n if filled + n <= c else 0
            return of_size[least(filled)] / filled

        able = [b for b in bins if b["size"] - b["used"] >= length]
        if able:
            b = min(able, key=lambda b: (b["size"] - b["used"], -b["changed"]))
        else:
            size = min((c for c in capacities if c >= length), key=lambda c: (per_token(c), c))
            bins.append(b := {"number": len(bins), "size": size, "used": 0})
        where.append((b["number"], b["used"]))
        b["used"] += length
        b["changed"] = t
    return [b for b, _ in where], [at for _, at in where], [least(b["used"]) for b in bins]


def plain_best(lengths, capacities, costs):
    of_size = dict(zip(capacities, costs))
    return min((plain_pack(lengths, capacities, costs, w) for w in (True, False)), key=lambda p: sum(of_size[c] for c in p[2]))


def test_pack_against_plain_best_fit():
    draw = random.Random(24)
    for _ in range(300):
        capacities = sorted(draw.sample([8, 16, 24, 64, 128], draw.randint(1, 5)))
        costs = sorted(draw.randint(1, 300) for _ in capacities)
        lengths = sorted((draw.randint(1, capacities[-1]) for _ in range(draw.randint(0, 60))), reverse=True)
        for way in (True, False):
            assert packing.pack_once(lengths, capacities, costs, way) == plain_pack(lengths, capacities, costs, way)
        assert packing.pack(lengths, capacities, costs) == plain_best(lengths, capacities, costs)


def test_packed_documents_against_plain_best_fit(spark):
    draw = random.Random(25)
    n_tokens = [draw.choice([draw.randint(1, 900), draw.randint(1, 9000), 300]) for _ in range(250)] + [20_000, 8192, 8193]
    pieces = sorted(
        (-min(8192, n - begin), i, begin) for i, n in enumerate(n_tokens) for begin in range(0, n, 8192)
    )
    capacities = list(packing.CAPACITIES)
    bins, places, sizes = plain_best([-p[0] for p in pieces], capacities, [packing.sequence_cost(c) for c in capacities])
    want = {(i, begin): (-n, b, sizes[b], at) for (n, i, begin), b, at in zip(pieces, bins, places)}
    rows = spark.createDataFrame(list(enumerate(n_tokens)), "doc_id long, n_tokens int")
    got = {(r["doc_id"], r["begin"]): (r["length"], r["bin"], r["capacity"], r["at"]) for r in packing.best_fit(rows).collect()}
    assert got == want
