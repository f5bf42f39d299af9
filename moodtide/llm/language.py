"""Language of texts: sparse multinomial regression on TF-IDF of character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.frames import text_of
from moodtide.llm.words import FACTORS, U, flat_bytes, slices
from moodtide.session import bounded_batches

UNKNOWN = "und"
DIMS = 1 << 16
LONGEST = 3
SCALE = 100.0
MAX_LANGUAGES = 500
PER_LANGUAGE = 1500
CALIBRATION_SHARE = 0.2
#: Bytes of text whose n-grams are held at once: each takes some 60 bytes for every byte of text.
GRAM_BYTES = 1 << 18
#: Of ASCII only letters count; all other signs are one blank.
FOLD = np.array([i if chr(i).isalpha() else 32 for i in range(128)], np.uint64)


def grams_of(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For n = 1 to LONGEST the features of all n-grams in a row and the text of each.

    An n-gram of code points, in lower case and with ASCII other than letters as blanks, is hashed
    to one of DIMS features. N-grams do not cross from text to text.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    data, _ = flat_bytes(low)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(U)
    plain = codes < 128
    codes[plain] = FOLD[codes[plain].astype(np.int64)]
    owner = np.repeat(np.arange(len(low)), np.asarray(pc.utf8_length(low)))
    features, owners = [], []
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes), U)
        for n in range(1, LONGEST + 1):
            size = max(0, len(codes) - n + 1)
            sums = sums[:size] + codes[n - 1 :] * FACTORS[n]
            inside = owner[:size] == owner[n - 1 :]
            hashed = ((sums ^ (sums >> U(29))) * FACTORS[30] >> U(48)).astype(np.uint16)
            features.append(hashed[inside])
            owners.append(owner[:size][inside])
    return features, owners, len(low)


def counts_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and their counts, text by text."""
    for begin, end in slices(texts, GRAM_BYTES):
        features, owners, n = grams_of(texts.slice(begin, end - begin))
        bounds = [np.searchsorted(o, np.arange(n + 1)) for o in owners]
        for i in range(n):
            own = np.concatenate([f[b[i] : b[i + 1]] for f, b in zip(features, bounds)])
            found = np.bincount(own, minlength=DIMS)
            at = np.flatnonzero(found)
            yield at, found[at]


def document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one row for each feature it has met: in how many texts."""
    total = np.zeros(DIMS, np.int64)
    for batch in batches:
        for at, _ in counts_of(batch.column("text")):
            total[at] += 1
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["feature", "df"])


def sample_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(at.astype(np.uint16).tobytes(), n.astype(np.int32).tobytes()) for at, n in counts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("draw"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
            ["lang", "draw", "at", "n"],
        )


@dataclass
class Ftrl:
    """Follow the regularised leader for multinomial regression, one column per class."""

    classes: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1

    def __post_init__(self) -> None:
        self.z = np.zeros((DIMS + 1, self.classes))
        self.n = np.zeros((DIMS + 1, self.classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        """Weights of some features: exactly 0 while the gradients stay within the l1 penalty."""
        z, n = self.z[at], self.n[at]
        sparse = np.abs(z) <= self.l1
        return np.where(sparse, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[y] -= 1.0
        g = x[:, None] * error
        squared = g * g
        self.z[at] += g - (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += squared


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(logits / math.exp(log_t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    if not len(y):
        return 1.0
    low, high, step = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - step * (high - low), low + step * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


@dataclass
class Model:
    """Labels in order, weights per feature (IDF and temperature worked in) and the biases."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def logits(self, texts: pa.Array) -> np.ndarray:
        features, owners, n = grams_of(texts)
        sums, counts = np.zeros((n, len(self.labels))), np.zeros(n)
        for own, owner in zip(features, owners):
            counts += np.bincount(owner, minlength=n)
            for c in range(len(self.labels)):
                sums[:, c] += np.bincount(owner, weights=self.weights[:, c][own], minlength=n)
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> pa.Array:
        labels, scores = [], []
        for begin, end in slices(texts, GRAM_BYTES):
            p = softmax(self.logits(texts.slice(begin, end - begin)))
            best = p.argmax(axis=1)
            labels += [self.labels[i] for i in best]
            scores.append(p[np.arange(len(best)), best])
        return pa.StructArray.from_arrays(
            [pa.array(labels, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"]
        )


def fit(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 3, seed: int = 7
) -> Model | None:
    """A model from rows of text and lang (both not null); none without such rows.

    IDF counts every n-gram of every whole text given: tasks send one row per feature. Weights are
    learned from about ``per_language`` different whole texts per language, chosen by a hash of the
    text, of whose copies one is taken; the share CALIBRATION_SHARE of them sets the temperature
    instead. The sample is all that reaches the driver: at most 6 bytes for each different feature of a text.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select("text", "lang", F.xxhash64(F.lit(seed), "text").alias("draw"))
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("draw").alias("texts"))
    totals = {r["lang"]: r for r in per_lang.limit(MAX_LANGUAGES + 1).collect()}
    if not totals:
        return None
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    labels = sorted(totals)
    documents = sum(r["n"] for r in totals.values())
    df = np.zeros(DIMS, np.int64)
    per_task = rows.select("text").mapInArrow(document_frequencies, "feature int, df long")
    met = per_task.groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df[met["feature"].to_numpy()] = met["df"].to_numpy()
    idf = np.log((1 + documents) / (1 + df)) + 1

    share = F.lit(1.0)
    for lang, r in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / r["texts"]))).otherwise(share)
    chosen = rows.where((F.pmod("draw", F.lit(1 << 40)) / F.lit(float(1 << 40))) < share).dropDuplicates(["lang", "draw"])
    sample = chosen.mapInArrow(sample_features, "lang string, draw long, at binary, n binary").toArrow()
    rank = pc.sort_indices(sample, [("draw", "ascending"), ("lang", "ascending"), ("at", "ascending")]).to_numpy()
    y = np.array([labels.index(lang) for lang in sample["lang"].to_pylist()], int)[rank]

    def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Features of a sampled text and their values, made when asked for: they need far more room."""
        row = int(rank[i])
        at = np.frombuffer(sample["at"][row].as_buffer(), np.uint16).astype(np.int64)
        n = np.frombuffer(sample["n"][row].as_buffer(), np.int32)
        return np.append(at, DIMS), np.append(SCALE * n / max(1, n.sum()) * idf[at], 1.0)

    held = max(1, int(len(y) * CALIBRATION_SHARE)) if len(y) >= 10 else 0
    learner = Ftrl(len(labels))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y) - held) + held:
            learner.learn(*vector(int(i)), y[i])
    weights = learner.weights(np.arange(DIMS + 1))
    logits = np.array([x @ weights[at] for at, x in map(vector, range(held))]).reshape(held, len(labels))
    t = temperature(logits, y[:held])
    del sample, vector
    pa.default_memory_pool().release_unused()  # the driver goes on with other stages
    return Model(labels, SCALE * idf[:, None] * weights[:DIMS] / t, weights[DIMS] / t)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def language(text: Column, model: Model | None, spark) -> Column:
    """Struct of lang and score (the calibrated probability); ``und`` with 0 where no letter is."""
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return none
    shared = bounded_batches(spark).sparkContext.broadcast((model.labels, model.weights, model.bias))

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(*shared.value)
        for part in parts:
            yield known.predict(part)

    return F.when(has_letter(text), predicted(text)).otherwise(none)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model | None:
    """``fit`` on the rows that are not held out, have a language and at least one letter."""
    text = F.col(text_col).cast("string")
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & has_letter(text))
    return fit(known.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang")), **options)


def identify(
    docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Without a ``model``, one is learned from the text and language of the rows of ``docs`` that are
    not held out (crc32 of the id as text, modulo 4, is not 2; a null id counts as empty text). A
    prediction sees nothing but the text, all of it. Null texts and texts without a letter, and all
    texts when there is nothing to learn from, are ``und`` with score 0.
    """
    model = model or learn(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        language(F.col("text"), model, docs.sparkSession).alias("found"),
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def in_known_language(
    docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is found with a score of ``least``.

    What goes are texts without a letter and texts for which no language has that probability.
    """
    model = learn(docs, id_col, text_col, lang_col)
    found = language(F.col(text_col).cast("string"), model, docs.sparkSession)
    return docs.where(found["score"] >= least)
