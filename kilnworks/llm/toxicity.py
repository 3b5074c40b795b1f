"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Learning: of the labelled rows, `rows` at most (those of least hash of the id, so the choice is stable) are fetched;
tasks count in how many texts of either label each n-gram stands; the `features` n-grams whose log-count ratio is
surest (largest against its standard error) are kept; a logistic regression with L2 penalty is fitted on
presence * ratio. The sample and the features are bounded by those two parameters, so the fit takes place on the
driver and the model is some hundred KB.

Scoring reads whole texts: n-grams of 4, 5 and 6 characters of the lower-case text, in which all ASCII but letters
and digits counts as space, are looked up by 64-bit hash in a table, each counted once for a text.

Edge cases: null and empty texts get the score of the intercept; labels other than 0 and 1, null ids of labels and
labels without a document are left out; an id with several labels or texts contributes each; without labels of both
kinds every score is the share of label 1 (0.5 without labels); other columns pass through, and one named like the
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.bytetext import mix
from kilnworks.llm.scratch import cut

ROWS = 20_000
FEATURES = 8_192
ORDERS = (4, 5, 6)
PENALTY = 2.0
STEPS = 250
_BLOCK = 1 << 20
_PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[k for k in range(128) if not chr(k).isalnum()]] = 0x20


@dataclass(frozen=True)
class Model:
    """Hashes of the kept n-grams in ascending order, their log-count ratios and weights, and the intercept."""

    grams: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    intercept: float


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, code points, lengths) of runs of texts, each lower-cased and set between spaces."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(f" {(t or '').lower()} ")
        size += len(held[-1])
        if size >= _BLOCK or k == len(texts) - 1:
            points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield first, k + 1, np.where(points < 128, _PLAIN[np.minimum(points, 127)], points), np.array(list(map(len, held)))
            first, held, size = k + 1, [], 0


def _grams(points: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hash of the n-gram at each position where it ends inside its text, and the text's number."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    wide = points.astype(np.uint64)
    total = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        total[: len(points) - n + 1] += wide[n - 1 :] * _PLACES[n - 1]
        if n in ORDERS:
            fits = left >= n
            yield mix(total[fits] + np.uint64(n)), doc[fits]


def _presence(texts: list[str | None], grams: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, text number, feature) of the distinct features of each text; texts are numbered from first."""
    bits = 20
    table = np.zeros(1 << bits, dtype=bool)
    table[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
    for first, last, points, lengths in _blocks(texts):
        found = []
        for h, doc in _grams(points, lengths):
            maybe = table[(h >> np.uint64(64 - bits)).astype(np.int64)]
            h, doc = h[maybe], doc[maybe]
            spot = np.minimum(np.searchsorted(grams, h), max(len(grams) - 1, 0))
            hit = grams[spot] == h if len(grams) else np.zeros(len(h), bool)
            found.append(doc[hit] * max(len(grams), 1) + spot[hit])
        both = np.unique(np.concatenate(found))
        yield first, last, both // max(len(grams), 1), both % max(len(grams), 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, label and the number of texts that hold the n-gram, for each 4 million or so of them."""
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for label, parts in held.items():
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), label, np.int32)), pa.array(n.astype(np.int64))], names=["h", "label", "n"])
                parts.clear()

    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=np.int64)
        for first, _, points, lengths in _blocks(texts):
            for h, doc in _grams(points, lengths):
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, label = h[new], labels[first + doc[new]]
                for k in (0, 1):
                    held[k].append(h[label == k])
                size += len(h)
            if size >= 1 << 22:
                yield from flush()
                size = 0
    yield from flush()


def fit_weights(docs: np.ndarray, features: np.ndarray, ratio: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression on presence * ratio by full-batch gradient steps with moments (Adam), penalised by L2."""
    rows, width = len(labels), len(ratio)
    values = ratio[features]
    w, b = np.zeros(width), float(np.log((labels.mean() + 1e-9) / (1 - labels.mean() + 1e-9)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(docs, weights=w[features] * values, minlength=rows) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(features, weights=err[docs] * values, minlength=width) + penalty * w, err.sum()) / rows
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.03 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS, features: int = FEATURES) -> Model:
    """A model from `rows` labelled ids at most, and `rows` of the texts that they have, those of least hash."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    known = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("text", "label", F.xxhash64("_id", "text", "label").alias("key"))
    known = cut(known, "labelled")  # the corpus is read once for all that follows
    if known.count() > rows:  # ids that repeat bring more texts: keep those of least hash, of rows that are all alike any
        last = known.select("key").orderBy("key").limit(rows).agg(F.max("key")).first()[0]  # keys alone are sorted
        known = known.filter(F.col("key") < last).unionByName(known.filter(F.col("key") == last).limit(1))
        known = cut(known, "known")
    known = known.select("text", "label")
    counts = known.mapInArrow(_count, "h long, label int, n long")
    by_gram = counts.groupBy("h").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"))
    texts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    none = np.zeros(0)
    if not texts.get(0) or not texts.get(1):
        share = min(max(texts.get(1, 0) / max(sum(texts.values()), 1), 1e-6), 1 - 1e-6) if texts else 0.5
        return Model(none.astype(np.uint64), none, none, float(np.log(share / (1 - share))))
    ratio = F.log((F.col("p") + 1) / (texts[1] + 2)) - F.log((F.col("q") + 1) / (texts[0] + 2))
    sure = F.abs(ratio) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    top = by_gram.select("h", ratio.alias("r"), sure.alias("sure")).orderBy(F.desc("sure"), "h").limit(features).collect()
    grams, r = np.array([x[0] for x in top], dtype=np.int64).view(np.uint64), np.array([x[1] for x in top])
    order = np.argsort(grams)
    grams, r = grams[order], r[order]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            for first, last, doc, feature in _presence(batch.column(0).to_pylist(), grams):
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                lists = [feature[cut[k] : cut[k + 1]].astype(np.int32) for k in range(last - first)]
                yield pa.RecordBatch.from_arrays([pa.array(given[first:last], pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["label", "features"])

    # Bounded by rows * features, in truth by the few hundred kept n-grams that stand in a text.
    sample = known.mapInArrow(present, "label int, features array<int>").toArrow()
    lists = sample.column("features").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    y = sample.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((lengths, y))  # sums don't depend on the order in which tasks end
    doc = np.repeat(np.argsort(order), lengths)
    w, b = fit_weights(doc, lists.values.to_numpy().astype(np.int64), r, y[order])
    return Model(grams, r, w, b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, model.ratio * model.weight, model.intercept))

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams, value, intercept = shared.value
        for texts in parts:
            z = np.full(len(texts), intercept)
            for first, last, doc, feature in _presence(texts.tolist(), grams):
                z[first:last] += np.bincount(doc, weights=value[feature] if len(value) else None, minlength=last - first)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return docs.withColumn(out, probability(F.col(text)))
