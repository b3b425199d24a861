"""A quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallybook.llm.common import by_value, columns_of, free_name, map_batches
from tallybook.session import materialize

BINS = 12
FEATURES = 13
_CLASSES = np.full(256, 5)
for _class, _members in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"-()?")):
    _CLASSES[list(_members)] = _class
_CLASSES[128:] = 6


def features(text: str | None) -> list[float]:
    """Shares and ratios of a whole text; empty texts are all zero."""
    raw = text.encode() if text else b""
    words = raw.lower().split()
    if not words:
        return [0.0] * FEATURES
    lower, upper, digits, blanks, points, signs, others = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=7).tolist()
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = raw.split(b"\n")
    pairs = list(zip(words, words[1:], strict=False))
    return [
        upper / max(1, upper + lower), digits / size, blanks / size, points / size, signs / size, others / size,
        len(counts) / n ** 0.8, max(counts.values()) / n, len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / n, sum(map(len, words)) / n, len(set(lines)) / len(lines), float(np.log(n)),
    ]


@dataclass
class Evidence:
    """Log odds of good against bad: each feature's bin has a weight."""

    borders: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS, and one for the constant at the end
    prior: float  # share of good documents in the sample

    def log_ratio(self, rows: np.ndarray) -> np.ndarray:
        """Evidence of documents, the sample's prior odds taken out."""
        places = np.stack([np.searchsorted(b, rows[:, i], side="right") for i, b in enumerate(self.borders)], 1)
        score = self.weights[:-1].reshape(len(self.borders), BINS)[np.arange(len(self.borders)), places].sum(1) + self.weights[-1]
        return np.clip(score - np.log(self.prior / (1 - self.prior)), -30, 30)


def train(rows: np.ndarray, good: np.ndarray, ridge: float = 1.0) -> Evidence:
    """Logistic regression on binned features, by Newton's method on a bounded sample."""
    if len(rows) == 0:
        rows, good = np.zeros((2, FEATURES)), np.array([0.0, 1.0])
    borders = np.quantile(rows, np.arange(1, BINS) / BINS, axis=0).T
    places = np.stack([np.searchsorted(b, rows[:, i], side="right") for i, b in enumerate(borders)], 1)
    x = np.zeros((len(rows), len(borders) * BINS + 1))
    for i in range(len(borders)):
        x[np.arange(len(rows)), i * BINS + places[:, i]] = 1
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (good - p) - ridge * w)
    return Evidence(borders, w, float((good.sum() + 1) / (len(good) + 2)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Evidence:
    """Fit on about ``sample`` labelled documents (doc_id, text; doc_id, quality), by hash of the id.

    Fewer labelled documents are all used.  Labels without quality or id teach nothing.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))
    chosen = known.where(share).limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("good")], names=["features", "good"])

    got = map_batches(rows.select("text", (F.col("quality") > 0).cast("double").alias("good")), work, "features array<double>, good double").toArrow()
    table = np.array(got.column("features").to_pylist()).reshape(-1, FEATURES)
    good = got.column("good").to_numpy()
    order = np.lexsort((good, *table.T)) if len(table) else []
    return train(table[order], good[order])


def with_evidence(docs: DataFrame, evidence: Evidence, name: str = "log_ratio") -> DataFrame:
    """The same columns (text among them) and ``name``, in one pass over whole texts."""
    shared = by_value(docs, evidence)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = shared()
        for batch in batches:
            rows = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            scores = evidence.log_ratio(rows) if len(rows) else np.zeros(0)
            yield batch.append_column(pa.field(name, pa.float64()), pa.array(scores, pa.float64()))

    return map_batches(docs, work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def _key(*columns: Column) -> Column:
    """A text that is null-safe: null and "null" differ."""
    return F.concat_ws("\x1f", *[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string"))) for c in columns])


def site_rates(scored: DataFrame, prior: float) -> DataFrame:
    """(host, path) with ``rate``: the share of good documents, shrunken twice.

    ``scored`` has (host, path, p), p a document's chance to be good.  A host's rate is
    shrunk toward the global rate, a path's toward its host's, each by a strength that is
    estimated from how much the groups differ beyond chance (method of moments).  Sums per
    path are taken first (partial sums before the shuffle), all else is on that table.
    """
    # Written: all that follows reads this table, and the texts are read once for it.
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    rate = F.sum("host_good") / F.sum("host_n")
    total = hosts.agg(
        rate.alias("rate"),
        # Beta-binomial moments: spread of the groups' rates, less what chance makes.
        F.sum(F.col("host_good") * F.col("host_good") / F.col("host_n")).alias("squares"),
        F.sum("host_n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("host_n") * F.col("host_n")).alias("n2")).first()
    mean = min(max(total["rate"] if total["rate"] is not None else prior, 1e-4), 1 - 1e-4)
    strength = _strength(mean, total)
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + strength * mean) / (F.col("host_n") + strength))
    inside = paths.join(hosts.select("host", "host_rate"), "host")
    spread = inside.agg(
        F.sum(F.pow(F.col("good") / F.col("n") - F.col("host_rate"), 2) * F.col("n")).alias("s"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).first()
    between = max(0.0, ((spread["s"] or 0) - (spread["groups"] or 0) * mean * (1 - mean)) / max(1, spread["n"] or 1))
    own = min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6
    return inside.select("host", "path", ((F.col("good") + own * F.col("host_rate")) / (F.col("n") + own)).alias("rate"))


def _strength(mean: float, total) -> float:
    if not total["n"] or total["groups"] < 2:
        return 1e6
    within = total["groups"] * mean * (1 - mean)
    between = (total["squares"] - total["n"] * mean * mean - within) / max(1.0, total["n"] - total["n2"] / total["n"])
    return min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = 20_000, least: float = 0.5) -> DataFrame:
    """The given columns and ``quality_score``, ``quality_kept``.

    A document's evidence (log odds of its features) is added to the log odds of its path's
    rate of good documents.  Documents below ``least`` are rejected.  The text is read
    twice, whole: once for the rates, once for the result; the table of rates has a row a
    path and is joined.  Null hosts and paths are groups of their own; null and empty texts
    have the evidence of empty texts; repeated rows get the same result; without labels all
    evidence is neutral.  Where a given column has the name of an added one, the added one
    gets underscores before its name; given columns are never changed.
    """
    evidence = fit(docs, labels, sample)
    prior = float(np.log(evidence.prior / (1 - evidence.prior)))
    host_key, path_key = _key(F.col(host)), _key(F.col(host), F.col(path))
    narrow = with_evidence(docs.select("text", host, path), evidence).select(
        host_key.alias("host"), path_key.alias("path"), (1 / (1 + F.exp(-(F.col("log_ratio") + prior)))).alias("p"))
    # Written, so that Spark knows the table's size when it chooses how to join it.
    at, found = free_name(docs, "path_key"), free_name(docs, "path_rate")
    rates = materialize(site_rates(narrow, evidence.prior).select(F.col("path").alias(at), F.col("rate").alias(found)))
    ratio = free_name(docs, "log_ratio")
    rows = with_evidence(docs, evidence, ratio).withColumn(at, path_key).join(rates, at)
    rate = F.least(F.greatest(F.col(found), F.lit(1e-4)), F.lit(1 - 1e-4))
    score = 1 / (1 + F.exp(-(F.col(ratio) + F.log(rate / (1 - rate)))))
    name = free_name(docs, "quality_score")
    return rows.select(*columns_of(docs), score.alias(name)).withColumn(free_name(docs, "quality_kept"), F.col(name) >= least)
