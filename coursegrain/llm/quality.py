"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes FEATURES transformed statistics. The labelled training rows give each
class a mean and a covariance, summed in Spark; a covariance is shrunk towards the pooled
diagonal. A score is the logistic of the difference of the two log densities, each from a
Mahalanobis distance by the Cholesky factor of its class, which is computed once and sent
with the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, table, text_or_empty, written

SHRINK = 0.05
FLOOR = 1e-4
HELD_OUT = 1
#: Labelled rows that keep_good fits on, about, where there are more; their ids are broadcast.
FIT_ROWS = 200_000
FOLDS = 3

_SYMBOLS = np.frombuffer(b"#$%&*@^~_=+<>\\/{}[]", np.uint8)
_STOPS = np.frombuffer(b".,;:!?", np.uint8)
NAMES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "stops", "bars", "bangs",
    "line_ends", "spaces", "non_ascii", "distinct_words", "distinct_lines", "entropy", "symbol_words", "upper_words",
]
FEATURES = len(NAMES)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text; an empty text has zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(raw, minlength=256)
    words = text.split()
    lines = text.split("\n")
    share = lambda k: float(np.sqrt(k / n))  # noqa: E731  square roots even out the spread of small shares
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    lengths = (edges[1::2] - edges[::2]) if len(edges) else np.zeros(1)
    p = counts[counts > 0] / n
    last = raw[edges[1::2] - 1] if len(edges) else raw[:0]
    first = raw[edges[::2]] if len(edges) else raw[:0]
    second = raw[np.minimum(edges[::2] + 1, n - 1)] if len(edges) else raw[:0]
    w = max(1, len(lengths))
    return [
        float(np.log1p(n)) / 4, float(np.log1p(len(words))) / 4, float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        share(counts[65:91].sum()), share(counts[48:58].sum()), share(counts[_SYMBOLS].sum()), share(counts[_STOPS].sum()), share(counts[124]), share(counts[33]),
        share(counts[10]), share(counts[32]), share(counts[128:].sum()), len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), float(-(p * np.log(p)).sum()),
        float(np.sqrt(np.isin(last, _SYMBOLS).sum() / w)), float(np.sqrt((((first >= 65) & (first <= 90)) & ((second >= 65) & (second <= 90))).sum() / w)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each whole text; null and empty texts have zeros.

    One row for each row of docs, repeated or not; columns other than doc_id and text are not
    looked at; an empty table has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a partition: count, sums and sums of products, as place and value."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False)
        x = b.column(1).flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, FEATURES))
        for c in np.unique(y):
            own = x[y == c]
            s = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            sums[int(c)] = sums.get(int(c), 0) + s
    for c, s in sums.items():
        yield pa.record_batch([pa.array(np.full(len(s), c, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], names=["label", "place", "value"])


class Discriminant:
    """The two classes' means, Cholesky factors and priors."""

    def __init__(self, moments: dict[int, np.ndarray], shrink: float = SHRINK):
        d = FEATURES
        self.count = {c: float(m[0]) for c, m in moments.items() if m[0] > 0}
        self.only = next(iter(self.count)) if len(self.count) == 1 else None
        self.parts = {}
        if len(self.count) < 2:
            return
        mean = {c: moments[c][1 : d + 1] / n for c, n in self.count.items()}
        scatter = {c: moments[c][d + 1 :].reshape(d, d) - n * np.outer(mean[c], mean[c]) for c, n in self.count.items()}
        total = sum(self.count.values())
        pooled = np.diag(np.maximum(np.diag(sum(scatter.values())) / total, 0) + FLOOR)
        for c, n in self.count.items():
            a = max(shrink, d / (d + n))  # a class of few rows leans on the pooled spread
            cov = (1 - a) * scatter[c] / n + a * pooled
            low = np.linalg.cholesky((cov + cov.T) / 2)
            self.parts[c] = (mean[c], np.linalg.inv(low), float(np.log(np.diag(low)).sum()), float(np.log(n / total)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0.5 without training rows; 1 or 0 if all of them have one label."""
        if not self.parts:
            return np.full(len(x), 0.5 if self.only is None else float(self.only))
        log = {}
        for c, (mean, inverse, half_det, prior) in self.parts.items():
            z = (x - mean) @ inverse.T
            log[c] = prior - half_det - 0.5 * (z * z).sum(1)
        # Divided by the number of features so that far scores keep an order of their own.
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / FEATURES, -500, 500)))


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label (0 or 1), one row for each doc_id.

    Labels that are null or neither 0 nor 1, and those of a doc_id that has both, are left out."""
    known = labels.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("most"))
    return known.filter("label = most").select("doc_id", "label")


def fit(x: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """From features (doc_id, x) and labels (doc_id, label): all labelled rows count, repeated ones as often.

    Other columns are not looked at; without labelled rows all scores are 0.5."""
    rows = x.select("doc_id", "x").join(usable_labels(labels), "doc_id").select("label", "x").mapInArrow(_moments, "label int, place int, value double")
    moments: dict[int, np.ndarray] = {}
    for r in rows.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():  # two classes, FEATURES squared sums
        moments.setdefault(r["label"], np.zeros(1 + FEATURES + FEATURES**2))[r["place"]] = r["value"]
    return Discriminant(moments, shrink)


def score(x: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score for each row of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            rows = b.column(1).flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, FEATURES))
            yield pa.record_batch([b.column(0), pa.array(model.scores(rows))], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def labelled_documents(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that have a usable label; of more than most labels, about most, drawn by a hash.

    So the broadcast of ids is bounded, and no text is shuffled."""
    known = written(usable_labels(labels).select("doc_id"), "labelled")
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    return docs.join(F.broadcast(known), "doc_id", "left_semi")


def keep_good(docs: DataFrame, labels: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """The rows of docs, with all columns, that a model of its labelled ones scores 0.5 or more.

    Null texts are scored as empty ones; repeated rows are scored alike; an empty table has no
    rows. Statistics are taken of the labelled rows for the fit, and of all rows as they are
    scored."""
    model = fit(features(labelled_documents(docs, labels)), labels, shrink)
    columns = docs.columns
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(place).to_pylist()]).reshape(b.num_rows, FEATURES)
            yield b.filter(pa.array(model.scores(x) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learnt from."""
    labels = table(spark, sf_dir, "labels")
    return labels.filter(id_crc(F.col("doc_id")) % FOLDS != HELD_OUT).select("doc_id", F.col("quality").alias("label"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a model of all training labels."""
    x = written(features(table(spark, sf_dir, "documents")), "quality-features")
    scored = score(x, fit(x, training_labels(spark, sf_dir)))
    held = F.coalesce(id_crc(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
