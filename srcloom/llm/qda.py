"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics. Over every labelled training row (no sample) Spark adds up, in turn, the
sums that standardise the statistics, counts, sums and products of the standardised vectors by class, and the log loss at each
of a few temperatures; the driver sees two matrices of fixed size and nothing that grows with the data. The covariances are
shrunk towards the pooled one and its diagonal; a score is the logistic of the difference of the classes' log densities,
computed from cached Cholesky factors and divided by the temperature of least loss, plus the log prior odds.

Edge cases: null and empty texts have the statistics of the empty text and are scored like any other; labels that are null
or other than 0 and 1 are ignored; several labels of one document each count; with fewer than two classes in training every
score is 0.5 (an empty training set) or the class itself; a null doc_id is never held out nor labelled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, crc_bucket, materialise

NAMES = (
    "log_words mean_len sd_len symbols upper digits bang pipes log_lines words_per_line dup_lines distinct top_word "
    "adjacent ends capital other_bytes entropy repeats long_words"
).split()
SHRINK_POOLED = 0.15
SHRINK_DIAGONAL = 0.05
#: Standardised statistics are held within these bounds, in training and scoring alike.
BOUND = 5.0
#: What log density differences may be divided by (statistics of one text aren't independent); that of least training loss is taken.
TEMPERATURES = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)
THRESHOLD = 0.3
FOLDS = 5
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    p = hist[hist > 0] / size
    lens = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if n:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        counts = np.bincount(w)
        pairs = np.unique(w[:-1] * len(ids) + w[1:]).size if n > 1 else 0
        distinct, top, adjacent, repeats = len(ids) / n, counts.max() / n, float((w[1:] == w[:-1]).sum()) / n, 1 - pairs / max(1, n - 1)
    else:
        distinct = top = adjacent = repeats = 0.0
    share = lambda c, of=size: float(np.sqrt(c / of))
    return [
        float(np.log1p(n)), float(np.log1p(lens.mean())), float(np.log1p(lens.std())),
        share(hist[_SYMBOLS].sum()), share(hist[65:91].sum(), letters), share(hist[48:58].sum()), share(hist[33]), share(hist[124]),
        float(np.log1p(len(lines))), float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),
        distinct * float(np.log1p(n)) / 5, float(np.sqrt(top)), float(np.sqrt(adjacent)),
        share(sum(x[-1] in b".,!?;:" for x in words), max(1, n)), share(sum(65 <= x[0] <= 90 for x in words), max(1, n)),
        share(hist[128:].sum()), float(-(p * np.log2(p)).sum()), float(np.sqrt(max(0.0, repeats))), share((lens > 15).sum(), max(1, n)),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x): the statistics of every row."""
    batched(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["id", "x"])

    return src.mapInArrow(run, "id long, x array<double>").withColumnRenamed("id", id_col)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.values if hasattr(column, "values") else column.combine_chunks().values, np.float64).reshape(len(column), len(NAMES))


def _partial(change):
    """A mapInArrow function: over a partition, rows (label, position, value) of the products of (1, change(x)) by class."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = np.hstack([np.ones((b.num_rows, 1)), change(_matrix(b.column(1)))])
                y = b.column(0).to_numpy(zero_copy_only=False)
                for c in np.unique(y).tolist():
                    total[c] = total.get(c, 0.0) + x[y == c].T @ x[y == c]
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, c), pa.int32()), pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], ["label", "at", "value"])

    return run


def _sums(rows: DataFrame, change) -> dict[int, np.ndarray]:
    """The products of (1, change(x)) by class, added up over all rows."""
    sums = rows.mapInArrow(_partial(change), "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    d = len(NAMES) + 1
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():  # 2 (d + 1)^2 rows at most
        found.setdefault(r["label"], np.zeros(d * d))[r["at"]] = r["value"]
    return {c: v.reshape(d, d) for c, v in found.items()}


class Scale:
    """Standardises statistics and holds them within BOUND."""

    def __init__(self, sums: dict[int, np.ndarray]):
        every = sum(sums.values())
        n = every[0, 0]
        self.center = every[0, 1:] / n
        self.scale = np.sqrt(np.maximum(np.diag(every)[1:] / n - self.center**2, 1e-4))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -BOUND, BOUND)


class Model:
    """Means, Cholesky factors (as inverses) and log determinants of both classes, from products of standardised statistics."""

    def __init__(self, sums: dict[int, np.ndarray], scale: Scale | None = None, temperature: float = 1.0):
        self.scale, self.temperature = scale, temperature
        self.only = None if len(sums) == 2 else (list(sums) or [0.5])[0]
        if self.only is not None:
            return
        n = sum(m[0, 0] for m in sums.values())
        means = {c: m[0, 1:] / m[0, 0] for c, m in sums.items()}
        covs = {c: m[1:, 1:] / m[0, 0] - np.outer(means[c], means[c]) for c, m in sums.items()}
        pooled = sum(sums[c][0, 0] * covs[c] for c in sums) / n
        self.parts = {}
        for c, cov in covs.items():
            cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
            cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(pooled) + 0.05) + 1e-3 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts[c] = (means[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())
        self.prior = float(np.log(sums[1][0, 0] / sums[0][0, 0]))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = self.scale(x)
        density = {c: -0.5 * ((((z - mu) @ inverse.T) ** 2).sum(axis=1) + logdet) for c, (mu, inverse, logdet) in self.parts.items()}
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), float(self.only))
        return 1 / (1 + np.exp(-np.clip(self.prior + self.difference(x) / self.temperature, -30, 30)))


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """The model at the temperature of least log loss over rows, the first of equals."""

    def run(batches):
        loss = np.zeros(len(TEMPERATURES))
        for b in batches:
            if b.num_rows:
                y, d = b.column(0).to_numpy(zero_copy_only=False), model.difference(_matrix(b.column(1)))
                odds = np.clip(model.prior + d[:, None] / np.array(TEMPERATURES), -30, 30)
                loss += np.log1p(np.exp(np.where(y[:, None] == 1, -odds, odds))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(loss)), pa.int32()), pa.array(loss)], ["at", "loss"])

    total = {r["at"]: r["loss"] for r in rows.mapInArrow(run, "at int, loss double").groupBy("at").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = TEMPERATURES[min(total, key=lambda k: (total[k], k))]
    return model


def fit(rows: DataFrame) -> Model:
    """rows: (label 0 or 1, x)."""
    rows = rows.select(F.col("label").cast("int"), "x")
    raw = _sums(rows, _same)
    if len(raw) < 2:
        return Model(raw)
    scale = Scale(raw)
    return _calibrated(rows, Model(_sums(rows, scale), scale))


def _same(x: np.ndarray) -> np.ndarray:
    return x


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted. Trains on rows whose crc32 of the id is no multiple of folds."""
    x = materialise(features(docs, id_col, text_col), "features")
    held = F.coalesce(crc_bucket(F.col(id_col), folds) == 0, F.lit(False))
    marked = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    train = materialise(x.filter(~held).join(marked, id_col).select("label", "x"), "labelled")
    model = fit(train)

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["id", "score"])

    scored = x.select(F.col(id_col).alias("id"), "x").mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
