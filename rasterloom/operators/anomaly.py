"""Isolation forest, reconstruction errors, thresholds, splits, training control."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that trees are grown from: those with the smallest hash of the id.
POOL = 8_192

#: Spread of a column, relative to its values, that counts as none.
ROUNDING = 1e-12


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


class IsolationForest:
    """Random trees on samples of a bounded pool; a node is (dimension, cut, left, right) or a leaf with its depth."""

    def __init__(self, df: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42, pool: int = POOL):
        rows = df.select("id", "x").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pool).collect()
        x = np.array([r[1] for r in rows], dtype=float)
        self.sample = min(sample, len(x))
        rng = np.random.default_rng(seed)
        deep = int(np.ceil(np.log2(max(2, self.sample))))
        self.trees = [self._grow(x[rng.choice(len(x), self.sample, replace=False)], deep, rng) for _ in range(trees)] if len(x) else []

    @staticmethod
    def _grow(x: np.ndarray, deep: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        dim, cut, left, right, depth = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            me = len(dim)
            for column in (dim, cut, left, right, depth):
                column.append(0)
            low, high = rows.min(0), rows.max(0)
            wide = np.flatnonzero(high - low > ROUNDING * np.maximum(np.abs(low), np.abs(high)))  # rounding noise makes no cut
            if level >= deep or len(rows) <= 1 or not len(wide):
                dim[me], depth[me] = -1, level + average_path(len(rows))
                return me
            k = int(rng.choice(wide))
            # in (low, high], so that neither side is empty
            at = max(high[k] - rng.random() * (high[k] - low[k]), np.nextafter(low[k], np.inf))
            below = rows[:, k] < at
            dim[me], cut[me] = k, at
            left[me] = node(rows[below], level + 1)
            right[me] = node(rows[~below], level + 1)
            return me

        node(x, 0)
        return np.array(dim), np.array(cut, dtype=float), np.array(left), np.array(right), np.array(depth, dtype=float)

    def depths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for dim, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = np.flatnonzero(dim[at] >= 0)
                if not len(inner):
                    break
                k = at[inner]
                at[inner] = np.where(x[inner, dim[k]] < cut[k], left[k], right[k])
            total += depth[at]
        return total / max(1, len(self.trees))

    def scores(self, df: DataFrame) -> DataFrame:
        """id, score in (0, 1]: 2 ^ (-mean depth / expected depth); higher is more isolated."""
        scale = average_path(self.sample) or 1.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(1).to_pylist(), dtype=float)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2.0 ** (-self.depths(x) / scale))], ["id", "score"])

        return df.select("id", "x").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, score double")


def impute(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """id and x: the columns in order, null and NaN replaced by a value."""
    return df.select("id", F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(value)) for c in columns]).alias("x"))


def exact_percentile(df: DataFrame, column: str, q: float, few: int = 50_000) -> float | None:
    """Percentile with linear interpolation, exact at any size.

    Approximate quantiles bracket the two ranks, counts below the bracket place them, and only the values inside the
    bracket, a few at most, are sorted on the driver.
    """
    v = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = v.count()
    if n == 0:
        return None
    rank = (n - 1) * q
    lo, hi = int(np.floor(rank)), int(np.ceil(rank))
    if n <= few:
        values = sorted(r[0] for r in v.collect())
        a, b = values[lo], values[hi]
    else:
        def value_at(k: int) -> float:
            error = few / n / 8
            low, high = v.approxQuantile("v", [max(0.0, k / n - 2 * error), min(1.0, k / n + 2 * error)], error)
            below = v.filter(F.col("v") < low).count()
            inside = v.filter(F.col("v").between(low, high)).groupBy("v").count().orderBy("v").limit(few).collect()
            for value, c in inside:
                below += c
                if below > k:
                    return float(value)
            return float(high)

        a, b = value_at(lo), value_at(hi) if hi != lo else None
        b = a if b is None else b
    return a + (b - a) * (rank - lo)


def contamination_cut(scored: DataFrame, contamination: float = 0.2, score: str = "score") -> DataFrame:
    """Adds pred: -1 (outlier) above the 1 - contamination percentile of the score, else 1."""
    cut = exact_percentile(scored, score, 1.0 - contamination)
    return scored.withColumn("pred", F.when(F.col(score) > F.lit(cut), -1).otherwise(1))


def clean_or_noisy(pred: Column) -> Column:
    return F.when(pred == 1, "clean").otherwise("noisy")


def split_seeded(df: DataFrame, share: float, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Adds split: the first floor(n * share) rows in the order of md5(id, seed) are train, the others validation.

    The border is found by counting hash prefixes; only rows of the border's own prefix are ranked.
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    rows = df.withColumn("_h", h)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.substring("_h", 1, 3).alias("p")).count().collect())  # 4096 at most
    left = int(np.floor(sum(c for _, c in counts) * share))
    for prefix, c in counts:
        if left < c:
            border = rows.filter(F.substring("_h", 1, 3) == prefix).select("_h", id_col).orderBy("_h", id_col).limit(left + 1).collect()
            cut = border[left]
            train = (F.col("_h") < cut[0]) | ((F.col("_h") == cut[0]) & (F.col(id_col) < cut[1]))
            break
        left -= c
    else:
        train = F.lit(True)
    return rows.withColumn("split", F.when(train, "train").otherwise("val")).drop("_h")


def mean_image_errors(train: DataFrame, df: DataFrame) -> DataFrame:
    """id, error: mean squared difference from the mean of the training vectors."""
    m = train.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("m")).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("s"))
    square = F.zip_with("x", "s", lambda v, q: (v - q["m"]) * (v - q["m"]))
    return df.crossJoin(F.broadcast(m)).select("id", (F.aggregate(square, F.lit(0.0), lambda a, v: a + v) / F.size("x")).alias("error"))


def spread_threshold(errors: DataFrame, k: float = 3.0) -> DataFrame:
    """threshold: mean + k population deviations, one row."""
    return errors.agg((F.avg("error") + k * F.stddev_pop("error")).alias("threshold"))


def classify(errors: DataFrame, threshold: DataFrame) -> DataFrame:
    """Adds threshold and label: normal below it, anomalous else."""
    return errors.crossJoin(F.broadcast(threshold)).withColumn("label", F.when(F.col("error") < F.col("threshold"), "normal").otherwise("anomalous"))


def filter_stats(classified: DataFrame) -> DataFrame:
    n = lambda name: F.sum(F.when(F.col("label") == name, 1).otherwise(0)).alias(name)
    return classified.agg(F.count("*").alias("total"), n("normal"), n("anomalous"))


def histogram(errors: DataFrame, bins: int = 50) -> DataFrame:
    """bin (from 0), n of equal-width bins from the smallest to the largest error, the last one closed on both sides."""
    r = errors.agg(F.min("error").alias("low"), F.max("error").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("error") - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0)
    return errors.crossJoin(F.broadcast(r)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def binary_metrics(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """n, accuracy, precision, recall, f1 of class 1; 0 where a denominator is 0."""
    c = lambda t, p: F.sum(F.when((F.col(truth) == t) & (F.col(prediction) == p), 1).otherwise(0))
    s = df.agg(F.count("*").alias("n"), c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return s.select("n", over(tp + tn, tp + fp + fn + tn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def early_stop(losses: DataFrame, patience: int = 5, delta: float = 0.0) -> DataFrame:
    """epoch, loss, best, waited, improved up to and with the epoch that stops: no improvement by more than delta for
    ``patience`` epochs.  losses: epoch, loss of one run (a short, ordered curve in one row)."""
    curve = losses.agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("curve"))
    kind = "struct<best:double,waited:int,done:boolean,rows:array<struct<epoch:int,loss:double,best:double,waited:int,improved:boolean>>>"
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(False).alias("done"), F.array().alias("rows")).cast(kind)

    def step(s: Column, e: Column) -> Column:
        better = e["loss"] < s["best"] - delta
        best, waited = F.when(better, e["loss"]).otherwise(s["best"]), F.when(better, 0).otherwise(s["waited"] + 1)
        row = F.struct(e["epoch"].cast("int").alias("epoch"), e["loss"].alias("loss"), best.alias("best"), waited.alias("waited"), better.alias("improved"))
        return F.when(s["done"], s).otherwise(F.struct(best.alias("best"), waited.alias("waited"), (waited >= patience).alias("done"), F.concat(s["rows"], F.array(row)).alias("rows")).cast(kind))

    return curve.select(F.inline(F.aggregate("curve", start, step, lambda s: s["rows"])))


def plateau_lr(losses: DataFrame, rate: float = 0.001, factor: float = 0.5, patience: int = 3) -> DataFrame:
    """epoch, lr after each epoch: the rate is cut by the factor whenever the loss has not improved for more than ``patience``
    epochs, and the count starts again."""
    curve = losses.agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("curve"))
    kind = "struct<best:double,waited:int,lr:double,rows:array<struct<epoch:int,lr:double>>>"
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(rate).alias("lr"), F.array().alias("rows")).cast(kind)

    def step(s: Column, e: Column) -> Column:
        better = e["loss"] < s["best"]
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        cut = waited > patience
        lr = F.when(cut, s["lr"] * factor).otherwise(s["lr"])
        row = F.struct(e["epoch"].cast("int").alias("epoch"), lr.alias("lr"))
        return F.struct(F.least(s["best"], e["loss"]).alias("best"), F.when(cut, 0).otherwise(waited).alias("waited"), lr.alias("lr"), F.concat(s["rows"], F.array(row)).alias("rows")).cast(kind)

    return curve.select(F.inline(F.aggregate("curve", start, step, lambda s: s["rows"])))


#: Layers of the convolutional autoencoder (fixed values): kind, inputs, outputs, kernel.
LAYERS = (
    ("conv", 1, 32, 5), ("norm", 0, 32, 0), ("conv", 32, 64, 5), ("norm", 0, 64, 0), ("conv", 64, 128, 5), ("norm", 0, 128, 0),
    ("conv", 128, 256, 5), ("norm", 0, 256, 0), ("conv", 256, 512, 5), ("norm", 0, 512, 0), ("linear", 512, 128, 0),
    ("linear", 128, 8192, 0), ("conv", 512, 256, 5), ("norm", 0, 256, 0), ("conv", 256, 128, 5), ("norm", 0, 128, 0),
    ("conv", 128, 64, 5), ("norm", 0, 64, 0), ("conv", 64, 32, 5), ("norm", 0, 32, 0), ("conv", 32, 1, 5),
)


def param_count(layers: DataFrame) -> DataFrame:
    """params of each kind of layer: kernel^2 * in * out + out, in * out + out, 2 * out."""
    n = F.when(F.col("kind") == "conv", F.col("kernel") * F.col("kernel") * F.col("inputs") * F.col("outputs") + F.col("outputs")).when(F.col("kind") == "linear", F.col("inputs") * F.col("outputs") + F.col("outputs")).otherwise(2 * F.col("outputs"))
    return layers.groupBy("kind").agg(F.sum(n).cast("long").alias("params"))
