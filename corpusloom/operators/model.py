"""Features, pooling, quantization, linear heads, windows and packing."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import numbers


def column_stats(rows: DataFrame, vector: str, columns: list[int], floor: float = 1e-6) -> DataFrame:
    """One row: arrays mean and std (population; 1 where it is below the floor) of some columns of an array."""
    aggs = [x for i in columns for x in (F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}"), F.stddev_pop(F.get(vector, F.lit(i)).cast("double")).alias(f"s{i}"))]
    one = rows.agg(*aggs)
    return one.select(F.array(*(F.col(f"m{i}") for i in columns)).alias("mean"), F.array(*(F.when(F.col(f"s{i}") < floor, 1.0).otherwise(F.col(f"s{i}")) for i in columns)).alias("std"))


def standardized(rows: DataFrame, stats: DataFrame, vector: str, columns: list[int]) -> DataFrame:
    """Columns normalised with the statistics of another set of rows (those of the train fold)."""
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn(vector, numbers.zscore(F.transform(vector, lambda x: x.cast("double")), columns, F.col("mean"), F.col("std"))).drop("mean", "std")


def mean_pool(rows: DataFrame, group: str, vector: str, width: int) -> DataFrame:
    """Mean vector of each group; rows without a vector do not count, groups without any give zeros."""
    means = [F.coalesce(F.avg(F.get(vector, F.lit(i)).cast("double")), F.lit(0.0)) for i in range(width)]
    return rows.groupBy(group).agg(F.count(vector).alias("n"), F.array(*means).alias(vector))


def quantized(rows: DataFrame, vector: str) -> DataFrame:
    """Adds scale, q and the largest error of each row."""
    out = rows.withColumn("quant", numbers.quantize_row(F.col(vector)))
    error = F.array_max(F.zip_with(vector, numbers.dequantize(F.col("quant")), lambda a, b: F.abs(a.cast("double") - b)))
    return out.select("*", F.col("quant.scale").alias("scale"), F.col("quant.q").alias("q"), error.alias("error")).drop("quant")


def linear_head(train: DataFrame, features: str, label: str, balance: bool = True, l2: float = 1e-3, iterations: int = 50):
    """A logistic head fitted by Spark's ML library, positive rows weighted by the class balance."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    if balance:
        total, pos = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
        weight = (total - pos) / max(pos, 1)
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, float(weight)).otherwise(1.0))
    return LogisticRegression(maxIter=iterations, regParam=l2, weightCol="weight" if balance else None).fit(rows) if balance else LogisticRegression(maxIter=iterations, regParam=l2).fit(rows)


def probability(rows: DataFrame, model, features: str, name: str = "prob") -> DataFrame:
    """The model's probability as a plain expression over the array: no vector, no Python."""
    w = F.array(*map(F.lit, [float(x) for x in model.coefficients.toArray()]))
    dot = F.aggregate(F.zip_with(features, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, x: t + x)
    return rows.withColumn(name, F.round(numbers.sigmoid(dot + float(model.intercept)), 6))


def flips(a: DataFrame, b: DataFrame, key: list[str], prob: str = "prob", at: float = 0.5) -> DataFrame:
    """How many decisions of two scorers differ."""
    return a.select(*key, F.col(prob).alias("p")).join(b.select(*key, F.col(prob).alias("q")), key).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") >= at) != (F.col("q") >= at)).alias("flips"))


def window_starts(n: Column, window: int, stride: int) -> Column:
    """Starts of overlapping windows over n tokens: one for short pages; the last one reaches the end."""
    return F.when(n <= window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - window) / stride).cast("int") * stride, F.lit(stride)))


def window_samples(tokens: DataFrame, key: str, window: int, stride: int | None = None) -> DataFrame:
    """tokens(key, idx, first, last: token places of each block, null for blocks without tokens; n: tokens of the page)
    -> key, tok_lo, tok_hi, blk_lo, blk_hi of every window with at least one whole block."""
    stride = stride or window // 2
    order = W.partitionBy(key).orderBy("idx")
    ride = F.coalesce(F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    rows = tokens.select(key, "idx", "n", F.coalesce("first", ride).alias("first"), F.coalesce("last", ride).alias("last"))
    # the windows that a block may lie in are counted from its places: no range join
    top = F.ceil((F.col("n") - window) / stride).cast("int")
    lo = F.greatest(F.lit(0), F.ceil((F.col("last") + 1 - window) / stride).cast("int"))
    hi = F.least(top, F.floor(F.col("first") / stride).cast("int"))
    long = rows.where(F.col("n") > window).select(key, "idx", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))).alias("w"))
    out = long.groupBy(key, "w").agg(F.min("idx").alias("blk_lo"), (F.max("idx") + 1).alias("blk_hi")).select(key, (F.col("w") * stride).alias("tok_lo"), (F.col("w") * stride + window).alias("tok_hi"), "blk_lo", "blk_hi")
    short = rows.where(F.col("n") <= window).groupBy(key).agg(F.first("n").alias("n"), F.max("idx").alias("m")).select(key, F.lit(0).alias("tok_lo"), F.col("n").cast("int").alias("tok_hi"), F.lit(0).alias("blk_lo"), (F.col("m") + 1).alias("blk_hi"))
    return out.unionByName(short)


def owned(windows: DataFrame, key: str, window: int) -> DataFrame:
    """windows(key, start) -> the part lo..hi (local) that each window owns: up to the middle of each overlap."""
    order = W.partitionBy(key).orderBy("start")
    before, after = F.lag("start").over(order), F.lead("start").over(order)
    lo = F.when(before.isNull(), 0).otherwise(F.floor((before + window + F.col("start")) / 2) - F.col("start"))
    hi = F.when(after.isNull(), window).otherwise(F.floor((F.col("start") + window + after) / 2) - F.col("start"))
    return windows.select(key, "start", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def packed(pages: DataFrame, key: str, length: str, rows: int, cells: int, longest: int, parts: int = 8) -> DataFrame:
    """key, length, part, batch: pages in order of length, in batches of at most ``rows`` pages and rows x longest <= cells;
    a page above ``longest`` is a batch of its own.  Lengths are dealt by range, each partition packs its own run."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(key, length).schema)

    def each(batches):
        from pyspark import TaskContext

        part, batch, held, last = TaskContext.get().partitionId(), -1, 0, 0
        for b in batches:
            out = []
            for n in b.column(length).to_pylist():
                if batch < 0 or n > longest or last > longest or held >= rows or (held + 1) * n > cells:
                    batch, held = batch + 1, 0
                held, last = held + 1, n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(length), pa.array([part] * len(out), pa.int32()), pa.array(out, pa.int32())], [key, length, "part", "batch"])

    return pages.select(key, length).repartitionByRange(parts, length, key).sortWithinPartitions(length, key).mapInArrow(each, f"{kinds}, part int, batch int")


def gru(pages: DataFrame, key: str, features: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """key, probs: a bidirectional GRU over a page's rows (an array of vectors), with given weights, in numpy.

    weights: for each direction f, b the matrices W (3H x D), U (3H x H) and vector c (3H), gates in the order reset,
    update, candidate; v (2H) and a number o for the output.
    """
    kind = pages.schema[key].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.float64) for k, v in weights.items()})

    def run(x, w, u, c):
        size = u.shape[1]
        h, out = np.zeros(size), []
        for a in x @ w.T + c:
            z = u @ h
            r = 1 / (1 + np.exp(-(a[:size] + z[:size])))
            k = 1 / (1 + np.exp(-(a[size : 2 * size] + z[size : 2 * size])))
            h = (1 - k) * np.tanh(a[2 * size :] + r * z[2 * size :]) + k * h
            out.append(h)
        return np.array(out)

    def each(batches):
        w = shared.value
        for b in batches:
            probs = []
            for page in b.column(features).to_pylist():
                x = np.array(page or [], np.float64)
                if not len(x):
                    probs.append([])
                    continue
                h = np.concatenate([run(x, w["fW"], w["fU"], w["fc"]), run(x[::-1], w["bW"], w["bU"], w["bc"])[::-1]], 1)
                probs.append(np.round(1 / (1 + np.exp(-(h @ w["v"] + w["o"]))), 6).tolist())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(probs, pa.list_(pa.float64()))], [key, "probs"])

    return pages.select(key, features).mapInArrow(each, f"`{key}` {kind}, probs array<double>")
