"""Run ledger: latest records, seed means, pivots, population checks, speed statistics and reports."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(runs: DataFrame, cell: list[str], ts: str, tie: str) -> DataFrame:
    """The last record of each cell; of equal times the smaller tie key."""
    n = F.row_number().over(W.partitionBy(*cell).orderBy(F.desc(ts), tie))
    return runs.withColumn("__n", n).where("__n = 1").drop("__n")


def seeds(runs: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (from two seeds on) and a printed form of each cell; nothing is dropped."""
    out = runs.groupBy(*cell).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("shown", F.when(F.col("n") > 1, F.format_string("%.4f±%.4f", "mean", "sd")).otherwise(F.format_string("%.4f", "mean")))


def pivot(cells: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """One row per ``row``, a column per stated value; what is missing shows as a dash."""
    out = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    return out.select(row, *(F.coalesce(F.col(f"`{c}`"), F.lit("—")).alias(f"{column}_{c}") for c in columns))


def short_populations(runs: DataFrame, board: str, n: str) -> DataFrame:
    """Records that were scored on fewer pages than the board's largest population."""
    most = runs.groupBy(board).agg(F.max(n).alias("most"))
    return runs.join(most, board).where(F.col(n) < F.col("most"))


def guard(runs: DataFrame, board: str, n: str) -> DataFrame:
    """The runs, or an error if a record's population is short."""
    bad = short_populations(runs, board, n).limit(5).collect()
    if bad:
        raise ValueError(f"records with fewer pages than their board has: {bad}")
    return runs


def experiments(runs: DataFrame, experiment: str, ts: str) -> DataFrame:
    return runs.groupBy(experiment).agg(F.count(F.lit(1)).alias("runs"), F.max(ts).alias("latest"))


def varying(runs: DataFrame, config: Column) -> DataFrame:
    """Config keys (of a map column) with the number of their values; keys with one value are printed once elsewhere."""
    return runs.select(F.explode(config).alias("key", "value")).groupBy("key").agg(F.countDistinct("value").alias("n_values")).withColumn("varies", F.col("n_values") > 1)


def latency(rows: DataFrame, group: list[str], ms: str) -> DataFrame:
    """n, median, mean, p90 (place int(0.9 n), counted from 0, of the sorted values) and 1000 / median.

    Equal values are combined before the shuffle; the running count then goes over the distinct values of a group.
    """
    counted = rows.where(F.col(ms).isNotNull()).groupBy(*group, ms).agg(F.count(F.lit(1)).alias("c"))
    size = rows.groupBy(*group).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean"))
    placed = counted.withColumn("upto", F.sum("c").over(W.partitionBy(*group).orderBy(ms))).join(size, group)
    at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(ms)))
    n = F.col("n")
    out = placed.groupBy(*group).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), at(F.floor((n - 1) / 2)).alias("lo"), at(F.floor(n / 2)).alias("hi"), at(F.floor(n * 9 / 10)).alias("p90"))
    out = out.withColumn("median", (F.col("lo") + F.col("hi")) / 2)
    return out.select(*group, "n", "median", "mean", "p90", (1000 / F.col("median")).alias("per_s"))


def ratios(rows: DataFrame, page: str, method: str, ms: str, base: str, bucket: str | None = None) -> DataFrame:
    """Medians and means of each method against ``base`` over the pages that both have timed; an empty overlap has no row."""
    one = rows.groupBy(page, method, *([bucket] if bucket else [])).agg(F.avg(ms).alias(ms))
    b = one.where(F.col(method) == base).select(page, F.col(ms).alias("base_ms"))
    both = one.where(F.col(method) != base).join(b, page)
    keys = [method, *([bucket] if bucket else [])]
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(ms).alias("median"), F.median("base_ms").alias("base_median"), F.avg(ms).alias("mean"), F.avg("base_ms").alias("base_mean"))
    return out.select(*keys, "n", (F.col("base_median") / F.col("median")).alias("x_median"), (F.col("base_mean") / F.col("mean")).alias("x_mean"))


def bucket(n: Column, edges=(1024, 4096, 16384, 32768)) -> Column:
    """Labels of ranges of token counts."""
    names = [f"<{edges[0]}", *(f"{a}-{b}" for a, b in zip(edges, edges[1:])), f">={edges[-1]}"]
    return reduce(lambda c, x: c.when(n < x[0], x[1]), zip(edges[1:], names[1:]), F.when(n < edges[0], names[0])).otherwise(names[-1])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def report(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row with a Markdown table (a report is read by people: the rows are few)."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns)), " | "), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    return rows.select(F.struct(*order).alias("o"), line.alias("l")).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n")).alias("markdown"))


def cell_key(runs: DataFrame) -> DataFrame:
    """Adds section: runs with limits or holdouts never share a table with full ones."""
    section = F.when(F.col("holdout").isNotNull(), "holdout").when(F.col("train_limit").isNotNull(), "ladder").otherwise("full")
    return runs.withColumn("section", section)
