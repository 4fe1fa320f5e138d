"""Scores of selections: n-gram and word overlap, means over records, languages and page types.

Both texts of a pair are in one row, so their overlap is counted there: both arrays of units are sorted into runs, the runs
are merged, and neighbours with one unit give the smaller count.  No token is shuffled, no side is collected.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import bound, harmonic, ngrams, segments, tokenize


def runs(units: Column) -> Column:
    """array<struct<u, n>>: each different unit and how often it occurs, sorted; linear after the sort."""
    first = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), F.struct(x.alias("u"), i.alias("at")))), lambda x: x.isNotNull())
    counted = lambda s: bound(first(s), lambda f: F.transform(f, lambda x, i: F.struct(x["u"].alias("u"), (F.coalesce(F.get(f, i + 1)["at"], F.size(s)) - x["at"]).alias("n"))))
    return bound(F.sort_array(units), counted)


def shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of units."""
    both = F.sort_array(F.concat(runs(a), runs(b)))
    least = lambda c: F.transform(c, lambda x, i: F.when(F.get(c, i + 1)["u"] == x["u"], F.least(x["n"], F.get(c, i + 1)["n"])).otherwise(0))
    return F.aggregate(bound(both, least), F.lit(0).cast("bigint"), lambda t, x: t + x)


def overlaps(pairs: DataFrame, key: list[str], pred: Column, ref: Column) -> DataFrame:
    """key, n_pred, n_ref, overlap: multiset sizes and intersection of two arrays of units, for each row of pairs."""
    rows = pairs.select(*key, pred.alias("__pred"), ref.alias("__ref"))
    return rows.select(*key, F.size("__pred").cast("bigint").alias("n_pred"), F.size("__ref").cast("bigint").alias("n_ref"), shared(F.col("__pred"), F.col("__ref")).alias("overlap"))


def _scores(o: DataFrame, key: list[str], both_empty: Column) -> DataFrame:
    p = F.when(both_empty, 1.0).when(F.col("n_pred") > 0, F.col("overlap") / F.col("n_pred")).otherwise(0.0)
    r = F.when(both_empty, 1.0).when(F.col("n_ref") > 0, F.col("overlap") / F.col("n_ref")).otherwise(0.0)
    return o.withColumns({"prec": p, "rec": r}).withColumn("f1", harmonic(F.col("prec"), F.col("rec"))).select(*key, "n_pred", "n_ref", "overlap", "prec", "rec", "f1")


def word_f1(pairs: DataFrame, key: list[str], pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Bag-of-words precision, recall, F1 per row, with the columns of key: both empty scores 1, one empty 0."""
    o = overlaps(pairs, key, tokenize(F.col(pred)), tokenize(F.col(ref)))
    return _scores(o, key, (F.col("n_pred") == 0) & (F.col("n_ref") == 0))


def rouge_n(pairs: DataFrame, key: list[str], pred: str = "pred", ref: str = "ref", n: int = 5) -> DataFrame:
    """Clipped n-gram precision, recall, F1: both blank scores 1; fewer than n tokens have no n-gram."""
    blank = F.regexp_replace(F.concat(F.coalesce(pred, F.lit("")), F.coalesce(ref, F.lit(""))), r"\s", "") == ""
    rows = pairs.select(*key, F.col(pred).alias("__p"), F.col(ref).alias("__r"), blank.alias("__blank"))
    o = overlaps(rows, [*key, "__blank"], ngrams(segments(F.col("__p")), n), ngrams(segments(F.col("__r")), n))
    return _scores(o, [*key, "__blank"], F.col("__blank")).drop("__blank")


def lcs_length(a: list, b: list) -> int:
    """Length of a longest common subsequence: one numpy row a token."""
    if not a or not b:
        return 0
    codes = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[t] for t in a]), np.array([codes[t] for t in b])
    if len(x) > len(y):
        x, y = y, x
    row = np.zeros(len(y) + 1, np.int64)
    for t in x:
        up = row[1:].copy()
        hit = np.where(y == t, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(up, hit))
    return int(row[-1])


def rouge_l(pairs: DataFrame, key: list[str], pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Longest-common-subsequence precision, recall, F1 over words; the table is a program of its own, so Arrow batches."""
    rows = pairs.select(*key, tokenize(F.col(pred)).alias("a"), tokenize(F.col(ref)).alias("b"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in key), "n_pred bigint, n_ref bigint, overlap bigint"])

    def each(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            cols = [pa.array(x, pa.int64()) for x in ([*map(len, a)], [*map(len, b)], [lcs_length(x, y) for x, y in zip(a, b, strict=True)])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *cols], [*key, "n_pred", "n_ref", "overlap"])

    return _scores(rows.mapInArrow(each, schema), key, (F.col("n_pred") == 0) & (F.col("n_ref") == 0))


def board(scores: DataFrame, edges: tuple[float, ...] = ()) -> DataFrame:
    """One row: n and n_null (records without a score, which no mean counts), the mean precision, recall, F1, and the
    number of records below each edge; one pass."""
    mean = lambda c: F.avg(F.when(F.col("f1").isNotNull(), F.col(c))).alias(c)
    return scores.agg(F.count("f1").alias("n"), F.count_if(F.col("f1").isNull()).alias("n_null"), mean("prec"), mean("rec"), mean("f1"), *below(edges))


def below(edges: tuple[float, ...]) -> list[Column]:
    return [F.count_if(F.col("f1") < e).alias(f"below_{round(100 * e)}") for e in edges]


def by_group(scores: DataFrame, group: str, order: list[str] | None = None) -> DataFrame:
    """Means per group, with the place of the group in a stated order (others last, by name)."""
    out = scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1"))
    if order is not None:
        place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
        out = out.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))
    return out


def macro_micro(scores: DataFrame, group: str) -> DataFrame:
    """Macro (mean of group means) and micro (mean of records), from one pass over the groups."""
    per = scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("f1").alias("s"))
    return per.agg(F.avg(F.col("s") / F.col("n")).alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))


def confusion(rows: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """tp, fp, fn and guarded precision, recall, F1."""
    t = rows.agg(F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"), F.count_if(~pred & truth).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return t.withColumns({"prec": p, "rec": r}).withColumn("f1", 2 * F.col("prec") * F.col("rec") / F.greatest(F.col("prec") + F.col("rec"), F.lit(1e-9)))


TAILS = (0.95, 0.90, 0.85, 0.80)


def tails(scores: DataFrame, edges: tuple[float, ...] = TAILS) -> DataFrame:
    """How many records lie below each edge."""
    return scores.agg(*below(edges))


def worst(scores: DataFrame, key: str, below: float = 0.8, k: int = 20) -> DataFrame:
    """The k lowest records under a bound, ties by key."""
    return scores.where(F.col("f1") < below).orderBy("f1", key).limit(k)


def best_threshold(rows: DataFrame, prob: Column, truth: Column, grid=tuple(round(0.30 + 0.05 * i, 2) for i in range(9))) -> DataFrame:
    """F1 at each threshold (strictly above), and whether it is the best (first of equals); one pass over the rows."""
    counts = [F.count_if((prob > t) & truth).alias(f"tp{i}") for i, t in enumerate(grid)] + [F.count_if((prob > t) & ~truth).alias(f"fp{i}") for i, t in enumerate(grid)] + [F.count_if(~(prob > t) & truth).alias(f"fn{i}") for i, t in enumerate(grid)]
    one = rows.agg(*counts)
    long = one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(grid)))).alias("x")).select("x.*")
    long = long.withColumn("f1", 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)))
    best = long.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("b"))
    return long.crossJoin(F.broadcast(best)).select("threshold", "tp", "fp", "fn", "f1", (F.col("threshold") == F.col("b")).alias("best"))  # one row


def class_balance(rows: DataFrame, truth: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(truth).alias("pos")).withColumn("pos_weight", (F.col("total") - F.col("pos")) / F.greatest("pos", F.lit(1)))
