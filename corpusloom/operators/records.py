"""Run records: names, cells, selection, checks, curves and nested tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["model", "layers", "head", "feats", "cap"]
OPTIONAL = ["train_limit", "holdout", "epochs"]


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Named columns, with a default where they are null or empty."""
    return rows.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")) if isinstance(d, str) else F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()))


def section(runs: DataFrame) -> Column:
    """Runs with limits or holdouts never share a table with full ones; columns that a ledger lacks count as null."""
    has = lambda c: F.col(c).isNotNull() if c in runs.columns else F.lit(False)
    return F.when(has("holdout"), "holdout").when(has("train_limit"), "ladder").otherwise("full")


def cell(runs: DataFrame) -> Column:
    """What runs must share to be seeds of one another: a struct, optional fields null-safe."""
    kinds = dict(runs.dtypes)
    return F.struct(*((F.col(c).cast("string") if c in kinds else F.lit(None).cast("string")).alias(c) for c in [*CELL, *OPTIONAL]), section(runs).alias("section"))


def arm(size: Column, layers: Column, head: Column, quantized: Column) -> Column:
    """size-layers, with the head if it is not linear and a mark for quantized runs."""
    return F.concat(size, F.lit("-"), layers.cast("string"), F.when(head == "linear", "").otherwise(F.concat(F.lit("-"), head)), F.when(quantized, "-int8").otherwise(""))


def board_of(model_id: Column) -> Column:
    """A model's id begins with its board."""
    return F.element_at(F.split(model_id, "-", 2), 1)


def promotable(runs: DataFrame) -> DataFrame:
    return runs.where(section(runs) == "full")


def selected(runs: DataFrame, column: str, prefixes: list[str], without: list[str] = ()) -> DataFrame:
    """Runs whose name begins with one of some prefixes and with none of others."""
    name = F.col(column)
    keep = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(name, p))
    drop = F.exists(F.array(*map(F.lit, without)), lambda p: F.startswith(name, p)) if without else F.lit(False)
    return runs.where(keep & ~drop)


def judged(rows: DataFrame, drift: Column, errors: dict[str, Column]) -> DataFrame:
    """Adds verdict (valid, dropped, error) and reason: the first error that holds comes before drift."""
    reason = F.coalesce(*(F.when(c, F.lit(k)) for k, c in errors.items()))
    return rows.withColumn("reason", F.coalesce(reason, F.when(drift, "drift"))).withColumn("verdict", F.when(reason.isNotNull(), "error").when(drift, "dropped").otherwise("valid"))


def checked(rows: DataFrame, drift: Column, errors: dict[str, Column]) -> DataFrame:
    """The valid rows; rows that drifted go, a malformed one is an error."""
    own = judged(rows, drift, errors)
    bad = own.where("verdict = 'error'").limit(5).collect()
    if bad:
        raise ValueError(f"malformed records: {bad}")
    return own.where("verdict = 'valid'").drop("verdict", "reason")


def flattened(rows: DataFrame, key: str, record: Column) -> DataFrame:
    """key, name, value of every field of a JSON object, nested ones as dotted names (two levels, as records have)."""
    top = rows.select(key, F.explode(F.from_json(record, "map<string,string>")).alias("name", "value"))
    inner = F.when(F.startswith("value", F.lit("{")), F.from_json("value", "map<string,string>"))
    deep = F.transform(F.map_entries(inner), lambda e: F.struct(F.concat(F.col("name"), F.lit("."), e["key"]).alias("name"), e["value"].alias("value")))
    return top.select(key, F.explode(F.coalesce(deep, F.array(F.struct("name", "value")))).alias("e")).select(key, "e.name", "e.value")


def running_best(curves: DataFrame, run: list[str], epoch: str = "epoch", val: str = "val") -> DataFrame:
    """Adds best (so far) and improved: strictly above all epochs before."""
    order = W.partitionBy(*run).orderBy(epoch)
    before = F.max(val).over(order.rowsBetween(W.unboundedPreceding, -1))
    return curves.withColumns({"best": F.max(val).over(order.rowsBetween(W.unboundedPreceding, 0)), "improved": before.isNull() | (F.col(val) > before)})


def epochs(curves: DataFrame, run: list[str], epoch: str = "epoch", val: str = "val") -> DataFrame:
    """run, n, mean_val, best_epoch (earliest of equals), best_val."""
    best = F.max_by(epoch, F.struct(F.col(val), -F.col(epoch)))
    return curves.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.avg(val).alias("mean_val"), best.alias("best_epoch"), F.max(val).alias("best_val"))


def nested(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """outer, cells: a map from inner to the sorted list of its values (seeds of a cell)."""
    lists = rows.groupBy(outer, inner).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return lists.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "v")))).alias("cells"))


def ranked(value: Column, order: list[str]) -> Column:
    """A sort key: places of a stated order, then all others by name."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.struct(F.when(place > 0, place).otherwise(len(order) + 1).alias("place"), F.when(place > 0, "").otherwise(value).alias("name"))


def unequal_groups(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Groups whose set of members differs from the largest one's size: runs of one cell must be tested alike."""
    sizes = rows.groupBy(group).agg(F.countDistinct(member).alias("n"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).where("n < most")  # one row
