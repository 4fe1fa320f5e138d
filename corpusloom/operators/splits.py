"""Corpus merging, leak-free folds, nested subsets and overlap checks."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VAL_SHARE, MOST = 0.10, 1.4


def shuffled(key: Column, seed: int) -> Column:
    """A place in a keyed order: the same everywhere, no global shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def modes(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value of each group; ties go to the smaller one."""
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    least = counted.groupBy(group).agg(F.max("c").alias("m"))
    return counted.join(least, group).where("c = m").groupBy(group).agg(F.min(value).alias(value))


def site_split(pages: DataFrame, site: str, language: str, level: str, seed: int = 7, share: float = VAL_SHARE) -> DataFrame:
    """site, n, fold: whole sites go to val, per (language, level) of the site, until the share is reached.

    Sites come in a keyed order; one that would lift the bucket above 1.4 times its target is skipped.  The running total
    depends on what was taken, so a bucket's sites (not pages) are read in order by one task, which keeps one number.
    """
    sizes = pages.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    known = sizes.join(modes(pages, site, language), site).join(modes(pages, site, level), site)
    target = known.groupBy(language, level).agg((F.sum("n") * share).alias("target"))
    rows = known.join(F.broadcast(target), [language, level]).select(language, level, shuffled(F.col(site), seed).alias("o"), F.col(site).alias("site"), "n", "target")  # a row for each bucket

    def take(batches):
        bucket, got = None, 0.0
        for batch in batches:
            fold = []
            for lang, lev, n, want in zip(*(batch.column(c).to_pylist() for c in (language, level, "n", "target")), strict=True):
                if (lang, lev) != bucket:
                    bucket, got = (lang, lev), 0.0
                val = got < want and got + n <= want * MOST
                got += n if val else 0
                fold.append("val" if val else "train")
            yield pa.RecordBatch.from_arrays([batch.column("site"), batch.column("n"), pa.array(fold)], ["site", "n", "fold"])

    kind = pages.schema[site].dataType.simpleString()
    out = rows.repartition(language, level).sortWithinPartitions(language, level, "o", "site").mapInArrow(take, f"site {kind}, n bigint, fold string")
    return out.withColumnRenamed("site", site)


def nested_subset(pages: DataFrame, key: str, level: str, fold: str, n: int, seed: int = 20260815) -> DataFrame:
    """key, level of n training pages whose levels follow those of val; smaller subsets are contained in larger ones.

    Levels are dealt by their shares in val: the k-th page of a level gets the place (k - 1/2) / share in the sequence, so
    the first n places hold each level's share, and any prefix is a subset.  Levels that val lacks come last.
    """
    val = pages.where(F.col(fold) == "val").where(F.col(level).isNotNull()).groupBy(level).agg(F.count(F.lit(1)).alias("v"))
    total = val.agg(F.sum("v").alias("t"))
    share = val.crossJoin(F.broadcast(total)).select(level, (F.col("v") / F.col("t")).alias("share"))  # one row
    train = pages.where(F.col(fold) == "train").where(F.col(level).isNotNull())
    k = F.row_number().over(W.partitionBy(level).orderBy(shuffled(F.col(key), seed), key))
    placed = train.select(key, level).withColumn("k", k).join(share, level, "left").withColumn("place", F.when(F.col("share") > 0, (F.col("k") - 0.5) / F.col("share")).otherwise(F.lit(1e18) + F.col("k")))
    return placed.orderBy("place", level, key).limit(n).select(key, level)


def holdout(pages: DataFrame, language: str, held: str | None) -> DataFrame:
    """Adds fold: the held-out language is test, the others train; without one all are train."""
    return pages.withColumn("fold", F.when(F.col(language) == held, "test").otherwise("train") if held else F.lit("train"))


def merge(big: DataFrame, small: DataFrame, key: str, wins: dict[str, str]) -> DataFrame:
    """Union by key: for each column of ``wins`` the side that comes first ('big' or 'small'); source tells where a key was."""
    a, b = big.withColumn("__a", F.lit(1)).alias("a"), small.withColumn("__b", F.lit(1)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c, w: F.coalesce(*(F.col(f"{s}.{c}") for s in (("a", "b") if w == "big" else ("b", "a")))).alias(c)
    source = F.when(F.col("__b").isNull(), "full").when(F.col("__a").isNull(), "test").otherwise("both")
    return joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *(pick(c, w) for c, w in wins.items()), source.alias("source"))


def unpaired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only, and on which."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    return x.join(y, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side"))


def overlap(ours: DataFrame, theirs: DataFrame, url: str, domain: str, fold: str) -> DataFrame:
    """Per fold of theirs: shared normalised urls (violations) and shared domains."""
    urls = theirs.join(ours.select(url).distinct(), url, "left_semi").groupBy(fold).agg(F.countDistinct(url).alias("urls"))
    domains = theirs.join(ours.select(domain).distinct(), domain, "left_semi").groupBy(fold).agg(F.countDistinct(domain).alias("domains"))
    return urls.join(domains, fold, "full_outer").select(fold, F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("domains", F.lit(0)).alias("domains"))


def replicated(base: DataFrame, extra: DataFrame, times: int) -> DataFrame:
    """Union all with the extra rows repeated."""
    again = extra.withColumn("__r", F.explode(F.array_repeat(F.lit(1), times))).drop("__r")
    return base.unionByName(again)
