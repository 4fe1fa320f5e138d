"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each distinct (host, path) of the input is expanded into host suffixes (the host and its parent domains) times path
prefixes.  Every expression gets a SHA-256 digest; its first ``prefix_bits`` bits are equi-joined with those of the rules,
and the full digest is compared afterwards.  Of the rules that fit, the one with the longest text wins (ties: the longer
host, then block).  Path prefixes are cut at the lengths that occur among the rules, so that rules ending within a path
segment work as well; host suffixes have the numbers of labels that occur among the rules, so that a host of thousands
of labels costs no more than another.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from there up to ``?``, ``#``
or the end.  Built-in functions only.

Scale: expressions are made of distinct (host, path) pairs, which are combined before the shuffle; verdicts come back by
a left join whose large side may be split (a hot url is no hot task).  Rules are broadcast only when counted to be few.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and the default verdict.  Null ids and
repeated rows are kept as they are.  Rules with a null host or verdict are left out; equal rules count once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast (about 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    # (?s): '.' and the classes below also take line breaks
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(digest: Column, bits: int) -> Column:
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("bigint")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_bits: int = 32) -> DataFrame:
    """pages(page_id, url), rules(host, path, verdict) -> page_id, url, host, path, rule, verdict."""
    rules = (
        rules.where("host is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("/")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # 'block' > 'allow'
        .withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))
        .withColumn("key", _key(F.col("r_digest"), prefix_bits))
    )
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    labels = lambda host: F.split(host, r"\.")
    # one row; lengths of paths and numbers of labels are few
    sizes = rules.agg(F.collect_set(F.length("r_path")).alias("lengths"), F.collect_set(F.size(labels("r_host"))).alias("counts"))
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = F.filter("counts", lambda n: n <= F.size("labels"))
    hosts = F.transform(own, lambda n: F.array_join(F.slice("labels", -n, n), "."))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    expressions = (
        parts.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one"))
        .crossJoin(F.broadcast(sizes))  # one row
        .withColumn("labels", labels("host"))
        .select("host", "path", F.explode(hosts).alias("x_host"), fitting.alias("fitting"))
        .select("host", "path", "x_host", F.explode("fitting").alias("n"))
        .withColumn("x_path", F.expr("substring(path, 1, n)"))
        .withColumn("digest", F.sha2(F.concat("x_host", F.lit("\n"), "x_path"), 256))
        .withColumn("key", _key(F.col("digest"), prefix_bits))
    )
    hits = expressions.join(F.broadcast(rules) if few else rules, "key").where("digest = r_digest")
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict")
    )
