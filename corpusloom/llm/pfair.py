"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in an order drawn from a hash of their ids, form blocks of ``block_rows`` rows.  One slot of
the mix holds one block.  Target shares are multiples of 1/D (largest remainders; D at least 1024 and 8 per source): a
source with a_s of D slots should have received ``t * a_s / D`` blocks after t slots.  Its k-th block (from 0) is released
at floor(k * D / a_s) and due at ceil((k + 1) * D / a_s); earliest-deadline-first over these windows fills every slot and
keeps every source within less than one block of its share at all times.  After D slots all sources are exactly on their
share, so one period holds for as many periods as every source can fill, and the slot of any block is a formula: nothing
is simulated over the corpus.  When a source runs out within a period, the windows of that period come from the fluid
schedule in which the others take over its share; then the shares of the remaining sources are scaled up and the next
periods follow.  There are at most two such segments for each source, and for each period; their tables (sources x segments
rows, D numbers a segment) are broadcast while small, else joined by a shuffle.  No row is dropped or repeated.

Ranks within a source come from counts: rows fall into (source, hash bucket) groups of about BUCKET_ROWS rows, a
hot source just has more buckets; prefix sums over bucket counts give the first rank of each bucket.

Built-in functions only; the driver sees one row for each source.

Defined cases: rows with a null source are a source of their own.  Weights default to the square root of the source's
rows; sources without a given weight (or one that is not positive) come after all others, by their square roots.  Rows
that repeat an id keep places of their own.  Null ids are rows like any other.  An empty table gives an empty result.
"""

import heapq
import json
import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, shared_dir

BLOCK_ROWS = 64
BUCKET_ROWS = 2000
LEAST_PERIOD = 1024
#: A plan of up to so many numbers (4 to 8 bytes each) is broadcast.
PLAN_NUMBERS = 2_000_000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of a period: largest remainders, one at least."""
    total = math.fsum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    left = period - sum(out.values())
    if left > 0:
        for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[:left]:
            out[s] += 1
    if left < 0:  # small sources were raised to one slot: the largest give way, in turn
        rank = {s: i for i, s in enumerate(sorted(out, reverse=True))}
        largest = [(-n, rank[s], s) for s, n in out.items()]
        heapq.heapify(largest)
        for _ in range(-left):
            n, r, s = largest[0]
            out[s] -= 1
            heapq.heapreplace(largest, (n + 1, r, s))
    return out


def schedule(share: dict[str, int], have: dict[str, int]) -> dict[str, list[int]]:
    """Slots of the first have[s] <= share[s] blocks of each source, by earliest deadline within Pfair windows.

    The fluid schedule gives sources their shares until they have no block left: at virtual time x, source s has
    received min(x * share, have) blocks.
    """
    names = sorted(share)
    a = np.array([share[s] for s in names], np.int64)
    n = np.array([have[s] for s in names], np.int64)
    # received by all at virtual time x: x times the shares that last beyond x, and all blocks of the others
    last = np.argsort(n / a, kind="stable")
    lasting = np.concatenate([[a.sum()], a.sum() - np.cumsum(a[last])])
    spent = np.concatenate([[0], np.cumsum(n[last])])
    who = np.repeat(np.arange(len(names)), n + 1)
    k = np.arange(len(who)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    over = np.searchsorted((n / a)[last], k / a[who], "left")
    fluid = k * lasting[over] + a[who] * spent[over]  # times a[who]
    job = np.flatnonzero(k < n[who])
    release, due = fluid[job] // a[who[job]], -(-fluid[job + 1] // a[who[job]])
    order = np.argsort(release, kind="stable")
    # (due, source, block) as one number: earliest deadline first, ties to the source that sorts first
    keys = [(d << 84) | (w << 42) | j for d, w, j in zip(due[order].tolist(), who[job][order].tolist(), k[job][order].tolist(), strict=True)]
    release = release[order].tolist()
    slots: list[list[int]] = [[] for _ in names]
    ready: list[int] = []
    at, mask = 0, (1 << 42) - 1
    for slot in range(len(keys)):
        while at < len(keys) and release[at] <= slot:
            heapq.heappush(ready, keys[at])
            at += 1
        key = heapq.heappop(ready)
        if slot >= key >> 84:
            raise AssertionError("a block missed its deadline")
        slots[key >> 42 & mask].append(slot)
    return dict(zip(names, slots, strict=True))


def segments(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """Rows (source, first block, blocks per period, first slot, period length, periods, slots): where blocks go."""
    out, left, start = [], {s: n for s, n in blocks.items() if n}, 0
    done = dict.fromkeys(blocks, 0)
    while left:
        share = shares({s: weights[s] for s in left}, period)
        times = min(left[s] // share[s] for s in left)
        have = share if times else {s: min(share[s], left[s]) for s in left}
        times = max(times, 1)
        slots, length = schedule(share, have), sum(have.values())
        for s in left:
            out.append({"src": s, "first": done[s], "per": have[s], "start": start, "length": length, "times": times, "slots": slots[s]})
            done[s] += have[s] * times
        start += length * times
        left = {s: blocks[s] - done[s] for s in left if blocks[s] > done[s]}
    return out


def literal(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The plan as rows: a broadcast while its size, which is known, is small, else a table written in parts."""
    schema = "array<struct<src:string,first:bigint,per:bigint,start:bigint,length:bigint,times:bigint,slots:array<int>>>"
    part = lambda own: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(own)), schema)).alias("p")).select(*(F.col(f"p.{c}").alias(f"__{c}") for c in ("src", "first", "per", "start", "length", "times", "slots")))
    size = sum(len(r["slots"]) + 20 for r in rows)
    if size <= PLAN_NUMBERS:
        return F.broadcast(part(rows))
    path, own, n = f"{shared_dir(spark)}/pfair-plan-{uuid.uuid4().hex}", [], 0
    for i, r in enumerate(rows):
        own.append(r)
        n += len(r["slots"]) + 20
        if n > PLAN_NUMBERS // 4 or i == len(rows) - 1:
            part(own).write.mode("append").parquet(path)
            own, n = [], 0
    return spark.read.parquet(path)


def _source(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def placed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """docs with __src, __rank, __slot, __position, and the number of slots. Reads doc_id and source."""
    spark = docs.sparkSession
    counts = dict(docs.groupBy(_source(F.col("source")).alias("src")).count().collect())  # a row for each source
    total = sum(counts.values())
    buckets = max(1, -(-total // BUCKET_ROWS))
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    given = {("null" if k is None else f"={k}"): w for k, w in (weights or {}).items() if w > 0}
    groups = [{s: given[s] for s in counts if s in given}, {s: math.sqrt(n) for s, n in counts.items() if s not in given}]
    period = max(LEAST_PERIOD, 1 << (8 * len(counts)).bit_length())
    rows, slots = [], 0
    for own in groups:
        part = segments({s: blocks[s] for s in own}, own, period)
        rows += [r | {"start": r["start"] + slots} for r in part]
        slots += sum(blocks[s] for s in own)
    plan = literal(spark, rows)
    h = F.xxhash64(F.col("doc_id"))
    base = docs.withColumns({"__src": _source(F.col("source")), "__hash": h}).withColumn("__bucket", F.pmod(F.col("__hash"), F.lit(buckets)))
    sizes = docs.select(_source(F.col("source")).alias("__src"), F.pmod(h, F.lit(buckets)).alias("__bucket")).groupBy("__src", "__bucket").count()
    before = sizes.select("__src", "__bucket", (F.sum("count").over(W.partitionBy("__src").orderBy("__bucket")) - F.col("count")).alias("__before"))
    ranked = base.withColumn("__nth", F.row_number().over(W.partitionBy("__src", "__bucket").orderBy("__hash", "doc_id"))).join(before, ["__src", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__nth") - 1).withColumn("__block", F.expr(f"__rank div {block_rows}"))
    found = ranked.join(plan, (ranked["__src"] == plan["__src"]) & F.expr("__block >= __first and __block < __first + __per * __times")).drop(plan["__src"])
    found = found.withColumn("__slot", F.expr("__start + ((__block - __first) div __per) * __length + get(__slots, cast((__block - __first) % __per as int))"))
    return found.withColumn("__position", F.col("__slot") * block_rows + F.col("__rank") % block_rows), slots


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, block (of its source), slot (of the mix), position (slot * block_rows + place in the block)."""
    out, _ = placed(docs.select("doc_id", "source"), weights, block_rows)
    return out.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


def interleave(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, part_rows: int = 16_384) -> DataFrame:
    """The rows of docs, all columns, in the order of the mix: partition i holds the i-th run of positions, sorted."""
    out, slots = placed(docs, weights, block_rows)
    parts = max(1, -(-slots * block_rows // part_rows))
    out = out.withColumn("__part", F.expr(f"cast(__position div {part_rows} as int)"))
    return out.repartitionById(parts, "__part").sortWithinPartitions("__position").select(*(F.col(quoted(c)) for c in docs.columns))
