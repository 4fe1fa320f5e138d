"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integers (floor(256 * x)).  They are dealt to range partitions by their nearest of some centroids (fitted
on a bounded sample, only the order of rows depends on them) and cut into blocks of BLOCK neighbours.  A block's forward
index is its matrix; its summary is the largest and smallest value of every dimension.  For a query, the sum of
``max(q * largest, q * smallest)`` bounds every score in the block.  Blocks are taken in falling order of that bound and
scored until the bound falls below the query's k-th best score; equal bounds are still scored, since ties go to the
smaller id.

Queries travel in chunks of at most CHUNK vectors and CHUNK_BYTES, one pass over the blocks for each chunk, one chunk after the
other, its results in a table; a first pass over a bounded sample of candidates gives each query a score that its k-th best
cannot fall below, so that most blocks fall at once.  Each task returns at most k rows per query; the k best of those are the
answer.

Scores are exact: in doubles while no partial sum can reach 2**53, else in 64-bit integers, whose sums are right whenever the
score itself fits a long; bounds are then taken a little too high.  A component or a score that fits no long is an error.

Defined cases: vectors that are null, or hold null, NaN or infinite components, take part neither as query nor as
candidate; so do rows with null ids.  A vector meets only vectors of the same length.  Of rows that repeat an id, the
query is the row with the smallest vector; a candidate with the query's own id is left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BLOCK = 256
CHUNK, CHUNK_BYTES = 50_000, 64_000_000
SAMPLE = 4096
CENTROIDS = 64


def integers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<bigint>): the rows that take part."""
    whole = F.expr(f"not exists(`{vec_col}`, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    large = F.raise_error(F.lit("a component fits no long")).cast("bigint")
    cut = F.transform(F.col(vec_col), lambda x: F.when(F.abs(x.cast("double") * 256) < 2.0**63, F.floor(x.cast("double") * 256).cast("bigint")).otherwise(large))
    return rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(whole).select(F.col(id_col).cast("bigint").alias("vec_id"), cut.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def gathered(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded number of rows(vec_id, v)."""
    got = rows.select("vec_id", "v").toArrow().combine_chunks()
    parts = got.to_batches()
    ids = [b.column("vec_id").to_numpy() for b in parts] or [np.zeros(0, np.int64)]
    return np.concatenate(ids), np.concatenate([matrix(b.column("v"), width) for b in parts] or [np.zeros((0, width), np.int64)])


def most(a: np.ndarray, b: np.ndarray) -> float:
    """No partial sum of a @ b.T is larger."""
    largest = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    return largest(a) * largest(b) * max(1, a.shape[1])


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact."""
    limit = most(a, b)
    if limit < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if limit >= 2**63 and np.abs(a.astype(np.float64) @ b.astype(np.float64).T).max(initial=0) >= 2.0**63 * (1 - 2.0**-40):
        raise OverflowError("a score fits no long")
    return a.astype(np.int64) @ b.astype(np.int64).T  # modulo 2**64: right if the score fits


def bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest score that a query can have in a block, or (for large values) a little more."""
    if max(most(q, top), most(q, low)) < 2**52:
        return dot(np.maximum(q, 0), top) + dot(np.minimum(q, 0), low)
    q, top, low = (x.astype(np.float64) for x in (q, top, low))
    slack = np.abs(q) @ np.maximum(np.abs(top), np.abs(low)).T * 2.0**-40
    return np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T + slack


class Best:
    """The k best (score, id) of each query so far; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[who], score], 1)
        i = np.concatenate([self.id[who], ids], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]  # -min is min: unfilled places stay last, their id is the largest
        unfilled = s == np.iinfo(np.int64).min
        if unfilled.any():
            order = np.lexsort((i, np.where(unfilled, np.iinfo(np.int64).max, -s)), axis=1)[:, : self.k]
        self.score[who], self.id[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(blocks: list[tuple[np.ndarray, np.ndarray]], q_id: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """Block-at-a-time: blocks are (ids, matrix); floor holds a score that a result cannot fall below."""
    best = Best(len(q), k, floor)
    top = np.stack([m.max(0) for _, m in blocks])
    low = np.stack([m.min(0) for _, m in blocks])
    for a in range(0, len(q), 2048):
        own = np.arange(a, min(len(q), a + 2048))
        bound = bounds(q[own], top, low)
        order = np.argsort(-bound, axis=1, kind="stable")
        rank, alive = 0, np.arange(len(own))
        while len(alive) and rank < len(blocks):
            b = order[alive, rank]
            least = best.least()[own[alive]]
            go = (bound[alive, b] >= least) | (least == np.iinfo(np.int64).min)
            alive, b = alive[go], b[go]
            for x in np.unique(b):
                who = own[alive[b == x]]
                ids, m = blocks[x]
                s = dot(q[who], m)
                s = np.where(ids[None, :] == q_id[who][:, None], np.iinfo(np.int64).min, s)
                s = np.where(s < floor[who][:, None], np.iinfo(np.int64).min, s)
                best.add(who, s, np.where(s == np.iinfo(np.int64).min, np.iinfo(np.int64).max, np.broadcast_to(ids, s.shape)))
            rank += 1
    return best


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """A few rounds of k-means over a bounded sample; they only decide which vectors stand side by side."""
    x = sample.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(5):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of rows for each of queries (both with id_col, vec_col)."""
    spark = rows.sparkSession
    base = integers(rows, id_col, vec_col)
    asked = integers(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    shapes = {n: c for n, c in base.groupBy(F.size("v")).count().collect() if n > 0}  # a row for each length of vector
    wanted = {n: c for n, c in asked.groupBy(F.size("v")).count().collect() if n in shapes}
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for width, count in sorted(wanted.items()):
        own = base.where(F.size("v") == width)
        total = shapes[width]
        share = min(1 << 20, -(-(SAMPLE << 20) // total))
        ids, sample = gathered(own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).limit(4 * SAMPLE), width)  # about SAMPLE rows
        centres = spark.sparkContext.broadcast(centroids(sample, CENTROIDS) if len(sample) else np.zeros((1, width)))

        def place(batches, centres=centres):
            c = centres.value
            half = (c * c).sum(1) / 2
            for batch in batches:
                m = matrix(batch.column("v"), c.shape[1]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array((m @ c.T - half).argmax(1), pa.int32()), batch.column("vec_id"), batch.column("v")], ["cell", "vec_id", "v"])

        parts = max(1, -(-total // 8192))
        # (cell, id) spreads equal vectors as well: a vector that a third of all rows share fills blocks like any other
        laid = own.mapInArrow(place, "cell int, vec_id bigint, v array<bigint>").repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
        pieces = max(1, -(-count // min(chunk, max(1, CHUNK_BYTES // (8 * width)))))
        if pieces > 1:
            laid = table(laid, "top-k-laid").repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
        for piece in range(pieces):
            some = asked.where(F.size("v") == width)
            some = some.where(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == piece) if pieces > 1 else some
            q_id, q = gathered(some, width)  # at most about ``chunk`` vectors
            if not len(q):
                continue
            floor = np.full(len(q), np.iinfo(np.int64).min)
            if len(sample):
                first = search([(ids[a : a + block], sample[a : a + block]) for a in range(0, len(ids), block)], q_id, q, floor, k)
                floor = first.score[:, -1].copy()
            shared = spark.sparkContext.broadcast((q_id, q, floor))

            def scan(batches, shared=shared, block=block, k=k):
                q_id, q, floor = shared.value
                blocks = []
                for batch in batches:
                    if batch.num_rows:
                        m, i = matrix(batch.column("v"), q.shape[1]), batch.column("vec_id").to_numpy()
                        blocks += [(i[a : a + block], m[a : a + block]) for a in range(0, len(i), block)]
                if blocks:
                    best = search(blocks, q_id, q, floor, k)
                    r, c = np.nonzero(best.score != np.iinfo(np.int64).min)
                    yield pa.RecordBatch.from_arrays([pa.array(q_id[r]), pa.array(best.id[r, c]), pa.array(best.score[r, c])], ["query_id", "vec_id", "score"])

            found = laid.mapInArrow(scan, "query_id bigint, vec_id bigint, score bigint")
            best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
            rows_ = best.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.s")).alias("score"))
            if pieces > 1:
                rows_ = table(rows_, "top-k")
                shared.destroy()
            out = out.unionByName(rows_)
    return out
