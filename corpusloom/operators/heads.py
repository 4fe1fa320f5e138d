"""Scorers of pages: token vectors, windows, heads and their artefacts, and probabilities for every page.

A page comes as blocks of text.  Tokens are looked up in a table of vectors, normalised without context, averaged over each
block, and joined with the block's features; a head turns a page's blocks into probabilities.  Long pages run in
overlapping windows of blocks, each of which owns the part up to the middle of its overlaps.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokenize


def embedded(tokens: DataFrame, table: DataFrame, token: str = "token", vector: str = "vector", eps: float = 1e-5) -> DataFrame:
    """tokens(.., token) with vector: looked up in table(token, vector) and normalised to mean 0 and variance 1.

    Tokens that the table lacks have no vector and do not count in a mean.  Null components stay null and count in nothing; a
    vector of nothing else stays as it is.
    """
    some = lambda v: F.filter(v, lambda x: x.isNotNull())
    mean = lambda v: F.aggregate(some(v), F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(some(v)), F.lit(0))
    one = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    centred = lambda v: one(mean(v), lambda m: F.transform(v, lambda x: x - m))
    scaled = lambda c: one(mean(F.transform(c, lambda x: x * x)), lambda s: F.transform(c, lambda x: x / F.sqrt(s + eps)))
    own = table.select(token, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    out = tokens.join(own, token, "left")
    return out.withColumn(vector, F.when(F.col(vector).isNotNull(), one(centred(F.col(vector)), scaled)))


def token_rows(blocks: DataFrame, key: str, idx: str = "idx", text: str = "text") -> DataFrame:
    return blocks.select(key, idx, F.explode_outer(tokenize(F.col(text))).alias("token"))


def joined(pooled: Column, features: Column, columns: list[int] | None = None) -> Column:
    """Pooled vector and (some of) a block's features in one array."""
    own = features if columns is None else F.transform(F.array(*map(F.lit, columns)), lambda i: F.get(features, i))
    return F.concat(pooled, F.transform(own, lambda x: x.cast("double")))


def live_features(feats: Column, mean: Column, std: Column, columns: list[int]) -> Column:
    """A block's full layout, normalised, then the columns that a model takes."""
    z = F.zip_with(F.zip_with(feats, mean, lambda x, m: x - m), std, lambda x, s: x / s)
    return F.element_at(F.transform(F.array(z), lambda v: F.transform(F.array(*map(F.lit, columns)), lambda i: F.get(v, i))), 1)


def with_features(pages: DataFrame, feats: str = "feats") -> DataFrame:
    """Pages whose feature matrix has rows and columns."""
    return pages.where((F.size(feats) > 0) & (F.size(F.get(F.col(feats), F.lit(0))) > 0))


def page_vectors(blocks: DataFrame, table: DataFrame, key: str, width: int, features: str | None = None) -> DataFrame:
    """key, vectors: an array with a vector for each block of blocks(key, idx, text), in order; zeros for blocks without tokens."""
    from corpusloom.operators.model import mean_pool

    rows = embedded(token_rows(blocks, key), table).withColumn("at", F.struct(key, "idx"))
    pooled = mean_pool(rows, "at", "vector", width).select("at.*", F.col("vector").alias("pooled"))
    if features:
        pooled = pooled.join(blocks.select(key, "idx", features), [key, "idx"])
    vector = joined(F.col("pooled"), F.col(features)) if features else F.col("pooled")
    order = F.array_sort(F.collect_list(F.struct("idx", vector.alias("v"))))  # a page's blocks
    return pooled.groupBy(key).agg(order.alias("l")).select(key, F.col("l.v").alias("vectors"))


# ---- heads: functions from a page's matrix to probabilities, made from plain arrays


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def linear(w: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """w: v (D), o."""
    return lambda x: _sigmoid(x @ w["v"] + w["o"])


def trees(w: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Boosted stumps: column, threshold, value below, value above, one of each per stump, and o."""
    column = w["column"].astype(int)
    return lambda x: _sigmoid(np.where(x[:, column] <= w["threshold"], w["below"], w["above"]).sum(1) + w["o"])


def transformer(w: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """One layer of one-headed self-attention over a page's blocks: q, k, p (D x H), r (H x D), v (D), o."""

    def run(x):
        score = (x @ w["q"]) @ (x @ w["k"]).T / np.sqrt(w["q"].shape[1])
        score = np.exp(score - score.max(1, keepdims=True))
        x = x + (score / score.sum(1, keepdims=True)) @ (x @ w["p"]) @ w["r"]
        return _sigmoid(x @ w["v"] + w["o"])

    return run


HEADS: dict[str, Callable] = {"linear": linear, "trees": trees, "transformer": transformer}


def windows(n: int, size: int) -> list[tuple[int, int, int, int]]:
    """(from, to, owned from, owned to) of overlapping windows over n blocks; the owned parts tile them."""
    if n <= size:
        return [(0, n, 0, n)]
    step = max(1, size // 2)
    starts = [*range(0, n - size, step), n - size]
    edges = [0, *((a + size + b) // 2 for a, b in zip(starts, starts[1:])), n]
    return [(a, a + size, lo, hi) for a, lo, hi in zip(starts, edges, edges[1:])]


def infer(pages: DataFrame, key: str, kind: str, weights: dict, size: int = 2048, vectors: str = "vectors") -> DataFrame:
    """key, probs: the head's probabilities of pages(key, vectors), in windows of ``size`` blocks; not rounded, for thresholds."""
    shared = pages.sparkSession.sparkContext.broadcast((kind, {k: np.asarray(v, float) for k, v in weights.items()}))

    def each(batches):
        name, w = shared.value
        head = HEADS[name](w)
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch, probs = whole.slice(at, 100), []
                for page in batch.column(vectors).to_pylist():
                    x, out = np.array(page or [], float), []
                    for a, b, lo, hi in windows(len(x), size) if len(x) else ():
                        out.append(head(x[a:b])[lo - a : hi - a])
                    probs.append(np.concatenate(out).tolist() if out else [])
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(probs, pa.list_(pa.float64()))], [key, "probs"])

    return pages.select(key, vectors).mapInArrow(each, f"`{key}` {pages.schema[key].dataType.simpleString()}, probs array<double>")


def vocabulary(pages: DataFrame, table: DataFrame, width: int, tokens: str = "tokens") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens in pages(tokens: an array of integers for each block) that table(token, vector) has: the tokens in order,
    the sums of their normalised vectors and how many there are of each; null components are 0, vectors without any don't count.

    It is collected: as many vectors as there are different tokens, however many tokens there are.
    """
    found = pages.select(F.explode(F.array_distinct(F.flatten(tokens))).alias("token")).distinct()
    own = F.slice("vector", 1, width)
    rows = embedded(found, table).select("token", own.alias("vector")).where(F.exists("vector", lambda x: x.isNotNull())).collect()
    ids, at = np.unique(np.array([r.token for r in rows], np.int64), return_inverse=True)
    sums = np.zeros((len(ids), width))
    for i, r in zip(at, rows):
        sums[i, : len(r.vector)] += [x or 0.0 for x in r.vector]
    return ids, sums, np.bincount(at, minlength=len(ids))


def pooled(rows: np.ndarray, tokens: np.ndarray, n: int, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean vectors of n blocks from their tokens (rows: the block of each); zeros for blocks without any that is known."""
    ids, sums, counts = known
    out = np.zeros((n, sums.shape[1]))
    at = np.searchsorted(ids, tokens)
    at[at == len(ids)] = 0
    own = ids[at] == tokens if len(ids) else np.zeros(len(tokens), bool)
    pairs, times = np.unique(rows[own] * len(ids) + at[own], return_counts=True)
    if not len(pairs):
        return out
    block, token = np.divmod(pairs, len(ids))
    edges = np.flatnonzero(np.diff(block, prepend=-1))
    with np.errstate(invalid="ignore"):  # vectors need not be finite
        for a in range(0, len(edges), 1000):  # so many blocks at a time; a block has a vector for each of its different tokens
            lo, hi = edges[a], edges[a + 1000] if a + 1000 < len(edges) else len(pairs)
            e, t, k = edges[a : a + 1000] - lo, token[lo:hi], times[lo:hi]
            out[block[lo + e]] = np.add.reduceat(sums[t] * k[:, None], e) / np.add.reduceat(counts[t] * k, e)[:, None]
    return out


def infer_tokens(pages: DataFrame, key: str, known: tuple[np.ndarray, np.ndarray, np.ndarray], kind: str, weights: dict, size: int = 2048, tokens: str = "tokens") -> DataFrame:
    """key, probs: as ``infer``, of pages(key, tokens), a row for each key, whose blocks are pooled from ``vocabulary``'s vectors
    where they are scored: no row or vector for each token leaves a task.

    tokens has, for each row that the page came in (one, as a rule), an array of integers for each block.  Blocks in the same
    place are pooled together, and probs has their probability once for each row.
    """
    shared = pages.sparkSession.sparkContext.broadcast((kind, {k: np.asarray(v, float) for k, v in weights.items()}, known))

    def lengths(lists):
        return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def starts(n):
        return np.concatenate([[0], np.cumsum(n)])

    def scored(rows, head, own):
        """A list of probabilities for each of some pages."""
        copies = rows.flatten()
        blocks = copies.flatten()
        n = lengths(copies)
        page = np.repeat(np.arange(len(rows)), lengths(rows))  # of each copy
        longest = np.zeros(len(rows), np.int64)
        np.maximum.at(longest, page, n)
        base = starts(longest)
        place = np.repeat(base[page] - starts(n)[:-1], n) + np.arange(len(blocks))  # of each block
        x = pooled(np.repeat(place, lengths(blocks)), blocks.flatten().to_numpy().astype(np.int64), base[-1], own)
        probs = np.zeros(base[-1])
        for at, to in zip(base, base[1:]):
            for a, b, lo, hi in windows(to - at, size) if to > at else ():
                probs[at + lo : at + hi] = head(x[at + a : at + b])[lo - a : hi - a]
        ends = starts(n)[starts(lengths(rows))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(probs[place], pa.float64()))

    def each(batches):
        name, w, own = shared.value
        head = HEADS[name](w)
        for batch in batches:
            rows = batch.column(tokens)
            n = starts(lengths(rows.flatten()))[starts(lengths(rows))]
            edges = [0, *(np.flatnonzero(np.diff(n[1:] // 8000)) + 1), len(rows)]  # runs of some 8000 blocks, or a page
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), scored(rows.slice(a, b - a), head, own)], [key, "probs"])

    return pages.select(key, tokens).mapInArrow(each, f"`{key}` {pages.schema[key].dataType.simpleString()}, probs array<double>")


def export(pages: DataFrame, probs: DataFrame, key: str) -> DataFrame:
    """key, probs for every page; an empty list for pages that were not scored."""
    return pages.select(key).join(probs, key, "left").select(key, F.coalesce("probs", F.array().cast("array<double>")).alias("probs"))


# ---- artefacts and training


def save(spark: SparkSession, path: str, kind: str, weights: dict, note: str = "") -> None:
    """A head as rows name, shape, values, with its kind; the folder must not exist."""
    arrays = {k: np.asarray(v, float) for k, v in weights.items()}
    rows = [(kind, note, k, list(a.shape), a.ravel().tolist()) for k, a in arrays.items()]
    spark.createDataFrame(rows, "kind string, note string, name string, shape array<int>, values array<double>").write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[str, dict[str, np.ndarray]]:
    rows = spark.read.parquet(path).collect()  # the arrays of one head
    return rows[0].kind, {r.name: np.array(r["values"]).reshape(r.shape) for r in rows}


def trained(train: DataFrame, val: DataFrame, features: str, label: str, iterations: tuple[int, ...] = (5, 10, 20, 40)) -> tuple[dict, list[dict]]:
    """A linear head on frozen vectors: weights of the best budget by validation F1 (the earliest of equals), and the curve."""
    from corpusloom.operators.metrics import confusion
    from corpusloom.operators.model import linear_head, probability

    best, curve = None, []
    for n in iterations:
        m = linear_head(train, features, label, iterations=n)
        f1 = confusion(probability(val, m, features), F.col("prob") > 0.5, F.col(label) == 1).first()["f1"]
        curve.append({"epoch": n, "val": f1})
        if best is None or f1 > best[0]:
            best = (f1, {"v": m.coefficients.toArray(), "o": np.array(float(m.intercept))})
    return best[1], curve


RECIPES: dict[str, Callable] = {}


def recipe(name: str):
    """Decorator: a recipe is a function from a config and its inputs to (result, curve)."""

    def add(fn):
        RECIPES[name] = fn
        return fn

    return add


@recipe("table")
def table_recipe(config: dict, inputs: dict[str, DataFrame]) -> tuple[dict, list[dict]]:
    """Trains a linear head, scans thresholds on val, saves the artefact at config['path']."""
    from corpusloom.operators import metrics, model

    weights, curve = trained(inputs["train"], inputs["val"], "vector", "label")
    save(inputs["train"].sparkSession, config["path"], "linear", weights, config.get("note", ""))
    dot = F.aggregate(F.zip_with("vector", F.array(*map(F.lit, weights["v"].tolist())), lambda a, b: a.cast("double") * b), F.lit(float(weights["o"])), lambda t, x: t + x)
    best = metrics.best_threshold(inputs["val"], model.numbers.sigmoid(dot), F.col("label") == 1).where("best").first()
    return {"threshold": best["threshold"], "val_f1": best["f1"], "best_val": max(c["val"] for c in curve)}, curve
