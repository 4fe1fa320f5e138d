"""Near-duplicates by BagMinHash: weighted Jaccard over multisets of five-word shingles.

Signature.  Every shingle owns one Poisson process of rate 1 for each unit of its weight (its count), arranged as a
hierarchy: the intervals [0,1), [1,2), [2,4), [4,8), ... of the weight axis are roots.  The first point of an interval of
width r comes after an exponential time of rate r; the point is then followed down to one unit by fair splits, and each
sibling it passes starts anew from that time.  All draws depend only on the shingle and the interval, so two documents
see the same points wherever both weights reach.  Each point falls into one of M components, and a component keeps its
earliest point: two signatures agree in a component with probability equal to the weighted Jaccard of the documents.
Points later than a limit that leaves no component empty are never drawn (a document with an empty component is redone
with twice the limit), so the work per document is its number of shingles plus about M log M points.

Grouping.  Documents with equal multisets are one node (combined before any shuffle).  BANDS bands of ROWS components
give bucket keys; P(no shared bucket) is below 1e-4 at similarity 0.8.  In each bucket every node is compared with one
centre, not with all others: the node that shares most bucket places with others.  A pair is linked if the exact multiset
overlap gives a similarity of THRESHOLD or more.  What a bucket then holds besides its centre's component gets a centre of
its own.  Where a bucket still holds several components, an exact prefix filter gives the pairs that are left: to be
similar enough, two multisets must share one of their rarest items, n - o + 1 of them if o is the least overlap that the
sizes in their buckets allow.  Nodes outside the largest component of such a bucket are joined on these items with all
others, and the pairs not compared so far are verified, but for those that the items found in no other node rule out.  So no link between nodes that share a bucket is lost, and no
bucket is expanded into all its pairs.

Scale: each task keeps a group of texts; sketches are 220 bytes a document; shingle sets are only made for documents in
buckets of two nodes or more.  What a bucket has one row of (its size, its centre, its largest component) is joined to its
nodes by a shuffle, but by a broadcast for large buckets, so no task gets all nodes of one.  Components are found with joins over tables written to the shared folder.

Defined cases: a text of 1 to 4 words has one shingle, all its words.  Null texts and texts without words are alone in
their class.  A class is named by its least doc_id (null if all are null).  Repeated rows are copies of one another.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, drop_table, grams, mix, pieces, quoted, table, within

SHINGLE, THRESHOLD = 5, 0.8
M, BANDS, ROWS = 128, 25, 5
#: Ids up to this number (8 bytes each, 16 with the hash of a text) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Buckets of more than HOT_LEAST nodes and more than 1 / HOT_KEYS of all places are large: fewer than HOT_KEYS (60 bytes each).
HOT_KEYS, HOT_LEAST = 100_000, 1000
#: Texts are sketched in groups of about so many bytes.
SKETCH_BYTES = 700_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def gap(x: np.ndarray) -> np.ndarray:
    """Exponential of rate 1 from random bits."""
    return -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT)


def seed(s: np.ndarray, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
    return mix(s ^ mix(lo.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + width.astype(np.uint64)))


class Sketcher:
    def __init__(self, shingle: int = SHINGLE):
        self.k, self.hasher = shingle, WordHasher()

    def multisets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, count), sorted by text and shingle."""
        h, starts = self.hasher.group(texts)
        at = within(starts, self.k)
        s = grams(h, self.k)[at]
        doc = np.searchsorted(starts, at, "right") - 1
        n = np.diff(starts)
        short = np.flatnonzero((n > 0) & (n < self.k))
        if len(short):
            own = np.array([grams(h[starts[i] : starts[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short], np.uint64)
            s, doc = np.concatenate([s, own]), np.concatenate([doc, short])
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        where = np.flatnonzero(first)
        return doc[where], s[where], np.diff(np.append(where, len(s)))

    @staticmethod
    def digests(doc: np.ndarray, s: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of each multiset (0, 0 for an empty one)."""
        out = np.zeros((2, n), np.uint64)
        if len(doc):
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for i, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
                out[i, doc[at]] = mix(np.add.reduceat(mix((s ^ np.uint64(salt)) + mix(w.astype(np.uint64) * np.uint64(salt))), at))
        return out[0], out[1]

    @staticmethod
    def signatures(doc: np.ndarray, s: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """The earliest point of each component, a row per text (infinite for empty multisets)."""
        sig = np.full((n, M), np.inf)
        weight = np.bincount(doc, w, minlength=n)
        limit = M * (np.log(M) + 2.5) / np.maximum(weight, 1)
        todo = weight > 0
        while todo.any():
            own = todo[doc]
            sig[todo] = np.inf
            Sketcher.points(doc[own], s[own], w[own], limit, sig)
            todo = todo & np.isinf(sig).any(1)
            limit = limit * 2
        return sig

    @staticmethod
    def points(doc, s, w, limit, sig) -> None:
        flat = sig.reshape(-1)
        parts, lo, width = [], 0, 1
        own = np.arange(len(doc))
        while len(own):  # the roots that each weight reaches
            low, wide = np.full(len(own), lo), np.full(len(own), width)
            state = seed(s[own], low, wide)
            t = gap(mix(state)) / width
            go = t <= limit[doc[own]]
            parts.append((own[go], low[go], wide[go], t[go]))
            lo, width = (1, 1) if lo == 0 else (lo * 2, lo * 2)
            own = own[w[own] > lo]
        own, low, wide, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        state = seed(s[own], low, wide) + _GOLD
        while len(own):
            more = []
            while (big := np.flatnonzero(wide > 1)).size:  # follow the point down; siblings start from its time
                half = wide[big] // 2
                right = (mix(state[big]) >> np.uint64(63)).astype(np.int64)
                sibling = low[big] + (1 - right) * half
                new = seed(s[own[big]], sibling, half)
                ts = t[big] + gap(mix(new)) / half
                ok = (sibling < w[own[big]]) & (ts <= limit[doc[own[big]]])
                more.append((own[big][ok], sibling[ok], half[ok], ts[ok], new[ok] + _GOLD))
                low[big] += right * half
                wide[big] = half
                state[big] = seed(s[own[big]], low[big], half) + _GOLD
            ok = low < w[own]
            own, low, wide, t, state = own[ok], low[ok], wide[ok], t[ok], state[ok]
            x = mix(state)
            np.minimum.at(flat, doc[own] * M + (x & np.uint64(M - 1)).astype(np.int64), t)
            t, state = t + gap(x), state + _GOLD
            ok = t <= limit[doc[own]]
            more.append((own[ok], low[ok], wide[ok], t[ok], state[ok]))
            own, low, wide, t, state = (np.concatenate(x) for x in zip(*more, strict=True))

    @staticmethod
    def bands(sig: np.ndarray) -> np.ndarray:
        """BANDS bucket keys of each signature."""
        bits = sig[:, : BANDS * ROWS].copy().view(np.uint64).reshape(len(sig), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (len(sig), BANDS)).copy()
        for r in range(ROWS):
            key = mix(key ^ bits[:, :, r])
        return key


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, at (hash of the text: tells rows of one id apart), node (digest of the multiset; null without words), n
    (shingles), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        own = Sketcher()
        for batch in pieces(batches, SKETCH_BYTES):
            texts = batch.column("text").to_pylist()
            doc, s, w = own.multisets(texts)
            d1, d2 = own.digests(doc, s, w, len(texts))
            keys = own.bands(own.signatures(doc, s, w, len(texts)))
            n = np.bincount(doc, w, minlength=len(texts)).astype(np.int64)
            none = n == 0
            node = pa.StructArray.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], ["a", "b"], mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), node, pa.array(n), lists(keys[~none].view(np.int64).reshape(-1), np.where(none, 0, BANDS))], ["doc_id", "at", "node", "n", "bands"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash(docs).alias("at")).mapInArrow(each, f"doc_id {kind}, at bigint, node struct<a:bigint,b:bigint>, n bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, items: the multiset as a set, the c-th occurrence of a shingle being an item of its own."""

    def each(batches):
        own = Sketcher()
        for batch in pieces(batches, SKETCH_BYTES):
            texts = batch.column("text").to_pylist()
            doc, s, w = own.multisets(texts)
            d1, d2 = own.digests(doc, s, w, len(texts))
            at = np.concatenate([[0], np.cumsum(w)])
            nth = np.arange(at[-1]) - np.repeat(at[:-1], w)
            items = np.repeat(s, w) + mix(nth.astype(np.uint64)) * (nth > 0).astype(np.uint64)
            node = pa.StructArray.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], ["a", "b"])
            yield pa.RecordBatch.from_arrays([node, lists(items.view(np.int64), np.bincount(doc, w, minlength=len(texts)).astype(np.int64))], ["node", "items"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "node struct<a:bigint,b:bigint>, items array<bigint>")


def few(ids: DataFrame, count: int) -> DataFrame:
    """A broadcast where the rows (8 or 16 bytes each) were counted to be few."""
    return F.broadcast(ids) if count <= BROADCAST_IDS else ids


class Grouping:
    """The steps between sketches and classes; every step is a table in the shared folder, until close()."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD):
        self.docs, self.threshold, self.made = docs, threshold, []
        self.sketches = self.table(sketches(docs), "bagminhash-sketches", packed=False)
        self.nodes = self.table(
            self.sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.min(F.expr("if(doc_id is null, null, struct(doc_id, at))")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")),
            "bagminhash-nodes",
        )
        self.unnamed = self.nodes.where("doc_id is null").limit(1).count() > 0
        keys = self.nodes.select("node", "n", F.explode("bands").alias("key"))
        counts = table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "bagminhash-counts", packed=True)
        total = counts.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
        self.often = F.col("members") > max(HOT_LEAST, total // HOT_KEYS)  # holds for fewer than HOT_KEYS keys
        hot = F.broadcast(counts.where(self.often))
        cold = keys.join(hot.select("key"), "key", "left_anti").join(counts.where(~self.often), "key")
        shared = table(keys.join(hot, "key").unionByName(cold), "bagminhash-shared", packed=True)
        company = shared.groupBy("node").agg(F.sum("members").alias("company"))
        self.buckets = self.table(shared.join(company, "node").select("key", "node", "n", "company", "members"), "bagminhash-buckets")
        drop_table(counts)
        drop_table(shared)

    def table(self, df: DataFrame, name: str, packed: bool = True) -> DataFrame:
        self.made.append(table(df, name, packed))
        return self.made[-1]

    def close(self) -> None:
        """Removes the tables; nothing that read them may be used any more."""
        while self.made:
            drop_table(self.made.pop())

    def by_bucket(self, rows: DataFrame, side, how: str = "inner") -> DataFrame:
        """rows joined with side(rows), which has one row for a key at most; the few large buckets are not shuffled."""
        large, small = rows.where(self.often), rows.where(~self.often)
        return large.join(F.broadcast(side(large)), "key", how).unionByName(small.join(side(small), "key", how))

    def around(self, rows: DataFrame) -> DataFrame:
        """Pairs of each node with the centre of each of its buckets."""
        centres = lambda own: own.groupBy("key").agg(F.max(F.struct("company", "node", "n")).alias("c"))
        return self.by_bucket(rows, centres).select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("c.node").alias("y"), F.col("c.n").alias("ny"))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, items of the nodes given: from one document of each."""
        own = self.nodes.select("node", "doc_id", "at").join(nodes, "node")
        ids = own.where("doc_id is not null").select("doc_id").distinct()
        texts = self.docs.join(few(ids, ids.count()), "doc_id", "left_semi").select("text")
        if self.unnamed:  # nodes without an id are found by the hash of a text, copies of that text once
            ats = own.where("doc_id is null").select("at").distinct()
            rows = self.docs.where("doc_id is null").select(F.col("text").cast("string").alias("text"))
            rows = rows.join(few(ats, ats.count()), text_hash(rows) == ats["at"], "left_semi")
            texts = texts.select(F.col("text").cast("string").alias("text")).unionByName(rows.dropDuplicates(["text"]))
        return shingle_sets(texts)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) of nodes whose multisets overlap by the threshold."""
        sets = self.sets(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct())
        got = pairs.join(sets.select(F.col("node").alias("x"), F.col("items").alias("xs")), "x").join(sets.select(F.col("node").alias("y"), F.col("items").alias("ys")), "y")
        both = F.size(F.array_intersect("xs", "ys"))
        return got.where(both >= self.threshold * (F.size("xs") + F.size("ys") - both) - 1e-9).select("x", "y").distinct()

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Each pair once, smaller node first; pairs whose sizes rule the threshold out are left."""
        fits = F.least("nx", "ny") >= self.threshold * F.greatest("nx", "ny") - 1e-9
        return pairs.where(fits & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def components(self, links: DataFrame) -> DataFrame:
        """node, component: the least node that links reach (least neighbours, then jumps to the component's component)."""
        edges = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        label = table(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("component")).select(F.col("x").alias("node"), "component"), "bagminhash-components", packed=True)
        while True:
            seen = edges.join(label.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
            step = label.join(seen, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
            jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
            new = table(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old"), "bagminhash-components", packed=True)
            moved = new.where("component != old").limit(1).count()
            drop_table(label)
            label = new
            if not moved:
                self.made.append(label)
                return label.select("node", "component")

    def mixed(self, links: DataFrame) -> DataFrame:
        """Rows (key, node, n, company, members, component) of the buckets that hold nodes of several components."""
        rows = self.buckets.join(self.components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = lambda own: own.where("members > 2").groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("key")
        rows = table(rows, "bagminhash-coloured", packed=True)
        out = self.table(self.by_bucket(rows, several, "left_semi"), "bagminhash-mixed")
        drop_table(rows)
        return out

    def besides(self, rows: DataFrame) -> DataFrame:
        """The rows that are not in the largest component of their bucket."""

        def main(own):
            size = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
            return size.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main")).select("key", F.col("main.component").alias("main"))

        return self.by_bucket(rows, main).where("component != main").drop("main")

    def rare_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of nodes of different components that share one of their rarest items, one of them beside the largest."""
        least = lambda own: own.groupBy("key").agg(F.min("n").alias("least"))
        nodes = self.by_bucket(rows, least).groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.min("least").alias("least"))
        t = self.threshold
        # the least overlap with a partner that is as small as the buckets and the threshold allow
        partner = F.greatest(F.ceil(F.col("n") * t - 1e-9), F.col("least"))
        overlap = F.ceil((F.col("n") + partner) * (t / (1 + t)) - 1e-9)
        nodes = self.table(nodes.withColumn("prefix", (F.col("n") - overlap + 1).cast("int")), "bagminhash-prefixes")
        items = self.sets(nodes.select("node")).join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", F.explode("items").alias("item"))
        items = table(items, "bagminhash-items", packed=True)
        seen = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
        ranked = items.join(seen, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("l"))  # a document's items
        common = F.size(F.filter("l", lambda i: i["df"] > 1)).alias("common")  # no overlap is larger
        prefix = ranked.join(nodes, "node").select("node", "n", "component", common, F.explode(F.slice("l", F.lit(1), F.greatest("prefix", F.lit(1)))).alias("i"))
        prefix = self.table(prefix.where("i.df > 1").select("node", "n", "component", "common", F.col("i.item").alias("item")), "bagminhash-prefix")
        drop_table(items)
        few_rows = self.besides(rows).select("node").distinct()
        a = prefix.join(few_rows, "node", "left_semi").alias("a")
        enough = F.least("a.common", "b.common") >= (F.col("a.n") + F.col("b.n")) * (t / (1 + t)) - 1e-9
        return a.join(prefix.alias("b"), "item").where("a.component != b.component").where(enough).selectExpr("a.node as x", "a.n as nx", "b.node as y", "b.n as ny")

    def linked(self) -> DataFrame:
        """node, component for every node that has a link."""
        tested = self.table(self.compared(self.around(self.buckets)), "bagminhash-tested")
        links = self.table(self.verified(tested), "bagminhash-links")
        for step in ("beside", "rare"):
            rows = self.mixed(links)
            if not rows.limit(1).count():
                break
            own = self.besides(rows) if step == "beside" else None
            pairs = self.around(own) if step == "beside" else self.rare_pairs(rows)
            pairs = self.table(self.compared(pairs).join(tested, ["x", "y"], "left_anti"), "bagminhash-tested")
            if pairs.limit(1).count():
                tested = tested.unionByName(pairs)
                links = links.unionByName(self.table(self.verified(pairs), "bagminhash-links"))
        return self.components(links)

    def classes(self) -> DataFrame:
        """doc_id, at, class_id, class_size, copies, stays (the row that a class with an id keeps): a row for each row of
        the documents."""
        linked = self.linked()
        named = self.nodes.select("node", "row", "copies").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        whole = named.groupBy("component").agg(F.min("row").alias("row"), F.sum("copies").alias("class_size"))
        named = named.drop("row").join(whole, "component").where("class_size > 1").select("node", "row", "class_size", "copies")
        return self.sketches.select("doc_id", "at", "node").join(named, "node", "left").select(
            "doc_id", "at", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("row.doc_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
            (F.col("class_size").isNull() | ((F.col("doc_id") == F.col("row.doc_id")) & (F.col("at") == F.col("row.at")))).alias("stays"),
        )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, copies (documents with the same multiset of shingles) for each row of docs."""
    own = Grouping(docs, threshold)
    out = table(own.classes().select("doc_id", "class_id", "class_size", "copies"), "bagminhash-classes")
    own.close()
    return out


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of docs: of the doc_id that names it, and of that id's texts in the class one.

    Rows are told apart by id and text, so an id may stand on texts of several classes.  Rows whose id is null stay.
    """
    own = Grouping(docs, threshold)
    classes = own.classes().where("class_size > 1 and doc_id is not null")
    classes = table(classes.select(F.col("doc_id").alias("own_id"), "at", "stays"), "bagminhash-classes")
    own.close()
    gone = classes.where("not stays").select("own_id", "at").distinct()
    again = classes.where("stays").groupBy("own_id", "at").count().where("count > 1").select("own_id", "at")
    same = lambda rows: (docs["doc_id"] == rows["own_id"]) & (text_hash(docs) == rows["at"])
    kept = docs.join(few(gone, gone.count()), same(gone), "left_anti")
    repeats = again.count()
    if repeats:
        again = few(again, repeats)
        kept = kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*(F.col(quoted(c)) for c in docs.columns))
