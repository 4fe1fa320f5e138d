"""Benchmark decontamination by winnowing.

A *window* is a run of ``span`` consecutive words of a benchmark item (an item with fewer words, but not none, is one
window).  Every run of ``span`` words has ``span - k + 1`` k-grams; the smallest of their hashes is its fingerprint.
A document and an item that share ``span`` words therefore share a fingerprint, wherever the run stands: nothing that
long can be missed.  Fingerprints of the corpus are joined with those of the benchmark; each hit is extended to its whole
window, looked up among the benchmark's different windows and confirmed word by word; hits that touch make one span.

Work is in proportion to the words of a document, whatever repeats: a window that stands in an item (or in many items) any
number of times is one entry of the index, with the list of its items.

The benchmark side is cut into blocks of at most ``block_bytes`` characters: one block is broadcast, its size known
before anything is collected; a larger benchmark takes one pass over the corpus for each block, one after the other and
through a table, with the same result.  The corpus is never shuffled: each document is handled in the task that read it,
so a hot source or a passage that a third of all documents share costs no more than any other row.

Defined cases: null and empty texts, and texts without words, have no words and no hits.  Repeated rows each give a row.
Items without words never occur.  Items whose id is null count for hits but are not listed.  Several rows with one
item_id are one item.  Columns other than doc_id, text, item_id are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, drop_table, filtered, grams, pieces, smallest, table, within, words_of

SPAN, K = 10, 5
BLOCK_BYTES = 16_000_000
_OTHER = np.uint64(0x94D049BB133111EB)


class Index:
    """Fingerprints and windows of one block of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str]], span: int, k: int):
        self.span, self.k = span, k
        rows = [(i, w) for i, t in items if (w := words_of(t))]
        names = {i: n for n, i in enumerate(dict.fromkeys(i for i, _ in rows))}
        self.ids = list(names)
        joined = [" ".join(w).encode() + b" " for _, w in rows]
        self.text = b"".join(joined)
        self.h, starts = WordHasher().texts([x.decode() for x in joined])
        at = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32) + 1
        self.offset = np.concatenate([[0], at])  # where each word begins, in bytes
        item = np.repeat(np.array([names[i] for i, _ in rows], np.int64), np.diff(starts))
        g, spots = grams(self.h, k), within(starts, span)
        self.prints = np.unique(smallest(g, span - k + 1)[spots]) if len(spots) else np.zeros(0, np.uint64)
        lengths = np.diff(starts)
        #: length of a window -> its table
        self.windows = {span: self.table(spots, span, item)} if len(spots) else {}
        for length in sorted({int(x) for x in lengths if x < span}):
            self.windows[length] = self.table(starts[:-1][lengths == length], length, item)

    def table(self, at: np.ndarray, length: int, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each different window: hash (rising), a place where it stands, and its items (from first[e] to first[e + 1])."""
        key, other = self.hashes(self.h, at, length), self.hashes(self.h ^ _OTHER, at, length)
        order = np.lexsort((item[at], other, key))
        key, other, at = key[order], other[order], at[order]
        new = np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1]))
        own = new | np.append(True, item[at[1:]] != item[at[:-1]])  # an item counts once for a window
        return key[new], at[new], np.append(np.flatnonzero(new[own]), own.sum()), item[at[own]]

    @staticmethod
    def hashes(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """A hash of the ``length`` words from each place on."""
        out = np.zeros(len(at), np.uint64)
        for j in range(length):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
        return out

    @classmethod
    def of(cls, parts: dict) -> "Index":
        """The index again, from its parts (plain arrays and lists travel to the executors)."""
        own = cls.__new__(cls)
        own.__dict__ = dict(parts)
        return own

    def scan(self, texts: list[str | None], hasher: WordHasher) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: its number of words, the hit runs [from, to), and the items that occur."""
        h, starts = hasher.group(texts)
        found: list[list[tuple[int, int, np.ndarray, np.ndarray]]] = [[] for _ in texts]
        for length in self.windows:
            at = self.candidates(h, starts) if length == self.span else within(starts, length)
            if not len(at):
                continue
            key = self.windows[length][0]
            wanted = self.hashes(h, at, length)
            lo, hi = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
            same = np.flatnonzero(hi > lo)
            doc = np.searchsorted(starts, at[same], "right") - 1
            for d in np.unique(doc).tolist():
                own = same[doc == d] if len(texts) == 1 else same[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                found[d].append((length, int(starts[d]), at[own], np.stack([lo[own], hi[own]], 1)))
        out = []
        for d, hits in enumerate(found):
            spans, items = [], set()
            words = words_of(texts[d]) if hits else []
            for length, start, at, entries in hits:
                place, first, owner = self.windows[length][1:]
                sure = set()
                for a, (lo, hi) in zip((at - start).tolist(), entries.tolist(), strict=True):
                    text = " ".join(words[a : a + length]).encode()
                    for e in range(lo, hi):  # one, unless two windows have one hash
                        p = int(place[e])
                        if self.text[self.offset[p] : self.offset[p + length] - 1] == text:
                            spans.append((a, a + length))
                            sure.add(e)
                for e in sure:
                    items.update(owner[first[e] : first[e + 1]].tolist())
            out.append((int(starts[d + 1] - starts[d]), merged(spans), items))
        return out

    def candidates(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places of the windows whose fingerprint the benchmark has."""
        at = within(starts, self.span)
        if not len(at) or not len(self.prints):
            return at[:0]
        m = smallest(grams(h, self.k), self.span - self.k + 1)[at]
        known = np.flatnonzero(self.maybe(m))
        return at[known[np.isin(m[known], self.prints)]]

    def maybe(self, m: np.ndarray) -> np.ndarray:
        """A cheap test that every known fingerprint passes."""
        if not hasattr(self, "bits"):
            self.bits = np.zeros(1 << 20, bool)
            self.bits[(self.prints >> np.uint64(44)).astype(np.int64)] = True
        return self.bits[(m >> np.uint64(44)).astype(np.int64)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in pieces of about block_bytes, one at a time, and whether it is the last one."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r[0], r[1]) for r in own.toLocalIterator()], b == n - 1


def passes(docs: DataFrame, benchmark: DataFrame, span: int, k: int, block_bytes: int, step) -> DataFrame:
    """``step(docs, shared index, last)`` for one block of the benchmark after the other; a table between two blocks."""
    out = docs
    for items, last in blocks(benchmark, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(vars(Index(items, span, k)))
        new = step(out, index, last)
        if not last:
            new = table(new, "decontaminate")
            index.destroy()
            if out is not docs:
                drop_table(out)
        out = new
    return out


def scan(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES, text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, text (if wanted), n_words, spans (hit words as [from, to) pairs), items (item ids,
    sorted)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"
    start = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))

    def step(rows, index, last):
        kept = ["doc_id", "text"] if text or not last else ["doc_id"]

        def each(batches):
            own, hasher = Index.of(index.value), WordHasher()
            for batch in pieces(batches):
                had, listed = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                n, spans, names = [], [], []
                for (words, found, who), old, known in zip(own.scan(batch.column("text").to_pylist(), hasher), had, listed, strict=True):
                    names.append(sorted({*known, *(own.ids[i] for i in who if own.ids[i] is not None)}))
                    spans.append([{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in old] + found)])
                    n.append(words)
                kinds = batch.schema.field("spans").type, batch.schema.field("items").type
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(spans, kinds[0]), pa.array(names, kinds[1])], [*kept, "n_words", "spans", "items"])

        return rows.mapInArrow(each, f"doc_id {kind}, {'text string, ' if 'text' in kept else ''}{found}")

    return passes(start, benchmark, span, k, block_bytes, step)


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["b"] - s["a"])
    return scan(docs, benchmark, text=False, **kw).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no window occurs, all columns kept; every row is judged by its whole text."""

    def step(rows, index, last):
        def each(batches):
            own, hasher = Index.of(index.value), WordHasher()
            for batch in pieces(batches):
                yield batch.filter(pa.array([not found for _, found, _ in own.scan(batch.column("text").to_pylist(), hasher)], pa.bool_()))

        return filtered(rows, each)

    return passes(docs, benchmark, span, k, block_bytes, step)
