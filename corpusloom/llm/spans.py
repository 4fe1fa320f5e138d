"""Substring dedup over sentence spans.

A text is cut into sentences: after ``.``, ``!``, ``?`` (or their full-width forms) before white space, and at line ends.
From every sentence with words on, a span takes sentences until it has RUN of them with words and MIN_WORDS words.  Spans
are hashed over their words (case, punctuation and white space do not count) to 128 bits and grouped over the whole
corpus.  Of equal spans the one with the least (doc_id, row, place) is the first; sentences that any other occurrence
covers are removed, whole, with the white space behind them.  So a passage that repeats across documents stays once.
With ``across`` only occurrences in other rows than the first one's are removed: what a document merely repeats within
itself stays.

Scale: spans (44 bytes each) are computed once, into a table; they are shuffled twice, texts once.  Counting combines spans
before the shuffle.  Spans that occur more often than HOT_LEAST and a HOT_KEYS-th of all are at most HOT_KEYS, so they are
joined by a broadcast; all others are joined by a shuffle in which no key is large.  A document's spans are gathered per
document.

Rows are told apart by file and place in the file, whatever the splits; ``docs`` that is no plain scan of Parquet files is
written to a table first.

Defined cases: null texts stay null and have no sentence.  Texts with too few sentences or words have no span and stay.
Repeated rows: the first stays, the others lose what they repeat.  Null ids come before all others
and are not listed among the firsts.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, mix, pieces, powers, table

RUN, MIN_WORDS = 3, 12
#: At most HOT_KEYS spans (40 bytes each) are broadcast: those with more than 1 / HOT_KEYS of all, and more than HOT_LEAST.
HOT_KEYS, HOT_LEAST = 100_000, 1000
CUT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n\s*")
_A, _B = 0x5851F42D4C957F2D, 0xDA942042E4DD58B5


def sentences(text: str) -> list[int]:
    """Where sentences begin, and the end of the text."""
    at = [0, *(m.end() for m in CUT.finditer(text) if 0 < m.end() < len(text)), len(text)]
    return at if text else [0]


def folded(h: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run h[at[i] : at[i + 1]], in order."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h))[: len(h)], out=total[1:])
    down = powers(pow(base, -1, 1 << 64), len(h) + 1)
    return (total[at[1:]] - total[at[:-1]]) * down[at[:-1]]


def spans_of(texts: list[str | None], hasher: WordHasher, run: int, least: int) -> tuple[np.ndarray, ...]:
    """Of every span: text, first sentence, sentence after the last one, and two hashes."""
    pieces, owner, number = [], [], []
    for i, t in enumerate(texts):
        at = sentences(t) if t else [0]
        pieces += [t[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] if t else []
        owner += [i] * (len(at) - 1)
        number += range(len(at) - 1)
    h, starts = hasher.group(pieces)
    words = np.diff(starts)
    some = np.flatnonzero(words)  # sentences with words
    doc, place = np.array(owner, np.int64)[some], np.array(number, np.int64)[some]
    s = mix(folded(h, starts, _A) + words.astype(np.uint64))[some]
    before = np.concatenate([[0], np.cumsum(words[some])])
    n = len(some)
    first = np.arange(n)
    last = np.maximum(np.searchsorted(before, before[:-1] + least), first + run)  # after the last sentence
    end = np.searchsorted(doc, doc, "right")  # after the text's last sentence
    first = first[last <= end]
    last = last[first]
    out = []
    for base in (_A, _B):
        x = mix(s ^ np.uint64(base)) * powers(base, n)[:n] if n else s
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        down = powers(pow(base, -1, 1 << 64), n + 1)
        out.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
    return doc[first], place[first], place[last - 1] + 1, out[0], out[1]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: struct of a hash of the file's name and the place in the file."""
    own = ["doc_id", F.col("text").cast("string").alias("text")]
    try:
        return docs.select(*own, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias("row"))
    except AnalysisException:  # no plain scan of files: its rows have no place yet
        return rows_of(table(docs.select(*own), "spans-rows"))


def spans(rows: DataFrame, run: int = RUN, least: int = MIN_WORDS) -> DataFrame:
    """h1, h2, at (struct doc_id, row, a: the first sentence), b (sentence after the last one); rows as rows_of() gives them."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches):
        hasher = WordHasher()
        for batch in pieces(batches):
            doc, a, b, h1, h2 = spans_of(batch.column("text").to_pylist(), hasher, run, least)
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column("doc_id").take(doc),
                batch.column("f").take(doc), batch.column("i").take(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
            ], ["h1", "h2", "doc_id", "f", "i", "a", "b"])

    found = rows.select("doc_id", "text", "row.f", "row.i").mapInArrow(each, f"h1 bigint, h2 bigint, doc_id {kind}, f bigint, i bigint, a int, b int")
    return found.select("h1", "h2", F.struct("doc_id", F.struct("f", "i").alias("row"), "a").alias("at"), "b")


def repeated(rows: DataFrame, run: int = RUN, least: int = MIN_WORDS, across: bool = False) -> DataFrame:
    """row, cover (sentence ranges to remove), firsts (doc_ids that keep them): documents that lose sentences."""
    found = table(spans(rows, run, least), "spans")
    first = table(found.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "spans-first")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > max(HOT_LEAST, total // HOT_KEYS)  # fewer than HOT_KEYS keys
    hot = F.broadcast(first.where(often).drop("n"))
    cold = found.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(first.where(~often).drop("n"), ["h1", "h2"])
    other = found.join(hot, ["h1", "h2"]).unionByName(cold).where("at.row != first.row" if across else "at != first")
    return other.groupBy(F.col("at.row").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("at.a").alias("a"), "b"))).alias("cover"), F.sort_array(F.collect_set("first.doc_id")).alias("firsts")
    )


def deduplicate(docs: DataFrame, run: int = RUN, least: int = MIN_WORDS, across: bool = False) -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed, firsts (doc_ids that keep the removed passages)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows_of(docs)
    joined = rows.join(repeated(rows, run, least, across), "row", "left").select("doc_id", "text", "cover", "firsts")

    def cut(batches):
        for batch in pieces(batches):
            texts, n, gone = [], [], []
            for t, cover in zip(batch.column("text").to_pylist(), batch.column("cover").to_pylist(), strict=True):
                at = sentences(t) if t else [0]
                drop = np.zeros(len(at) - 1, bool)
                for c in cover or ():
                    drop[c["a"] : c["b"]] = True
                n.append(len(drop))
                gone.append(int(drop.sum()))
                texts.append(t if not gone[-1] else "".join(t[a:b] for a, b, d in zip(at[:-1], at[1:], drop.tolist(), strict=True) if not d))
            firsts = batch.column("firsts")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), firsts], ["doc_id", "text", "n_sentences", "n_removed", "firsts"])

    out = joined.mapInArrow(cut, f"doc_id {kind}, text string, n_sentences bigint, n_removed bigint, firsts array<{kind}>")
    return out.withColumn("firsts", F.coalesce("firsts", F.array().cast(f"array<{kind}>")))
