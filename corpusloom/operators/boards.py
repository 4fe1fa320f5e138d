"""Boards and extractors: folds, masks, predictions, scorers, and registries for a user's own."""

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dom, metrics, splits

# ---- masks and predictions


def masked(lines: DataFrame, key: str, mask: Column, order: str = "idx", line: str = "text") -> DataFrame:
    """key, pred: the chosen lines of each page, adapted and newline-joined; a page without any has an empty text."""
    kept = F.collect_list(F.when(mask, F.struct(F.col(order).alias("i"), T.adapt(T.unescape(F.col(line))).alias("t"))))  # a page's lines
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["t"]), "\n").alias("pred"))


def oracle(label: Column) -> Column:
    return F.coalesce(label == 1, F.lit(False))


def select_all() -> Column:
    return F.lit(True)


def above(prob: Column, threshold: float = 0.5) -> Column:
    """Strictly above, as training decides; a line without a probability is left out."""
    return F.coalesce(prob > threshold, F.lit(False))


def marked(pages: DataFrame, masks: DataFrame, key: str = "page_id") -> DataFrame:
    """key, main_html, markdown: pages(key, html) pruned to the lines that masks(key, mask: an array over the rendered lines)
    choose; the page is parsed and rendered once."""

    def each(html, mask):
        root = dom.Tree(html).root
        dom.sanitize(root)
        lines, src = dom.render(root)
        blocks = [i for i, t in enumerate(lines) if t.strip()]
        if len(mask or []) != len(blocks):
            raise ValueError(f"{len(mask or [])} labels for {len(blocks)} lines")
        chosen = [i for i, x in zip(blocks, mask or [], strict=True) if x]
        own = {n.id for i in chosen for n in src[i]}
        for n in dom.walk(root):
            if n.id in own:
                n.attrs[dom.SELECT_ATTR] = "true"
        keep = dom.main_set(root)
        body = dom.pruned(root, keep).replace(f' {dom.SELECT_ATTR}="true"', "")
        return [(body, "\n".join(lines[i] for i in chosen))]

    return dom.per_page(pages.join(masks, key), "main_html string, markdown string", each, key, ["html", "mask"])


def clean_reference(html: Column) -> Column:
    """Texts of the ``p`` elements, white space folded, empty ones left out, newline-joined."""
    inner = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1))
    plain = F.transform(inner, lambda x: T.strip(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " ")))
    return F.array_join(F.filter(plain, lambda x: x != ""), "\n")


# ---- folds


def fold_prefix(pages: DataFrame, key: str, fold: str, limit: int | None, seed: int = 7) -> DataFrame:
    """The first pages of each fold in a keyed order; None keeps all."""
    if limit is None:
        return pages
    n = F.row_number().over(W.partitionBy(fold).orderBy(splits.shuffled(F.col(key), seed), key))
    return pages.withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


class Folds:
    """Subsets of a corpus by column values, each planned and cached once; close() gives the memory back."""

    def __init__(self, pages: DataFrame):
        self.pages, self.kept = pages, {}

    def get(self, **where) -> DataFrame:
        at = tuple(sorted(where.items()))
        if at not in self.kept:
            rows = self.pages
            for c, v in where.items():
                rows = rows.where(F.col(c) == v)
            self.kept[at] = rows.persist()
        return self.kept[at]

    def close(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()


def trainable(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Pages without blocks teach nothing; scoring keeps them."""
    return pages.where(F.size(blocks) > 0)


def collisions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def apart(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error if two corpora share an id."""
    if both := collisions(a, b, key).limit(5).collect():
        raise ValueError(f"ids in both: {both}")


def subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n ids of a, how many b lacks, and whether a is within b."""
    ids = a.select(key).distinct().join(b.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__in").isNull()).alias("missing")).withColumn("within", F.col("missing") == 0)


def totals(lines: DataFrame, key: str, label: str = "label") -> DataFrame:
    """One row: pages, pages with main content, lines, main lines and their share."""
    per = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("m"))
    out = per.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("m") > 0).alias("with_main"), F.sum("n").alias("lines"), F.sum("m").alias("main"))
    return out.withColumn("share", F.col("main") / F.greatest("lines", F.lit(1)))


# ---- scorers


def answered(records: DataFrame, preds: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Every record with its prediction: records drive, a record without a prediction is an error (or empty)."""
    out = records.join(preds.select(key, "pred"), key, "left")
    pred = F.coalesce("pred", F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast("string") if strict else F.lit(""))
    return out.withColumn("pred", pred)


def score_text(preds: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """preds(key, text, kind: html or text), refs(key, ref) -> one row n, n_null, prec, rec, f1; null references count in n_null."""
    plain = F.when(F.col("kind") == "html", T.html_to_text(F.col("text"))).otherwise(F.col("text"))
    rows = answered(refs, preds.withColumn("pred", plain), key)
    scores = metrics.word_f1(rows, [key, "ref", "pred"])
    known = F.col("ref").isNotNull()
    return metrics.board(scores.select(*(F.when(known, F.col(c)).alias(c) for c in ("prec", "rec", "f1"))))


def val_metric(refs: DataFrame, key: str) -> Callable[[DataFrame], float]:
    """A function from predictions(key, pred) to the mean F1 over records whose references are read once."""
    kept = refs.persist()
    return lambda preds: metrics.board(metrics.word_f1(answered(kept, preds, key), [key])).first()["f1"]


# ---- extractors and boards of a user's own

EXTRACTORS: dict[str, tuple[str, Callable[[str], str]]] = {}


def register(name: str, kind: str):
    """Decorator: an extractor is a function from html to a text (kind: html or text)."""
    if kind not in ("html", "text"):
        raise ValueError(f"kind {kind}")

    def add(fn):
        EXTRACTORS[name] = (kind, fn)
        return fn

    return add


@register("everything", "text")
def everything(html: str) -> str:
    return "\n".join(x for x in dom.render(dom.Tree(html).root)[0] if x.strip())


@register("article", "html")
def article(html: str) -> str:
    root = dom.Tree(html).root
    keep = dom.main_set(root, lambda n: n.tag in ("article", "main"))
    for n in dom.walk(root):
        if n.id in keep and n.tag in ("article", "main"):
            n.attrs[dom.SELECT_ATTR] = "true"
    return dom.pruned(root, keep)


@register("dense", "text")
def dense(html: str) -> str:
    """Lines outside navigation whose links hold less than half of their nodes, of some length."""
    lines, src = dom.render(dom.Tree(html).root)
    own = lambda s: not any(m.tag in ("nav", "header", "footer", "aside") for n in s for m in n.path())
    return "\n".join(t for t, s in zip(lines, src, strict=True) if s and own(s) and (len(t) >= 40 or any(n.tag in ("p", "h1", "h2", "h3") for n in s)) and sum(n.tag == "a" for n in s) * 2 <= len(s))


def extracted(pages: DataFrame, name: str, key: str = "page_id") -> DataFrame:
    """key, kind, text, error, ms: what an extractor gives for each page; empty texts stay, a failure has its message and no text."""
    import time

    kind, fn = EXTRACTORS[name]

    def each(batches):
        for pdf in batches:
            out = []
            for k, html in zip(pdf[key], pdf["html"], strict=True):
                began = time.perf_counter()
                try:
                    got, error = fn(html or ""), None
                except Exception as e:  # a user's code: the page is counted as failed
                    got, error = None, f"{type(e).__name__}: {e}"
                out.append((k, kind, got, error, 1000 * (time.perf_counter() - began)))
            yield pd.DataFrame(out, columns=[key, "kind", "text", "error", "ms"])

    return pages.select(key, "html").mapInPandas(each, f"{key} {pages.schema[key].dataType.simpleString()}, kind string, text string, error string, ms double")


class Board(Protocol):
    """What a benchmark board offers; every method gives or takes DataFrames."""

    name: str

    def pages(self, fold: str, limit: int | None = None) -> DataFrame: ...

    def references(self, fold: str) -> DataFrame: ...

    def scorer(self, fold: str) -> Callable[[DataFrame], float]: ...

    def score(self, preds: DataFrame, fold: str) -> DataFrame: ...


BOARDS: dict[str, Board] = {}


class PagesBoard:
    """A board over pages(page_id, html, fold), whose references are the articles."""

    def __init__(self, name: str, pages: DataFrame):
        self.name, self.table = name, pages
        BOARDS[name] = self

    def pages(self, fold: str, limit: int | None = None) -> DataFrame:
        return fold_prefix(self.table.where(F.col("fold") == fold), "page_id", "fold", limit)

    def references(self, fold: str) -> DataFrame:
        article = F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*?)</article>", 1)
        return self.pages(fold).select("page_id", F.when(article != "", T.html_to_text(article)).alias("ref"))

    def scorer(self, fold: str) -> Callable[[DataFrame], float]:
        return val_metric(self.references(fold), "page_id")

    def score(self, preds: DataFrame, fold: str) -> DataFrame:
        return score_text(preds, self.references(fold), "page_id")


def matrix(models: dict[str, Callable[[DataFrame], DataFrame]], boards: list[Board], fold: str) -> DataFrame:
    """model, board, n, n_null, prec, rec, f1 of every model on every board, whatever it was trained on (a row for each pair)."""
    out = None
    for name, predict in models.items():
        for b in boards:
            row = b.score(predict(b.pages(fold)), fold).select(F.lit(name).alias("model"), F.lit(b.name).alias("board"), "*")
            out = row if out is None else out.unionByName(row)
    return out
