"""Text functions as Catalyst expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags whose ends must not join the words around them.
BLOCK_TAGS = "p div br li tr td th section article header footer aside nav blockquote pre figure figcaption ul ol table h1 h2 h3 h4 h5 h6".split()
DROPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
EDGES = r"^\s+|\s+$"
#: Patterns that labels and scores rest on, each with what takes its place, applied in this order.
UNESCAPED = [(r"\\([^\p{L}\p{N}_\s])", "$1")]
ADAPTED = [(r"\\_", "\x00"), (r"(?<![\p{L}\p{N}_\x00])_+|_+(?![\p{L}\p{N}_\x00])", ""), ("\x00", "_")]
NORMED = [(r"[*_]", ""), (r"\s+", " "), (EDGES, ""), (r"\s*\|[\s|]*", "|"), (r"^(?:[0-9]+\.\s+|>\s*|#+\s+)+", "")]


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and ``_`` of any script; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def segments(text: Column) -> Column:
    """Tokens for n-gram overlap: words, and every other character (white space too) by itself."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)([\p{L}\p{N}_]+|.)"), F.lit(1))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def language_tokens(text: Column, language: Column) -> Column:
    """Tokens; for languages written without blanks every letter of theirs is one."""
    single = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+)"), F.lit(1))
    return F.when(language.isin("zh", "ja"), single).otherwise(tokenize(text))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by an unprintable mark; none for shorter arrays."""
    starts = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return bound(tokens, lambda t: F.transform(starts(t), lambda i: F.array_join(F.slice(t, i, n), "\x01")))


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def html_to_text(html: Column) -> Column:
    """Visible text, one block a line: scripts, styles and comments go, block tags end lines, other tags vanish."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), DROPPED, "")
    s = F.regexp_replace(F.regexp_replace(s, BLOCK, "\n"), r"<[^>]*>", "")
    for name, char in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    lines = F.transform(F.split(s, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def blocks(text: Column) -> Column:
    """Non-blank lines, right-stripped."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+", "") != ""), lambda x: F.regexp_replace(x, r"\s+$", ""))


def unescape(text: Column) -> Column:
    r"""A backslash before punctuation goes."""
    return replaced(text, UNESCAPED)


def adapt(text: Column) -> Column:
    r"""Emphasis underscores go, escaped ones (``\_``) become plain, underscores within words stay."""
    return replaced(text, ADAPTED)


def norm(text: Column) -> Column:
    """A form for matching: single blanks, no emphasis marks, folded table pipes, no list, quote or heading marks in front."""
    return replaced(text, NORMED)


def join_selected(lines: Column, mask: Column | None = None) -> Column:
    """Kept lines, adapted, newline-joined; arrays of different length are an error; no mask keeps all."""
    if mask is None:
        kept = lines
    else:
        checked = F.when(F.size(lines) == F.size(mask), mask).otherwise(F.raise_error(F.lit("lines and mask differ in length")))
        kept = F.transform(F.filter(F.arrays_zip(lines.alias("l"), checked.alias("m")), lambda x: x["m"].cast("boolean")), lambda x: x["l"])
    return F.array_join(F.transform(kept, lambda x: adapt(unescape(x))), "\n")


def snippet_rate(text: Column, snippets: Column) -> Column:
    """Share of the snippets that occur in the text, whatever the case; 1 without snippets."""
    hit = F.size(F.filter(snippets, lambda s: F.contains(F.lower(text), F.lower(s))))
    return F.when(F.size(snippets) <= 0, F.lit(1.0)).otherwise(hit / F.size(snippets))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
