import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import numbers, text, urls
from corpusloom.operators import metrics


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("given_", "want"), [
    ("ftp://user:secret@files.Shop.example:2121/list?x=1", "shop.example"), ("//no-scheme.site.org", "unknown"), ("deep.er.still.museum#top", "still.museum"),
    ("http://192.168.1.1/admin", "192.168.1.1"), ("http://192.168.1.1:8080", "192.168.1.1"), ("https://blog.firm.com.au./", "firm.com.au"), ("http://gov.uk", "gov.uk"),
    ("https://xn--bcher-kva.example/buch", "xn--bcher-kva.example"), ("https://bücher.example", "bücher.example"), ("intranet", "intranet"), (None, "unknown"),
])
def test_domain(spark, given_, want):
    assert one(spark, given_, urls.domain_of) == want


def test_url_helpers(spark):
    assert one(spark, " HTTPS://www.A.com/b//#c", urls.norm_url) == "a.com/b"
    assert one(spark, "https://m.x.org/", urls.site_of) == "x.org"
    assert one(spark, "1,3-5,99", lambda c: urls.layer_spec(c, 6)) == [1, 3, 4, 5, 6]
    assert one(spark, "full", lambda c: urls.layer_spec(c, 6)) == [6] and len(one(spark, "all", lambda c: urls.layer_spec(c, 6))) == 6


@pytest.mark.parametrize(("s", "want"), [("snake\\_case _emph_ __b__", "snake_case emph b"), ("_a_b_", "a_b"), ("", "")])
def test_adapt(spark, s, want):
    assert one(spark, s, text.adapt) == want


@pytest.mark.parametrize(("s", "want"), [("1. a  b", "a b"), ("> # x *y*", "x y"), ("a |  | b", "a|b"), ("  _q_ ", "q"), ("## 2. > t", "t")])
def test_norm(spark, s, want):
    assert one(spark, s, text.norm) == want


def test_unescape_join_and_snippets(spark):
    assert one(spark, "a\\.b \\* \\a", text.unescape) == "a.b * \\a"
    row = spark.createDataFrame([(["a", "_b_", "c\\_d"], [1, 0, 1])], "l array<string>, m array<int>")
    assert row.select(text.join_selected(F.col("l"), F.col("m"))).first()[0] == "a\nc_d"
    assert row.select(text.join_selected(F.col("l"))).first()[0] == "a\nb\nc_d"
    with pytest.raises(Exception, match="differ in length"):
        row.select(text.join_selected(F.col("l"), F.array(F.lit(1)))).collect()
    assert one(spark, "Abc", lambda c: text.snippet_rate(c, F.array(F.lit("B"), F.lit("z")))) == 0.5
    assert one(spark, "Abc", lambda c: text.snippet_rate(c, F.array().cast("array<string>"))) == 1.0


def test_html_to_text(spark):
    html = "<nav>a</nav><script>x<y</script><p>foo</p><p>b<b>ar</b> &amp; &lt;q&gt;<!-- no --><br>z<style>.a{}</style>"
    assert one(spark, html, text.html_to_text) == "a\nfoo\nbar & <q>\nz"
    assert one(spark, None, text.html_to_text) == ""


def brute_f1(a, b):
    x, y = re.findall(r"\w+", (a or "").lower()), re.findall(r"\w+", (b or "").lower())
    if not x or not y:
        return float(not x and not y)
    o = sum((Counter(x) & Counter(y)).values())
    return 2 * o / (len(x) + len(y))


CASES = [("a b", "a b"), ("", ""), (None, None), ("a", ""), ("", "a"), ("x y", "a b"), ("c b a", "a b c"), ("a a b", "a b b"), ("Été É_x", "été é_x")]


def test_word_f1_and_rouge(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], "id int, pred string, ref string")
    got = {r.id: r for r in metrics.word_f1(df, ["id"]).collect()}
    assert [round(got[i].f1, 9) for i in range(len(CASES))] == [round(brute_f1(*c), 9) for c in CASES]
    r1 = {r.id: r.f1 for r in metrics.rouge_n(df, ["id"], n=1).collect()}
    r5 = {r.id: r.f1 for r in metrics.rouge_n(df, ["id"], n=5).collect()}
    assert r1[1] == r5[1] == r5[2] == 1.0 and r1[6] == 1.0 and r5[6] == 0 and r5[5] == 0
    rl = {r.id: r.f1 for r in metrics.rouge_l(df, ["id"]).collect()}
    assert rl[0] == 1 and rl[1] == 1 and rl[3] == 0 and abs(rl[6] - 1 / 3) < 1e-9 and abs(rl[7] - 2 / 3) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert metrics.lcs_length(a, b) == t[-1][-1]


def test_numbers(spark):
    v = [0.5, -1.0, 0.003, 0.0]
    q = one(spark, v, numbers.quantize_row, "array<double>")
    assert q.q == [64, -127, 0, 0]
    back = [x * q.scale for x in q.q]
    assert one(spark, back, numbers.quantize_row, "array<double>").q == q.q
    assert one(spark, [0.0, 0.0], numbers.quantize_row, "array<double>").scale == 1e-12
    assert max(abs(a - b) for a, b in zip(v, one(spark, v, numbers.quantize_affine, "array<double>"))) <= 1.5 / 255
    assert numbers.group_columns("BC") == [30, 31, 32] and len(numbers.group_columns("ABC")) == 33
    assert abs(one(spark, 0.0, lambda c: numbers.bce_with_logits(c, F.lit(1.0), F.lit(2.0)), "double") - 2 * 0.6931471805599453) < 1e-12
    lr = [round(one(spark, s, lambda c: numbers.learning_rate(c, 10, 2, 1.0), "int"), 3) for s in (0, 1, 2, 6, 10)]
    assert lr == [0.5, 1.0, 1.0, 0.5, 0.0]
