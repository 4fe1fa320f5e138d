from corpusloom.operators import dom
from corpusloom.operators import labels as L

PAGE = """<html><head><title>t</title></head><body><nav><ul><li>Home<li>About</ul></nav>
<div cc-select="true" data-anno-uid="7" class="notranslate keepme mark-selected" style="user-select: none; color: red"><h1>Head</h1><p>Main content here.<p>Second <b>bold</b></div>
<br><style id="cc-extraStyle">.x{}</style><span class="immersive-translate-target">Dup</span><p style="display:none">gone</p><footer>Foot &amp; end</footer></body></html>"""


def test_tree_and_intervals():
    t = dom.Tree(PAGE)
    for n in t.nodes:
        below = {m.id for m in dom.walk(n)}
        assert below == set(range(n.id, n.end + 1))
    assert [n.tag for n in t.nodes if n.tag in ("li", "p")] == ["li", "li", "p", "p", "p"]
    assert all(n.parent.tag == "ul" for n in t.nodes if n.tag == "li")


def test_sanitize_keeps_what_is_the_pages_own():
    root = dom.Tree(PAGE).root
    before = dom.render(root)[0]
    assert dom.residue(root)
    dom.sanitize(root, remove=False)
    assert dom.render(root)[0] == before  # hygiene does not change what renders
    root = dom.Tree(PAGE).root  # injected elements are known by the classes that hygiene removes
    dom.sanitize(root)
    assert dom.residue(root) == [] and not any("Dup" in x for x in dom.render(root)[0])
    div = next(n for n in dom.walk(root) if n.tag == "div")
    assert div.attrs == {"class": "notranslate keepme", "style": "color: red"}
    assert dom.main_set(root) == set()  # marks are gone: labels have to be taken first


def test_main_set():
    root = dom.Tree(PAGE).root
    tags = [n.tag for n in dom.walk(root) if n.id in dom.main_set(root)]
    assert tags == ["#root", "html", "body", "div", "h1", "p", "p", "b", "br"]
    inner = dom.Tree('<div cc-select="true" style="display: none"><p>x</p></div><section><p cc-select="true">y</p></section>').root
    assert [n.tag for n in dom.walk(inner) if n.id in dom.main_set(inner)] == ["#root", "section", "p"]


def test_lines_labels_and_features(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id long, html string")
    rows = L.blocks(L.sandwich(dom.lines(df))).orderBy("page_id", "idx").collect()
    assert [(r.text, r.label) for r in rows] == [("* Home", 0), ("* About", 0), ("# Head", 1), ("Main content here.", 1), ("Second bold", 1), ("Foot & end", 0)]
    head = rows[2].feats
    assert len(head) == 33 and head[dom.FEATURE_TAGS.index("h1")] == 1 and head[dom.FEATURE_TAGS.index("nav")] == 0
    hidden = [r.text for r in dom.lines(df, render_hidden=True).collect()]
    assert "gone" in hidden
    assert dom.pruned_html(df, "footer").where("page_id = 1").first().main_html.count("<footer") == 1
    assert dom.sanitized(df).where("residue <> ''").count() == 0
    assert dom.nodes(df).where("page_id = 1").count() == len(dom.Tree(PAGE).nodes)


def test_ordered_lists_and_deep_pages():
    lines = dom.render(dom.Tree("<ol><li>a<li>b</ol><ol><li>x</ol><table><tr><td>1<td>2<tr><td>3</table>").root)[0]
    assert [x for x in lines if x] == ["1. a", "2. b", "1. x", "1 | 2", "3"]
    assert len(list(dom.walk(dom.Tree("<div>" * 3000 + "x").root))) == 3001


def test_deep_pages_and_attributes_with_quotes(spark):
    deep = "<div>" * 30_000 + "<article>x</article>"
    df = spark.createDataFrame([(1, deep), (2, '<article title="a &quot;b&quot; <c>"><p>t</p></article>')], "page_id long, html string")
    assert [r.text for r in dom.lines(df).where("page_id = 1").collect()] == ["x"]
    assert dom.sanitized(df).where("page_id = 1").first().n_before == 30_002
    html = {r.page_id: r.main_html for r in dom.pruned_html(df).collect()}
    assert html[1].endswith("<article cc-select=\"true\">x</article>" + "</div>" * 30_000)
    again = dom.Tree(html[2]).nodes[1]
    assert again.attrs["title"] == 'a "b" <c>'


def test_declarations_are_read_as_such():
    node = dom.Tree('<p style="-webkit-user-select: none; USER-SELECT : none;color:red" class="a immersive-translate-x">t</p>').nodes[1]
    assert dom.cleaned(node) == {"style": "-webkit-user-select: none; color:red", "class": "a"}
