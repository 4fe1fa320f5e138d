"""Pages as trees: parse, sanitize, main set, render with provenance, features and labels.

Spark has no HTML parser, so one Arrow function per page does what needs the tree; everything after that (labels of lines,
ranges, scores) is relational.  A node is numbered in document order and knows the end of its subtree, so subtree and
ancestor tests are range tests.  The renderer is this package's own: one line per block, list and heading marks, tables
with pipes; it keeps for every line the nodes that gave it text.
"""

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.functions.text import BLOCK_TAGS

#: What annotators' tools and a translation extension leave in pages: where it stands, how it is compared, the
#: value, and what it condemns.
SELECT_ATTR = "cc-select"
MARKS = [
    ("attribute", "is", "data-immersive-translate-translation-element-mark", "element"),
    ("class", "prefix", "immersive-translate-", "element"),
    ("id", "prefix", "immersive-translate", "element"),
    ("style id", "is", "cc-extraStyle", "element"),
    ("style name", "is", "cc", "element"),
    ("attribute", "is", "data-anno-uid", "attribute"),
    ("attribute", "is", SELECT_ATTR, "attribute"),
    ("attribute", "prefix", "data-immersive-translate-", "attribute"),
    ("class", "is", "mark-selected", "class"),
    ("class", "is", "cc-unloaded", "class"),
    ("class", "prefix", "immersive-translate-", "class"),
    ("declaration", "is", "user-select:none", "declaration"),
]

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCK_TAGS if t not in ("br", "li", "tr", "td", "th")}
SKIPPED = {"script", "style", "noscript", "template", "head", "title", "svg"}
#: Tags whose presence on the path to a line are features (this package's choice).
FEATURE_TAGS = "main article section nav header footer aside form ul ol li table tr td th p h1 h2 h3 h4 h5 h6 a blockquote pre code figure figcaption span div".split()


class Node:
    __slots__ = ("id", "parent", "end", "tag", "attrs", "children", "depth")

    def __init__(self, number, parent, tag, attrs):
        self.id, self.parent, self.tag, self.attrs, self.children, self.end = number, parent, tag, attrs, [], number
        self.depth = parent.depth + 1 if parent else 0

    def path(self):
        n = self
        while n:
            yield n
            n = n.parent


class Tree(HTMLParser):
    """Nodes in document order; children hold nodes and strings. Comments and instructions vanish; nothing raises."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node(0, None, "#root", {})
        self.nodes, self.open = [self.root], [self.root]
        self.feed(html)
        self.close()
        for n in reversed(self.nodes):
            if n.parent:
                n.parent.end = max(n.parent.end, n.end)

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1) if ends else ():
            if self.open[i].tag in ends:
                del self.open[i:]
                break
            if self.open[i].tag in ("ul", "ol", "table", "div", "article", "section", "body"):
                break
        node = Node(len(self.nodes), self.open[-1], tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if data.strip():
            self.open[-1].children.append(data)
        elif self.open[-1].children and isinstance(self.open[-1].children[-1], (Node, str)):
            self.open[-1].children.append(" ")


def hidden(node: Node) -> bool:
    style = node.attrs.get("style", "")
    return "display:none" in style or "display: none" in style


def declaration(text: str) -> str:
    """A style declaration in one spelling."""
    return ":".join(x.strip().lower() for x in text.split(":", 1))


def marks(node: Node) -> list[tuple[str, str]]:
    """(what is condemned, value) for every mark of MARKS on a node."""
    a = node.attrs
    seen = [("attribute", k) for k in a] + [("class", t) for t in a.get("class", "").split()] + [("id", a.get("id", ""))]
    seen += [(f"style {k}", a.get(k)) for k in ("id", "name") if node.tag == "style"]
    seen += [("declaration", declaration(d)) for d in a.get("style", "").split(";")]
    return [(action, value) for where, value in seen for w, how, what, action in MARKS if w == where and value and (value == what or (how == "prefix" and value.startswith(what)))]


def cleaned(node: Node) -> dict[str, str]:
    """The node's attributes without what is condemned; an attribute that would be left empty goes."""
    gone = set(marks(node))
    out = {k: v for k, v in node.attrs.items() if ("attribute", k) not in gone}
    for name, kind, cut, form, glue in (("class", "class", None, str, " "), ("style", "declaration", ";", declaration, "; ")):
        if name in out and any(action == kind for action, _ in gone):
            out[name] = glue.join(x.strip() for x in out[name].split(cut) if x.strip() and (kind, form(x)) not in gone)
            if not out[name]:
                del out[name]
    return out


def sanitize(root: Node, remove: bool = True) -> None:
    """Removes condemned elements (if asked) below root, and condemned attributes, classes and styles; what renders stays."""
    for n in walk(root):  # a node's children are cut before the walk goes on to them
        if remove:
            n.children = [c for c in n.children if not (isinstance(c, Node) and any(action == "element" for action, _ in marks(c)))]
    for n in walk(root):
        n.attrs = cleaned(n)


def residue(root: Node) -> list[str]:
    """What a sanitizer left: empty for a clean tree."""
    return [f"{action} {n.tag if action == 'element' else f'{value} on {n.tag}'}" for n in walk(root) for action, value in dict.fromkeys(marks(n))]


def walk(root: Node):
    """Nodes below root (and root) in document order, without recursion."""
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def main_set(root: Node, selected=None) -> set[int]:
    """Numbers of the nodes that belong to the main content: selected subtrees that are not hidden, their ancestors, and
    line breaks next to them in document order."""
    selected = selected or (lambda n: n.attrs.get(SELECT_ATTR) == "true")
    full: set[int] = set()
    todo = [root]
    while todo:
        n = todo.pop()
        if hidden(n):
            continue
        if selected(n):
            full.update(m.id for m in walk(n))
            above = n.parent
            while above and above.id not in full:
                full.add(above.id)
                above = above.parent
        else:
            todo += [c for c in n.children if isinstance(c, Node)]
    order = list(walk(root))
    beside = zip([None, *order], order, [*order[1:], None])
    breaks = {n.id for before, n, after in beside if n.tag == "br" and any(m and m.tag != "br" and m.id in full for m in (before, after))}
    return full | breaks


def opening(node: Node) -> str:
    quoted = lambda v: v.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    return f"<{node.tag}{''.join(f' {k}={chr(34)}{quoted(v)}{chr(34)}' for k, v in node.attrs.items())}>"


def pruned(root: Node, keep: set[int]) -> str:
    """HTML of the kept nodes; text directly below a node that is only an ancestor of kept ones goes with the rest."""
    out: list[str] = []
    todo: list[tuple] = [(root, False)]  # nodes to open, and strings that are ready
    while todo:
        n, inside = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.id not in keep:
            continue
        whole = inside or n.attrs.get(SELECT_ATTR) == "true"
        if n.parent:
            out.append(opening(n))
            if n.tag not in VOID:
                todo.append((f"</{n.tag}>", whole))
        for c in reversed(n.children):
            if isinstance(c, Node):
                todo.append((c, whole))
            elif whole:
                todo.append((c.replace("&", "&amp;").replace("<", "&lt;"), whole))
    return "".join(out)


class Renderer:
    """Lines of a tree, and for each the nodes whose text it holds (none for structural lines)."""

    def __init__(self, render_hidden: bool):
        self.render_hidden = render_hidden
        self.lines: list[str] = []
        self.src: list[set[Node]] = []
        self.text: list[str] = []
        self.from_: set[Node] = set()

    def line(self, text: str, nodes: set[Node]) -> None:
        self.lines.append(text)
        self.src.append(nodes)

    def flush(self) -> None:
        s = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if s:
            self.line(s, self.from_)
        self.text, self.from_ = [], set()

    def enter(self, n: Node, lists: list) -> list | None:
        """Begins a node; the lists around its children, or None if it does not render."""
        if n.tag in SKIPPED or (hidden(n) and not self.render_hidden):
            return None
        if is_block(n):
            self.flush()
            if n.tag in ("p", "ul", "ol", "table", "h1", "h2", "h3", "blockquote") and self.lines and self.lines[-1]:
                self.line("", set())
        if n.tag == "hr":
            self.flush()
            self.line("---", set())
        if n.tag == "li":
            self.text.append("* " if not lists or lists[-1] is None else f"{lists[-1][0]}. ")
            if lists and lists[-1] is not None:
                lists[-1][0] += 1
        elif re.fullmatch("h[1-6]", n.tag):
            self.text.append("#" * int(n.tag[1]) + " ")
        elif n.tag == "blockquote":
            self.text.append("> ")
        elif n.tag in ("td", "th") and self.text:
            self.text.append(" | ")
        return [*lists, None] if n.tag == "ul" else [*lists, [1]] if n.tag == "ol" else lists

    def run(self, root: Node) -> None:
        todo: list[tuple] = [(root, [], None)]  # nodes to enter, nodes to leave (lists is None), strings with their node
        while todo:
            n, lists, owner = todo.pop()
            if isinstance(n, str):
                self.text.append(n)
                if n.strip():
                    self.from_.add(owner)
            elif lists is None:
                self.flush()
            elif (inner := self.enter(n, lists)) is not None:
                if is_block(n):
                    todo.append((n, None, None))
                todo += [(c, inner, n) for c in reversed(n.children)]
        self.flush()


def is_block(n: Node) -> bool:
    return n.tag in BLOCK_TAGS and n.tag not in ("td", "th")


def render(root: Node, render_hidden: bool = False) -> tuple[list[str], list[set[Node]]]:
    """Lines, and for each the nodes whose text it holds (none for structural lines)."""
    r = Renderer(render_hidden)
    r.run(root)
    return r.lines, r.src


def features(node_set: set[Node], line: str) -> list[float]:
    """One row: a flag per tag on the way to the line, depth, has_link, log_chars."""
    path = {m.tag for n in node_set for m in n.path()}
    depth = max((n.depth for n in node_set), default=0)
    return [float(t in path) for t in FEATURE_TAGS] + [float(depth), float("a" in path), round(math.log1p(len(line)), 4)]


def per_page(pages: DataFrame, schema: str, each, key: str = "page_id", columns: list[str] | None = None) -> DataFrame:
    """One call of each(html) (or of the given columns) per page, giving rows behind the page's key."""
    kind = pages.schema[key].dataType.simpleString()
    columns = columns or ["html"]
    rows = pages.select(key, *columns)

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                given = [batch.column(c).to_pylist() for c in columns]
                given[0] = [h or "" for h in given[0]]
                out = [(k, *r) for k, *x in zip(batch.column(key).to_pylist(), *given, strict=True) for r in each(*x)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType.fromDDL(f"{key} {kind}, {schema}")
    arrow = to_arrow_schema(whole)
    names, types = arrow.names, arrow.types
    return rows.mapInArrow(run, whole)


def nodes(pages: DataFrame) -> DataFrame:
    """page_id, node_id, parent_id, end_id, tag, depth, attrs, text: the tree as rows; the text is the node's own."""

    def each(html):
        return [(n.id, n.parent.id if n.parent else None, n.end, n.tag, n.depth, list(n.attrs.items()), re.sub(r"\s+", " ", "".join(c for c in n.children if isinstance(c, str))).strip()) for n in Tree(html).nodes]

    return per_page(pages, "node_id int, parent_id int, end_id int, tag string, depth int, attrs map<string,string>, text string", each)


def lines(pages: DataFrame, select_tag: str | None = "article", render_hidden: bool = False) -> DataFrame:
    """page_id, idx, text, known (1/0 by provenance, null for structural lines), blank, feats: from one render.

    Main content is what annotators marked, or the subtree of ``select_tag`` where pages carry no marks.  The main set is
    taken before the page is sanitized, which removes the marks.
    """

    def each(html):
        root = Tree(html).root
        marked = any(SELECT_ATTR in n.attrs for n in walk(root))
        main = main_set(root, None if marked or not select_tag else lambda n: n.tag == select_tag)
        sanitize(root)
        text, src = render(root, render_hidden)
        return [(i, t.rstrip(), (int(any(n.id in main for n in s)) if s else None), not t.strip(), features(s, t)) for i, (t, s) in enumerate(zip(text, src, strict=True))]

    return per_page(pages, "idx int, text string, known int, blank boolean, feats array<float>", each)


def sanitized(pages: DataFrame) -> DataFrame:
    """page_id, n_nodes before and after, removed elements, residue (joined; empty for clean pages)."""

    def each(html):
        root = Tree(html).root
        before = sum(1 for _ in walk(root))
        sanitize(root)
        after = sum(1 for _ in walk(root))
        return [(before, after, before - after, "; ".join(residue(root)))]

    return per_page(pages, "n_before int, n_after int, n_removed int, residue string", each)


def pruned_html(pages: DataFrame, select_tag: str = "article") -> DataFrame:
    """page_id, html of the main set only."""

    def each(html):
        root = Tree(html).root
        for n in walk(root):
            if n.tag == select_tag:
                n.attrs[SELECT_ATTR] = "true"
        keep = main_set(root)
        text = pruned(root, keep)
        return [(text, len(keep))]

    return per_page(pages, "main_html string, n_kept int", each)


def markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown: the rendered lines, without links or images; every page starts from a fresh renderer."""

    def each(html):
        return [("\n".join(x for x in render(Tree(html).root)[0]),)]

    return per_page(pages, "markdown string", each)
