"""Pages as rows of nodes, and selectors over them.

``page_nodes(pages)`` gives a row for each element, numbered in document order; an element's descendants are the
numbers up to its ``last``. A page's text is stored once, in its row 0; every other row says from where to where its own
text stands in it. So a node's text is one join on the page away, and nothing is repeated along the tree.

Selectors are data: ``steps`` turns them into rows, one a compound (``td.name:first-child``), and ``select`` matches all
selectors of all hosts at once, a join per step whatever their number. Understood are tags, ``*``, ``#id``, ``.class``,
``[attribute]`` with ``=``, ``^=``, ``$=``, ``*=``, ``~=``, ``:first-child``, ``:last-child``, ``:nth-child(n)``, ``:contains('text')``, the
combinators blank, ``>``, ``+`` and ``~``, and lists with commas; anything else raises an error when the rules are read.

Elements are closed as browsers do where their end tag is missing (``li``, ``p``, cells, rows), inside their own list or table only;
rows that stand in a table alone get a ``tbody``. Texts of scripts, styles and templates are left out. Element boundaries are a
blank, but for those of inline elements. A null or empty page has its row 0 alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import domains as D

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "code", "em", "font", "i", "mark", "small", "span", "strong", "sub", "sup", "u"}
SILENT = {"script", "style", "template", "noscript"}
#: What an element's start closes, if it is open inside the same ``WITHIN``.
CLOSES = {
    "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    **{t: {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"} for t in ("thead", "tbody", "tfoot")},
    **{t: {"p"} for t in ("p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "main", "nav", "form", "dl", "pre", "blockquote")},
}
WITHIN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "p": {"div", "td", "th", "li", "section", "article", "body"}}
TABLE = {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "caption", "dt"}
NODE = (
    "node int, parent int, last int, nth int, nth_last int, tag string, id string, classes array<string>, attributes map<string,string>, "
    "at int, upto int, table int, row int, col int, lead int, text string"
)
FIELDS = [f.split()[0] for f in NODE.split(", ")]


class _Tree(HTMLParser):
    """The nodes of one page, as lists in the order of ``FIELDS``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, None, 0, 1, 1, "#document", None, [], [], 0, 0, None, None, None, None, None]]
        self.open, self.children, self.text, self.size = [0], [0], [], 0
        self.grids: list[list[int]] = []  # of each open table: its node, rows and cells so far
        self.lead: int | None = None

    def _put(self, text: str) -> None:
        self.text.append(text)
        self.size += len(text)

    def _close(self, depth: int) -> None:
        """Close the elements above ``depth`` of the stack."""
        while len(self.open) > depth:
            own = self.rows[self.open.pop()]
            self.children.pop()
            if own[5] not in INLINE:
                self._put(" ")
            own[2], own[10] = len(self.rows) - 1, self.size
            if own[5] == "table" and self.grids:
                self.grids.pop()
            if own[5] in HEADINGS:
                self.lead = own[0]

    def _start(self, tag: str, attrs: list) -> None:
        wall = WITHIN.get(tag) or ({"table"} if tag in TABLE else WITHIN["p"])
        closes = CLOSES.get(tag, ())
        found = len(self.open)
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.rows[self.open[depth]][5]
            if name in closes:
                found = depth
            elif name in wall:
                break
        self._close(found)
        over = self.rows[self.open[-1]][5]
        if tag == "tr" and over == "table":
            self._start("tbody", [])
        elif tag in ("td", "th") and over in ("table", "tbody", "thead", "tfoot"):
            self._start("tr", [])
        if tag not in INLINE:
            self._put(" ")
        own = dict((k, v or "") for k, v in attrs)
        node, parent = len(self.rows), self.open[-1]
        self.children[-1] += 1
        grid: list[int | None] = [None, None, None]
        if self.grids and tag in ("tr", "td", "th"):
            top = self.grids[-1]
            if tag == "tr":
                top[1], top[2] = top[1] + 1, 0
                grid = [top[0], top[1], None]
            else:
                grid = [top[0], top[1], top[2]]
                span = own.get("colspan", "")
                top[2] += max(1, int(span)) if span.isascii() and span.isdigit() and len(span) < 4 else 1
        self.rows.append([node, parent, node, self.children[-1], 0, tag, own.get("id"), own.get("class", "").split(), list(own.items()), self.size, self.size, *grid, self.lead, None])
        if tag not in VOID:
            self.open.append(node)
            self.children.append(0)
            if tag == "table":
                self.grids.append([node, -1, 0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs)  # a slash closes void elements only, which are closed anyway

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.rows[self.open[depth]][5]
            if name == tag:
                self._close(depth)
                return
            if name == "table" and tag in TABLE or name in ("td", "th") and tag not in (*TABLE, "table"):
                return

    def handle_data(self, data: str) -> None:
        if self.rows[self.open[-1]][5] not in SILENT:
            self._put(data)

    def finish(self) -> list[list]:
        self.close()
        self._close(1)
        top = self.rows[0]
        top[2], top[10], top[15] = len(self.rows) - 1, self.size, "".join(self.text)
        count: dict[int, int] = {}
        for own in self.rows[1:]:
            count[own[1]] = max(count.get(own[1], 0), own[3])
        for own in self.rows[1:]:
            own[4] = count[own[1]] + 1 - own[3]
        return self.rows


def tree(html: str | None) -> list[list]:
    own = _Tree()
    own.feed(html or "")
    return own.finish()


def page_nodes(pages: DataFrame) -> DataFrame:
    """``page_url`` and the fields of ``NODE`` for every element of ``pages(url, html)``."""
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([("page_url", pa.string()), *((n, kinds[k]) for n, k in (f.split() for f in NODE.split(", ")))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += ([url, *r] for r in tree(html))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(work, f"page_url string, {NODE}")


def with_text(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found(page_url, at, upto)`` with ``text``: what stands there in the page, blanks squeezed."""
    page = nodes.where("node = 0").select("page_url", F.col("text").alias("_page"))
    own = F.col("_page").substr(F.col("at") + 1, F.col("upto") - F.col("at"))
    return found.drop("text").join(page, "page_url").withColumn("text", F.trim(F.regexp_replace(own, r"[\s ]+", " "))).drop("_page")


# Selectors.

STEP = "step int, steps int, combinator string, tag string, id string, classes array<string>, attributes array<struct<name: string, op: string, value: string>>, nth int, nth_last int, contains string"
_SIMPLE = re.compile(
    r"""(?P<tag>[A-Za-z][A-Za-z0-9-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]"""
    r"""|:(?P<edge>first|last)-child|:nth-child\(\s*(?P<nth>\d+)\s*\)|:(?:contains|-soup-contains)\(\s*(?P<text>"[^"]*"|'[^']*'|[^)]*?)\s*\)"""
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def parse(selector: str) -> list[list[dict]]:
    """The alternatives of a selector, each a list of compounds with what stands between them and the one before."""
    bare = lambda v: v[1:-1] if v[:1] in ("'", '"') else v
    out, at, text = [], 0, selector.strip()
    steps: list[dict] = []
    combinator = " "
    while True:
        own = {"combinator": combinator, "tag": None, "id": None, "classes": [], "attributes": [], "nth": None, "nth_last": None, "contains": None}
        begin = at
        while m := _SIMPLE.match(text, at):
            if m["tag"] and at > begin:
                break
            at = m.end()
            if m["tag"]:
                own["tag"] = None if m["tag"] == "*" else m["tag"].lower()
            elif m["id"]:
                own["id"] = m["id"]
            elif m["cls"]:
                own["classes"].append(m["cls"])
            elif m["name"]:
                own["attributes"].append((m["name"].lower(), m["op"] or "", bare(m["value"] or "")))
            elif m["edge"]:
                own["nth" if m["edge"] == "first" else "nth_last"] = 1
            elif m["nth"]:
                own["nth"] = int(m["nth"])
            else:
                own["contains"] = bare(m["text"])
        if at == begin:
            raise ValueError(f"not understood in the selector {selector!r}: {text[at:] or 'its end'!r}")
        steps.append(own)
        if (m := re.compile(r"\s*,\s*").match(text, at)) or at == len(text):
            out.append(steps)
            if not m:
                return out
            steps, combinator, at = [], " ", m.end()
        elif m := _COMBINATOR.match(text, at):
            combinator, at = m[1] or " ", m.end()
        else:
            raise ValueError(f"not understood in the selector {selector!r}: {text[at:]!r}")


def steps(rules: DataFrame) -> DataFrame:
    """``host, rule`` and the fields of ``STEP``: a row a compound of each alternative of ``rules(host, selector)``.

    ``rule`` is the selector with the alternative's number. Rules are settings: they are parsed in Spark, and an error in one stops the job.
    """
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    attributes = pa.list_(pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())]))
    fields = re.findall(r"(\w+) (array<struct<[^>]*>>|[^,]+)(?:, |$)", STEP)
    schema = pa.schema([("host", pa.string()), ("rule", pa.string()), *((n, kinds.get(k, attributes)) for n, k in fields)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, selector in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, own in enumerate(parse(selector)):
                    rows += ({"host": host, "rule": f"{selector}#{k}", "step": i, "steps": len(own), **s, "attributes": [dict(zip(("name", "op", "value"), a, strict=True)) for a in s["attributes"]]} for i, s in enumerate(own))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return rules.select(F.lower("host").alias("host"), "selector").where("selector is not null").distinct().mapInArrow(work, f"host string, rule string, {STEP}")


#: Steps that are sent to every task; more of them are joined by host.
FEW_STEPS = 20_000


def select(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_url, selector`` and the node's fields with its ``text``: what each selector of a page's host finds in it.

    ``rules(host, selector)``; a rule without a host holds for all pages. Steps are matched from the left, each by one join on the page:
    a node stays if a match of the step before stands where the combinator says.
    """
    own = steps(rules)
    rows = own.collect() if own.count() <= FEW_STEPS else None  # settings, a bounded number
    longest = max((r.steps for r in rows), default=0) if rows is not None else own.agg(F.max("steps")).first()[0]
    if not longest:
        return with_text(nodes.limit(0).withColumn("selector", F.lit(None).cast("string")), nodes)
    hosted = nodes.withColumn("_host", D.host_of(F.col("page_url")))
    fit = (
        (F.col("s.tag").isNull() | (F.col("s.tag") == F.col("tag"))) & (F.col("s.id").isNull() | (F.col("s.id") == F.col("id")))
        & (F.size(F.array_except("s.classes", "classes")) == 0) & (F.col("s.nth").isNull() | (F.col("s.nth") == F.col("nth"))) & (F.col("s.nth_last").isNull() | (F.col("s.nth_last") == F.col("nth_last")))
        & F.forall("s.attributes", lambda a: F.coalesce(_attribute(a), F.lit(False)))
    )
    told = own.select("host", F.struct("rule", *[f for f, _ in re.findall(r"(\w+) (array<struct<[^>]*>>|[^,]+)(?:, |$)", STEP)]).alias("s"))
    told = F.broadcast(told) if rows is not None else told
    here = hosted.where("node > 0")
    if rows is not None:  # only tags that a selector names, unless one names none
        tags = {r.tag for r in rows}
        here = here if None in tags else here.where(F.col("tag").isin(*tags))
    pairs = here.join(told, F.col("host").isNull() | (F.col("host") == F.col("_host"))) if rows is not None else here.join(told, F.col("host") == F.col("_host")).unionByName(here.join(F.broadcast(told.where("host is null")), F.lit(True)))
    pairs = pairs.where(fit)
    if rows is None or any(r.contains for r in rows):
        texts = with_text(pairs.where("s.contains is not null"), nodes).where(F.contains("text", F.col("s.contains"))).withColumn("text", F.lit(None).cast("string"))
        pairs = pairs.where("s.contains is null").unionByName(texts.select(*pairs.columns))
    found = pairs.where("s.step = 0")
    done = found.where("s.steps = 1")
    for k in range(1, longest):
        before = found.select(*(F.col(c).alias(f"_{c}") for c in ("page_url", "node", "last", "parent", "nth")), F.col("s.rule").alias("_rule"))
        now = pairs.where(F.col("s.step") == k)
        c = F.col("s.combinator")
        there = (
            ((c == " ") & (F.col("_node") < F.col("node")) & (F.col("node") <= F.col("_last"))) | ((c == ">") & (F.col("parent") == F.col("_node")))
            | ((c == "+") & (F.col("parent") == F.col("_parent")) & (F.col("nth") == F.col("_nth") + 1)) | ((c == "~") & (F.col("parent") == F.col("_parent")) & (F.col("nth") > F.col("_nth")))
        )
        found = now.join(before, (F.col("page_url") == F.col("_page_url")) & (F.col("s.rule") == F.col("_rule")) & there, "left_semi")
        done = done.unionByName(found.where(F.col("s.steps") == k + 1))
    out = done.withColumn("selector", F.regexp_replace("s.rule", "#[0-9]+$", "")).drop("s", "host", "_host", "text")
    return with_text(out.dropDuplicates(["page_url", "selector", "node"]), nodes)


def _attribute(a: Column) -> Column:
    """An attribute test on the row's attributes."""
    v = F.try_element_at("attributes", a["name"])
    op, w = a["op"], a["value"]
    word = F.array_contains(F.split(v, r"\s+"), w)
    return v.isNotNull() & F.when(op == "", True).when(op == "=", v == w).when(op == "^=", v.startswith(w) & (w != "")).when(op == "$=", v.endswith(w) & (w != "")).when(op == "*=", v.contains(w) & (w != "")).otherwise(word)
