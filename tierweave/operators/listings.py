"""Vendors that tables, lists and hosts' own rules name on subprocessor pages, from the node table (``nodes``).

All give ``page_url, ord, domain, name, evidence``: ``ord`` is the entry's place in the page; ``domain`` is one that the entry itself
says, else ``_org:`` and the name (``subprocessors.filter_results`` looks it up). An entry's name stands before what is in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import orgs as O
from tierweave.operators import nodes as N
from tierweave.operators import subprocessors, trust
from tierweave.plans.graph import told

#: What the heading of the column that names vendors says, most telling first.
HEADERS = ("entity name", "vendor name", "company name", "subprocessor", "sub-processor", "entity", "vendor", "company", "organization", "provider", "supplier", "name")
SITES = "website|web site|url|domain|homepage"
#: What the heading before a list of vendors says, and how such lists are marked.
CONTEXT = ("subprocessor", "sub-processor", "third party", "third-party", "vendor", "service provider", "processor", "supplier")
MARKED = r"(?i)sub-?processor|processor|vendor|supplier|provider"
ASIDE = ("nav", "header", "footer", "aside", "menu")


def bare_name(c: Column) -> Column:
    """An entry without what stands in brackets, and without marks at its ends."""
    return F.regexp_replace(O.squeeze(F.regexp_replace(c, r"\([^)]*\)?", " ")), r"^[\s:•|–—-]+|[\s:;,•|–—-]+$", "")


def also_named(c: Column) -> Column:
    """The name that an entry gives in brackets as the one it is known by."""
    return F.nullif(F.trim(F.regexp_extract(c, r"(?i)\((?:d/b/a|dba|doing business as|a/k/a|aka|formerly)\s+([^)]+)\)", 1)), F.lit(""))


def _entries(rows: DataFrame, said: Column, site: Column | None = None) -> DataFrame:
    """``rows(page_url, ord, entry, evidence)`` as finds; ``said`` is the text whose domain counts, then the entry's site."""
    tries = [subprocessors.domain_in_text(said), *([trust.domain_of(site)] if site is not None else [])]
    own = rows.withColumn("name", bare_name(F.col("entry"))).where(F.octet_length("name").between(2, 100))
    return own.withColumn("domain", F.coalesce(*tries, F.concat(F.lit("_org:"), F.col("name")))).select("page_url", "ord", "domain", "name", also_named(F.col("entry")).alias("other_name"), "evidence")


def tables(nodes: DataFrame, headers: tuple[str, ...] = HEADERS, selectors: DataFrame | None = None) -> DataFrame:
    """The rows of tables with a heading that names vendors: of the first pattern that any heading holds, its first column.

    ``selectors(host, selector)`` name the tables that count; without them all do. A nested table is one of its own.
    """
    cells = nodes.where("table is not null and tag in ('td', 'th')")
    if selectors is not None:
        chosen = N.select(nodes, selectors).select("page_url", F.col("node").alias("table")).distinct()
        cells = cells.join(chosen, ["page_url", "table"], "left_semi")
    cells = N.with_text(cells, nodes).select("page_url", "table", "row", "col", "node", "tag", "text")
    top = cells.groupBy("page_url", "table").agg(F.coalesce(F.min(F.when(F.col("tag") == "th", F.col("row"))), F.min("row")).alias("top"))
    cells = cells.join(top, ["page_url", "table"])
    rank = F.coalesce(*[F.when(F.lower("text").contains(h), i) for i, h in enumerate(headers)])
    heads = cells.where("row = top").groupBy("page_url", "table").agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("col").alias("col")))).alias("n"), F.min(F.when(F.lower("text").rlike(SITES), F.col("col"))).alias("site_col"))
    heads = heads.where("n is not null").select("page_url", "table", F.col("n.col").alias("name_col"), "site_col")
    rows = cells.where("row > top").join(heads, ["page_url", "table"]).groupBy("page_url", "table", "row").agg(
        F.min(F.when(F.col("col") == F.col("name_col"), F.col("text"))).alias("entry"), F.min(F.when(F.col("col") == F.col("site_col"), F.col("text"))).alias("site"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "node", "text"))), lambda x: x["text"]), " | ").alias("evidence"), F.min("node").alias("ord"),
    )
    return _entries(rows, F.col("entry"), F.col("site"))


def _inside(rows: DataFrame, outer: DataFrame, how: str) -> DataFrame:
    """Rows that stand below (or not below) one of the nodes ``outer(page_url, node, last)``."""
    own = outer.select(F.col("page_url").alias("_page"), F.col("node").alias("_from"), F.col("last").alias("_to"))
    return rows.join(own, (F.col("page_url") == F.col("_page")) & (F.col("node") > F.col("_from")) & (F.col("node") <= F.col("_to")), how)


def lists(nodes: DataFrame, context: tuple[str, ...] = CONTEXT, selectors: DataFrame | None = None) -> DataFrame:
    """The items of lists of vendors: their set-off beginning (``strong``, ``b``), else what stands before a dash, colon or bracket.

    ``selectors(host, selector)`` name the lists or items that count. Without them those count that begin with a set-off
    name, that stand below a node marked as such a list, or whose list follows a heading or paragraph of the ``context``; never those of navigation, heads and feet.
    """
    items = nodes.where("tag = 'li'").select("page_url", "node", "last", "parent", "at", "upto")
    nested = nodes.where("tag in ('ul', 'ol')").groupBy("page_url", F.col("parent").alias("node")).agg(F.min("at").alias("_cut"))
    items = items.join(nested, ["page_url", "node"], "left").withColumn("upto", F.coalesce("_cut", "upto")).drop("_cut")
    bold = nodes.where("tag in ('strong', 'b')").select("page_url", F.col("at").alias("b_at"), F.col("upto").alias("b_upto"), F.col("parent").alias("_in"), F.col("node").alias("b"))
    first = bold.groupBy("page_url", F.col("_in").alias("node")).agg(F.min_by(F.struct("b_at", "b_upto"), "b").alias("b"))
    items = N.with_text(items.join(first, ["page_url", "node"], "left"), nodes).withColumn("evidence", F.col("text"))
    starts = N.with_text(items.where("b is not null").select("page_url", "node", F.col("b.b_at").alias("at"), F.col("b.b_upto").alias("upto")), nodes).select("page_url", "node", F.col("text").alias("bold"))
    items = items.drop("text").join(starts, ["page_url", "node"], "left").withColumn("set_off", F.coalesce((F.octet_length("bold") >= 2) & F.col("evidence").startswith(F.col("bold")), F.lit(False)))
    if selectors is not None:
        chosen = N.select(nodes, selectors).select("page_url", (F.col("node") - F.when(F.col("tag") == "li", 1).otherwise(0)).alias("node"), "last").distinct()
        wanted = _inside(items, chosen, "left_semi")
    else:
        own_lists = nodes.where("tag in ('ul', 'ol') and lead is not null").select("page_url", F.col("node").alias("parent"), F.col("lead").alias("_lead"))
        heads = N.with_text(nodes.where(F.col("tag").isin(*N.HEADINGS)), nodes).where(F.lower("text").rlike("|".join(context))).select("page_url", F.col("node").alias("_lead"))
        after = own_lists.join(heads, ["page_url", "_lead"], "left_semi").select("page_url", "parent").withColumn("_after", F.lit(True))
        marks = nodes.where(F.concat_ws(" ", "id", F.array_join("classes", " ")).rlike(MARKED) & ~F.col("tag").isin("html", "body", "li"))
        marked = _inside(items.select("page_url", "node"), marks, "left_semi").withColumn("_marked", F.lit(True))
        wanted = items.join(after, ["page_url", "parent"], "left").join(marked, ["page_url", "node"], "left").where("set_off or _after or _marked")
        wanted = _inside(wanted, nodes.where(F.col("tag").isin(*ASIDE)), "left_anti")
    before = F.element_at(F.split("evidence", r"\s+[-–—•|]\s+|:\s|\s\("), 1)
    rows = wanted.withColumn("entry", F.when(F.col("set_off"), F.col("bold")).otherwise(before)).withColumn("ord", F.col("node"))
    return _entries(rows, F.col("evidence"))


def custom(pages: DataFrame, nodes: DataFrame, selectors: DataFrame, patterns: DataFrame, names: DataFrame, exclusions: DataFrame) -> DataFrame:
    """What hosts' own rules find in their pages.

    ``selectors(host, selector, attribute, transform)`` take nodes' texts or attributes (``transform``: ``trim``, ``lowercase`` or ``domain``);
    ``patterns(host, pattern, capture)`` take a group of each match in a page's plain text and in its source. An entry that one of
    ``exclusions(host, pattern)`` matches goes. Of ``names(host, name, domain)`` the one that an entry holds earliest (at one place: the longest) gives its domain.
    """
    found = N.select(nodes, selectors.select("host", "selector")).withColumn("host", D.host_of(F.col("page_url"))).select("page_url", "host", "selector", "attributes", "text", F.col("node").alias("ord"))
    found = found.join(told(selectors.distinct()), ["host", "selector"])
    value = F.when(F.col("attribute").isNull(), F.col("text")).otherwise(F.try_element_at("attributes", F.lower("attribute")))
    value = F.when(F.col("transform") == "lowercase", F.lower(F.trim(value))).when(F.col("transform") == "domain", trust.domain_of(value)).otherwise(F.trim(value))
    one = found.select("page_url", "host", "ord", value.alias("entry"))
    plain = N.with_text(nodes.where("node = 0"), nodes).select("page_url", F.col("text").alias("body"))
    bodies = plain.unionByName(pages.select(F.col("url").alias("page_url"), F.col("html").alias("body"))).withColumn("host", D.host_of(F.col("page_url")))
    two = bodies.join(told(patterns), "host").select("page_url", "host", F.posexplode(F.regexp_extract_all("body", F.col("pattern"), F.col("capture"))).alias("ord", "entry"))
    rows = one.unionByName(two.withColumn("entry", O.squeeze(F.regexp_replace("entry", "<[^>]*>", " ")))).where(F.octet_length("entry").between(2, 200))
    rows = rows.groupBy("page_url", "host", "entry").agg(F.min("ord").alias("ord"))
    rows = rows.join(told(exclusions.select(F.col("host").alias("_h"), F.col("pattern").alias("_p"))), (F.col("host") == F.col("_h")) & F.expr("entry rlike _p"), "left_anti")
    place = F.instr(F.lower("entry"), F.lower("_name"))
    known = rows.join(told(names.select("host", F.col("name").alias("_name"), F.col("domain").alias("_domain"))), "host").withColumn("_at", place).where("_at > 0")
    known = known.groupBy("page_url", "entry").agg(F.min_by("_domain", F.struct("_at", -F.length("_name"), "_name")).alias("_domain"))
    out = rows.join(known, ["page_url", "entry"], "left").withColumn("evidence", F.col("entry"))
    own = _entries(out.where("_domain is null"), F.col("entry"))
    mapped = out.where("_domain is not null").select("page_url", "ord", F.col("_domain").alias("domain"), bare_name(F.col("entry")).alias("name"), also_named(F.col("entry")).alias("other_name"), "evidence")
    every = own.unionByName(mapped)
    first = every.groupBy("page_url", "domain").agg(F.min_by(F.struct("ord", "name", "other_name", "evidence"), F.struct("ord", "name")).alias("r"))
    return first.select("page_url", "r.ord", "domain", "r.name", "r.other_name", "r.evidence")


def by_other_name(found: DataFrame, known: DataFrame) -> DataFrame:
    """``_org:`` finds whose own name no organization of ``known(organization, domain)`` has, but whose other name one has, take that one's place."""
    key = lambda c: F.lower(O.normalize(F.col(c)))
    have = known.select(key("organization").alias("_key")).distinct()
    own, other = (have.select(F.col("_key").alias(k), F.lit(True).alias(flag)) for k, flag in (("_own", "_has_own"), ("_other", "_has_other")))
    rows = found.withColumn("_own", key("name")).withColumn("_other", key("other_name")).join(own, "_own", "left").join(other, "_other", "left")
    swap = F.col("domain").startswith("_org:") & F.col("_has_own").isNull() & F.col("_has_other")
    return rows.withColumn("domain", F.when(swap, F.concat(F.lit("_org:"), "other_name")).otherwise(F.col("domain"))).select(*found.columns)
