"""Reports and exports. Rows are written by Spark; only bounded summaries become single texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V
from tierweave.functions.records import escape_markdown, mermaid_id
from tierweave.operators import relations as R

#: Column order of the flat export: the root first.
FLAT = (
    "root_customer_domain", "root_customer_organization", "nth_party_domain", "nth_party_organization", "nth_party_layer", "nth_party_customer_domain", "nth_party_customer_organization", "nth_party_record", "nth_party_record_type", "evidence",
)


def write_layer(rel: DataFrame, path: str) -> None:
    """Append rows, parted by layer: the spool of a running discovery."""
    rel.withColumn("layer", F.col("nth_party_layer")).write.mode("append").partitionBy("layer").parquet(path)


def write_csv(rel: DataFrame, path: str, single: bool = False) -> None:
    rows = rel.select(*FLAT)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).csv(path)


def json_report(rel: DataFrame) -> DataFrame:
    """``at, line``: one JSON object, ``summary`` and ``relationships``, a relationship a line; a comma stands before each but the first."""
    s = R.summary(rel).first()
    summary = json.dumps({k: s[k] for k in ("total_relationships", "max_depth", "unique_domains", "unique_organizations")})
    own = _rows(rel, 1, F.to_json(F.struct(*JSON_FIELDS), {"ignoreNullFields": "false"}))
    first = own.agg(F.min("at").alias("_first"))
    own = own.join(F.broadcast(first), F.lit(True)).select("at", F.concat(F.when(F.col("at") == F.col("_first"), "  ").otherwise(", "), "line").alias("line"))
    return _around(rel, [f'{{"summary": {summary}, "relationships": ['], ["]}"]).unionByName(own)


def write_json(rel: DataFrame, path: str, single: bool = False) -> None:
    """One object; its lines stand in the folder's files in order, or in one file."""
    write_lines(json_report(rel), path, single)


def write_batch(rel: DataFrame, path: str, results: DataFrame | None = None) -> None:
    """One folder a root, a summary of all roots, and of ``results(domain, success)`` how many of them came to an end."""
    rel.write.mode("overwrite").partitionBy("root_customer_domain").parquet(f"{path}/relationships")
    own = rel.groupBy("root_customer_domain").agg(F.count("*").alias("relationships"))
    own.write.mode("overwrite").json(f"{path}/summary")
    if results is not None:
        batch_summary(results, own).coalesce(1).write.mode("overwrite").json(f"{path}/batch")


def batch_summary(results: DataFrame, counts: DataFrame) -> DataFrame:
    """One row ``total_domains, successful, failed, total_relationships`` for ``results(domain, success)`` and ``counts(root_customer_domain, relationships)``."""
    own = results.join(counts, F.lower("domain") == F.lower("root_customer_domain"), "left")
    good = F.coalesce("success", F.lit(False))
    return own.agg(F.count("*").alias("total_domains"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.coalesce("relationships", F.lit(0))), F.lit(0)).alias("total_relationships"))


#: Column names of the quarantine's CSV, fixed.
QUARANTINE = ("Timestamp", "Source Domain", "Record Type", "Raw Record", "Extracted Service", "Failure Reason")


def quarantine(rows: DataFrame, at: Column, record_type: str = "DNS::TXT::VERIFICATION") -> DataFrame:
    """``rows(name, rdata, reason)``, and ``service`` if there is one, in the quarantine's six columns; ``at`` is the time."""
    service = F.coalesce("service", F.lit("N/A")) if "service" in rows.columns else F.lit("N/A")
    parts = (F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'"), F.col("name"), F.lit(record_type), F.col("rdata"), service, F.col("reason"))
    return rows.select(*[c.alias(n) for c, n in zip(parts, QUARANTINE, strict=True)])


def write_quarantine(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def mermaid(rel: DataFrame) -> DataFrame:
    """``at, line``: the graph's lines; a node for each domain, an edge for each pair and type."""
    nodes = rel.groupBy(F.col("nth_party_domain").alias("d")).agg(F.min("nth_party_layer").alias("layer"), F.min("nth_party_organization").alias("o"))
    node = nodes.select(F.struct(F.lit(0).alias("k"), "layer", "d").alias("at"), F.concat(F.lit("    "), mermaid_id(F.col("d")), F.lit('["'), F.coalesce("o", "d"), F.lit('"]')).alias("line"))
    arrow = F.when(F.col("nth_party_record_type").startswith("DNS"), " --> ").otherwise(" -.-> ")
    edge = rel.select("nth_party_layer", F.col("nth_party_domain").alias("d"), F.concat(F.lit("    "), mermaid_id(F.col("nth_party_customer_domain")), arrow, mermaid_id(F.col("nth_party_domain"))).alias("line")).distinct()
    return node.unionByName(edge.select(F.struct(F.lit(1).alias("k"), F.col("nth_party_layer").alias("layer"), "d").alias("at"), "line"))


ROW = ("nth_party_domain", "nth_party_organization", "nth_party_layer", "nth_party_customer_domain", "nth_party_record_type")


#: The fields of a relationship in the JSON report, in order.
JSON_FIELDS = (
    "nth_party_domain", "nth_party_organization", "nth_party_layer", "nth_party_customer_domain", "nth_party_customer_organization", "nth_party_record", "nth_party_record_type", "root_customer_domain", "root_customer_organization", "evidence",
)


def _rows(rel: DataFrame, part: int, line: Column) -> DataFrame:
    """``at, line`` for each relationship, in one part of a report."""
    return rel.select(F.struct(F.lit(part).alias("part"), F.col("nth_party_layer").cast("long").alias("a"), F.col("nth_party_domain").alias("b"), F.col("seq").alias("c")).alias("at"), line.alias("line"))


def _fixed(rel: DataFrame, part: int, texts: list[str]) -> DataFrame:
    rows = [(part, i, "", 0, x) for i, x in enumerate(texts)]
    own = rel.sparkSession.createDataFrame(rows, "part int, a long, b string, c long, line string")
    return own.select(F.struct("part", "a", "b", F.col("c").cast(rel.schema["seq"].dataType).alias("c")).alias("at"), "line")


def _around(rel: DataFrame, head: list[str], foot: list[str]) -> DataFrame:
    return _fixed(rel, 0, head).unionByName(_fixed(rel, 2, foot))


def _lines(rel: DataFrame, head: list[str], row: Column, foot: list[str]) -> DataFrame:
    """``at, line``: a report's lines in their order; one for each relationship, however many there are."""
    return _around(rel, head, foot).unionByName(_rows(rel, 1, row))


#: A report's tables: which record types (none: all others), heading, what it says, and the columns after vendor, organization and layer.
TABLES = (
    (("DNS::TXT::SPF",), "Senders of e-mail (SPF)", "They may send e-mail in the domain's name.", ("Customer", "SPF record")),
    (("DNS::TXT::VERIFICATION",), "Connected services (domain verification)", "They have verified the domain and are likely to be connected to it.", ("Customer", "Verification record")),
    (("DISCOVERY::WEBPAGE_SOURCE", "DISCOVERY::WEBPAGE_NETWORK"), "Web pages", "Pages refer to them or send them requests.", ("Method", "Customer", "Evidence")),
    ((), "Other relationships", "", ("Type", "Customer", "Record")),
)
RISKS = (
    "## Risks", "", "- Senders of e-mail can write in the organization's name.", "- Connected services have confirmed control of the domain and may hold its data.",
    "- What pages load or call can read visitors' data and send it on.", "- Vendors of vendors are out of the organization's sight.", "", "### What to do", "",
    "1. Check that each connected service is still needed.", "2. Take senders out of the SPF record that no longer send.", "3. Run the analysis again from time to time.", "4. Write down why each vendor is there.",
)
ARROWS = {"DNS::TXT::SPF": "-.->", "DNS::SUBDOMAIN": "==>", "DISCOVERY::WEBPAGE_SOURCE": "-..->", "DISCOVERY::WEBPAGE_NETWORK": "-.->"}


def _cells(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(escape_markdown(c.cast("string")), F.lit("")) for c in columns]), F.lit(" |"))


def markdown(rel: DataFrame) -> DataFrame:
    """A Markdown report's lines: summary, counts by type and layer, the graph, four tables by record type, and the risks.

    Tables without a row are left out. An empty report says so.
    """
    s = R.summary(rel).first()
    if not s.total_relationships:
        return _fixed(rel, 0, ["# Vendor relationships", "", "No vendor relationships found."])
    types = {r.record_type: r.n for r in R.by_type(rel).collect()}  # a row a type
    root = rel.select("root_customer_domain", "root_customer_organization").orderBy("root_customer_domain", "root_customer_organization").first()
    head = ["# Vendor relationships", "", f"Domain: {root[0]}", f"Organization: {root[1]}", "", f"- Relationships: {s.total_relationships}", f"- Deepest layer: {s.max_depth}", f"- Domains: {s.unique_domains}", f"- Organizations: {s.unique_organizations}", "", "## By record type", ""]
    head += [f"- {t}: {types[t]}" for t in sorted(types)]
    head += ["", "## By layer", ""] + [f"- {r.layer}: {r.n}" for r in R.by_layer(rel).orderBy("layer").collect()]
    head += ["", "## Graph", "", "```mermaid", "graph TD"]
    lines = _fixed(rel, 0, head)
    roots = rel.select("root_customer_domain", "root_customer_organization").groupBy(F.col("root_customer_domain").alias("d")).agg(F.min("root_customer_organization").alias("o"))
    place = lambda part, layer, name: F.struct(F.lit(part).alias("part"), layer.cast("long").alias("a"), name.alias("b"), F.lit(0).cast(rel.schema["seq"].dataType).alias("c")).alias("at")
    box = lambda d, o: F.concat(F.lit("    "), mermaid_id(d), F.lit('["'), d, F.lit("<br/>("), F.coalesce(o, d), F.lit(')"]')).alias("line")
    nodes = rel.groupBy(F.col("nth_party_domain").alias("d")).agg(F.min("nth_party_layer").alias("layer"), F.min("nth_party_organization").alias("o")).join(roots.select("d"), "d", "left_anti")
    kind = F.col("nth_party_record_type")
    arrow = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ARROWS.items() for x in kv]), kind), F.lit("-->"))
    edge = F.concat(F.lit("    "), mermaid_id(F.col("nth_party_customer_domain")), F.lit(" "), arrow, F.lit('|"'), kind, F.lit(" "), F.col("nth_party_layer").cast("string"), F.lit('"| '), mermaid_id(F.col("nth_party_domain")))
    lines = lines.unionByName(roots.select(place(1, F.lit(0), F.col("d")), box(F.col("d"), F.col("o")))).unionByName(nodes.select(place(2, F.col("layer"), F.col("d")), box(F.col("d"), F.col("o"))))
    lines = lines.unionByName(rel.select(F.col("nth_party_layer").alias("layer"), edge.alias("line")).distinct().select(place(3, F.col("layer"), F.col("line")), "line"))
    lines = lines.unionByName(_fixed(rel, 4, ["```", "", "Dashed: e-mail and requests. Double: subdomains. Dotted: references in pages. Solid: all others. Edges say record type and layer.", "", "## Relationships", ""]))
    named = [t for ts, *_ in TABLES for t in ts]
    for i, (own, title, about, columns) in enumerate(TABLES):
        here = [t for t in types if (t in own if own else t not in named)]
        if not here:
            continue
        names = ("Vendor", "Organization", "Layer", *columns)
        part = 5 + 2 * i
        lines = lines.unionByName(_fixed(rel, part, [f"### {title}", "", *([about, ""] if about else []), "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]))
        of = {"Customer": F.col("nth_party_customer_domain"), "Type": kind, "Method": F.when(kind == "DISCOVERY::WEBPAGE_SOURCE", "Page source").otherwise("Requests")}
        cells = _cells(F.col("nth_party_domain"), F.col("nth_party_organization"), F.col("nth_party_layer"), *[of.get(c, F.col("nth_party_record")) for c in columns])
        lines = lines.unionByName(_rows(rel.where(kind.isin(*here)), part + 1, cells))
    return lines.unionByName(_fixed(rel, 20, ["", *RISKS]))


def escape_html(c: Column) -> Column:
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def html(rel: DataFrame) -> DataFrame:
    """An HTML report's lines: the summary, the sources that are present with their labels, and every row of the table."""
    s = R.summary(rel).first()
    present = {r.record_type for r in R.by_type(rel).collect()}
    short = dict(V.SHORT_LABELS)
    options = [f'<option value="{h}">{short[v]}</option>' for v, h, *_ in V.RECORD_TYPES if h in present]
    labels = json.dumps({k: short[v] for v, h, *_ in V.RECORD_TYPES for k in (h, v)})
    summary = json.dumps({"total_relationships": s.total_relationships, "max_depth": s.max_depth, "unique_domains": s.unique_domains, "unique_organizations": s.unique_organizations})
    head = ['<!DOCTYPE html><html><head><meta charset="utf-8"><title>Vendor relationships</title></head><body>', f'<script type="application/json" id="summary">{summary}</script>', f'<script type="application/json" id="labels">{labels}</script>']
    head += ["<select>", *options, "</select>", "<table><tr>" + "".join(f"<th>{c}</th>" for c in ROW) + "</tr>"]
    cells = F.concat(*[F.concat(F.lit("<td>"), F.coalesce(escape_html(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in ROW])
    return _lines(rel, head, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")), ["</table></body></html>"])


def write_lines(lines: DataFrame, path: str, single: bool = False) -> None:
    """The lines in their order, in files whose names sort alike, each a run of the report; or all in one file."""
    own = lines.orderBy("at").select("line")
    (own.coalesce(1) if single else own).write.mode("overwrite").text(path)


def export(rel: DataFrame, path: str, fmt: str) -> None:
    """By format; an unknown one is written as CSV."""
    {"json": write_json, "markdown": lambda r, p: write_lines(markdown(r), p), "html": lambda r, p: write_lines(html(r), p), "parquet": lambda r, p: r.write.mode("overwrite").parquet(p)}.get(fmt, write_csv)(rel, path)
