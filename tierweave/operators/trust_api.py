"""Trust centers of known kinds, and strategies that read lists from captured API responses.

A strategy is a row: how a list is asked for (``kind``, address, method, body, query) and how its answer is read (``path`` and
fields). Requests are strategies with their ``{{slug}}`` filled in; what was answered is a table of
captured responses, so asking is a join on method, address and body.

``STRATEGY``: ``page_url, kind`` (``rest``, ``graphql`` or ``hydration``)``, url, slug, method, body`` (template)``, query`` (template)``, variables, operation,
path, name_field, url_field, purpose_field, evidence_fields, score, n_items``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V
from tierweave.operators import trust
from tierweave.operators.trust_probes import assigned_object, filled

STRATEGY = (
    "page_url string, kind string, url string, slug string, method string, body string, query string, variables map<string,string>, operation string, "
    "path string, name_field string, url_field string, purpose_field string, evidence_fields array<string>, score double, n_items int"
)
PRODUCTS = "map<string, struct<slug: string, show: boolean, raw: struct<spData: struct<items: map<string, struct<listEntries: array<string>>>>>>>"
LEAST_ITEMS = 3


def _strategy(**given: Column) -> list[Column]:
    """The fields of ``STRATEGY``; those that are not given are null."""
    out = []
    for name, kind in (f.rsplit(" ", 1) if "<" not in f else f.split(" ", 1) for f in STRATEGY.split(", ")):
        out.append(given.get(name, F.lit(None)).cast(kind).alias(name))
    return out


def json_path(path: Column) -> Column:
    """A dotted path as JSON path; the empty one is the whole value."""
    return F.when(path == "", "$").otherwise(F.concat(F.lit("$['"), F.replace(path, F.lit("."), F.lit("']['")), F.lit("']")))


def at(value: Column, path: Column) -> Column:
    return F.call_function("get_json_object", value, json_path(path))


def hydration(pages: DataFrame) -> DataFrame:
    """``page_url, body``: the JSON that a page hydrates from."""
    return pages.where(F.contains("html", F.lit("__NEXT_DATA__"))).select(F.col("url").alias("page_url"), F.regexp_extract("html", V.NEXT_DATA, 1).alias("body")).where("body <> ''")


def product_lists(pages: DataFrame) -> DataFrame:
    """Strategies for trust centers whose pages hold lists by product: each item of a shown product with three entries or more.

    One of the first five entries must name a company. A product without a slug goes by its key; one that is not said to be hidden is shown.
    """
    own = hydration(pages.where(F.contains("html", F.lit("__SB_CONFIG__"))))
    products = F.from_json(F.get_json_object("body", "$.props.pageProps.orgInfo.sp.products"), PRODUCTS)
    rows = own.select("page_url", F.explode(products).alias("product", "p")).where(F.coalesce("p.show", F.lit(True)))
    rows = rows.select("page_url", "product", F.coalesce("p.slug", "product").alias("slug"), F.explode("p.raw.spData.items").alias("item", "i")).withColumn("entries", F.col("i.listEntries"))
    named = F.exists(trust._read(F.slice("entries", 1, 5)), lambda e: F.coalesce(e["company"]["name"] != "", F.lit(False)))
    rows = rows.where((F.size("entries") >= LEAST_ITEMS) & named)
    path = F.concat(F.lit("props.pageProps.orgInfo.sp.products."), "product", F.lit(".raw.spData.items."), "item", F.lit(".listEntries"))
    fields = F.array(*map(F.lit, ("company.name", "purpose", "location")))
    return rows.select(*_strategy(page_url=F.col("page_url"), kind=F.lit("hydration"), slug=F.col("slug"), path=path, name_field=F.lit("company.name"), url_field=F.lit("company.domain"), purpose_field=F.lit("purpose"), evidence_fields=fields, score=F.lit(0.95), n_items=F.size("entries")))


def vendor_reports(pages: DataFrame) -> DataFrame:
    """``page_url, body, slug``: the report object that a page assigns, to its closing brace, and the page's slug."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                report, asset = assigned_object(html, "VENDOR_REPORT"), assigned_object(html, "CANONICAL_ASSET")
                try:
                    slug = json.loads(asset).get("slug") if asset else None
                except ValueError:
                    slug = None
                if report:
                    rows.append((url, report, slug if isinstance(slug, str) else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["page_url", "body", "slug"])

    own = pages.where(F.contains("html", F.lit("window.VENDOR_REPORT"))).select(F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(work, "page_url string, body string, slug string")


def report_strategies(reports: DataFrame) -> DataFrame:
    """Strategies that ask a report's public address for its list, for ``vendor_reports`` with three entries or more; without a slug the address is empty."""
    n = F.size(F.from_json(F.get_json_object("body", "$._embedded.subprocessors"), "array<string>"))
    url = F.when(F.col("slug").isNull(), "").otherwise(F.concat(F.lit(V.REPORT_ADDRESS), "slug", F.lit("&embed_canonical_assets=true")))
    rows = reports.withColumn("n", n).where(F.col("n") >= LEAST_ITEMS)
    return rows.select(*_strategy(page_url=F.col("page_url"), kind=F.lit("rest"), url=url, slug=F.col("slug"), method=F.lit("GET"), path=F.lit("_embedded.subprocessors"), name_field=F.lit("name"), url_field=F.lit("website"), purpose_field=F.lit("description"), evidence_fields=F.array(F.lit("name"), F.lit("description")), score=F.lit(0.95), n_items=F.col("n")))


def _sorted(variables: Column) -> Column:
    """A map as text, the same for the same entries in whatever order."""
    return F.to_json(F.array_sort(F.map_entries(variables)))


def requests(strategies: DataFrame) -> DataFrame:
    """Strategies of the kinds ``rest`` and ``graphql`` with ``_method, _url, _body``: what is asked, with slugs filled in.

    A query is a POST of its text, its variables and its operation; of a REST strategy only a POST has a body.
    """
    slug, method = F.col("slug"), F.upper(F.coalesce("method", F.lit("GET")))
    asked = F.to_json(F.struct(F.coalesce("operation", F.lit("")).alias("o"), filled(F.col("query"), slug).alias("q"), _sorted(F.transform_values(F.coalesce("variables", F.create_map().cast("map<string,string>")), lambda k, v: filled(v, slug))).alias("v")))
    graph = F.col("kind") == "graphql"
    body = F.when(graph, asked).when(method == "POST", F.trim(filled(F.coalesce("body", F.lit("")), slug))).otherwise("")
    own = strategies.where("kind in ('rest', 'graphql') and url <> ''")
    return own.withColumn("_method", F.when(graph | (method == "POST"), "POST").otherwise("GET")).withColumn("_url", filled(F.col("url"), slug)).withColumn("_body", body)


def answered(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """``requests`` with the ``answer`` that ``responses(method, url, body, status, response)`` hold for them; of several the last by text.

    A body with a ``query`` is compared as one, whatever the order of its fields. Answers that failed, and queries' answers with errors, are none.
    """
    parts = F.from_json("body", "query string, operationName string, variables map<string,string>")
    query = F.to_json(F.struct(F.coalesce(parts["operationName"], F.lit("")).alias("o"), parts["query"].alias("q"), _sorted(F.coalesce(parts["variables"], F.create_map().cast("map<string,string>"))).alias("v")))
    own = responses.withColumn("_body", F.when(parts["query"].isNotNull(), query).otherwise(F.trim(F.coalesce("body", F.lit("")))))
    own = own.where("status between 200 and 299 and response is not null").withColumn("_method", F.when(F.upper("method") == "POST", "POST").otherwise("GET"))
    own = own.withColumn("_body", F.when(F.col("_method") == "POST", F.col("_body")).otherwise("")).groupBy("_method", F.col("url").alias("_url"), "_body").agg(F.max("response").alias("answer"))
    both = asked.join(own, ["_method", "_url", "_body"])
    errors = F.coalesce(F.size(F.from_json(F.get_json_object("answer", "$.errors"), "array<string>")) > 0, F.lit(False))
    return both.where((F.col("kind") != "graphql") | ~errors).drop("_method", "_url", "_body")


def read(found: DataFrame) -> DataFrame:
    """``page_url, ord, domain, name, evidence`` of strategies with their ``answer``, as their paths and fields say.

    Where the answer holds canonical assets and its first entry names one, entries get name and website of theirs by a join inside the
    answer (of assets with one id the last counts), and entries without any go. An entry without an address gets ``_org:`` and its name.
    """
    key = ["page_url", "path"]
    rows = found.withColumn("items", F.from_json(at(F.col("answer"), F.col("path")), "array<string>")).where("items is not null")
    assets = F.from_json(F.get_json_object("answer", "$._embedded.canonical_assets"), "array<struct<id: string, name: string, website: string>>")
    rows = rows.withColumn("assets", F.filter(F.coalesce(assets, F.array().cast("array<struct<id: string, name: string, website: string>>")), lambda a: a["id"].isNotNull() & a["name"].isNotNull()))
    related = (F.size("assets") > 0) & F.coalesce(F.get_json_object(F.get("items", F.lit(0)), "$.canonical_asset_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("related", related)
    own = rows.select(*key, F.posexplode("assets").alias("_at", "_a")).groupBy(*key, F.col("_a.id").alias("_id")).agg(F.max_by("_a", "_at").alias("_a"))
    items = rows.select(*key, "related", "name_field", "url_field", "purpose_field", "evidence_fields", F.posexplode("items").alias("ord", "item"))
    items = items.withColumn("_id", F.when(F.col("related"), F.get_json_object("item", "$.canonical_asset_id"))).join(own, [*key, "_id"], "left")
    name = F.when(F.col("related"), F.col("_a.name")).otherwise(F.trim(at(F.col("item"), F.col("name_field"))))
    site = F.when(F.col("related"), F.col("_a.website")).otherwise(at(F.col("item"), F.col("url_field")))
    about = at(F.col("item"), F.coalesce("purpose_field", F.lit("description")))
    told = F.when(F.col("related"), F.concat_ws(" | ", F.col("_a.name"), about)).when(F.coalesce(F.size("evidence_fields"), F.lit(0)) <= 0, name)
    told = told.otherwise(F.array_join(F.transform("evidence_fields", lambda f: at(F.col("item"), f)), " | "))
    out = items.select("page_url", "path", "ord", name.alias("name"), trust.domain_of(site).alias("_d"), told.alias("evidence")).where(F.octet_length("name") >= 2)
    return out.select("page_url", "ord", F.coalesce("_d", F.concat(F.lit("_org:"), "name")).alias("domain"), "name", "evidence")


def best(strategies: DataFrame) -> DataFrame:
    """Of each page the strategy with the highest score, then with most entries, then the first by path."""
    rest = [c for c in strategies.columns if c != "page_url"]
    picked = F.min_by(F.struct(*rest), F.struct(-F.col("score"), -F.col("n_items"), "path"))
    return strategies.groupBy("page_url").agg(picked.alias("r")).select("page_url", "r.*")


def vendors(pages: DataFrame, responses: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """``page_url, ord, domain, name, evidence`` of trust centers of known kinds, and of strategies that are ``given`` (``STRATEGY``).

    A report's public address is asked first; where ``responses`` hold no answer, the report in the page itself is read.
    """
    reports = vendor_reports(pages)
    found = best(product_lists(pages).unionByName(report_strategies(reports)))
    hydrated = found.where("kind = 'hydration'").join(hydration(pages).withColumnRenamed("body", "answer"), "page_url")
    asked = found.where("kind = 'rest'")
    embedded = asked.join(reports.select("page_url", F.col("body").alias("answer")), "page_url")
    columns = [f.split()[0] for f in STRATEGY.split(", ")] + ["answer"]
    parts = [hydrated]
    if responses is None:
        parts.append(embedded)
    else:
        every = asked if given is None else asked.unionByName(given.select(*asked.columns))
        got = answered(requests(every), responses)
        parts += [got, embedded.join(got.select("page_url").distinct(), "page_url", "left_anti")]
    out = read(parts[0].select(*columns))
    for p in parts[1:]:
        out = out.unionByName(read(p.select(*columns)))
    return out
