"""The subprocessor phase as one plan: vendors and pages in, finds out.

Ways to read a disclosure are ordered (``LEVELS``). All vendors go through them level by level: a level sees only the pages of
vendors that no earlier one has answered, and its finds and the vendors left are written to the shared folder, so that a
lost executor repeats its own tasks only. Of a vendor's pages that a level can read, the most telling address counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.operators import listings, subprocessors, trust, trust_api
from tierweave.operators import nodes as N
from tierweave.plans.graph import committed, told

LEVELS = ("custom", "trust_center", "capture", "table", "list")
FOUND = ("page_url", "domain", "name", "other_name", "evidence")


@dataclass
class Rules:
    """Hosts' own rules: see ``listings.custom``. Of the hosts in ``only(host)`` no general way is tried."""

    selectors: DataFrame
    patterns: DataFrame
    names: DataFrame
    exclusions: DataFrame
    only: DataFrame


def addresses(vendors: DataFrame, pages: DataFrame) -> DataFrame:
    """``target, place, page_url``: the pages that stand where ``vendors(domain)`` may list subprocessors."""
    key = lambda c: F.regexp_replace(F.lower(c), "/+$", "")
    asked = subprocessors.page_urls(vendors.select("domain").where("domain is not null").distinct()).select(F.col("domain").alias("target"), F.col("ord").alias("place"), key("url").alias("_key"))
    have = pages.select(F.col("url").alias("page_url"), key("url").alias("_key")).where("page_url is not null").distinct()
    # Some hundred addresses a vendor: Spark takes them for as small as the vendors, and would send them all to every task.
    return asked.hint("merge").join(have, "_key").groupBy("target", "page_url").agg(F.min("place").alias("place"))


def _find(level: str, pages: DataFrame, nodes: DataFrame, captures: DataFrame | None, responses: DataFrame | None, rules: Rules | None) -> DataFrame | None:
    if level == "custom":
        return listings.custom(pages, nodes, rules.selectors, rules.patterns, rules.names, rules.exclusions) if rules else None
    if level == "trust_center":
        return trust_api.vendors(pages, responses).withColumn("other_name", F.lit(None).cast("string"))
    if level == "capture":
        if captures is None:
            return None
        own = captures.join(pages.select(F.col("url").alias("page_url")).distinct(), "page_url", "left_semi")
        return trust.subprocessors(trust.entity_arrays(own)).withColumn("other_name", F.lit(None).cast("string"))
    return listings.tables(nodes) if level == "table" else listings.lists(nodes)


def phase(vendors: DataFrame, pages: DataFrame, captures: DataFrame | None = None, responses: DataFrame | None = None, rules: Rules | None = None, known: DataFrame | None = None) -> DataFrame:
    """``target, domain, evidence, method, page_url``: what ``vendors(domain)`` disclose on ``pages(url, html)``.

    ``captures`` and ``responses`` are JSON that was captured (``trust``, ``trust_api``); ``known(organization, domain)`` says whose names stand for which domains.
    Finds are filtered by ``scan.from_subprocessors``. Pages that stand twice count once; null pages hold nothing.
    """
    left = committed(addresses(vendors, pages), "disclosures-addresses")
    here = pages.select("url", "html").join(left.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi").groupBy("url").agg(F.max("html").alias("html"))
    here = committed(here, "disclosures-pages")
    nodes = committed(N.page_nodes(here), "disclosures-nodes")
    general = here if rules is None else here.withColumn("host", D.host_of(F.col("url"))).join(told(rules.only.select(F.lower("host").alias("host"))), "host", "left_anti").drop("host")
    parts = []
    for level in LEVELS:
        open_pages = left.select("page_url").distinct()
        own = (here if level == "custom" else general).join(open_pages.withColumnRenamed("page_url", "url"), "url", "left_semi")
        found = _find(level, own, nodes.join(own.select(F.col("url").alias("page_url")), "page_url", "left_semi"), captures, responses, rules)
        if found is None:
            continue
        rows = left.join(found.select(*FOUND), "page_url")
        first = rows.groupBy("target").agg(F.min(F.struct("place", "page_url")).alias("r")).select("target", F.col("r.page_url").alias("page_url"))
        answered = committed(rows.join(first, ["target", "page_url"], "left_semi").select("target", "domain", "name", "other_name", "evidence", F.lit(level).alias("method"), "page_url").distinct(), "disclosures-found")
        parts.append(answered)
        left = committed(left.join(answered.select("target").distinct(), "target", "left_anti"), "disclosures-left")
        if left.isEmpty():
            break
    every = reduce(DataFrame.unionByName, parts)
    return (every if known is None else listings.by_other_name(every, known)).select("target", "domain", "evidence", "method", "page_url")
