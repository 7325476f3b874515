"""A whole scan as one plan: observation tables to facts, facts to layers, layers to the report's rows.

The phases (DNS records, subprocessors, subdomains, tenants, certificates, web traffic) are branches
of their own; each projects to one shape, ``target, domain, source_type, raw_record``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import records
from tierweave.operators import registry, relations, subprocessors, txt, web
from tierweave.plans import graph

SHAPE = ("target", "domain", "source_type", "raw_record")


def from_txt(answers: DataFrame) -> DataFrame:
    """``answers(name, rdata)``: what a domain's TXT records name."""
    return txt.extract_txt(answers.select(F.lower("name").alias("target"), "rdata")).select(*SHAPE)


def from_subprocessors(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``found(target, domain, evidence)`` after the result filter."""
    return subprocessors.filter_results(found, known).select("target", "domain", F.lit("HTTP::SUBPROCESSOR").alias("source_type"), F.col("evidence").alias("raw_record"))


def from_subdomains(found: DataFrame) -> DataFrame:
    return registry.subdomain_vendors(found).select("target", "domain", "source_type", F.col("evidence").alias("raw_record"))


def from_tenants(results: DataFrame) -> DataFrame:
    """Confirmed and likely tenants: ``results(domain, vendor_domain, platform, url, status, evidence)``."""
    text = F.format_string("Tenant URL: %s (%s) | %s", "url", "status", "evidence")
    own = results.where(F.col("status").isin("Confirmed", "Likely"))
    return own.select(F.col("domain").alias("target"), F.col("vendor_domain").alias("domain"), F.lit("DISCOVERY::SAAS_TENANT").alias("source_type"), text.alias("raw_record"))


def from_certificates(entries: DataFrame) -> DataFrame:
    return registry.certificate_vendors(entries).select(F.col("query_domain").alias("target"), F.col("vendor_domain").alias("domain"), F.lit("DISCOVERY::CT_LOG").alias("source_type"), F.col("evidence").alias("raw_record"))


def from_web(pages: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """``pages(url, html)`` and ``requests(page_url, ordinal, request_url)``, each page on behalf of its base domain."""
    base = lambda df, url: df.withColumn("target", D.base_domain(D.host_of(F.col(url))))
    seen = web.page_resources(base(pages, "url"))
    if requests is not None:
        seen = web.web_traffic(seen, web.network_vendors(base(requests, "page_url")))
    return seen.select(D.base_domain(D.host_of(F.col("page_url"))).alias("target"), F.col("vendor_domain").alias("domain"), "source_type", F.col("evidence").alias("raw_record"))


def from_parents(domains: DataFrame) -> DataFrame:
    """A scanned subdomain's own base domain."""
    base = D.base_domain(F.col("target"))
    own = domains.select(F.lower("target").alias("target")).distinct().withColumn("domain", base).where("domain <> target")
    return own.select("target", "domain", F.lit("DNS::SUBDOMAIN").alias("source_type"), F.format_string("Subdomain analysis: %s -> %s", "target", "domain").alias("raw_record"))


def unite(*phases: DataFrame) -> DataFrame:
    """All phases' facts: per target one of each base domain, source and record, under the base domain."""
    every = graph.committed(reduce(DataFrame.unionByName, [p.select(*SHAPE) for p in phases]).where("target is not null and domain is not null"), "scan-phases")
    return every.withColumn("domain", D.base_domain(F.col("domain"))).where("target is not null and domain is not null").distinct()


def minimal(roots: DataFrame, answers: DataFrame, names: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The relationship rows of a scan of ``roots(root)`` by TXT records alone (``answers(name, rdata)``).

    A name's facts are those of its own records and of the SPF records that these include, however far. Vendors are followed by the name
    that the record says, ``max_depth`` layers deep; common infrastructure is listed and never followed, whatever the depth. ``names(domain, organization)``.
    """
    low = answers.select(F.lower("name").alias("name"), "rdata").where("name is not null and rdata is not null")
    included = txt.resolve_spf(low.select(F.col("name").alias("root")).distinct(), low).where("lookup > 0").select(F.col("root").alias("target"), "name")
    own = txt.extract_txt(low.withColumnRenamed("name", "target")).select(*SHAPE)
    more = txt.extract_txt(included.join(low, "name")).where("source_type = 'DNS::TXT::SPF'").select(*SHAPE)
    facts = own.unionByName(more).distinct().withColumn("base", D.base_domain(F.col("domain"))).withColumn("customer", D.base_domain(F.col("target")))
    facts = graph.committed(facts, "minimal-facts").where("base <> customer")
    edges = facts.where(~D.is_common_infrastructure(F.col("base"))).select(F.col("target").alias("customer"), D.normalize_for_lookup(F.col("domain")).alias("vendor"))
    reached = graph.layers(roots.select(F.lower("root").alias("root")), edges, max_depth=None if max_depth is None else max_depth - 1)
    rows = reached.select(F.col("root").alias("root_customer_domain"), F.col("domain").alias("target"), (F.col("layer") + 1).alias("nth_party_layer")).join(facts, "target")
    record = records.record_value(F.col("source_type"), F.col("base"), F.col("target"), F.col("raw_record"), F.col("domain"))
    rows = rows.withColumn("nth_party_record", record).withColumnsRenamed({"customer": "nth_party_customer_domain", "base": "nth_party_domain", "raw_record": "evidence", "source_type": "nth_party_record_type"})
    return _ordered(_named(rows.drop("target", "domain").distinct(), names))


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """With the organizations at all three positions; a domain without one stands for itself."""
    once = names.groupBy("domain").agg(F.min("organization").alias("organization"))
    for d, o in relations.POSITIONS:
        rows = rows.join(once.select(F.col("domain").alias(d), F.col("organization").alias(o)), d, "left").withColumn(o, F.coalesce(o, d))
    return rows


def _ordered(rows: DataFrame) -> DataFrame:
    """The report's columns, with an order that does not depend on how the rows are spread."""
    order = F.xxhash64("root_customer_domain", "nth_party_customer_domain", "nth_party_domain", "nth_party_record_type", "nth_party_record")
    rows = rows.withColumn("seq", F.col("nth_party_layer").cast("long") * F.lit(1 << 58) + F.shiftrightunsigned(order, 6))
    return rows.select(*[c.split()[0] for c in relations.SCHEMA.replace("\n", " ").split(", ")])


def report(roots: DataFrame, facts: DataFrame, names: DataFrame, max_depth: int | None = 3, curated: DataFrame | None = None, include_infrastructure: bool = False, checkpoint: str | None = None) -> DataFrame:
    """The relationship rows of a scan from ``roots(root)``.

    ``facts`` are ``unite``'s. A vendor is skipped where it is its customer's own, or no public host; it is
    followed at most ``max_depth`` layers deep; without such a bound, common infrastructure is not followed. ``checkpoint`` keeps whole layers for a later run. ``names(domain, organization)`` says who
    stands behind a domain (``attribution.attribute``); a domain without one stands for itself.
    """
    facts = graph.committed(facts, "scan-observed")  # what follows reads plain columns, not the expressions that made them
    own = graph.committed(facts.where(~D.is_non_registrable(F.col("domain")) & ~D.same_organization(F.col("domain"), F.col("target"))), "scan-facts")
    edges = own.select(F.col("target").alias("customer"), F.col("domain").alias("vendor"))
    reached = graph.layers(roots, edges, max_depth=None if max_depth is None else max_depth - 1, stop_at_infrastructure=max_depth is None, checkpoint=checkpoint)
    rows = reached.select(F.col("root").alias("root_customer_domain"), F.col("domain").alias("target"), (F.col("layer") + 1).alias("nth_party_layer")).join(own, "target")
    rows = rows.withColumnsRenamed({"target": "nth_party_customer_domain", "domain": "nth_party_domain", "raw_record": "nth_party_record", "source_type": "nth_party_record_type"})
    rows = _ordered(_named(rows.withColumn("evidence", F.col("nth_party_record")), names))
    once = relations.dedup_relationships(rows, per=("root_customer_domain",))
    return relations.finalize(relations.drop_marketing(relations.drop_infrastructure(once, include_infrastructure)), curated)
