"""Observations and reference tables from files. Every reader names its schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierweave.functions.domains import is_batch_domain
from tierweave.operators.relations import SCHEMA

TABLES = {
    "dns_answers": "name string, rrtype string, rdata string, ordinal int, status string",
    "ct_entry": "query_domain string, provider string, ordinal int, issuer_ca_id bigint, issuer_name string, common_name string, name_value string, id bigint, entry_timestamp string, not_before string, not_after string",
    "pages": "url string, html string", "network_requests": "page_url string, ordinal int, request_url string", "whois": "domain string, response string",
    "captures": "page_url string, ordinal int, url string, body string", "http_probes": "pattern string, tenant string, url string, status int, body string, final_url string, error string", "relationships": SCHEMA,
}
VENDOR = """id string, organization string, primary_domain string, parent_vendor string, acquired_year int,
 domains map<string, struct<type: string, category: string, description: string, acquired_year: int, vendor_ref: string>>, verification_patterns array<string>, provider_aliases array<string>,
 saas_tenants array<struct<name: string, patterns: array<string>, detection: struct<success_indicators: array<string>, failure_indicators: array<string>, notes: string>>>"""


def observations(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of observations of a known kind; malformed JSON lines are dropped."""
    reader = spark.read.schema(TABLES[kind])
    return (reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader).format(fmt).load(path)


def batch_domains(spark: SparkSession, path: str) -> DataFrame:
    """``domain, label`` from a CSV, JSON or plain file, by its ending. Invalid domains are dropped.

    A CSV whose first line holds the word domain has a header; otherwise the first field of each
    line counts, and lines that begin with # do not. JSON is a list of names, a list of objects, or an object with ``domains``.
    """
    low = path.lower()
    if low.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        items = whole.select(F.explode(F.coalesce(F.expr("try_variant_get(v, '$.domains', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))).alias("i"))
        rows = items.select(F.coalesce(F.expr("try_variant_get(i, '$.domain', 'string')"), F.expr("try_variant_get(i, '$', 'string')")).alias("domain"), F.expr("try_variant_get(i, '$.label', 'string')").alias("label"))
    else:
        lines = spark.read.text(path)
        first = lines.limit(1).collect()
        if low.endswith(".csv") and first and "domain" in first[0][0].lower():
            table = spark.read.option("header", True).csv(path)
            names = {c.strip().lower(): c for c in table.columns}
            label = F.trim(F.col(names["label"])) if "label" in names else F.lit(None).cast("string")
            rows = table.select(F.trim(F.col(names["domain"])).alias("domain"), F.nullif(label, F.lit("")).alias("label")) if "domain" in names else table.select(F.trim(F.col(table.columns[0])).alias("domain"), label.alias("label"))
        else:
            rows = lines.where(~F.trim("value").startswith("#")).select(F.trim(F.get(F.split("value", ","), F.lit(0))).alias("domain"), F.lit(None).cast("string").alias("label"))
    return rows.withColumn("domain", F.lower("domain")).where(is_batch_domain(F.col("domain")))


def vendor_registry(spark: SparkSession, path: str) -> DataFrame:
    """Vendor documents, one JSON file each; unreadable ones and those whose name begins with an underscore are left out."""
    return spark.read.schema(VENDOR).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "[!_]*.json").json(path).where("id is not null")


def registry_domains(registry: DataFrame) -> DataFrame:
    """``domain, organization, id``: listed domains, and primary ones unless listed by anyone."""
    listed = registry.select(F.explode(F.map_keys("domains")).alias("domain"), "organization", "id").withColumn("domain", F.lower("domain"))
    primary = registry.select(F.lower("primary_domain").alias("domain"), "organization", "id").where("domain is not null").join(listed.select("domain"), "domain", "left_anti")
    return listed.unionByName(primary)


def registry_aliases(registry: DataFrame) -> DataFrame:
    return registry.select(F.lower(F.explode("provider_aliases")).alias("alias"), "id")


def registry_patterns(registry: DataFrame) -> DataFrame:
    return registry.select(F.explode("verification_patterns").alias("pattern"), F.lower("primary_domain").alias("domain"))


def registry_tenants(registry: DataFrame) -> DataFrame:
    """Tenant patterns of the registry in the form of the platform table."""
    rows = registry.select(F.col("primary_domain").alias("vendor_domain"), F.explode("saas_tenants").alias("t"))
    return rows.select(F.col("t.name").alias("name"), "vendor_domain", F.col("t.patterns").alias("tenant_patterns"), F.col("t.detection").alias("detection"))


def platforms(spark: SparkSession, path: str) -> DataFrame:
    one = "name string, vendor_domain string, tenant_patterns array<string>, detection struct<success_indicators: array<string>, failure_indicators: array<string>, notes: string>"
    return spark.read.schema(f"platforms array<struct<{one.replace(' string', ': string').replace(' array', ': array').replace(' struct', ': struct')}>>").option("multiLine", True).json(path).select(F.inline("platforms"))


def known_vendors(spark: SparkSession, path: str, tier: str = "base") -> DataFrame:
    """``domain, organization, tier`` from ``{"vendors": {domain: organization}}``."""
    rows = spark.read.schema("vendors map<string, string>").option("multiLine", True).json(path)
    return rows.select(F.explode("vendors").alias("domain", "organization")).select(F.lower("domain").alias("domain"), "organization", F.lit(tier).alias("tier"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("vendors map<string, struct<organization: string, added: string, source: string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("vendors").alias("domain", "v")).select(F.lower("domain").alias("domain"), "v.*")


def company_table(spark: SparkSession, path: str) -> DataFrame:
    """``domain, organization`` from tab-separated files with # comments; the last line of a domain counts, files in order of their names."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(at.alias("at"), F.regexp_replace("value", r"\r$", "").alias("line")).where(~F.trim("line").startswith("#"))
    parts = lines.select("at", F.lower(F.trim(F.get(F.split("line", "\t", 2), F.lit(0)))).alias("domain"), F.trim(F.get(F.split("line", "\t", 2), F.lit(1))).alias("organization"))
    return parts.where("domain <> '' and organization <> ''").groupBy("domain").agg(F.max_by("organization", "at").alias("organization"))


def company_table_version(spark: SparkSession, path: str) -> str | None:
    """What the table's ``# dataset_version:`` line says."""
    said = spark.read.text(path).where(F.trim("value").rlike(r"^#\s*dataset_version:")).select(F.trim(F.regexp_extract("value", r"dataset_version:(.*)$", 1)).alias("v"))
    found = said.agg(F.min("v")).first()
    return found[0] if found else None


def or_else(read: Callable[[], DataFrame], fallback: DataFrame) -> DataFrame:
    """What ``read`` reads, or the table that comes with the installation where its files are missing or hold nothing."""
    try:
        found = read()
        return fallback if found.isEmpty() else found
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return fallback


def all_platforms(platforms: DataFrame, registry: DataFrame) -> DataFrame:
    """The platform table with the registry's tenants after it; a name and owner that the table has already counts once."""
    own = registry_tenants(registry).join(platforms.select("name", "vendor_domain"), ["name", "vendor_domain"], "left_anti")
    return platforms.unionByName(own.select(*platforms.columns))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, without those that do not fit; of a compressed file that breaks off, the lines before the break."""
    text = spark.read.option("ignoreCorruptFiles", True).text(path)
    return text.select(F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull() & F.col("r").cast("string").isNotNull()).select("r.*").dropna("all")


def subdomains(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "host string, source string").where("host is not null").select(F.lower("host").alias("subdomain"), "source")


def spotter_entries(raw: DataFrame) -> DataFrame:
    """Certificate rows with ``dns_names`` in the common form of entries."""
    return raw.select("query_domain", F.lit("certspotter").alias("provider"), "ordinal", F.coalesce(F.col("id").try_cast("bigint"), F.lit(0)).alias("id"), F.get("dns_names", F.lit(0)).alias("common_name"), F.array_join("dns_names", "\n").alias("name_value"))


def merklemap_entries(raw: DataFrame) -> DataFrame:
    """``raw(query_domain, ordinal, body)``: ``{"results": [{"hostname": ...}]}`` as one entry with a name a line."""
    names = F.filter(F.transform(F.from_json("body", "results array<struct<hostname: string>>")["results"], lambda r: r["hostname"]), lambda n: n.isNotNull())
    return _entries(raw, names, "merklemap")


def censys_entries(raw: DataFrame) -> DataFrame:
    """``raw(query_domain, ordinal, body)``: every hit's names, else its certificate's, else the alternative names that were parsed."""
    hit = "names array<string>, cert struct<names: array<string>, parsed: struct<subject_alt_name: struct<dns_names: array<string>>>>"
    hits = F.from_json("body", f"result struct<hits: array<struct<{hit.replace('names array', 'names: array', 1).replace('cert struct', 'cert: struct', 1)}>>>")["result"]["hits"]
    names = F.flatten(F.transform(hits, lambda h: F.coalesce(h["names"], h["cert"]["names"], h["cert"]["parsed"]["subject_alt_name"]["dns_names"], F.array().cast("array<string>"))))
    return _entries(raw, names, "censys")


def _entries(raw: DataFrame, names: Column, provider: str) -> DataFrame:
    rows = raw.select("query_domain", F.lit(provider).alias("provider"), "ordinal", F.lit(0).cast("bigint").alias("id"), F.lit(None).cast("string").alias("common_name"), names.alias("_names"))
    return rows.where(F.size("_names") > 0).withColumn("name_value", F.array_join("_names", "\n")).drop("_names")


def txt_and_cname(answers: DataFrame) -> DataFrame:
    """``name, txt, cnames``: a domain's TXT and CNAME answers in order, from one pass over ``answers``."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.upper("rrtype") == kind, F.struct("ordinal", "rdata")))), lambda r: r["rdata"])
    return answers.groupBy(F.lower("name").alias("name")).agg(of("TXT").alias("txt"), of("CNAME").alias("cnames"))


def assembled_vendors(base: DataFrame, remote: DataFrame | None = None, local: DataFrame | None = None) -> DataFrame:
    """``domain, organization, tier``: of the base table, a newer remote one and local overrides, for each domain the best tier's row."""
    tiers = [(t, n) for t, n in ((local, "overrides"), (remote, "remote"), (base, "base")) if t is not None]
    every = reduce(DataFrame.unionByName, [t.select(F.lower("domain").alias("domain"), "organization", F.lit(n).alias("tier"), F.lit(i).alias("_rank")) for i, (t, n) in enumerate(tiers)])
    return every.groupBy("domain").agg(F.min_by(F.struct("organization", "tier"), F.struct("_rank", "organization")).alias("r")).select("domain", "r.*")
