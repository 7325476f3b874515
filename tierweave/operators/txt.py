"""Vendors named in DNS TXT records: SPF, DKIM, DMARC and domain verification.

Each extractor turns a record into ``array<struct<domain, source_type>>`` by built-in functions;
``extract_txt`` unites them per record and keeps the first of equal facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V
from tierweave.functions.domains import base_domain, is_dns_name
from tierweave.functions.orgs import lookup
from tierweave.plans.graph import committed, told

FACTS = "array<struct<domain:string,source_type:string>>"


def _none() -> Column:
    return F.array().cast(FACTS)


def _facts(domains: Column, source_type: str) -> Column:
    return F.transform(domains, lambda d: F.struct(d.alias("domain"), F.lit(source_type).alias("source_type")))


def clean_record(c: Column) -> Column:
    """Without quotes around it and without backslash escapes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, '^"+|"+$', ""), r"(?s)\\(.)", "$1"), r"\\$", "")


def strip_spf_macros(c: Column) -> Column:
    return F.regexp_replace(c, V.SPF_MACRO, "")


def spf(record: Column) -> Column:
    """Base domains after the six mechanisms, in the mechanisms' order."""
    low = F.lower(record)
    names = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in V.SPF_MECHANISMS]))
    good = F.filter(F.transform(names, strip_spf_macros), is_dns_name)
    return F.when(low.startswith("v=spf1"), _facts(F.transform(good, base_domain), "DNS::TXT::SPF")).otherwise(_none())


def spf_rejected(record: Column) -> Column:
    """Names in an SPF record that are no DNS names."""
    low = F.lower(record)
    names = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in V.SPF_MECHANISMS]))
    return F.when(low.startswith("v=spf1"), F.filter(names, lambda n: ~is_dns_name(strip_spf_macros(n)))).otherwise(F.array().cast("array<string>"))


def dkim(record: Column) -> Column:
    values = F.flatten(F.array(*[F.regexp_extract_all(record, F.lit(p), F.lit(1)) for p in V.DKIM_TAGS]))
    keyed = record.contains("k=rsa") | record.contains("k=ed25519")
    return F.when(keyed, _facts(F.filter(values, is_dns_name), "DNS::TXT::DKIM")).otherwise(_none())


def dmarc(record: Column) -> Column:
    """Hosts of the first rua and the first ruf tag, as they stand."""
    low = F.lower(record)
    of = lambda tag: F.regexp_extract_all(F.regexp_extract(low, f"(?s)^.*?{tag}=([^;]*)", 1), F.lit(V.DMARC_MAILTO), F.lit(2))
    good = F.filter(F.concat(of("rua"), of("ruf")), is_dns_name)
    return F.when(low.startswith("v=dmarc1"), _facts(good, "DNS::TXT::DMARC")).otherwise(_none())


def provider_domain(name: Column) -> Column:
    """The domain of a provider's token; null for unknown ones."""
    return F.coalesce(lookup(name, V.PROVIDERS), F.when(name.isin(*V.PROVIDERS_DOT_COM), F.concat(name, F.lit(".com"))))


def verification(record: Column) -> Column:
    """Static patterns (by plain, case-sensitive containment), then provider tokens."""
    static = F.filter(F.array(*[F.when(record.contains(p), d) for p, d in V.VERIFICATION_PATTERNS]), lambda d: d.isNotNull())
    tokens = F.flatten(F.array(*[F.regexp_extract_all(record, F.lit(p), F.lit(1)) for p in V.PROVIDER_TOKENS]))
    dynamic = F.filter(F.transform(tokens, lambda t: provider_domain(F.lower(t))), lambda d: d.isNotNull())
    return _facts(F.concat(static, dynamic), "DNS::TXT::VERIFICATION")


def extract_txt(records: DataFrame, record: str = "rdata") -> DataFrame:
    """``records`` (any columns) with a row per fact: ``domain, source_type, raw_record, fact``.

    Within a record, the first of equal facts stays; ``fact`` is its place.
    """
    cleaned = clean_record(F.col(record))
    found = F.concat(spf(cleaned), dkim(cleaned), dmarc(cleaned), verification(cleaned))
    rows = records.select("*", F.posexplode(F.array_distinct(found)).alias("fact", "_f"))
    return rows.select(*records.columns, "fact", F.col("_f.domain").alias("domain"), F.col("_f.source_type").alias("source_type"), F.col(record).alias("raw_record"))


def unmatched_txt(records: DataFrame, record: str = "rdata") -> DataFrame:
    """Records of more than five bytes in which nothing is found: the quarantine rows."""
    cleaned = clean_record(F.col(record))
    found = F.concat(spf(cleaned), dkim(cleaned), dmarc(cleaned), verification(cleaned))
    return records.where((F.size(found) == 0) & (F.octet_length(cleaned) > 5)).withColumn("reason", F.lit("No pattern matched this TXT record"))


def _held(texts: DataFrame, patterns: DataFrame, size: int) -> DataFrame:
    """``texts(_t)`` with every one of ``patterns(_p, ...)`` that they hold, by a gram index.

    Each pattern is indexed under that run of ``size`` characters in it which fewest patterns hold, and texts are
    looked up by their runs, so a text meets the patterns that share a run with it, not all of them. Patterns shorter than ``size`` are
    indexed whole, and looked up by runs of their own length. Empty patterns are left out.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))
    own = patterns.where("_p <> ''")
    grams = own.select("_p").distinct().withColumn("_gram", F.explode(runs(F.col("_p"), size)))
    often = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    index = grams.join(often, "_gram").groupBy("_p").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    every = F.flatten(F.array(*[runs(F.col("_t"), n) for n in range(1, size + 1)]))
    # The texts' runs are many times the texts, and Spark takes them for no more: the patterns are what is sent, or both sides are shuffled.
    met = texts.withColumn("_gram", F.explode(F.array_distinct(every))).join(told(index), "_gram").where(F.contains("_t", F.col("_p")))
    return met.drop("_gram").join(told(own), "_p")


def verification_join(records: DataFrame, patterns: DataFrame, record: str = "rdata", size: int = 3) -> DataFrame:
    """Records with every pattern of ``patterns(pattern, domain)`` that they contain; different records are looked up once, in a gram index."""
    texts = records.select(F.col(record).alias("_t")).where("_t is not null").distinct()
    held = _held(texts, patterns.withColumn("_p", F.col("pattern")), size).drop("_p")
    return records.join(held.hint("merge"), F.col(record) == F.col("_t")).drop("_t")


def first_verification(records: DataFrame, patterns: DataFrame, record: str = "rdata", size: int = 3) -> DataFrame:
    """``records`` with the ``domain`` of the first of ``patterns(rank, pattern, domain)`` that they contain, whatever the case; null without one.

    Different records are looked up once, in a gram index. An empty pattern fits every record.
    """
    low = patterns.where("pattern is not null").select("rank", F.lower("pattern").alias("_p"), F.col("domain").alias("_d"))
    texts = records.select(F.lower(record).alias("_t")).where("_t is not null").distinct()
    best = _held(texts, low, size).groupBy("_t").agg(F.min(F.struct("rank", "_d")).alias("r"))
    empty = low.where("_p = ''").agg(F.min(F.struct("rank", "_d")).alias("e"))
    out = records.withColumn("_t", F.lower(record)).join(best, "_t", "left").join(F.broadcast(empty), F.lit(True), "left")
    return out.withColumn("domain", F.when(F.col("_t").isNotNull(), F.least(F.col("r"), F.col("e"))["_d"])).drop("_t", "r", "e")


def verification_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.VERIFICATION_PATTERNS), "pattern string, domain string")


def resolve_spf(roots: DataFrame, answers: DataFrame, most_lookups: int = 10) -> DataFrame:
    """SPF records reached over include and redirect: ``root, name, lookup``.

    ``roots(root)`` and ``answers(name, rdata)`` join once a level. Within a root, names are taken in
    breadth-first order, each once, and ``most_lookups`` of them are followed; macros are not.
    """
    targets = lambda r: F.filter(F.flatten(F.array(*[F.regexp_extract_all(F.lower(r), F.lit(p), F.lit(1)) for p in V.SPF_MECHANISMS[:2]])), lambda t: ~t.contains("%"))
    spf_of = answers.where(F.lower(clean_record(F.col("rdata"))).startswith("v=spf1")).select(F.lower("name").alias("name"), F.transform(targets(clean_record(F.col("rdata"))), lambda t: F.regexp_replace(t, r"\.$", "")).alias("targets"))
    seen = committed(roots.select("root", F.lower("root").alias("name"), F.lit(0).alias("lookup")), "spf")
    spf_of = committed(spf_of, "spf-targets")
    frontier = seen
    for _ in range(most_lookups):
        found = frontier.join(spf_of, "name").select("root", "lookup", F.posexplode("targets").alias("at", "name"))
        found = found.groupBy("root", "name").agg(F.min(F.struct("lookup", "at")).alias("o"))
        found = found.join(seen.select("root", "name"), ["root", "name"], "left_anti")
        done = seen.groupBy("root").agg(F.max("lookup").alias("done"))
        place = F.row_number().over(Window.partitionBy("root").orderBy("o.lookup", "o.at", "name"))
        # Each level is written out, so that none makes the earlier ones run again.
        frontier = found.withColumn("p", place).join(done, "root").select("root", "name", (F.col("done") + F.col("p")).alias("lookup")).where(F.col("lookup") <= most_lookups)
        frontier = committed(frontier, "spf")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
