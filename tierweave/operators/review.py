"""Review decisions: validation, outcomes, overrides, audit.

``decisions(seq, type, domain, organization, source, action, signals, note, allow_infra_operator)`` with
``signals: array<struct<layer, tool, url, quote>>``; ``overrides(domain, organization, added, source)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierweave.functions import orgs as O

# --- Fixed values: layers of evidence, sources, infrastructure names. ---
LAYERS = ("web", "whois", "dns", "tls", "search", "registry", "crunchbase", "wikipedia")
MACHINE_SOURCES = ("claude_verified", "whois_verified")
INFRASTRUCTURE = ("cloudflare", "amazon", "aws", "google", "microsoft", "azure", "akamai", "fastly", "godaddy", "namecheap", "markmonitor", "gandi", "tucows")


def rank(source: Column) -> Column:
    return F.when(source == "user_confirmed", 3).when(source.isin(*MACHINE_SOURCES), 2).otherwise(1)


def naming_layers(org: Column, signals: Column, layers: tuple[str, ...] = LAYERS) -> Column:
    """In how many different layers a quote holds a significant word of the name."""
    tokens = O.significant_tokens(org)
    named = F.filter(signals, lambda s: F.lower(F.trim(s["layer"])).isin(*layers) & F.arrays_overlap(F.split(F.lower(s["quote"]), r"[^\p{L}\p{N}]+"), tokens))
    return F.size(F.array_distinct(F.transform(named, lambda s: F.lower(F.trim(s["layer"])))))


def rejection(layers: tuple[str, ...] = LAYERS) -> Column:
    """The first rule that a decision breaks; null if none."""
    quoted = F.filter("signals", lambda s: F.lower(F.trim(s["layer"])).isin(*layers) & (F.trim(s["quote"]) != ""))
    kinds = F.size(F.array_distinct(F.transform(quoted, lambda s: F.lower(F.trim(s["layer"])))))
    infra = F.exists(O.significant_tokens(F.col("organization"), ()), lambda t: t.isin(*INFRASTRUCTURE))
    return (
        F.when(F.col("type") != "domain_org", "unsupported type").when(F.trim("domain") == "", "empty domain").when(F.trim("organization") == "", "empty organization")
        .when((F.size(quoted) < 2) | (kinds < 2), "lacks provenance").when(~F.col("source").isin(*MACHINE_SOURCES), "source not permitted")
        .when(naming_layers(F.col("organization"), F.col("signals"), layers) < 2, "not corroborated").when(infra & ~F.coalesce("allow_infra_operator", F.lit(False)), "infrastructure provider")
    )


def outcomes(decisions: DataFrame, overrides: DataFrame, dry_run: bool = False) -> DataFrame:
    """``decisions`` with ``outcome`` and ``reason``.

    Decisions on a domain act one after the other: each is held against the override as the ones before left it, which
    a fold over the domain's valid decisions in their order gives.
    """
    judged = decisions.withColumn("reason", rejection()).withColumn("key", F.lower(F.trim("domain")))
    judged = judged.withColumn("ready", (F.col("action") != "abstain") & F.col("reason").isNull())
    now = overrides.select(F.lower("domain").alias("key"), F.struct(F.col("organization").alias("o"), F.col("source").alias("s")).alias("now"))
    steps = judged.where("ready").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("organization").alias("o"), F.col("source").alias("s")))).alias("steps")).join(now, "key", "left")
    kind = "struct<now:struct<o:string,s:string>,out:array<struct<seq:bigint,outcome:string>>>"
    verb = "would_write" if dry_run else "written"

    def step(a: Column, x: Column) -> Column:
        had = a["now"]
        outcome = F.when(had.isNull(), verb).when((had["o"] == x["o"]) & (had["s"] == x["s"]), "unchanged").when(rank(had["s"]) > rank(x["s"]), "skipped_precedence").otherwise(verb)
        after = F.when((outcome == verb) & F.lit(not dry_run), F.struct(x["o"].alias("o"), x["s"].alias("s"))).otherwise(had)
        return F.struct(after.alias("now"), F.concat(a["out"], F.array(F.struct(x["seq"].alias("seq"), outcome.alias("outcome")))).alias("out")).cast(kind)

    start = F.struct(F.col("now"), F.array().cast("array<struct<seq:bigint,outcome:string>>").alias("out")).cast(kind)
    done = steps.select(F.explode(F.aggregate("steps", start, step)["out"]).alias("r")).select("r.*")
    both = judged.join(done, "seq", "left")
    outcome = F.when(F.col("action") == "abstain", "abstained").when(F.col("reason").isNotNull(), "rejected").otherwise(F.col("outcome"))
    return both.withColumn("outcome", outcome).withColumn("reason", F.when(F.col("outcome") == "rejected", F.col("reason"))).drop("key", "ready")


def upsert(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """The overrides with the last of ``changes(seq, domain, organization, added, source)`` per domain put in."""
    last = changes.groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.max_by(F.struct("organization", "added", "source"), "seq").alias("r")).select("domain", "r.*")
    kept = overrides.withColumn("domain", F.lower("domain")).join(last.select("domain"), "domain", "left_anti")
    return kept.select("domain", "organization", "added", "source").unionByName(last)


def changes_of(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Of ``changes`` those that change the overrides as the ones before leave them: another organization or source. ``upsert`` takes these alone."""
    own = changes.withColumn("domain", F.lower(F.trim("domain")))
    had = overrides.select(F.lower("domain").alias("domain"), F.lit(-1).cast("long").alias("seq"), "organization", "source")
    before = F.lag(F.struct("organization", "source")).over(Window.partitionBy("domain").orderBy("seq"))
    told = had.unionByName(own.select("domain", F.col("seq").cast("long").alias("seq"), "organization", "source")).withColumn("_b", before)
    new = told.where("seq >= 0").where(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.struct("organization", "source"))).select("domain", "seq")
    return own.join(new, ["domain", "seq"], "left_semi")


def entries(overrides: DataFrame, source: str | None = None) -> DataFrame:
    """All overrides, or those of one source."""
    own = overrides.withColumn("domain", F.lower("domain"))
    return own if source is None else own.where(F.col("source") == source)


def entry(overrides: DataFrame, domain: str) -> DataFrame:
    """A domain's override, whatever its case."""
    return overrides.where(F.lower("domain") == domain.lower())


def remove(overrides: DataFrame, domains: DataFrame) -> DataFrame:
    return overrides.join(domains.select(F.lower("domain").alias("_d")), F.lower(F.col("domain")) == F.col("_d"), "left_anti")


def audit(judged: DataFrame) -> DataFrame:
    """A JSON line for each decision that was written."""
    return judged.where("outcome = 'written'").select(F.to_json(F.struct("domain", "organization", "source", "action", "signals", "note")).alias("value"))


def first_pending(pending: DataFrame) -> DataFrame:
    """Of each source, the first domain proposed for a name. ``pending(source_domain, org_name, inferred_domain, seq)``."""
    place = F.row_number().over(Window.partitionBy("source_domain", "org_name").orderBy("seq"))
    return pending.withColumn("_n", place).where("_n = 1").drop("_n")
