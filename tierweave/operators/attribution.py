"""Who owns a domain: a cascade of curated tables, then of what observations say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import fixed_values as V
from tierweave.functions import orgs as O
from tierweave.operators.registry import is_redacted, owner
from tierweave.operators.web import page_organization
from tierweave.plans.graph import committed

def curated(domains: DataFrame, tiers: list[tuple[str, DataFrame]], base_tiers: tuple[str, ...] = ()) -> DataFrame:
    """``domains`` with ``organization`` and ``tier``: the first tier that knows the domain, then the first that knows its base domain.

    ``tiers`` are (name, table of ``domain, organization``), best first. ``base_tiers`` names those that are asked for base domains; all
    of them if empty. Of repeated domains in a tier the first organization by name counts. Each tier is joined as Spark
    sees fit: small tables by broadcast, large ones by shuffle.
    """
    out = domains.withColumn("_base", D.base_domain(F.col("domain"))).withColumn("_domain", F.lower("domain"))
    picks = []
    for on in ("_domain", "_base"):
        for name, table in tiers:
            if on == "_base" and base_tiers and name not in base_tiers:
                continue
            col = f"_{name}{on}"
            own = table.groupBy(F.lower("domain").alias(on)).agg(F.min("organization").alias(col))
            out = out.join(own, on, "left")
            picks.append(F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("organization"), F.lit(name).alias("tier"))))
    best = F.coalesce(*picks)
    return out.withColumn("_best", best).select(*domains.columns, F.col("_best.organization").alias("organization"), F.col("_best.tier").alias("tier"))


def resolve_curated(domains: DataFrame, known: list[tuple[str, DataFrame]], dataset: DataFrame | None = None) -> DataFrame:
    """``domains`` with ``organization`` and ``tier``, by what needs no observation.

    In this order: the tables of known vendors (overrides first, the registry last), corrections of
    rollups that went stale, a dataset of domain owners, and the owner of a brand suffix.
    """
    first = curated(domains, known)
    base, suffix = D.base_domain(F.col("domain")), D.registry_suffix(F.col("domain"))
    first = first.withColumn("_fix", O.lookup(base, V.STALE_ROLLUPS)).withColumn("_brand", O.lookup(suffix, V.BRAND_SUFFIXES)).withColumn("_data", F.lit(None).cast("string"))
    if dataset is not None:
        own = curated(domains.select("domain").distinct(), [("dataset", dataset)]).select("domain", F.col("organization").alias("_data"))
        first = first.drop("_data").join(own, "domain", "left")
    tries = (("organization", F.col("tier")), ("_fix", F.lit("curated_correction")), ("_data", F.lit("embedded_dataset")), ("_brand", F.lit("brand_tld")))
    best = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("organization"), t.alias("tier"))) for c, t in tries])
    return first.withColumn("_best", best).select(*domains.columns, F.col("_best.organization").alias("organization"), F.col("_best.tier").alias("tier"))


def attribute(domains: DataFrame, tiers: list[tuple[str, DataFrame]], pages: DataFrame | None = None, whois: DataFrame | None = None, least: float = 0.6, dataset: DataFrame | None = None) -> DataFrame:
    """``domain, organization, source, is_verified`` for each different domain.

    Curated tables first; what they leave open is looked up in the page (if its confidence is ``least`` or more
    and the name acceptable), then in the registration record unless that is redacted, then told by the domain's label.
    Only the open domains reach the pages and records.
    """
    first = committed(resolve_curated(domains.select("domain").where("domain is not null").distinct(), tiers, dataset), "curated")
    done = first.where("organization is not null").select("domain", "organization", F.col("tier").alias("source"), F.lit(True).alias("is_verified"))
    rest = first.where("organization is null").select("domain")
    rest = rest.withColumn("web", F.lit(None).cast("string"))
    if pages is not None:
        own = pages.select(D.host_of(F.col("url")).alias("domain"), page_organization(F.col("html")).alias("p")).where(F.col("p.confidence") >= F.lit(least).cast("float"))
        own = own.where(acceptable(F.col("p.organization"), F.col("domain"))).groupBy("domain").agg(F.max_by("p.organization", F.struct("p.confidence", "p.organization")).alias("web"))
        rest = rest.drop("web").join(own, "domain", "left")
    rest = rest.withColumn("record", F.lit(None).cast("string"))
    if whois is not None:
        own = whois.where(~is_redacted(F.col("response"))).select("domain", owner(F.col("response"), F.col("domain")).alias("record")).where("record is not null").groupBy("domain").agg(F.min("record").alias("record"))
        rest = rest.drop("record").join(own, "domain", "left")
    best = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("organization"), F.lit(s).alias("source"))) for c, s in ((F.col("web"), "web"), (F.col("record"), "registration"), (O.domain_label(F.col("domain")), "label"))])
    return done.unionByName(rest.select("domain", best.alias("b")).select("domain", "b.organization", "b.source", F.lit(False).alias("is_verified")))


def is_interstitial(name: Column) -> Column:
    """A page that stands before a site, or a registry's prose."""
    return F.lower(name).rlike("|".join(map(re.escape, V.INTERSTITIALS)))


def acceptable(name: Column, domain: Column) -> Column:
    """A name from a page may stand: filled, no waiting page, plausible, no go-between."""
    return (F.trim(name) != "") & ~is_interstitial(name) & O.is_plausible_name(name) & ~O.is_intermediary(name, domain)


def with_organizations(facts: DataFrame, names: DataFrame) -> DataFrame:
    """``facts(customer, vendor)`` with both organizations; a domain without one stands for itself."""
    for side in ("vendor", "customer"):
        own = names.select(F.col("domain").alias(side), F.col("organization").alias(f"{side}_organization"))
        facts = facts.join(own, side, "left").withColumn(f"{side}_organization", F.coalesce(f"{side}_organization", side))
    return facts


def unverified(rel: DataFrame, known: DataFrame) -> DataFrame:
    """``domain, organization`` that no curated table knows and that look as if made from the domain."""
    pairs = rel.select(F.col("nth_party_domain").alias("domain"), F.col("nth_party_organization").alias("organization")).distinct()
    own = known.select(F.lower("domain").alias("domain")).distinct()
    return pairs.join(own, F.lower(pairs["domain"]) == own["domain"], "left_anti").where(O.is_likely_inferred(F.col("domain"), F.col("organization")))
