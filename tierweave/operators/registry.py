"""Facts from certificate logs, registration records, subdomain lists and tenant probes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import fixed_values as V
from tierweave.functions import orgs as O
from tierweave.functions.binding import let
from tierweave.plans.graph import told

# --- Fixed values: lines of registration records, in their order. ---
OWNER_LINES = (
    r"(?im)^\s*Registrant Organization:\s*(.+)$", r"(?im)^\s*Registrant Organisation:\s*(.+)$", r"(?im)^\s*Organization:\s*(.+)$", r"(?im)^\s*Organisation:\s*(.+)$", r"(?im)^\s*OrgName:\s*(.+)$", r"(?im)^\s*org-name:\s*(.+)$",
    r"(?im)^\s*Company:\s*(.+)$", r"(?im)^\s*Registrant Name:\s*(.+)$", r"(?im)^\s*Registrant:\s*(.+)$", r"(?im)^\s*Registrant:\s*$\r?\n\s+(\S.*)$",
)
REGISTRAR_LINES = (r"(?i)Registrar:\s*(.+)", r"(?i)Sponsoring Registrar:\s*(.+)", r"(?i)Registrar Name:\s*(.+)")
REFERRAL = r"(?im)^\s*(?:refer|registrar whois server|whois server|whois):[ \t]*(?:\w+://)?([^\s/]+)"


def certificate_vendors(entries: DataFrame) -> DataFrame:
    """``query_domain, vendor_domain, evidence``: foreign base domains in certificates, the first seen of each.

    ``entries(query_domain, ordinal, id, common_name, name_value)``; names stand one a line, the common name last. Empty names are left out.
    """
    names = F.concat(F.split(F.coalesce("name_value", F.lit("")), r"\r?\n"), F.array(F.coalesce("common_name", F.lit(""))))
    rows = entries.select("query_domain", "ordinal", "id", F.posexplode(names).alias("at", "name")).withColumn("name", F.trim(F.regexp_replace(F.trim("name"), r"^\*\.", ""))).where("name <> ''")
    rows = rows.withColumn("vendor_domain", D.base_domain(F.col("name"))).where((F.col("vendor_domain") != D.base_domain(F.col("query_domain"))) & ~D.is_certificate_infrastructure(F.col("vendor_domain")))
    first = rows.groupBy("query_domain", "vendor_domain").agg(F.min_by(F.struct("id", "name"), F.struct("ordinal", "at")).alias("r"))
    return first.select("query_domain", "vendor_domain", F.concat(F.lit("Certificate "), F.col("r.id").cast("string"), F.lit(": "), F.col("r.name")).alias("evidence"))


def first_provider(responses: DataFrame, providers: list[str], cursor: int = 0) -> DataFrame:
    """Of each domain's providers, in turn from ``cursor``, the first that answered. ``responses(query_domain, provider, ok, ...)``."""
    turn = F.array_position(F.array(*map(F.lit, providers[cursor:] + providers[:cursor])), F.col("provider"))
    best = responses.where("ok").groupBy("query_domain").agg(F.min_by("provider", turn).alias("provider"))
    return responses.join(best, ["query_domain", "provider"])


def clean_owner(c: Column) -> Column:
    return O.squeeze(F.regexp_replace(c, r"[\r\n]+", " "))


def owner(response: Column, domain: Column) -> Column:
    """The registrant: of the lines in their order, the first that is filled and no go-between."""
    tries = [clean_owner(F.regexp_extract(response, p, 1)) for p in OWNER_LINES]
    return F.get(F.filter(F.array(*tries), lambda t: (t != "") & ~O.is_intermediary(t, domain)), F.lit(0))


def registrar(response: Column) -> Column:
    tries = [clean_owner(F.regexp_extract(response, p, 1)) for p in REGISTRAR_LINES]
    return F.coalesce(*[F.when((t != "") & ~is_placeholder(t), t) for t in tries])


def is_placeholder(c: Column) -> Column:
    """Holds a text that is no owner's name, or begins with a digit as addresses do."""
    return F.lower(c).rlike("|".join(map(re.escape, V.PLACEHOLDERS)) + "|^[0-9]")


def is_redacted(response: Column) -> Column:
    tries = [F.nullif(clean_owner(F.regexp_extract(response, p, 1)), F.lit("")) for p in (*OWNER_LINES, *REGISTRAR_LINES)]
    return F.coalesce(is_placeholder(F.coalesce(*tries)), F.lit(False))


def referral(response: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(response, REFERRAL, 1)), F.lit(""))


def subdomain_vendors(found: DataFrame) -> DataFrame:
    """``target, domain, source_type, evidence``: vendors behind subdomains, from their TXT records if foreign, and from all their CNAMEs.

    ``found(target, subdomain, source, txt_vendors array<struct<domain, source_type, raw_record>>, cnames array<struct<name, base>>)``.
    """
    txt = found.select("target", "subdomain", "source", F.explode("txt_vendors").alias("v")).where(D.base_domain(F.col("v.domain")) != D.base_domain(F.col("target")))
    txt = txt.select("target", F.col("v.domain").alias("domain"), F.col("v.source_type").alias("source_type"), F.format_string("Via subdomain %s (subfinder:%s): %s", "subdomain", "source", "v.raw_record").alias("evidence"))
    cname = found.select("target", "subdomain", "source", F.explode("cnames").alias("c"))
    cname = cname.select("target", F.col("c.base").alias("domain"), F.lit("DISCOVERY::SUBFINDER").alias("source_type"), F.format_string("Subdomain %s CNAMEs to %s (subfinder:%s)", "subdomain", "c.name", "source").alias("evidence"))
    return txt.unionByName(cname)


def subdomain_counts(vendors: DataFrame) -> DataFrame:
    """Per target how many of ``subdomain_vendors``' rows came by TXT records and by CNAMEs."""
    by_cname = F.col("source_type") == "DISCOVERY::SUBFINDER"
    return vendors.groupBy("target").agg(F.count_if(~by_cname).alias("txt"), F.count_if(by_cname).alias("cname"))


def tenant_names(domain: Column) -> Column:
    base = F.lower(F.element_at(F.split(domain, r"\."), 1))
    return F.array(base, *[F.concat(base, F.lit(s)) for s in ("-inc", "inc", "-corp", "corp")])


def probe_url(pattern: Column, tenant: Column) -> Column:
    url = F.replace(pattern, F.lit("{tenant}"), tenant)
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def probes(domains: DataFrame, platforms: DataFrame) -> DataFrame:
    """Every tenant name at every pattern of every platform: the platforms are a curated table and are broadcast."""
    names = domains.select("domain", F.explode(tenant_names(F.col("domain"))).alias("tenant"))
    patterns = platforms.select(F.col("name").alias("platform"), "vendor_domain", F.explode("tenant_patterns").alias("pattern"))
    return names.join(F.broadcast(patterns)).withColumn("url", probe_url(F.col("pattern"), F.col("tenant")))


def tenant_status(status: Column, body: Column, success: Column, failure: Column) -> Column:
    """A failure mark, then the status code, then the success marks decide."""
    low = F.lower(body)
    has = lambda marks: F.exists(marks, lambda m: low.contains(F.lower(m)))
    return F.when(has(failure), "NotFound").when(status == 200, F.when(has(success), "Confirmed").when(F.size(success) == 0, "Likely").otherwise("Unknown")).when(status >= 400, "NotFound").otherwise("Unknown")


def matches_baseline(probe: DataFrame, baseline: DataFrame) -> DataFrame:
    """``probe`` with ``is_baseline``: same body, or same code and nearly the same length, or same final address as a tenant that cannot exist."""
    base = baseline.select("pattern", F.col("status").alias("_s"), F.xxhash64("body").alias("_h"), F.octet_length("body").alias("_l"), F.col("final_url").alias("_u"))
    ratio = F.octet_length("body") / F.nullif(F.col("_l"), F.lit(0))
    same = (F.xxhash64("body") == F.col("_h")) | (F.col("status") == F.col("_s")) & ratio.between(0.95, 1.05) | (F.col("final_url") == F.col("_u"))
    return probe.join(told(base), "pattern", "left").withColumn("is_baseline", F.coalesce(same, F.lit(False))).drop("_s", "_h", "_l", "_u")


def redirected_to_main_site(probe_url: Column, final_url: Column) -> Column:
    """The probe ended at a company's own site: on the same host a path became the root; else the last two labels stayed and
    nothing but ``www.`` stands before them; or a move that is known."""

    def hosts(h: Column) -> Column:
        core = lambda x: F.array_join(F.slice(F.split(x, r"\."), F.greatest(F.size(F.split(x, r"\.")) - 1, F.lit(1)), 2), ".")
        one, two = core(h["probe"]), core(h["final"])
        path = (F.length(D.path_of(probe_url)) > 1) & D.path_of(final_url).isin("/", "")
        bare = (one == two) & (F.regexp_replace(h["final"], r"^www\.", "") == one)
        moved = reduce(lambda a, b: a | b, [(one == x) & (two == y) for x, y in V.KNOWN_REDIRECTS])
        return F.when(h["probe"] == h["final"], path).otherwise(bare | moved)

    return F.coalesce(let(F.struct(D.host_of(probe_url).alias("probe"), D.host_of(final_url).alias("final")), hosts), F.lit(False))


def confirmed_tenants(results: DataFrame) -> DataFrame:
    """One row per domain and platform owner, confirmed ones before likely ones."""
    rank = F.struct(F.when(F.col("status") == "Confirmed", 0).otherwise(1), F.col("url"))
    return results.where(F.col("status").isin("Confirmed", "Likely")).groupBy("domain", "vendor_domain").agg(F.min_by(F.struct("platform", "url", "status"), rank).alias("r")).select("domain", "vendor_domain", "r.*")
