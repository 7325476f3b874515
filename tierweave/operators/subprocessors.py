"""Subprocessor pages: where to look for them, and what of their text names a vendor."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import fixed_values as V
from tierweave.functions import orgs as O
from tierweave.functions import suffixes
from tierweave.functions.binding import let


def page_urls(domains: DataFrame) -> DataFrame:
    """``domains(domain)`` with ``ord, url``: the addresses at which a domain may list subprocessors, most telling first.

    A name that begins with a trust center's label puts its own page first and gets no such label again.
    """
    paths = list(dict.fromkeys((*V.SUBPROCESSOR_PATHS, *(f"{s}/{p}" for s in V.SUBPROCESSOR_SECTIONS for p in V.SUBPROCESSOR_PAGES))))
    name = F.lower(F.trim("domain"))
    trust = name.rlike(rf"^(?:{'|'.join(V.TRUST_LABELS)})\.")
    at = lambda prefix, ps: [F.concat(F.lit("https://" + prefix), name, F.lit(p)) for p in ps]
    first = F.when(trust, F.array(*at("", ("/subprocessors",)))).otherwise(F.array().cast("array<string>"))
    labels = F.when(~trust, F.array(*[u for x in V.TRUST_LABELS for u in at(x + ".", ("/subprocessors", "/"))])).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(first, F.array(*at("", paths[:10])), labels, F.array(*at("", paths[10:])), F.array(*at("www.", paths))))
    return domains.select("*", F.posexplode(every).alias("ord", "url"))


def is_valid_suffix(c: Column) -> Column:
    """A top-level name that the public-suffix list holds."""
    return suffixes.is_top_level(F.lower(c))


def is_common_word(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*V.COMMON_WORDS)


def is_garbled(c: Column) -> Column:
    """Five letters or more without a vowel, or eight or more with hardly any."""

    def of(letters: Column) -> Column:
        vowels = F.length(F.regexp_replace(letters, "[^aeiouy]", ""))
        n = F.length(letters)
        return ((n >= 5) & (vowels == 0)) | ((n >= 8) & (vowels / F.nullif(n, F.lit(0)) < 0.15))

    return F.coalesce(let(F.regexp_replace(F.lower(c), "[^a-z]", ""), of), F.lit(False))


def is_valid_vendor_domain(c: Column) -> Column:
    """A host below a listed suffix whose own label has three characters or more, and that is no placeholder for a domain."""
    placeholders = [f"{x}.{y}" for x in V.PLACEHOLDER_LABELS for y in ("com", "net", "org")]

    def of(name: Column) -> Column:
        named = let(suffixes.taken(name, r"[^.]{3,}\."), lambda base: (base != "") & ~base.isin(*placeholders))
        return name.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$") & named

    return F.coalesce(let(F.lower(F.trim(c)), of), F.lit(False))


NAMES = r"(?i)(?<![a-z0-9.-])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})(?![a-z0-9-])"


def domain_in_text(c: Column) -> Column:
    """The first valid vendor's domain in a text (the host of an address or an e-mail counts), without ``www.``; null without one."""
    found = F.transform(F.regexp_extract_all(c, F.lit(NAMES), F.lit(1)), lambda d: F.regexp_replace(F.lower(d), r"^www\.", ""))
    return F.get(F.filter(found, is_valid_vendor_domain), F.lit(0))


def looks_like_vendor(c: Column) -> Column:
    """A domain together with a word that companies or their services go by."""
    return c.rlike(NAMES) & F.lower(c).rlike(r"(?<![a-z])(?:" + "|".join(V.VENDOR_WORDS) + r")(?![a-z])")


def is_false_positive(c: Column) -> Column:
    """What a name finder takes for an organization and is none: codes, field names, standards, public bodies."""

    def of(low: Column) -> Column:
        codes = (F.length(low) <= 2) | low.isin(*V.LANGUAGE_CODES) | low.rlike(r"^[a-z]{2}-[a-z]{2,4}$")
        fields = low.rlike("^[a-z0-9]+(_[a-z0-9]+)+$")
        standards = low.rlike("^(?:" + "|".join(map(re.escape, V.STANDARDS)) + r")(?:[ /-]*(?:iec)?[ -]*[0-9][0-9.:-]*)?$")
        bodies = F.regexp_replace(low, "^the ", "").isin(*V.NON_VENDORS)
        return codes | fields | standards | bodies

    return let(F.lower(F.trim(c)), of)


def is_valid_org_name(c: Column) -> Column:
    """3 to 80 characters in eight words at most, not made of several cells of a table."""
    return let(F.trim(c), lambda name: F.length(name).between(3, 80) & (F.size(F.split(O.squeeze(name), " ")) <= 8) & ~F.lower(name).rlike("|".join(V.ROW_MARKERS)))


def filter_results(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``found`` (a ``domain`` column, others stay) without what is no vendor's domain.

    ``_org:`` names get the domain of a known organization (``known(organization, domain)``, compared by normalized names); without one
    they stay only if they are a domain themselves. Names without a dot, with blanks, that are bare suffixes, under no
    listed suffix, common words or garbled go.
    """
    columns = found.columns
    rows = found.withColumn("_known", F.lit(None).cast("string"))
    if known is not None:
        org = F.regexp_extract("domain", "^_org:(.*)$", 1)
        own = known.groupBy(F.lower(O.normalize(F.col("organization"))).alias("_key")).agg(F.min("domain").alias("_known"))
        rows = found.withColumn("_key", F.when(F.col("domain").startswith("_org:"), F.lower(O.normalize(org)))).join(own, "_key", "left")
    rows = rows.withColumn("domain", F.lower(F.coalesce("_known", F.regexp_replace("domain", "^_org:", ""))))

    def keep(name: Column) -> Column:
        return name.contains(".") & ~name.rlike(r"\s") & let(suffixes.below(name), lambda own: (own != "") & ~is_common_word(own) & ~is_garbled(own))

    return rows.where(F.col("_known").isNotNull() | keep(F.col("domain"))).select(*columns)


def custom_domains(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_url, domain, at``: for ``texts(page_url, host, text)`` the domain of the rule that matches earliest.

    ``rules(host, name, domain)`` say for a host which names stand for which domains; of names at one place the longest counts.
    """
    both = texts.join(rules.select("host", "name", F.col("domain").alias("_d")), "host").withColumn("at", F.instr(F.lower("text"), F.lower("name"))).where("at > 0")
    first = both.groupBy("page_url").agg(F.min_by(F.struct("_d", "at"), F.struct("at", -F.length("name"), "name")).alias("r"))
    return first.select("page_url", F.col("r._d").alias("domain"), F.col("r.at").alias("at"))


def custom_matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_url, name``: different first groups of a host's own patterns in its pages' plain text. ``rules(host, pattern)``."""
    both = texts.join(rules, "host").select("page_url", F.explode(F.regexp_extract_all("text", F.col("pattern"), F.lit(1))).alias("name"))
    return both.select("page_url", F.trim("name").alias("name")).where(is_valid_org_name(F.col("name"))).distinct()


def skip_repeated(rows: DataFrame) -> DataFrame:
    """``rows(domain, organization, depth, seq)`` whose organization's page is still to be read.

    An organization is read at depth 1 always, deeper only the first time it is met; implausible and placeholder names say nothing.
    """
    columns = rows.columns
    named = lambda key: F.when(O.is_plausible_name(F.col("organization")) & (key != "") & ~key.isin(*V.SHARED_ORG_KEYS), key)
    marked = rows.withColumn("_key", let(F.lower(F.trim(O.normalize(F.col("organization")))), named))
    always = F.coalesce(F.col("depth") <= 1, F.lit(False))
    first = marked.where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*columns), F.struct("depth", "seq")).alias("r")).select("r.*")
    return marked.where(always | F.col("_key").isNull()).select(*columns).unionByName(first.where(~always))


def host_texts(pages: DataFrame) -> DataFrame:
    """``page_url, host, text``: the plain text of ``pages(url, html)``."""
    bare = F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    return pages.select(F.col("url").alias("page_url"), D.host_of(F.col("url")).alias("host"), F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " ")).alias("text"))
