"""Organization names: cleaning, casing, similarity, and who stands behind them."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V
from tierweave.functions.binding import let
from tierweave.functions.domains import base_domain, registrable_label
from tierweave.functions.suffixes import is_listed, is_top_level

SPACES = r"[\s\u0085  -     　]+"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip_domain_ending(c: Column) -> Column:
    """``Acme.com`` and ``Acme.co.uk`` without what follows the name, if it is a public suffix."""

    def of(name: Column) -> Column:
        labels = F.split(name, r"\.")
        head = lambda n: F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - n, F.lit(1))), ".")
        tail = lambda n: F.lower(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))

        def cut_(one: Column) -> Column:
            fit = (F.size(labels) > 1) & ~name.rlike(r"\s") & (F.octet_length(one) >= 2) & ~one.endswith(".") & (tail(1) != "")
            compound = (F.size(labels) > 2) & (F.octet_length(head(2)) >= 2) & is_listed(tail(2))
            return F.when(~fit, name).when(compound, head(2)).when(is_top_level(tail(1)), one).otherwise(name)

        return let(head(1), cut_)

    return let(F.trim(c), of)


def strip_corporate_suffix(c: Column) -> Column:
    """Without a legal form at the end; of several, the one that comes first in the list; never the whole name."""

    def of(words: Column) -> Column:
        def shorter(bare: Column) -> Column:
            take = F.lit(0)
            for s in reversed(V.CORPORATE_SUFFIXES):
                parts = s.split(" ")
                ends = F.array_join(F.slice(bare, F.greatest(F.size(bare) - len(parts) + 1, F.lit(1)), len(parts)), " ") if len(parts) > 1 else F.element_at(bare, -1)
                take = F.when((F.size(words) > len(parts)) & (ends == s), len(parts)).otherwise(take)
            return let(take, lambda n: F.slice(words, 1, F.greatest(F.size(words) - n, F.lit(1))))

        own = let(F.transform(words, lambda w: F.lower(F.regexp_replace(w, "[.,]+$", ""))), shorter)
        return F.regexp_replace(F.array_join(own, " "), "[, ]+$", "")

    return let(F.split(squeeze(F.regexp_replace(F.trim(c), r"[, ]+$", "")), " "), of)


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "['‘’`\"“”„]", ""), "[–—]", "-")


def title_case(c: Column) -> Column:
    """All-upper and all-lower words get capitals; small words inside stay small; acronyms and mixed words stay."""

    def capitals(w: Column) -> Column:
        chars = F.filter(F.split(w, ""), lambda x: x != "")
        folded = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(True).alias("start")), lambda a, x: F.struct(F.concat(a["out"], F.when(a["start"], F.upper(x)).otherwise(F.lower(x))).alias("out"), x.isin("-", "/", "&", ".").alias("start")))
        return folded["out"]

    def word(w: Column, i: Column) -> Column:
        def cased(letters: Column) -> Column:
            upper, lower = (letters != "") & (letters == F.upper(letters)), (letters != "") & (letters == F.lower(letters))
            small, short = (i > 0) & F.lower(w).isin(*V.SMALL_WORDS), F.upper(w).isin(*V.ACRONYMS)
            return F.when(small, F.lower(w)).when(short, F.upper(w)).when(~upper & ~lower, w).when(upper & (F.length(w) == 2), w).otherwise(capitals(w))

        return let(F.regexp_replace(w, r"[^\p{L}]", ""), cased)

    return F.array_join(F.transform(F.filter(F.split(squeeze(c), " "), lambda w: w != ""), word), " ")


def lookup(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """The second text of the pair whose first one is ``c``; null without such a pair."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in dict(pairs).items() for x in kv]), c)


def brand_casing(c: Column) -> Column:
    """A known brand as it spells itself, with or without a legal form after it; null for other names."""

    def of(low: Column) -> Column:
        bare = F.rtrim(F.regexp_replace(low, r"\.+$", ""))
        for form in (", inc", " inc", " llc", " ltd", " corp", " co"):
            bare = F.regexp_replace(bare, f"(?:{form})+$", "")
        return F.coalesce(lookup(low, V.BRAND_CASING), lookup(F.trim(bare), V.BRAND_CASING))

    return let(F.lower(F.trim(c)), of)


def normalize(c: Column, aliases: tuple[tuple[str, str], ...] = V.ORG_ALIASES) -> Column:
    """The canonical name; ``aliases`` (lower-cased name, canonical one) are tried before and after, known brands' spellings last."""

    def of(name: Column) -> Column:
        first = F.regexp_replace(strip_domain_ending(name), "(?i)^the ", "")
        joined = let(first, lambda x: squeeze(F.replace(x, F.lit("&"), F.lit(" and "))))
        bare = let(joined, lambda x: strip_domain_ending(strip_corporate_suffix(x)))
        cased = let(bare, lambda x: title_case(squeeze(strip_punctuation(x))))
        known = lambda x: F.coalesce(lookup(F.lower(x), aliases), brand_casing(x), x)
        return F.when(name == "", "").otherwise(F.coalesce(lookup(F.lower(name), aliases), let(cased, lambda x: F.when(F.trim(x) == "", squeeze(name)).otherwise(known(x)))))

    return let(F.trim(c), of)


def best_match(names: DataFrame, candidates: DataFrame, least: float = 0.85) -> DataFrame:
    """``name, candidate, similarity``: of ``candidates(name)`` the one most similar to each of ``names(name)``, by normalized names.

    Of equally similar ones the first by alphabet. Names without a candidate at ``least`` or above are left out. Pairs are met by
    ``similar_names``' parts, never all with all; equal normalized names meet by themselves.
    """
    own = names.select(F.col("name").alias("_n"), normalize(F.col("name")).alias("key")).distinct()
    other = candidates.select(F.col("name").alias("_c"), normalize(F.col("name")).alias("key")).distinct()
    every = own.select("key").union(other.select("key")).distinct().withColumnRenamed("key", "name")
    close = similar_names(every, "name", least)
    pairs = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(every.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity")))
    both = own.join(pairs, own["key"] == pairs["a"]).join(other.select("_c", F.col("key").alias("_k")), F.col("b") == F.col("_k"))
    best = both.groupBy("_n").agg(F.min_by(F.struct("_c", "similarity"), F.struct(-F.col("similarity"), F.col("_c"))).alias("r"))
    return best.select(F.col("_n").alias("name"), F.col("r._c").alias("candidate"), F.col("r.similarity").alias("similarity"))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance of the lower-cased names over the longer one's bytes; equal names 1, empty ones 0."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.octet_length(x), F.octet_length(y)))


def similar_names(names: DataFrame, column: str, least: float = 0.85) -> DataFrame:
    """``a, b, similarity`` of different names (a before b) that are at least ``least`` similar.

    Pairs are met by shared parts: two names that are ``least`` similar differ in at most ``k`` edits, by the bytes of the
    one with more, so of ``k + 1`` parts of the shorter one stands unchanged in the other, shifted by ``k`` at most. Each name knows
    its own ``k`` only; so a name is cut for every larger one as well that names of a fitting length have. A name too short for
    ``k + 1`` parts is cut into characters: above 0.75, similar names share one (without any, a character
    of four bytes gives 0.75 at most). Names are joined on (length of the shorter, edits, part, text), never all with all.
    """
    if not 0.75 < least <= 1:
        raise ValueError("names that share no character may be 0.75 similar: choose a larger least similarity")
    most = lambda n: F.floor((1 - least) * n + 1e-9).cast("int")
    own = names.select(F.lower(column).alias("key"), F.col(column).alias("name")).where("name is not null").distinct()
    own = own.withColumn("len", F.length("key")).where("len > 0").withColumn("own_k", most(F.octet_length("key")))
    down_to = lambda k: F.explode(F.sequence(F.greatest(F.lit(1), F.col("len") - k), F.col("len")))
    edits = own.select(down_to(F.col("own_k")).alias("short"), F.col("own_k").alias("k")).distinct()
    n = F.least(F.col("k") + 1, F.col("short"))
    begin, end = (F.floor((F.col("i") + x) * F.col("short") / n).cast("int") for x in (0, 1))
    parts = lambda df: df.where("k >= own_k").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("at", begin).withColumn("size", end - begin)
    cuts = parts(own.withColumn("short", F.col("len")).join(edits, "short"))
    cuts = cuts.select(F.col("name").alias("a"), "short", "k", "i", F.col("key").substr(F.col("at") + 1, F.col("size")).alias("part"))
    # As the longer one, a name gives the texts at all places where such a part may stand; the shorter has four bytes a character at most.
    places = parts(own.withColumn("short", down_to(most(4 * F.col("len")))).join(edits, "short").where("len - short <= k"))
    places = places.withColumn("from", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("k")), F.col("at") + F.col("k"))))
    places = places.select(F.col("name").alias("b"), "short", "k", "i", F.col("key").substr(F.col("from") + 1, F.col("size")).alias("part")).distinct()
    pairs = cuts.join(places, ["short", "k", "i", "part"]).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("similarity", similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)


def is_plausible_name(c: Column) -> Column:
    def of(low: Column) -> Column:
        padded = F.concat(F.lit(" "), low, F.lit(" "))
        return (low != "") & (F.size(F.split(squeeze(low), " ")) < 6) & ~low.startswith("a ") & ~low.startswith("an ") & ~_any([padded.contains(m) for m in V.PHRASE_MARKERS])

    return let(F.lower(F.trim(c)), of)


def _bounded(c: Column, phrases: tuple[str, ...]) -> Column:
    return c.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, phrases)) + r")(?![\p{L}\p{N}])")


def is_redaction(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return _any([low.contains(p) for p in V.REDACTIONS]) | F.regexp_replace(low, "[., ]+$", "").rlike("(^| )owner$| registrant$")


def is_own_name(org: Column, domain: Column) -> Column:
    """The name says the domain's label: one word of it, or two or three joined."""
    words = F.split(F.regexp_replace(F.lower(F.trim(org)), r"[^\p{L}\p{N}.&-]+", " "), " ")
    words = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", "")), lambda w: (w != "") & ~w.isin(*V.LEGAL_WORDS))
    parts = F.filter(F.transform(F.flatten(F.transform(words, lambda w: F.split(w, r"\."))), lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}]", "")), lambda p: F.octet_length(p) >= 3)

    def of(label: Column, parts: Column) -> Column:
        single = F.exists(parts, lambda p: (p == label) & ~p.isin(*V.GENERIC_WORDS))
        run = lambda i, k: (F.array_join(F.slice(parts, i, k), "") == label) & (i + (k - 1) <= F.size(parts))
        joined = F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: run(i, 2) | run(i, 3))
        whole = F.regexp_replace(F.lower(F.trim(org)), r"[^\p{L}\p{N}]", "") == label
        return F.coalesce((F.octet_length(label) >= 3) & (single | joined | whole), F.lit(False))

    return let(F.element_at(F.split(base_domain(domain), r"\."), 1), lambda label: let(parts, lambda p: of(label, p)))


def role(org: Column, domain: Column | None = None) -> Column:
    """``valid``, ``privacy``, ``registrar``, ``registry``, ``address`` or ``empty``; with a domain, its own name is valid and foreign authorities are registries."""

    def plain(low: Column) -> Column:
        out = F.when(low == "", "empty")
        for kind, own in groupby(V.EXACT_GO_BETWEENS, key=lambda x: x[1]):
            out = out.when(low.isin(*(n for n, _ in own)), kind)
        for kind, own in groupby(V.PHRASE_GO_BETWEENS, key=lambda x: x[1]):
            out = out.when(_bounded(low, tuple(n for n, _ in own)), kind)
        return out.otherwise("valid")

    low = F.lower(F.trim(org))
    if domain is None:
        return let(low, plain)
    public = F.exists(F.split(F.lower(domain), r"\."), lambda x: x.isin(*V.GOVERNMENT_LABELS))
    return let(low, lambda x: F.when(is_redaction(x), "privacy").when(is_own_name(x, domain), "valid").when(_bounded(x, V.STATE_AUTHORITIES) & ~public, "registry").otherwise(plain(x)))


def is_intermediary(org: Column, domain: Column) -> Column:
    return role(org, domain) != "valid"


def domain_label(domain: Column) -> Column:
    """The name that a domain itself gives: its registrable label with a capital, else the domain."""
    return let(registrable_label(domain), lambda x: F.coalesce(F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))), domain))


def is_likely_inferred(domain: Column, org: Column) -> Column:
    """The name is the domain's first label, with or without a legal form, or the domain."""
    base, low = F.lower(F.element_at(F.split(domain, r"\."), 1)), F.lower(org)
    return (low == F.lower(domain)) | _any([low == F.concat(base, F.lit(s)) for s in V.INFERRED_SUFFIXES])


def significant_tokens(c: Column, stop: tuple[str, ...] = ("the", "and", "for", "inc", "llc", "ltd", "corp", "company", "group", "gmbh")) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (F.octet_length(t) >= 3) & ~t.isin(*stop))
