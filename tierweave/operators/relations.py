"""Relationship tables: deduplication, filters, reconciliation, summaries.

A relationship row has ``nth_party_domain, nth_party_organization, nth_party_layer,
nth_party_customer_domain, nth_party_customer_organization, nth_party_record, nth_party_record_type,
root_customer_domain, root_customer_organization, evidence`` and ``seq``, the order in which it was seen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import orgs as O
from tierweave.operators.ranks import ranked_within
from tierweave.plans.graph import committed, told

SCHEMA = """nth_party_domain string, nth_party_organization string, nth_party_layer int, nth_party_customer_domain string, nth_party_customer_organization string,
 nth_party_record string, nth_party_record_type string, root_customer_domain string, root_customer_organization string, evidence string, seq bigint"""
DISCLOSED = ("HTTP::SUBPROCESSOR", "TRUST_CENTER::API")
WEB_TRAFFIC = ("DISCOVERY::WEBPAGE_SOURCE", "DISCOVERY::WEBPAGE_NETWORK")


def strip_org_prefix(rel: DataFrame) -> DataFrame:
    """Without a leaked ``_org:`` before vendor domains and names."""
    clean = lambda c: F.regexp_replace(c, "^_org:", "")
    return rel.withColumns({c: clean(F.col(c)) for c in ("nth_party_domain", "nth_party_organization")})


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_facts(facts: DataFrame, order: str = "seq") -> DataFrame:
    """Vendor facts before resolution: one per base domain, source type and raw record, the first seen."""
    return first_seen(facts.withColumn("base_domain", D.base_domain(F.col("domain"))), ["base_domain", "source_type", "raw_record"], [order])


def fold_evidence(parts: Column) -> Column:
    """Texts joined in order, each unless what is joined so far holds it already."""
    return F.aggregate(parts, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit(" | "), x)))


def dedup_relationships(rel: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """One row per vendor, customer and record type (and ``per``): the first seen, with all evidence folded in.

    Rows with equal key and evidence are reduced to their first before evidence is gathered, so
    what a group gathers is its different texts. Rows are dealt by the key, which serves both steps: whole rows are shuffled once.
    """
    keys = [*per, "nth_party_domain", "nth_party_customer_domain", "nth_party_record_type"]
    others = [c for c in rel.columns if c not in (*keys, "evidence")]
    once = rel.repartition(*keys).groupBy(*keys, "evidence").agg(F.min_by(F.struct(*others), "seq").alias("row"), F.min("seq").alias("_seq"))
    got = once.groupBy(*keys).agg(F.min_by("row", "_seq").alias("row"), F.array_sort(F.collect_list(F.struct("_seq", "evidence"))).alias("parts"))
    return got.select(*keys, "row.*", fold_evidence(F.col("parts.evidence")).alias("evidence")).select(*rel.columns)


def drop_unregistrable(rel: DataFrame) -> DataFrame:
    """Without rows whose vendor, or whose non-empty customer other than the root, is no public host.

    Each different host is judged once, and the rows are joined with those that fail. Hosts are written out first, for Spark would
    judge them before it makes them distinct, a host as often as it stands in a row.
    """
    vendor, customer = F.col("nth_party_domain"), F.col("nth_party_customer_domain")
    hosts = committed(rel.select(F.explode(F.array(vendor, customer)).alias("host")).distinct(), "hosts")
    bad = committed(hosts.where(D.is_non_registrable(F.col("host"))), "unregistrable")
    rel = rel.where(vendor.isNotNull()).join(bad.withColumnRenamed("host", "nth_party_domain"), "nth_party_domain", "left_anti")
    own = bad.select(F.col("host").alias("_h"))
    failed = (customer == F.col("_h")) & (customer != "") & ~F.coalesce(customer == F.col("root_customer_domain"), F.lit(False))
    return rel.join(own, failed, "left_anti")


def drop_infrastructure(rel: DataFrame, include: bool = False) -> DataFrame:
    """Without common infrastructure, unless it is disclosed as a subprocessor."""
    return rel if include else rel.where(F.col("nth_party_record_type").isin(*DISCLOSED) | ~D.is_common_infrastructure(F.col("nth_party_domain")))


def drop_marketing(rel: DataFrame) -> DataFrame:
    """Without marketing domains that only web traffic shows."""
    return rel.where(~(D.is_marketing(F.col("nth_party_domain")) & F.col("nth_party_record_type").isin(*WEB_TRAFFIC)))


def drop_self_references(rel: DataFrame) -> DataFrame:
    return rel.where(~D.same_organization(F.col("nth_party_domain"), F.col("nth_party_customer_domain")))


POSITIONS = (("nth_party_domain", "nth_party_organization"), ("nth_party_customer_domain", "nth_party_customer_organization"), ("root_customer_domain", "root_customer_organization"))


NAMED = "trim(domain) <> '' and trim(organization) <> ''"


def _pairs(rel: DataFrame) -> DataFrame:
    """``domain, organization, at`` for each position of each row; ``at`` has the position's bit."""
    pairs = F.explode(F.array(*[F.struct(F.col(d).alias("domain"), F.col(o).alias("organization"), F.lit(1 << i).alias("at")) for i, (d, o) in enumerate(POSITIONS)])).alias("p")
    return rel.select(pairs).select("p.*")


def named_domains(rel: DataFrame) -> DataFrame:
    """``domain, organization, n``: how often each name stands at a domain, over the three positions."""
    return _pairs(rel).where(NAMED).groupBy("domain", "organization").agg(F.count("*").alias("n"))


def different_pairs(rel: DataFrame) -> DataFrame:
    """``domain, organization, n, at``: every different pair, named or not, in a table of its own; ``at`` has the bits of the positions at which it stands."""
    return committed(_pairs(rel).groupBy("domain", "organization").agg(F.count("*").alias("n"), F.bit_or("at").alias("at")), "pairs")


def judged_names(pairs: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """``domain, organization, n, at, label, bad, fit, curated``: those of ``different_pairs`` that have a name, judged once, in a table of its own.

    ``bad`` names are go-betweens, ``fit`` ones plausible; ``curated`` is the domain's name in ``curated(domain, organization)``
    (whatever its case), if it has one.
    """
    domain, name = F.col("domain"), F.col("organization")
    judged = committed(pairs.where(NAMED).withColumns({"label": O.domain_label(domain), "bad": O.is_intermediary(name, domain), "fit": O.is_plausible_name(name)}), "judged")
    if curated is None:
        return judged.withColumn("curated", F.lit(None).cast("string"))
    own = curated.groupBy(F.lower("domain").alias("domain")).agg(F.min("organization").alias("curated"))
    return judged.join(own, "domain", "left")


def _renamed(rel: DataFrame, names: DataFrame) -> DataFrame:
    """``rel`` with the new names of ``names(domain, organization, at, _name)`` at all three positions.

    A position gets the names of the pairs that stand there. Few are sent to every task; many meet the rows by a shuffle and
    a hash table of the names, which have a row a pair.
    """
    columns = rel.columns
    for i, (d, o) in enumerate(POSITIONS):
        here = names.where(F.col("at").bitwiseAND(1 << i) != 0).select(F.col("domain").alias("_d"), F.col("organization").alias("_o"), "_name")
        own = (F.col(d) == F.col("_d")) & F.col(o).eqNullSafe(F.col("_o"))
        rel = rel.join(told(here, "shuffle_hash"), own, "left").withColumn(o, F.coalesce("_name", o)).drop("_d", "_o", "_name")
    return rel.select(*columns)


def reconcile_names(rel: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """One name per domain at all positions.

    A curated name wins; else of the plausible names that are neither a go-between nor the domain's own
    label, the most frequent, then the longest in bytes, then the first by alphabet; else the label.
    Rows are joined with the names that give way only, so that a position where none does costs no shuffle of the rows.
    """
    pairs = different_pairs(rel)
    judged = judged_names(pairs, curated)
    best = first_seen(judged.where("fit and not bad and organization <> label"), ["domain"], [F.desc("n"), F.desc(F.octet_length("organization")), "organization"])
    names = judged.groupBy("domain").agg(F.first("label").alias("label"), F.first("curated").alias("curated")).join(best.select("domain", F.col("organization").alias("voted")), "domain", "left")
    names = names.select("domain", F.coalesce("curated", "voted", "label").alias("_name"))
    return _renamed(rel, committed(pairs.join(names, "domain").where(~F.col("organization").eqNullSafe(F.col("_name"))), "names"))


def gate_intermediaries(rel: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Names of registrars, privacy services and authorities give way to the domain's label, unless curated."""
    bad = judged_names(different_pairs(rel), curated).where(F.col("bad") & ~F.col("organization").eqNullSafe(F.col("curated")))
    return _renamed(rel, committed(bad.select("domain", "organization", "at", F.col("label").alias("_name")), "gated"))


def finalize(rel: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """Reject, gate, reconcile, in this order.

    Reconciling rewrites all positions, so gating only has to leave go-betweens out of the vote, which it does by itself.
    """
    columns = rel.columns
    rel = committed(rel, "relationships", freed=True)  # read several times from here on
    return reconcile_names(drop_unregistrable(rel).select(*columns), curated)


def assemble(new: DataFrame, resumed: DataFrame | None = None, curated: DataFrame | None = None, include_infrastructure: bool = False) -> DataFrame:
    """The report's rows: resumed ones first, deduplicated, filtered, finalized.

    With resumed rows ``seq`` is a decimal; new ones get more than any number of a resumed run, which may be beyond a BIGINT.
    """
    rel = new
    if resumed is not None:
        rel = resumed.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)))
        rel = rel.withColumn("seq", F.when(F.col("_run") == 1, F.lit(Decimal(10**30))).otherwise(F.lit(Decimal(0))) + F.col("seq").cast("decimal(38,0)")).drop("_run")
    return finalize(drop_marketing(drop_infrastructure(dedup_relationships(rel), include_infrastructure)), curated)


def summary(rel: DataFrame) -> DataFrame:
    return rel.agg(
        F.count("*").alias("total_relationships"), F.coalesce(F.max("nth_party_layer"), F.lit(0)).alias("max_depth"),
        F.count_distinct("nth_party_domain").alias("unique_domains"), F.count_distinct("nth_party_organization").alias("unique_organizations"),
    )


def by_layer(rel: DataFrame) -> DataFrame:
    return rel.where("nth_party_layer >= 1").groupBy(F.col("nth_party_layer").alias("layer")).agg(F.count("*").alias("n"))


def by_type(rel: DataFrame) -> DataFrame:
    return rel.groupBy(F.col("nth_party_record_type").alias("record_type")).agg(F.count("*").alias("n"))


def unique_organizations(rel: DataFrame) -> DataFrame:
    return rel.select(F.col("nth_party_organization").alias("organization")).distinct()


def common_denominators(rel: DataFrame) -> DataFrame:
    """Organizations at the two deepest layers."""
    top = rel.agg(F.greatest(F.coalesce(F.max("nth_party_layer"), F.lit(0)) - 1, F.lit(0)).alias("least"))
    return rel.join(F.broadcast(top), F.col("nth_party_layer") >= F.col("least")).select(F.col("nth_party_organization").alias("organization")).distinct()


def at_layer(rel: DataFrame, layer: int) -> DataFrame:
    return rel.where(F.col("nth_party_layer") == layer)


def limit_per_customer(rel: DataFrame, limits: list[int]) -> DataFrame:
    """The first ``limits[depth]`` vendors of a customer at each depth; 0 and missing entries set no limit."""
    place = F.row_number().over(Window.partitionBy("root_customer_domain", "nth_party_customer_domain", "nth_party_layer").orderBy("seq"))
    own = F.coalesce(F.get(F.array(*map(F.lit, limits)), F.col("nth_party_layer")), F.lit(0)) if limits else F.lit(0)
    return rel.withColumn("_n", place).where((own == 0) | (F.col("_n") <= own)).drop("_n")


def vendors(rel: DataFrame) -> DataFrame:
    """Per vendor: smallest layer, layers, number of discoveries, sources and the last name that says more than the domain."""
    trivial = F.col("nth_party_organization").isNull() | (F.trim("nth_party_organization") == "") | (F.lower("nth_party_organization") == F.lower("nth_party_domain"))
    return rel.groupBy(F.col("nth_party_domain").alias("domain")).agg(
        F.min("nth_party_layer").alias("layer"), F.sort_array(F.collect_set("nth_party_layer")).alias("layers"), F.count("*").alias("discoveries"),
        F.sort_array(F.collect_set(F.struct(F.col("nth_party_record_type").alias("type"), F.col("nth_party_customer_domain").alias("customer")))).alias("sources"),
        F.max_by(F.when(~trivial, F.col("nth_party_organization")), F.when(~trivial, F.col("seq"))).alias("organization"),
    )


def children(rel: DataFrame) -> DataFrame:
    return rel.groupBy(F.col("nth_party_customer_domain").alias("domain")).agg(F.sort_array(F.collect_set("nth_party_domain")).alias("children"))


def edges(rel: DataFrame) -> DataFrame:
    """Different (customer, vendor) pairs with their number of records."""
    return rel.groupBy(F.col("nth_party_customer_domain").alias("customer"), F.col("nth_party_domain").alias("vendor")).agg(F.count("*").alias("n"), F.min("nth_party_layer").alias("layer"))


def active_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``domain, layers``: for each of ``nodes(domain, layer)`` the layers at which visible edges reach it, one below their sources;
    its own layer where none does. ``edges(customer, vendor, hidden)``."""
    seen = edges.where(~F.coalesce("hidden", F.lit(False))).join(nodes.select(F.col("domain").alias("customer"), F.col("layer").alias("_l")), "customer")
    reached = seen.groupBy(F.col("vendor").alias("domain")).agg(F.sort_array(F.collect_set((F.coalesce("_l", F.lit(0)) + 1).cast("int"))).alias("layers"))
    return nodes.join(reached, "domain", "left").select("domain", F.coalesce("layers", F.array(F.col("layer").cast("int"))).alias("layers"))


def pages_of_children(rel: DataFrame, size: int = 8) -> DataFrame:
    """Each customer's vendors in order, with the page of ``size`` that they stand on."""
    own = rel.groupBy(F.col("nth_party_customer_domain").alias("customer"), F.col("nth_party_domain").alias("vendor")).agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("customer").orderBy("seq", "vendor")) - 1
    return own.select("customer", "vendor", F.floor(place / size).cast("int").alias("page"))


def grid(rel: DataFrame, columns: int = 10) -> DataFrame:
    """A layered grid: per vendor its layer, and its row and column within it, in alphabetical order."""
    own = rel.groupBy(F.col("nth_party_domain").alias("domain")).agg(F.min("nth_party_layer").alias("layer"))
    place = F.col("place")
    return ranked_within(own, "layer", ["domain"], "place").select("domain", "layer", F.floor(place / columns).cast("int").alias("row"), (place % columns).alias("col"))


def layout(rel: DataFrame, root: str, columns: int = 10) -> DataFrame:
    """``domain, layer, row, col, x``: the grid below ``root`` with children near their parents.

    Layer by layer, vendors whose parent has a place come first, by the parent's ``x`` (parents at one place: the first seen child
    first), then by name; the others follow by name. Of several parents the one seen last as a customer counts. A row's places
    are centred: ``x`` counts half places from the middle. A layer is one job, and its places are written out.
    """
    own = rel.where(F.col("nth_party_domain") != root).groupBy(F.col("nth_party_domain").alias("domain")).agg(F.min("nth_party_layer").alias("layer"), F.min("seq").alias("seq"))
    told = rel.groupBy(F.col("nth_party_customer_domain").alias("parent")).agg(F.min("seq").alias("first"))
    pairs = rel.select(F.col("nth_party_domain").alias("domain"), F.col("nth_party_customer_domain").alias("parent")).distinct()
    parent = pairs.join(told, "parent").groupBy("domain").agg(F.max_by("parent", F.struct("first", "parent")).alias("parent"))
    own = committed(own.join(parent, "domain", "left"), "layout-vendors")
    spark = rel.sparkSession
    places = spark.createDataFrame([(root, 0, 0, 0, 0)], "domain string, layer int, row int, col int, x int")
    for (layer,) in sorted(own.select("layer").distinct().collect()):  # a row a layer
        rows = own.where(F.col("layer") == layer).join(places.select(F.col("domain").alias("parent"), F.col("x").alias("_x")), "parent", "left")
        group = rows.where("_x is not null").groupBy("parent").agg(F.min("seq").alias("_group"))
        rows = rows.join(group, "parent", "left")
        order = [F.col("_x").asc_nulls_last(), F.col("_group").asc_nulls_last(), "domain"]
        put = ranked_within(rows, "layer", order, "place").select(
            "domain", F.col("layer").cast("int").alias("layer"), F.floor(F.col("place") / columns).cast("int").alias("row"), (F.col("place") % columns).cast("int").alias("col"), F.col("place_of").alias("_n"),
        )
        in_row = F.least(F.lit(columns), F.col("_n") - F.col("row") * columns)
        places = places.unionByName(committed(put.withColumn("x", (2 * F.col("col") - (in_row - 1)).cast("int")).drop("_n"), "layout"))
    return places


def total_vendors(*tiers: DataFrame) -> DataFrame:
    """Different domains over all tiers of known vendors, whatever their case."""
    all_ = tiers[0].select(F.lower("domain").alias("domain"))
    for t in tiers[1:]:
        all_ = all_.unionByName(t.select(F.lower("domain").alias("domain")))
    return all_.agg(F.count_distinct("domain").alias("total_unique"))


def coverage(events: DataFrame) -> DataFrame:
    """Per phase: found and failed, and whether it is degraded. ``events(phase, found, failed)``."""
    own = events.groupBy("phase").agg(F.sum("found").alias("found"), F.sum("failed").alias("failed"))
    return own.withColumn("degraded", F.col("failed") > 0)


#: Phases of a scan with what their failures are called, in the order of a report; fixed.
DEGRADED = (
    ("subprocessor", "subprocessor failed on {} domain(s)"), ("webtraffic", "web-traffic capture failed on {} domain(s)"), ("subfinder", "subdomain discovery failed on {} domain(s)"), ("saas", "SaaS-tenant discovery failed on {} domain(s)"), ("ct", "CT-log discovery failed on {} domain(s)"),
)


def degradation(covered: DataFrame, failures: DataFrame) -> DataFrame:
    """``text, advice`` in one row: how a scan's coverage was degraded; ``text`` is null for a clean one.

    ``covered`` is ``coverage``'s; ``failures(starved, dns_failures, dns_name_failures)`` has one row. Vendors that were starved stand for the subprocessor
    phase's failures; of failed lookups those that are the names' own fault are told apart, for another network would not help.
    """
    of = {phase: F.max(F.when(F.col("phase") == phase, F.struct("failed", "degraded"))).alias(phase) for phase, _ in DEGRADED}
    row = covered.agg(*of.values()).join(F.broadcast(failures.limit(1)), F.lit(True))
    say = lambda template, n: F.concat(F.lit(template.split("{}")[0]), n.cast("string"), F.lit(template.split("{}")[1]))
    parts = [F.when(F.col(p)["degraded"], say(t, F.col(p)["failed"])) for p, t in DEGRADED]
    parts[0] = F.when(F.col("starved") > 0, say("subprocessor starved on {} vendor(s)", F.col("starved"))).otherwise(parts[0])
    link = F.greatest(F.col("dns_failures") - F.col("dns_name_failures"), F.lit(0))
    parts += [F.when(link > 0, say("DNS degraded on {} lookup(s)", link)), F.when(F.col("dns_name_failures") > 0, say("{} name(s) failed at their own authoritative DNS (not a local network fault)", F.col("dns_name_failures")))]
    advice = F.when(F.col("dns_failures") > F.col("dns_name_failures"), "re-run on a stable network").otherwise("see the coverage")
    return row.select(F.nullif(F.concat_ws("; ", *parts), F.lit("")).alias("text"), advice.alias("advice"))


def feature_status(dns_only: Column, enable: Column, disable: Column, default: Column, flag: Column) -> Column:
    """struct<enabled, reason> of a feature: a scan of records alone has none, a flag goes before the default."""
    reason = F.when(dns_only, "disabled (--dns-only mode)").when(enable, F.concat(F.lit("enabled via "), flag)).when(disable, "disabled via flag").when(default, "on by default").otherwise(F.concat(F.lit("disabled (default — enable with "), flag, F.lit(")")))
    return F.struct((~dns_only & (enable | (~disable & default))).alias("enabled"), reason.alias("reason"))


def manifest(features: DataFrame, covered: DataFrame) -> DataFrame:
    """``ord, line``: for each of ``features(ord, name, phase, enabled, reason)`` why it was on or off, and what its phase found and failed at."""
    both = features.join(covered, "phase", "left")
    counts = F.concat(F.lit(" — "), F.coalesce("found", F.lit(0)).cast("string"), F.lit(" found, "), F.coalesce("failed", F.lit(0)).cast("string"), F.lit(" failed"), F.when(F.col("degraded"), "  ⚠ degraded").otherwise(""))
    line = F.concat(F.rpad("name", 13, " "), F.lit(" "), "reason", F.when(F.col("enabled") & F.col("phase").isNotNull(), counts).otherwise(""))
    return both.select("ord", line.alias("line"))


def timings(events: DataFrame) -> DataFrame:
    """Per name: count, total, mean and share of the total. ``events(name, seconds)``."""
    own = events.groupBy("name").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))
    whole = own.agg(F.sum("total").alias("_all"))
    return own.join(F.broadcast(whole)).select("name", "n", "total", "mean", (F.col("total") / F.nullif(F.col("_all"), F.lit(0.0))).alias("share"))


def by_depth(events: DataFrame) -> DataFrame:
    """Per name and depth bucket (0 to 3, deeper ones together): count, total, and whether it bounds the whole run.

    ``events(name, depth, seconds, critical)``: of the names on the critical path the longest per bucket bounds it.
    """
    own = events.groupBy("name", F.least(F.col("depth"), F.lit(4)).alias("bucket")).agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.bool_or("critical").alias("critical"))
    longest = own.where("critical").groupBy("bucket").agg(F.max("total").alias("_most"))
    return own.join(longest, "bucket", "left").select("name", "bucket", "n", "total", (F.col("critical") & (F.col("total") == F.col("_most"))).alias("bounds"))


def latency_gradient(values: DataFrame, key: str, order: str, value: str, short: float, long: float) -> DataFrame:
    """``key, gradient``: of each key's values in order the ratio of the slow mean to the fast one, within 0.5 and 1."""
    fast, slow = smoothed(values, key, order, value, short).withColumnRenamed("mean", "_f"), smoothed(values, key, order, value, long).withColumnRenamed("mean", "_s")
    return fast.join(slow, key).select(key, F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.col("_s") / F.nullif(F.col("_f"), F.lit(0.0)))).alias("gradient"))


def smoothed(values: DataFrame, key: str, order: str, value: str, weight: float) -> DataFrame:
    """The exponentially weighted mean of each key's values in their order."""
    parts = values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v"))
    return parts.select(key, F.aggregate(F.col(f"v.{value}"), F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x.cast("double")).otherwise(a * (1 - weight) + x * weight)).alias("mean"))
