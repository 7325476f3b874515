"""Names that stand for one organization, brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.functions import orgs as O
from tierweave.plans.graph import committed


def clusters(names: DataFrame, least: float = 0.85) -> DataFrame:
    """``name, canonical`` for every different name of ``names(name, seq)``: names that are alike get one canonical name.

    Names are taken in the order in which they were first seen. One whose normalized form is known, or ``least`` similar to that of an
    earlier canonical one, takes the earliest of these; any other becomes canonical itself. Rounds settle all
    names at once whose earlier similar ones are settled, so their number is that of the longest chain of similar names, not of the names.
    """
    own = names.where("name is not null").groupBy("name").agg(F.min("seq").alias("seq")).withColumn("form", O.normalize(F.col("name")))
    own = committed(own.withColumn("key", F.lower("form")), "cluster-names")
    keys = own.groupBy("key").agg(F.min(F.struct("seq", "name", "form")).alias("r")).select("key", F.struct("r.seq", "r.name").alias("at"), F.col("r.form").alias("form"))
    keys = committed(keys, "cluster-keys")
    close = O.similar_names(keys, "key", least).select("a", "b")
    at = lambda k, o: keys.select(F.col("key").alias(k), F.col("at").alias(o))
    both = close.join(at("a", "at_a"), "a").join(at("b", "at_b"), "b")
    later = F.col("at_a") > F.col("at_b")
    links = committed(both.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("key"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("to")), "cluster-links")
    # A name without an earlier similar one leads; what follows settles the rest.
    open_ = links.select("key").distinct()
    leads = keys.join(open_, "key", "left_anti").select("key")
    open_ = committed(open_, "cluster-open")
    while not open_.isEmpty():
        leads = committed(leads, "cluster-leads")
        led = links.join(leads.withColumnRenamed("key", "to"), "to", "left_semi").select("key").distinct()
        open_ = committed(open_.join(led, "key", "left_anti"), "cluster-open")
        waits = links.join(open_.withColumnRenamed("key", "to"), "to", "left_semi").select("key").distinct()
        new = committed(open_.join(waits, "key", "left_anti"), "cluster-new")
        leads, open_ = leads.unionByName(new), committed(open_.join(new, "key", "left_anti"), "cluster-open")
    named = keys.join(leads, "key", "left_semi").select(F.col("key").alias("to"), "at", "form")
    led = links.join(named, "to").groupBy("key").agg(F.min_by("form", "at").alias("_lead"))
    lead = keys.join(leads.withColumn("_leads", F.lit(True)), "key", "left").join(led, "key", "left").select("key", F.when(F.col("_leads"), F.col("form")).otherwise(F.col("_lead")).alias("canonical"))
    return own.join(lead, "key").select("name", "canonical")
