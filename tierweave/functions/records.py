"""Record types, report texts and other small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V


def record_types(spark: SparkSession) -> DataFrame:
    """The dimension of record types (23 rows)."""
    rows = [(*r, i) for i, r in enumerate(V.RECORD_TYPES)]
    return spark.createDataFrame(rows, "variant string, hierarchy string, label string, category string, priority int, description string, ord int")


def with_record_type(df: DataFrame, column: str = "nth_party_record_type") -> DataFrame:
    """``df`` with label, category, priority and description of its record type."""
    own = record_types(df.sparkSession).withColumnRenamed("hierarchy", column).drop("variant", "ord")
    return df.join(F.broadcast(own), column, "left")


def legacy_record_type(c: Column) -> Column:
    by = {v: h for v, h, *_ in V.RECORD_TYPES}
    out = F.lit(by["Unknown"])
    for old, variant in V.LEGACY_TYPES.items():
        out = F.when(c == old, by[variant]).otherwise(out)
    return out


def short_label(c: Column) -> Column:
    """A record type's short label, by variant or hierarchy; of unknown ones the last part."""
    by = dict(V.SHORT_LABELS)
    pairs = [(k, by[v]) for v, h, *_ in V.RECORD_TYPES for k in (v, h)]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), c), F.element_at(F.split(c, "::"), -1))


def phase_label(c: Column) -> Column:
    """What found a fact of this record type."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.PHASE_LABELS for x in kv]), c), F.lit("discovery"))


def clamp_layer(layer: Column, most: int = 6) -> Column:
    """A layer's place on a ramp of ``most`` colours."""
    whole = F.when(F.isnan(layer.cast("double")) | (F.abs(layer.cast("double")) == float("inf")), 1).otherwise(layer.cast("long"))
    return F.greatest(F.lit(1), F.least(F.coalesce(whole, F.lit(1)), F.lit(most))).cast("int")


def layer_description(layer: Column) -> Column:
    return F.when(layer == 1, "1st party").when(layer == 2, "2nd party").when(layer == 3, "3rd party").otherwise(F.concat(layer.cast("string"), F.lit("th party")))


def record_value(source_type: Column, base: Column, customer: Column, raw: Column, vendor: Column) -> Column:
    """What is reported as the record: the raw TXT record, a note for subdomains, else the vendor."""
    txt = source_type.isin("DNS::TXT::VERIFICATION", "DNS::TXT::SPF", "DNS::TXT::DMARC", "DNS::TXT::DKIM")
    return F.when(source_type == "DNS::SUBDOMAIN", F.concat(base, F.lit(" (base of "), customer, F.lit(")"))).when(txt, raw).otherwise(vendor)


def mermaid_id(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c, r"[.\-]", "_"), "[^A-Za-z0-9_]", "")
    return F.when(plain == "", "unknown").when(plain.rlike("^[0-9]"), F.concat(F.lit("n"), plain)).otherwise(plain)


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([|*_])", r"\\$1")


def backoff_delay(attempt: Column, base: Column, most: Column, exponential: bool) -> Column:
    grown = base * F.pow(F.lit(2.0), attempt) if exponential else base * (attempt + 1)
    return F.least(grown.cast("long"), most)


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes of UTF-8."""
    chars = F.split(F.substring(c, 1, most), "")
    taken = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), lambda a, x: F.when((a["n"] >= 0) & (a["n"] + F.octet_length(x) <= most), F.struct(F.concat(a["out"], x).alias("out"), (a["n"] + F.octet_length(x)).alias("n"))).otherwise(F.struct(a["out"].alias("out"), F.lit(-1).alias("n"))))
    return F.when(F.octet_length(c) <= most, c).otherwise(taken["out"])


def format_timestamp(seconds: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
