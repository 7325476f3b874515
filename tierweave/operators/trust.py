"""Subprocessor lists in captured JSON and on subprocessor pages.

``captures(page_url, ordinal, url, body)`` are JSON responses. Arrays of objects are found at any
depth, scored, and the best of a page is taken with all arrays of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions.binding import let
from tierweave.plans.graph import told

# --- Fixed values: field names by meaning, in their order, and path words. ---
NAME_FIELDS = ("name", "companyName", "company_name", "vendor_name", "vendorName", "organization", "entity", "entityName", "entity_name", "company.name")
URL_FIELDS = ("url", "website", "domain", "link", "href", "websiteUrl", "website_url", "company.domain")
PURPOSE_FIELDS = ("purpose", "service", "description", "category", "type", "serviceDescription", "service_description")
LOCATION_FIELDS = ("location", "country", "region", "geography")
PATH_WORDS = ("subprocessor", "vendor", "processor", "provider", "supplier", "partner")


def _arrays(data: object) -> Iterator[tuple[str, list]]:
    """The arrays below objects, with their dotted paths; what lies inside an array is not looked into."""
    todo: list[tuple[str, object]] = [("", data)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in sorted(x.items(), reverse=True)]
        elif isinstance(x, list):
            yield path, x


def entity_arrays(captures: DataFrame) -> DataFrame:
    """``page_url, ordinal, path, items``: arrays of three or more members, over four fifths of them objects, below objects at any depth.

    Objects nest at will, so each body is walked by an Arrow function, which gives the arrays' members as JSON texts. A null
    body, or one that is no JSON, gives nothing.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, ordinal, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    data = json.loads(body) if body is not None else None
                except (ValueError, RecursionError):
                    continue
                for path, x in _arrays(data):
                    if len(x) >= 3 and sum(isinstance(i, dict) for i in x) / len(x) > 0.8:
                        rows.append((page, ordinal, path, [json.dumps(i, ensure_ascii=False, separators=(",", ":")) for i in x]))
            own = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.string()), pa.array(own[1], pa.int64()), pa.array(own[2], pa.string()), pa.array(own[3], pa.list_(pa.string()))], ["page_url", "ordinal", "path", "items"])

    own = captures.select(F.col("page_url").cast("string"), F.col("ordinal").cast("long"), F.col("body").cast("string"))
    return own.where(F.contains("body", F.lit("["))).mapInArrow(walk, "page_url string, ordinal long, path string, items array<string>")


ITEM = ", ".join(f"{f} string" for f in dict.fromkeys((*NAME_FIELDS, *URL_FIELDS, *PURPOSE_FIELDS, *LOCATION_FIELDS)) if "." not in f) + ", company struct<name: string, domain: string>"


def _read(items: Column) -> Column:
    """Members as structs of the fields that mean something, each parsed once."""
    return F.transform(items, lambda i: F.from_json(i, ITEM))


def _field(item: Column, field: str) -> Column:
    return F.nullif(reduce(lambda x, f: x[f], field.split("."), item), F.lit(""))


def _some(sample: Column, fields: tuple[str, ...]) -> Column:
    return F.exists(sample, lambda i: F.coalesce(*[_field(i, f) for f in fields]).isNotNull())


def score(items: Column, path: Column) -> Column:
    """How much an array looks like a list of subprocessors, 1 at most."""
    part = lambda test, v: F.when(test, v).otherwise(0.0)
    n = F.size(items)

    def of(sample: Column) -> Column:
        told = F.lower(path).rlike("|".join(PATH_WORDS))
        total = (
            part(n >= 5, 0.15) + part(n >= 10, 0.10) + part(told, 0.25)
            + part(_some(sample, NAME_FIELDS), 0.25) + part(_some(sample, URL_FIELDS), 0.15) + part(_some(sample, PURPOSE_FIELDS), 0.05) + part(_some(sample, LOCATION_FIELDS), 0.05)
        )
        return F.when(n > 0, F.least(total, F.lit(1.0))).otherwise(0.0)

    return let(_read(F.slice(items, 1, 5)), of)


def field_of(items: Column, fields: tuple[str, ...]) -> Column:
    """The first field that is filled in more than half of the first five members."""
    return let(_read(F.slice(items, 1, 5)), lambda sample: F.coalesce(*[_filled(sample, name) for name in fields]))


def _filled(sample: Column, name: str) -> Column:
    return F.when(F.size(F.filter(sample, lambda i: _field(i, name).isNotNull())) > 0.5 * F.size(sample), name)


def _by(item: Column, field: Column, fields: tuple[str, ...]) -> Column:
    """Of a member as ``_read`` gives it, the field that ``field`` names."""
    return reduce(lambda out, f: F.when(field == f, _field(item, f)).otherwise(out), fields, F.lit(None).cast("string"))


def subprocessors(arrays: DataFrame, least: float = 0.4) -> DataFrame:
    """``page_url, domain, name, evidence``: members of the page's best array and of all arrays of the same last name.

    An array counts with a name field and either an address field or a telling path. Of equal scores, the later wins. A member without an address gets ``_org:`` and its name.
    """
    scored = arrays.withColumn("score", score(F.col("items"), F.col("path"))).withColumn("nf", field_of(F.col("items"), NAME_FIELDS)).withColumn("uf", field_of(F.col("items"), URL_FIELDS)).withColumn("pf", field_of(F.col("items"), PURPOSE_FIELDS))
    scored = scored.withColumn("leaf", F.element_at(F.split("path", r"\."), -1)).where((F.col("score") >= least) & F.col("nf").isNotNull() & (F.col("uf").isNotNull() | F.lower("path").rlike("|".join(PATH_WORDS))))
    best = scored.groupBy("page_url").agg(F.max_by("leaf", F.struct("score", "ordinal", "path")).alias("leaf"))
    rows = scored.join(best, ["page_url", "leaf"], "left_semi").select("page_url", "ordinal", "path", "nf", "uf", "pf", F.posexplode(_read(F.col("items"))).alias("at", "item"))
    rows = rows.withColumn("name", _by(F.col("item"), F.col("nf"), NAME_FIELDS)).withColumn("address", _by(F.col("item"), F.col("uf"), URL_FIELDS)).withColumn("purpose", _by(F.col("item"), F.col("pf"), PURPOSE_FIELDS))
    rows = rows.where(F.octet_length("name") >= 2).withColumn("domain", F.coalesce(domain_of(F.col("address")), F.concat(F.lit("_org:"), F.col("name"))))
    place = F.row_number().over(Window.partitionBy("page_url", F.lower("domain"), F.lower("name")).orderBy("ordinal", "path", "at"))
    return rows.withColumn("_n", place).where("_n = 1").select("page_url", "domain", "name", F.concat_ws(" | ", "name", "purpose").alias("evidence"))


def domain_of(text: Column) -> Column:
    """The host in an address, with or without scheme and ``www.``."""
    host = F.regexp_extract(F.trim(text), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@\s]*@)?([A-Za-z0-9_.-]+\.[A-Za-z]{2,})(?:[:/?#].*)?$", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def resolve_names(found: DataFrame, known: DataFrame) -> DataFrame:
    """``_org:`` rows get the domain of a known organization; those without one and without a dot go. ``known(organization, domain)``."""
    own = known.groupBy(F.lower("organization").alias("_k")).agg(F.min("domain").alias("_d"))
    plain = F.regexp_replace("domain", "^_org:", "")
    both = found.withColumn("_k", F.when(F.col("domain").startswith("_org:"), F.lower(plain))).join(told(own), "_k", "left")
    both = both.withColumn("domain", F.coalesce("_d", F.when(F.col("domain").startswith("_org:"), F.when(plain.contains("."), plain)).otherwise(F.col("domain")))).drop("_k", "_d")
    return both.where(F.col("domain").isNotNull() & ~D.is_non_registrable(F.col("domain")))
