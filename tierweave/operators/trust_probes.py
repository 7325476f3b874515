"""Data that trust-center pages embed: found in the page, scored, and the best kept as the way to read it again.

``embedded(pages)`` turns each way of embedding into rows of JSON; from there on arrays are found and
scored as in captured responses (``trust``).
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V
from tierweave.operators import trust

LEAST = 0.4


def balanced(text: str, start: int) -> str | None:
    """The object that begins at ``start``, to its closing brace; braces in strings do not count."""
    depth, inside, at = 0, False, start
    while at < len(text):
        c = text[at]
        if inside:
            if c == "\\":
                at += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


def assigned_object(html: str, name: str) -> str | None:
    """The object assigned to ``window.<name>``, however deep it nests."""
    m = re.search(rf"window\.{re.escape(name)}\s*=\s*(?=\{{)", html)
    return balanced(html, m.end()) if m else None


def _blobs(html: str) -> Iterator[tuple[str, str]]:
    """(kind, JSON text) of what a page embeds, in the order of the probes."""
    for m in re.finditer(V.NEXT_DATA, html):
        yield "next_data", m[1]
        break
    for m in re.finditer(V.JSON_SCRIPT, html):
        if len(m[1].strip().encode()) >= 50:
            yield "json_script", m[1].strip()
    for p in V.BASE64_BLOBS:
        for m in re.finditer(p, html):
            try:
                yield "base64", base64.b64decode(m[1], validate=True).decode()
            except (binascii.Error, UnicodeDecodeError):
                continue
    for m in re.finditer(V.JS_OBJECTS, html):
        yield "js_object", m[2]


def embedded(pages: DataFrame) -> DataFrame:
    """``page_url, ordinal, kind, body``: JSON texts embedded in ``pages(url, html)``. A null page has none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, i, k, t) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h for i, (k, t) in enumerate(_blobs(h))]
            own = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.string()), pa.array(own[1], pa.int64()), pa.array(own[2], pa.string()), pa.array(own[3], pa.string())], ["page_url", "ordinal", "kind", "body"])

    # Only pages that may hold one of the patterns leave the JVM.
    maybe = F.col("html").rlike(r"__NEXT_DATA__|application/json|window\.[A-Z_]|[A-Za-z0-9+/=]{200}")
    return pages.where(maybe).select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(scan, "page_url string, ordinal long, kind string, body string")


def candidates(blobs: DataFrame) -> DataFrame:
    """``page_url, ordinal, kind, path, score, n_items, name_field, url_field, purpose_field``: arrays that score ``LEAST`` or more and have a name field.

    Of a hydration blob only the first array that scores counts, and if it has no name field the blob gives nothing.
    """
    arrays = trust.entity_arrays(blobs).withColumn("score", trust.score(F.col("items"), F.col("path"))).where(F.col("score") >= LEAST)
    rows = arrays.join(blobs.select("page_url", "ordinal", "kind"), ["page_url", "ordinal"])
    rows = rows.select(
        "page_url", "ordinal", "kind", "path", "score", F.size("items").alias("n_items"),
        trust.field_of(F.col("items"), trust.NAME_FIELDS).alias("name_field"), trust.field_of(F.col("items"), trust.URL_FIELDS).alias("url_field"), trust.field_of(F.col("items"), trust.PURPOSE_FIELDS).alias("purpose_field"),
    )
    first = rows.where("kind = 'next_data'").groupBy("page_url").agg(F.min("path").alias("path"))
    hydrated = rows.where("kind = 'next_data'").join(first, ["page_url", "path"], "left_semi")
    return rows.where("kind <> 'next_data'").unionByName(hydrated.select(*rows.columns)).where("name_field is not null")


def strategies(pages: DataFrame) -> DataFrame:
    """``page_url, kind, path, score, ...``: the best candidate of each page; of equal ones the first found."""
    found = candidates(embedded(pages))
    rest = [c for c in found.columns if c != "page_url"]
    return found.groupBy("page_url").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), "ordinal", "path")).alias("r")).select("page_url", "r.*")


def execute(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_url, name, address``: the members that ``strategies`` say how to read, from pages as they are now."""
    arrays = trust.entity_arrays(embedded(pages))
    rows = arrays.join(chosen.select("page_url", "ordinal", "path", "name_field", "url_field"), ["page_url", "ordinal", "path"])
    rows = rows.select("page_url", "name_field", "url_field", F.explode(trust._read(F.col("items"))).alias("item"))
    name, address = (trust._by(F.col("item"), F.col(f), fields) for f, fields in (("name_field", trust.NAME_FIELDS), ("url_field", trust.URL_FIELDS)))
    return rows.select("page_url", name.alias("name"), address.alias("address")).where(F.octet_length("name") >= 2)


def confident_pages(arrays: DataFrame, least: float = 0.5) -> DataFrame:
    """``page_url`` of pages with an array that scores ``least`` or more."""
    return arrays.where(trust.score(F.col("items"), F.col("path")) >= least).select("page_url").distinct()


def graphql_operation(url: Column) -> Column:
    """The operation that an address names; null without one."""
    return F.nullif(F.url_decode(F.regexp_extract(url, r"[?&]operation(?:Name)?=([^&#]*)", 1)), F.lit(""))


def capture_hints(captures: DataFrame) -> DataFrame:
    """``page_url, hint``: of the first capture that alone gives subprocessors its operation, or that it is GraphQL at all."""
    one = captures.withColumn("_p", F.concat_ws("#", "page_url", F.col("ordinal").cast("string")))
    given = trust.subprocessors(trust.entity_arrays(one.select(F.col("_p").alias("page_url"), F.lit(0).alias("ordinal"), "body"))).select(F.col("page_url").alias("_p")).distinct()
    first = one.join(given, "_p", "left_semi").groupBy("page_url").agg(F.min_by("url", "ordinal").alias("url"))
    hint = F.coalesce(graphql_operation(F.col("url")), F.when(F.contains("url", F.lit("graphql")), "graphql"))
    return first.select("page_url", hint.alias("hint"))


def with_hints(captures: DataFrame, hints: DataFrame) -> DataFrame:
    """Subprocessors from captures whose address holds the page's hint; where these give none, from all of its captures."""
    own = captures.join(hints, "page_url", "left")
    hinted = trust.subprocessors(trust.entity_arrays(own.where(F.contains("url", F.col("hint")))))
    rest = own.join(hinted.select("page_url").distinct(), "page_url", "left_anti")
    return hinted.unionByName(trust.subprocessors(trust.entity_arrays(rest)))


def slug(url: Column) -> Column:
    """The first of two or more path segments, unless it is a common word; null otherwise."""
    path = F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "/")
    return F.when((F.size(path) >= 2) & ~F.get(path, F.lit(0)).isin("", *V.NO_SLUGS), F.get(path, F.lit(0)))


def filled(template: Column, slug_: Column) -> Column:
    """An address with its ``{{slug}}`` filled in."""
    return F.replace(template, F.lit("{{slug}}"), F.coalesce(slug_, F.lit("")))


def is_stale(discovered_at: Column, now: Column, most_days: int) -> Column:
    """Found more than ``most_days`` ago; both are seconds."""
    return F.greatest(now - discovered_at, F.lit(0)) > most_days * 86400


def is_unreliable(failures: Column, most: int) -> Column:
    return failures >= most
