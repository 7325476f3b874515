"""Personal data: fixed formats, plus candidates that boosted trees accept. DataFrame functions only.

Four base kinds are found by pattern and check, leftmost and non-overlapping per kind: ``email``,
``ip`` (parts at most 255), ``card`` (16 to 19 digits that pass Luhn), ``phone`` (8 to 15 digits).
A match that fails its check is dropped and not retried. Base spans are always reported.

High-recall generators then propose further, overlapping spans (written-out e-mail addresses,
national phone numbers, group-formatted personal numbers, bank account numbers, short card
numbers). Base spans and generated ones alike are candidates: each gets boolean features of its format and its
context, and gradient-boosted trees give it a calibrated probability, which is reported. Generated candidates at or
above their generator's threshold are added where they do not overlap a base span. Of overlapping candidates the more probable one
stays, then the earlier, then the longer.

The trees are fitted on half of the labelled findings, their probabilities calibrated on a quarter, and thresholds set on the
last quarter. Spark counts the different feature vectors of these
(at most 2**features rows), and boosting runs on the counts. Scoring is a sum of ``when``
expressions. Positions are code points, ends exclusive. The findings are written out from templates by a fixed
rule, so they say nothing certain about other text.

Edge cases: null and empty texts have no spans; rows are kept one for one, null and repeated ids
included; other columns are ignored by ``pii_spans`` and kept by ``redact``. Quantifiers are possessive,
so that texts of any length neither overflow the matcher's stack nor take quadratic time. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: Java patterns. ``\G`` lets a match begin right after the one before, where the look-behind alone would not.
BASE_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
GENERATORS = {
    "email_words": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]\x20?dot\x20?[)\]]|\.)\x20?[A-Za-z0-9-]{2,}+)++",
    "phone_local": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "person_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card_short": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])",
}
GENERATOR_NEEDS = {
    "email_words": r"[(\[]\x20?at\x20?[)\]]", "phone_local": r"[0-9]{3}[\x20.-][0-9]{4}", "person_number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "card_short": r"[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}",
}
KINDS = (*BASE, *GENERATORS)
#: Words before a candidate that speak for it, and those that speak against it.
FOR_WORDS = r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|mail|e-mail|email|contact|reach|ssn|social|security|iban|account|bank|card|amex|payment|write)\b"
AGAINST_WORDS = r"(?i)\b(?:order|invoice|isbn|item|sku|part|ref|reference|version|serial|ticket|case|tracking|model|page|lot)\b"
CONTEXT = 24
#: Matches whose positions are added up together.
CHUNK = 64
#: Matches that together hold at least ``CONTEXT`` characters (the shortest has three).
ENOUGH = 8
MATCH = "struct<start:int,end:int,hit:string,before:string,after:string>"
SPAN = "struct<start:int,end:int,kind:string,p:double>"
#: Characters of a block of text when much of it is taken apart.
BLOCK = 4096


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """array<MATCH> of a pattern's matches in their order, each with ``CONTEXT`` characters before and two after it.

    Places and contexts come from the texts between the matches, in one pass: none is looked for in the whole text.
    """
    p = F.lit(pattern)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("hits"))

    def spans(x: Column) -> Column:
        gap, hit = lambda i: F.get(x["gaps"], i), lambda i: F.get(x["hits"], i)

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(gap(i))
            before = F.right(F.concat(acc["tail"], gap(i)), F.lit(CONTEXT))
            after = F.left(F.concat(gap(i + 1), F.coalesce(hit(i + 1), F.lit(""))), F.lit(2))
            own = F.struct(start.cast("int").alias("start"), (start + F.length(hit(i))).cast("int").alias("end"), hit(i).alias("hit"), before.alias("before"), after.alias("after"))
            return _let(own, lambda m: F.struct(m["end"].alias("at"), F.right(F.concat(m["before"], m["hit"]), F.lit(CONTEXT)).alias("tail"), F.concat(acc["out"], F.array(m)).alias("out")))

        empty = F.array().cast(f"array<{MATCH}>")
        run = lambda first, last, at, tail: F.aggregate(F.sequence(first, last), F.struct(at.alias("at"), tail.alias("tail"), empty.alias("out")), step)["out"]

        def chunked(n: Column) -> Column:
            """Chunks of ``CHUNK`` matches, so that growing arrays stay short in texts with many."""
            chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
            size = F.transform(chunks, lambda c: F.aggregate(F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, n) - 1), F.lit(0), lambda a, i: (a + F.length(gap(i)) + F.length(hit(i))).cast("int")))
            first = lambda sizes: F.aggregate(sizes, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array((F.element_at(a, -1) + v).cast("int"))))
            tail = lambda c: F.when(c == 0, "").otherwise(F.right(F.array_join(F.transform(F.sequence(c * CHUNK - ENOUGH, c * CHUNK - 1), lambda i: F.concat(gap(i), hit(i))), ""), F.lit(CONTEXT)))
            return _let(first(size), lambda at: F.flatten(F.transform(chunks, lambda c: run(c * CHUNK, F.least(c * CHUNK + CHUNK, n) - 1, F.get(at, c), tail(c)))))

        n = F.size(x["hits"])
        return F.when(n > CHUNK, chunked(n)).when(n > 0, run(F.lit(0), n - 1, F.lit(0), F.lit(""))).otherwise(empty)

    return F.when(text.rlike(needs), _let(parts, spans)).otherwise(F.array().cast(f"array<{MATCH}>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _let(d.cast("int") * (F.lit(1) + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(F.filter(ds, lambda d: d.isNotNull()), F.lit(0), lambda a, d: (a + d).cast("int")) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return _let(_digits(hit), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def features(kind: Column, hit: Column, before: Column, after: Column) -> dict[str, Column]:
    """Boolean features of a candidate's format and context."""
    digits = F.length(_digits(hit))
    return {f"is_{g}": kind == g for g in KINDS} | {
        "word_for": before.rlike(FOR_WORDS), "word_against": before.rlike(AGAINST_WORDS),
        "parens": hit.rlike(r"[(\[]"), "dashes": hit.rlike("-"), "dots": hit.rlike(r"\."), "spaces": hit.rlike(" "),
        "many_digits": digits >= 12, "zero_group": hit.rlike(r"(^|[^0-9])0{3}([^0-9]|$)"), "leads_01": hit.rlike(r"^\(?[01]"),
        "glued_after": after.rlike("^[A-Za-z0-9]"), "glued_before": before.rlike("[A-Za-z0-9_/#=]$"),
    }


FEATURES = (*(f"is_{g}" for g in KINDS), "word_for", "word_against", "parens", "dashes", "dots", "spaces", "many_digits", "zero_group", "leads_01", "glued_after", "glued_before")


def labelled_findings(spark: SparkSession, each: int = 160) -> DataFrame:
    """``kind, hit, before, after, label``: findings written out from templates by a fixed rule, ``each`` of a kind and label.

    True ones look like what people write about themselves; false ones are order numbers, part
    numbers, versions and the like in the same formats.
    """
    rows = []
    words_for = ("call me at ", "phone: ", "my mobile ", "contact ", "reach us by mail ", "tel. ", "write to ", "")
    words_against = ("order ", "invoice ", "item ", "part ", "serial ", "tracking ", "ref ", "ISBN ")
    for i in range(each):
        a, b, c, d = (211 + i * 37) % 780 + 210, (173 + i * 53) % 790 + 200, (1009 + i * 977) % 9000 + 1000, (17 + i * 7) % 89 + 10
        f, g = words_for[i % 8], words_against[i % 8]
        name = f"{'abcdefgh'[i % 8]}{'lmnopr'[i % 6]}ist{i}"
        sep = " -."[i % 3]
        rows += [("email_words", f"{name} (at) mail{i}.example.org" if i % 2 else f"{name} [at] host{i} [dot] example", f, " .", 1), ("email_words", f"{'we met him her'.split()[i % 4]} (at) {'noon dawn dusk one'.split()[i % 4]}. Then", "and ", " we", 0)]
        rows += [("phone_local", f"({a}) {b}-{c}" if i % 2 else f"{a}{sep}{b}{sep}{c}", f, " ,", 1), ("phone_local", f"{a % 100:03d}{sep}{b}{sep}{c}", g if i % 4 else "", "7 " if i % 2 else "", 0)]
        rows += [("person_number", f"{a}-{d}-{c}", ("ssn ", "social security ", "")[i % 3], " ", 1), ("person_number", f"{'000' if i % 2 else a}-{d}-{c}", g, " ", 0)]
        rows += [("iban", f"{('DE', 'FR', 'ES', 'GB')[i % 4]}{d} {c} {c + 1} {c + 2} {c + 3} {d}", ("iban ", "account ", "")[i % 3], ".", 1), ("iban", f"{('AB', 'XK', 'QZ')[i % 3]}{d}{c}{c + 5}", g, " ", 0)]
        rows += [("email", f"{name}@mail{i}.example.org", f, " .", 1), ("email", f"{'abc'[i % 3]}@{i}.{c}", g, "/x", 0)]
        rows += [("ip", f"{a % 256}.{b % 256}.{d}.{i % 256}", ("from ", "host ", "")[i % 3], " ", 1), ("ip", f"{i % 9}.{d}.0.{i % 7}", ("version ", "section ", "serial ")[i % 3], "-r" if i % 2 else " ", 0)]
        rows += [("card", f"4{c % 1000:03d} {c} {c + 1} {a * 5 + 1000}", ("card ", "pay with ", "")[i % 3], " ", 1), ("card", f"{c}{c}{c}{c}", g, "7 " if i % 2 else " ", 0)]
        rows += [("phone", f"+{d % 90 + 1} ({a}) {b}-{c}", f, " ,", 1), ("phone", f"+{c}{c}{d}", g, "00" if i % 2 else " ", 0)]
        rows += [("card_short", f"3782 {c}{d} {c}1", ("card ", "amex ", "payment ")[i % 3], " ", 1), ("card_short", f"{c}{c}{d}{c}1", g if i % 3 else "", " ", 0)]
    return spark.createDataFrame(rows, "kind string, hit string, before string, after string, label int")


def fit_trees(labelled: DataFrame, rounds: int = 24, depth: int = 2, rate: float = 0.4, penalty: float = 1.0, recall: float = 0.95) -> dict:
    """Boosted trees (logistic loss, second order) and per-kind thresholds for ``labelled``.

    Spark counts labels by feature vector and part; the fit sees those counts alone. Leaves hold log-odds,
    which are calibrated by a scale and shift on findings that were not fitted to; a kind's threshold is
    the highest that keeps ``recall`` of its true findings in the last part. A kind without such findings accepts nothing.
    """
    f = features(*(F.col(c) for c in ("kind", "hit", "before", "after")))
    part = F.pmod(F.xxhash64("kind", "hit", "before", "after"), F.lit(4)).cast("int")
    vectors = labelled.where("label is not null").select(F.array(*[F.coalesce(f[n], F.lit(False)) for n in FEATURES]).alias("x"), F.col("label"), "kind", part.alias("part"))
    counted = vectors.groupBy("x", "kind", "part").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect()
    every = sorted(((tuple(r["x"]), r["kind"], r["pos"], r["n"], r["part"]) for r in counted), key=lambda r: (r[1], r[0], r[4]))
    table, held, last = ([r for r in every if r[4] in own] for own in ((0, 1), (2,), (3,)))
    score = [0.0] * len(table)
    trees = []

    def grow(rows: Sequence[int], left: int, grad: list[float], hess: list[float]):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        best = None
        if left:
            for k in range(len(FEATURES)):
                yes = [i for i in rows if table[i][0][k]]
                if 0 < len(yes) < len(rows):
                    gy, hy = sum(grad[i] for i in yes), sum(hess[i] for i in yes)
                    gain = gy * gy / (hy + penalty) + (g - gy) ** 2 / (h - hy + penalty) - g * g / (h + penalty)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, k, yes)
        if best is None:
            return rate * g / (h + penalty)
        yes = set(best[2])
        return (FEATURES[best[1]], grow(best[2], left - 1, grad, hess), grow([i for i in rows if i not in yes], left - 1, grad, hess))

    def value(tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[1] if x[FEATURES.index(tree[0])] else tree[2]
        return tree

    for _ in range(rounds if table else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad, hess = [r[2] - r[3] * q for r, q in zip(table, p, strict=True)], [r[3] * q * (1 - q) for r, q in zip(table, p, strict=True)]
        trees.append(grow(range(len(table)), depth, grad, hess))
        score = [s + value(trees[-1], r[0]) for s, r in zip(score, table, strict=True)]
    raw = lambda x: sum(value(t, x) for t in trees)
    scale, shift, scores = 1.0, 0.0, [raw(r[0]) for r in held]
    for _ in range(60):  # Platt scaling, with the usual smoothed targets
        p = [1 / (1 + math.exp(-(scale * s + shift))) for s in scores]
        d = [(r[2] + 0.5) / (r[3] + 1) * r[3] - r[3] * q for r, q in zip(held, p, strict=True)]
        total = sum(r[3] for r in held) or 1
        scale, shift = scale + 0.5 * sum(x * s for x, s in zip(d, scores, strict=True)) / total, shift + 0.5 * sum(d) / total
    at = {}
    for kind in KINDS:
        own = sorted(((1 / (1 + math.exp(-(scale * raw(r[0]) + shift))), r[2]) for r in last if r[1] == kind), reverse=True)
        need, got, most = recall * sum(n for _, n in own), 0, math.inf
        for q, n in own:
            if got >= need:
                break
            got, most = got + n, q
        at[kind] = most - 1e-9
    return {"trees": trees, "scale": scale, "shift": shift, "thresholds": at}


def probability(model: dict, f: dict[str, Column]) -> Column:
    def expr(tree) -> Column:
        return F.lit(float(tree)) if not isinstance(tree, tuple) else F.when(F.coalesce(f[tree[0]], F.lit(False)), expr(tree[1])).otherwise(expr(tree[2]))

    total = reduce(lambda a, b: a + b, map(expr, model["trees"]), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * model["scale"] + model["shift"])))


def _groups(spans: Column) -> Column:
    """Spans, sorted by their starts, in groups that overlap one another: array<array<SPAN>>."""
    kind = f"struct<end:int,now:array<{SPAN}>,done:array<array<{SPAN}>>>"

    def step(acc: Column, m: Column) -> Column:
        same = m["start"] < acc["end"]
        now = F.when(same, F.concat(acc["now"], F.array(m))).otherwise(F.array(m))
        return F.struct(F.greatest(acc["end"], m["end"]).alias("end"), now.alias("now"), F.when(same, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done")).cast(kind)

    start = F.struct(F.lit(0).alias("end"), F.array().alias("now"), F.array().alias("done")).cast(kind)
    folded = lambda some: F.aggregate(some, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.filter(folded(F.array_sort(spans)), lambda g: F.size(g) > 0)


def _chosen(group: Column) -> Column:
    """Of a group's generated spans those that stay: the more probable first, then the earlier, then the longer, each if it overlaps nothing kept and no base span."""
    base = F.filter(group, lambda m: m["kind"].isin(*BASE))
    own = F.filter(group, lambda m: ~m["kind"].isin(*BASE))
    order = F.array_sort(F.transform(own, lambda m: F.struct((-m["p"]).alias("q"), m["start"].alias("start"), (-m["end"]).alias("e"), m["kind"].alias("kind"))))
    span = lambda m: F.struct(m["start"].alias("start"), (-m["e"]).alias("end"), m["kind"].alias("kind"), (-m["q"]).alias("p"))
    kept = F.aggregate(order, base, lambda acc, m: F.when(F.exists(acc, lambda k: (k["start"] < -m["e"]) & (m["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(span(m)))))
    return F.when(F.size(own) > 0, F.filter(kept, lambda m: ~m["kind"].isin(*BASE))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _judged(text: Column, base: Column, model: dict) -> Column:
    """struct<added, scored>: accepted candidates in the order of their starts, and every candidate, base spans first, each with its probability ``p``.

    Candidates are sorted by their starts and swept into groups that overlap; only within a group is each held against the others.
    """

    def candidates(g: str) -> Column:
        return _kinded(_matches(text, GENERATORS[g], GENERATOR_NEEDS[g]), g)

    maybe = reduce(lambda a, b: a | b, [text.rlike(n) for n in GENERATOR_NEEDS.values()])
    found = F.concat(base, F.when(maybe, F.concat(*map(candidates, GENERATORS))).otherwise(F.array().cast(CANDIDATES)))

    def scored(m: Column) -> Column:
        p = _let(F.struct(*[v.alias(k) for k, v in features(m["kind"], m["hit"], m["before"], m["after"]).items()]), lambda f: probability(model, {k: f[k] for k in FEATURES}))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), p.alias("p")).cast(SPAN)

    limit = F.create_map(*[x for k, v in model["thresholds"].items() for x in (F.lit(k), F.lit(float(v)))])

    def accepted(all_: Column) -> Column:
        good = F.filter(all_, lambda m: m["kind"].isin(*BASE) | (m["p"] >= F.element_at(limit, m["kind"])))
        any_ = F.exists(all_, lambda m: ~m["kind"].isin(*BASE))
        return F.when(any_, F.array_sort(F.flatten(F.transform(_groups(good), _chosen)))).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _let(F.transform(found, scored), lambda all_: F.struct(accepted(all_).alias("added"), all_.alias("scored")))


CANDIDATES = "array<struct<start:int,end:int,kind:string,hit:string,before:string,after:string>>"


def _kinded(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["hit"].alias("hit"), m["before"].alias("before"), m["after"].alias("after")))


def pii_spans(docs: DataFrame, model: dict | None = None, name: str = "_found") -> DataFrame:
    """``docs`` with a struct column ``name`` of ``base`` and ``added`` (arrays of struct<start, end, kind, p> in reporting
    order) and ``scored`` (every candidate, base ones first), all with their probabilities ``p``."""
    model = model or fit_trees(labelled_findings(docs.sparkSession))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of(kind: str) -> Column:
        return _kinded(F.filter(_matches(text, BASE_PATTERN[kind], NEEDS[kind]), lambda m: _passes(kind, m["hit"])), kind)

    both = _let(F.concat(*map(of, BASE)), lambda base: _let(_judged(text, base, model), lambda j: F.struct(F.slice(j["scored"], F.lit(1), F.size(base)).alias("base"), j["added"].alias("added"), j["scored"].alias("scored"))))
    return docs.withColumn(name, both)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row a document: counts per base kind, the digest of the base spans, all spans as text, ``n_added`` of them by the
    trees, the number of candidates judged (``n_scored``), and each span's probability (``scores``, in the order of ``spans``)."""
    found = pii_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "_found")
    base, added, scored = F.col("_found.base"), F.col("_found.added"), F.col("_found.scored")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform(F.concat(base, added), lambda s: F.format_number(s["p"], 3)), ",")
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, added)).alias("spans"),
        F.size(added).cast("long").alias("n_added"), F.size(scored).cast("long").alias("n_scored"), scores.alias("scores"),
    )


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    Texts without spans are unchanged, null ones stay null. All other columns stay as they are.
    """
    name = "_found"
    while name in docs.columns:
        name += "_"
    found = pii_spans(docs, model, name)
    spans = F.array_sort(F.concat(F.col(f"{name}.base"), F.col(f"{name}.added")))
    text = F.col("text")

    def merged(acc: Column, s: Column) -> Column:
        """Spans that overlap as one: its end grows, its kind is the first one's."""
        last = F.element_at(acc["out"], -1)
        inside = (F.size(acc["out"]) > 0) & (s["start"] < acc["at"])
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(acc["at"], s["end"]).alias("end"), last["kind"].alias("kind"))))
        new = F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, grown).otherwise(new).alias("out")).cast(MERGED)

    def clean(parts: Column) -> Column:
        """Each merged span's name, with the text before it; blocks keep every cut short."""
        blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

        def put(own: Column) -> Column:
            def between(low: Column, high: Column) -> Column:
                first = F.floor(low / BLOCK).cast("int")
                several = F.array_join(F.slice(own, first + 1, F.floor(high / BLOCK).cast("int") - first + 1), "")
                return several.substr((low - first * BLOCK + 1).cast("int"), (high - low).cast("int"))

            ends = lambda i: F.when(i == 0, 0).otherwise(F.get(parts, i - 1)["end"])
            named = F.transform(parts, lambda s, i: F.concat(between(ends(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.concat(F.array_join(named, ""), between(F.element_at(parts, -1)["end"], F.length(text)))

        return _let(blocks, put)

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(MERGED), merged, lambda acc: acc["out"])
    return found.withColumn("text", F.when(F.size(spans) > 0, _let(whole, clean)).otherwise(text)).drop(name)


MERGED = "struct<at:int,out:array<struct<start:int,end:int,kind:string>>>"
