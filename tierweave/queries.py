"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for the same rows.

The relationship view is made of orders and line items: customers buy from suppliers. Small fixtures
of records, probes and decisions stand where the tables hold nothing of the kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import fixed_values as V
from tierweave.functions import orgs as O
from tierweave.functions import records as RT
from tierweave.functions import suffixes
from tierweave.operators import attribution, clusters, entities, registry, relations, review, subprocessors, trust, trust_api, txt, web
from tierweave.operators import nodes as N
from tierweave.plans import disclosures, graph, scan
from tierweave.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(x) -> str:
    return "NULL" if x is None else f"[{', '.join(map(literal, x))}]" if isinstance(x, (list, tuple)) else str(x) if isinstance(x, (bool, int, float)) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a SQL relation."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({columns})"


def in_list_sql(column: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{column} = '{n}' OR ends_with({column}, '.{n}')" for n in names) + ")"


TYPES = (("AF", "DNS::TXT::SPF"), ("AO", "DNS::TXT::VERIFICATION"), ("NF", "HTTP::SUBPROCESSOR"), ("NO", "DISCOVERY::WEBPAGE_SOURCE"), ("RF", "DISCOVERY::CT_LOG"), ("RO", "TRUST_CENTER::API"))


#: Line items of a task of the relationship view, and up to how many the files' own parts do. The view's texts are some fifteen times as
#: large as the columns they are made of, so that parts merged by the size of those columns give a task millions of rows.
TASK_ROWS, FILE_ROWS = 200_000, 2_000_000


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders, ``TASK_ROWS`` or so a task however many there are."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    n = li.count()
    if n > FILE_ROWS:
        parts = -(-n // TASK_ROWS)
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationship view. ``seq`` is a decimal, for numbers of orders from 5,764,608 on are beyond a BIGINT."""
    r = dealt_lines(spark, sf_dir)
    s, c = F.col("l_suppkey").cast("string"), F.col("o_custkey").cast("string")
    kind = F.concat("l_returnflag", "l_linestatus")
    types = F.create_map(*[F.lit(x) for kv in TYPES for x in kv])
    vendor = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("cdn"), s, F.lit(".amazonaws.com"))).when(F.col("l_suppkey") % 5 == 1, F.concat(F.lit("px"), s, F.lit(".facebook.com"))).otherwise(F.concat(F.lit("s"), s, F.lit(".example.com")))
    name = F.concat(F.lit("Vendor "), s, F.when(F.col("l_orderkey") % 7 == 0, " Inc").when(F.col("l_orderkey") % 11 == 0, " Group").otherwise(""))
    seq = ((F.col("l_orderkey").cast("decimal(20,0)") * 16 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey") % 10_000
    return r.select(
        vendor.alias("nth_party_domain"), name.alias("nth_party_organization"), (1 + F.col("l_linenumber") % 3).cast("int").alias("nth_party_layer"), F.concat(F.lit("c"), c, F.lit(".example.org")).alias("nth_party_customer_domain"),
        F.concat(F.lit("Customer "), c).alias("nth_party_customer_organization"), F.col("o_orderpriority").alias("nth_party_record"), types[kind].alias("nth_party_record_type"),
        F.concat(F.lit("r"), (F.col("o_custkey") % 20).cast("string"), F.lit(".example.net")).alias("root_customer_domain"), F.concat(F.lit("Root "), (F.col("o_custkey") % 20).cast("string")).alias("root_customer_organization"),
        F.concat(F.lit("order "), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("evidence"), seq.cast("decimal(38,0)").alias("seq"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seq`` as the BIGINT that the SQL gives; null where the number is beyond one, on which the SQL ends with an error."""
    return rows.withColumn("seq", F.col("seq").try_cast("bigint"))


REL = """rel AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'cdn' || l_suppkey || '.amazonaws.com' WHEN l_suppkey % 5 = 1 THEN 'px' || l_suppkey || '.facebook.com' ELSE 's' || l_suppkey || '.example.com' END AS nth_party_domain,
 'Vendor ' || l_suppkey || CASE WHEN l_orderkey % 7 = 0 THEN ' Inc' WHEN l_orderkey % 11 = 0 THEN ' Group' ELSE '' END AS nth_party_organization, CAST(1 + l_linenumber % 3 AS INTEGER) AS nth_party_layer,
 'c' || o_custkey || '.example.org' AS nth_party_customer_domain, 'Customer ' || o_custkey AS nth_party_customer_organization, o_orderpriority AS nth_party_record,
 CASE l_returnflag || l_linestatus """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES) + """ END AS nth_party_record_type,
 'r' || (o_custkey % 20) || '.example.net' AS root_customer_domain, 'Root ' || (o_custkey % 20) AS root_customer_organization, 'order ' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS evidence,
 CAST(((l_orderkey * 16 + l_linenumber) * 10000000 + l_partkey) * 10000 + l_suppkey % 10000 AS BIGINT) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""  # fmt: skip
MERGED = """once AS (SELECT nth_party_domain d, nth_party_customer_domain c, nth_party_record_type t, evidence, min(seq) s FROM rel GROUP BY ALL),
 firsts AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY nth_party_domain, nth_party_customer_domain, nth_party_record_type ORDER BY seq) = 1),
 merged AS (SELECT f.* EXCLUDE (evidence), e.evidence FROM firsts f JOIN (SELECT d, c, t, string_agg(evidence, ' | ' ORDER BY s) evidence FROM once GROUP BY ALL) e ON d = nth_party_domain AND c = nth_party_customer_domain AND t = nth_party_record_type)"""


@query(f"WITH {REL}, {MERGED} SELECT * FROM merged")
def rel_dedup_merge(spark, sf_dir):
    return numbered(relations.dedup_relationships(rel(spark, sf_dir)))


@query(f"""WITH {REL}, b AS (SELECT nth_party_domain AS domain, nth_party_record_type AS source_type, nth_party_record AS raw_record, seq,
 CASE WHEN nth_party_domain LIKE '%.amazonaws.com' THEN 'amazonaws.com' WHEN nth_party_domain LIKE '%.facebook.com' THEN 'facebook.com' ELSE 'example.com' END AS base_domain FROM rel)
 SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY base_domain, source_type, raw_record ORDER BY seq) = 1""")
def rel_predup(spark, sf_dir):
    r = rel(spark, sf_dir)
    return numbered(relations.dedup_facts(r.select(F.col("nth_party_domain").alias("domain"), F.col("nth_party_record_type").alias("source_type"), F.col("nth_party_record").alias("raw_record"), "seq")))


@query(f"WITH {REL} SELECT count(*) AS total_relationships, CAST(coalesce(max(nth_party_layer), 0) AS INTEGER) AS max_depth, count(DISTINCT nth_party_domain) AS unique_domains, count(DISTINCT nth_party_organization) AS unique_organizations FROM rel")
def rel_summary(spark, sf_dir):
    return relations.summary(rel(spark, sf_dir))


@query(f"WITH {REL} SELECT nth_party_layer AS layer, count(*) AS n FROM rel GROUP BY 1")
def rel_by_layer(spark, sf_dir):
    return relations.by_layer(rel(spark, sf_dir))


@query(f"WITH {REL} SELECT nth_party_record_type AS record_type, count(*) AS n FROM rel GROUP BY 1")
def rel_by_type(spark, sf_dir):
    return relations.by_type(rel(spark, sf_dir))


@query(f"WITH {REL} SELECT DISTINCT nth_party_organization AS organization FROM rel")
def rel_unique_orgs(spark, sf_dir):
    return relations.unique_organizations(rel(spark, sf_dir))


@query(f"WITH {REL} SELECT DISTINCT nth_party_organization AS organization FROM rel WHERE nth_party_layer >= (SELECT greatest(max(nth_party_layer) - 1, 0) FROM rel)")
def rel_common_denominators(spark, sf_dir):
    return relations.common_denominators(rel(spark, sf_dir))


@query(f"WITH {REL} SELECT * FROM rel WHERE nth_party_layer = 2")
def rel_at_layer(spark, sf_dir):
    return numbered(relations.at_layer(rel(spark, sf_dir), 2))


@query(f"WITH {REL} SELECT * FROM rel WHERE nth_party_record_type IN ('HTTP::SUBPROCESSOR', 'TRUST_CENTER::API') OR NOT {in_list_sql('nth_party_domain', V.COMMON_INFRASTRUCTURE)}")
def rel_infra_filter(spark, sf_dir):
    return numbered(relations.drop_infrastructure(rel(spark, sf_dir)))


@query(f"WITH {REL} SELECT * FROM rel WHERE NOT (nth_party_record_type IN ('DISCOVERY::WEBPAGE_SOURCE', 'DISCOVERY::WEBPAGE_NETWORK') AND {in_list_sql('nth_party_domain', V.MARKETING)})")
def rel_marketing_filter(spark, sf_dir):
    return numbered(relations.drop_marketing(rel(spark, sf_dir)))


@query(f"""WITH {REL}, v AS (SELECT domain, organization, count(*) n FROM (SELECT nth_party_domain AS domain, nth_party_organization AS organization FROM rel UNION ALL
 SELECT nth_party_customer_domain, nth_party_customer_organization FROM rel UNION ALL SELECT root_customer_domain, root_customer_organization FROM rel) GROUP BY ALL)
 SELECT domain, organization FROM v QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, strlen(organization) DESC, organization) = 1""")
def rel_reconcile_org(spark, sf_dir):
    done = relations.reconcile_names(rel(spark, sf_dir))
    return relations.named_domains(done).select("domain", "organization")


@query(f"WITH {REL} SELECT * FROM rel QUALIFY nth_party_layer <> 2 AND nth_party_layer <> 1 OR row_number() OVER (PARTITION BY root_customer_domain, nth_party_customer_domain, nth_party_layer ORDER BY seq) <= CASE nth_party_layer WHEN 1 THEN 3 ELSE 2 END")
def rel_limits_topn(spark, sf_dir):
    return numbered(relations.limit_per_customer(rel(spark, sf_dir), [0, 3, 2]))


@query(f"""WITH {REL}, {MERGED} SELECT nth_party_record_type AS record_type, nth_party_layer AS layer, count(*) AS n, count(DISTINCT nth_party_domain) AS vendors FROM merged
 WHERE (nth_party_record_type IN ('HTTP::SUBPROCESSOR', 'TRUST_CENTER::API') OR NOT {in_list_sql('nth_party_domain', V.COMMON_INFRASTRUCTURE)}) AND NOT (nth_party_record_type = 'DISCOVERY::WEBPAGE_SOURCE' AND {in_list_sql('nth_party_domain', V.MARKETING)}) GROUP BY ALL""")
def rel_assemble(spark, sf_dir):
    done = relations.assemble(rel(spark, sf_dir))
    return done.groupBy(F.col("nth_party_record_type").alias("record_type"), F.col("nth_party_layer").alias("layer")).agg(F.count("*").alias("n"), F.count_distinct("nth_party_domain").alias("vendors"))


@query(f"""WITH {REL}, a AS (SELECT nth_party_domain AS domain, min(nth_party_layer) AS layer, array_to_string(list_sort(list(DISTINCT nth_party_layer)), ',') AS layers, count(*) AS discoveries,
 arg_max(nth_party_organization, seq) AS organization, count(DISTINCT nth_party_record_type || nth_party_customer_domain) AS n_sources FROM rel GROUP BY 1) SELECT * FROM a""")
def graph_vendor_agg(spark, sf_dir):
    v = relations.vendors(rel(spark, sf_dir))
    return v.select("domain", "layer", F.array_join(F.col("layers").cast("array<string>"), ",").alias("layers"), "discoveries", "organization", F.size("sources").cast("long").alias("n_sources"))


@query(f"WITH {REL} SELECT nth_party_customer_domain AS domain, array_to_string(list_sort(list(DISTINCT nth_party_domain)), ',') AS children FROM rel GROUP BY 1")
def graph_children(spark, sf_dir):
    return relations.children(rel(spark, sf_dir)).select("domain", F.array_join("children", ",").alias("children"))


@query(f"WITH {REL} SELECT nth_party_customer_domain AS customer, nth_party_domain AS vendor, count(*) AS n, min(nth_party_layer) AS layer FROM rel GROUP BY 1, 2")
def graph_edges(spark, sf_dir):
    return relations.edges(rel(spark, sf_dir))


@query(f"WITH {REL}, o AS (SELECT nth_party_customer_domain AS customer, nth_party_domain AS vendor, min(seq) AS s FROM rel GROUP BY 1, 2) SELECT customer, vendor, CAST((row_number() OVER (PARTITION BY customer ORDER BY s, vendor) - 1) // 8 AS INTEGER) AS page FROM o")
def graph_pages(spark, sf_dir):
    return relations.pages_of_children(rel(spark, sf_dir))


@query(f"WITH {REL}, o AS (SELECT nth_party_domain AS domain, min(nth_party_layer) AS layer FROM rel GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY domain) - 1 AS n FROM o) SELECT domain, layer, CAST(n // 10 AS INTEGER) AS row, CAST(n % 10 AS INTEGER) AS col FROM p")
def graph_grid(spark, sf_dir):
    return relations.grid(rel(spark, sf_dir))


def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' suppliers (a pair as often as it is ordered) and each supplier's next one in its nation."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    first = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("customer"), F.concat(F.lit("s"), "l_suppkey").alias("vendor"))
    following = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    chain = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), following.alias("b")).where("b is not null")
    return first.unionByName(chain.select(F.concat(F.lit("s"), "a").alias("customer"), F.concat(F.lit("s"), "b").alias("vendor")))


FACTS = """facts AS (SELECT DISTINCT 'c' || o_custkey AS customer, 's' || l_suppkey AS vendor FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL
 SELECT 's' || a, 's' || b FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier) WHERE b IS NOT NULL)"""


@query(f"""WITH RECURSIVE {FACTS}, walk(root, domain, layer) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION
 SELECT root, vendor, layer + 1 FROM walk JOIN facts ON customer = domain WHERE layer < 3) SELECT root, domain, CAST(min(layer) AS INTEGER) AS layer FROM walk GROUP BY 1, 2""")
def graph_bfs_layers(spark, sf_dir):
    """From every customer, three layers deep."""
    roots = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("root"))
    return graph.layers(roots, graph_facts(spark, sf_dir), max_depth=3)


HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)"


@query(f"SELECT page_id, lower({HOST}) AS host, regexp_extract(lower({HOST}), '([^.]+[.][^.]+)$', 1) AS base_domain, {HOST} LIKE '%google.com' AS is_infrastructure FROM pages")
def page_base_domain(spark, sf_dir):
    host = D.host_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), D.base_domain(host).alias("base_domain"), D.is_common_infrastructure(host).alias("is_infrastructure"))


@query(f"SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(web._tag(F.col("html"), "title"), F.lit("")).alias("title"))


def _name_sql() -> str:
    """The owner by title and copyright notice: the pages have no structured data and no telling meta tags."""
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    valid = lambda x: f"(strlen(trim({x})) BETWEEN 2 AND 100 AND regexp_matches(trim({x}), '^[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(trim({x}), '^[\\p{{N}}\\s]+$') AND lower(trim({x})) NOT IN ({quoted(V.NO_NAMES)}))"
    good = lambda x: f"({valid(x)} AND NOT regexp_matches({x}, '{'|'.join(V.PAGE_NAMES)}'))"
    side = lambda sep: f"trim({f'substr(t, strpos(t, {quoted([sep])}) + {len(sep)})' if sep.strip(' ') not in ('::', ':') else f'substr(t, 1, strpos(t, {quoted([sep])}) - 1)'})"
    parts = ", ".join(f"CASE WHEN strpos(t, {quoted([x])}) > 0 AND {good(side(x))} THEN {side(x)} END" for x in (" | ", " - ", " – ", " — ", " :: ", ": "))
    notices = ", ".join(f"CASE WHEN {valid(c)} THEN {c} END" for c in (f"trim(regexp_extract(f, {quoted([p])}, 1))" for p in V.COPYRIGHT))
    clean = lambda x: f"regexp_replace(CASE WHEN regexp_matches({x}, '(Inc|Ltd|Corp|Co|LLC)[.]$') THEN {x} || '.' ELSE {x} END, '[.]$', '')"
    tag = lambda n: f"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<{n}[^>]*>(.*?)</{n}>', 1), '<[^>]*>', '', 'g')), '')"
    return f"""WITH p AS (SELECT page_id, {tag('title')} AS t, coalesce({tag('footer')}, html) AS f FROM pages), q AS (SELECT page_id, CASE WHEN strlen(t) >= 3 THEN coalesce({parts}) END AS part,
 CASE WHEN strlen(t) BETWEEN 3 AND 49 AND NOT contains(t, 'Home') AND NOT contains(t, 'Welcome') AND {good('t')} THEN t END AS whole, coalesce({notices}) AS notice FROM p), r AS (SELECT page_id, part, whole, notice, regexp_replace(trim(coalesce(part, whole, notice)), '\\s+', ' ', 'g') AS n FROM q)
 SELECT page_id, {clean('n')} AS organization, CAST(CASE WHEN part IS NOT NULL THEN 0.65 WHEN whole IS NOT NULL THEN 0.5 WHEN notice IS NOT NULL THEN 0.6 END AS FLOAT) AS confidence,
 CASE WHEN part IS NOT NULL OR whole IS NOT NULL THEN 'title_tag' WHEN notice IS NOT NULL THEN 'copyright' END AS source FROM r"""


@query(_name_sql())
def page_organization(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", web.page_organization(F.col("html")).alias("r"))
    return own.select("page_id", "r.organization", "r.confidence", "r.source")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_length, (strlen(html) > 1000 AND length(regexp_replace(html, '<[^>]*>', '', 'g')) / strlen(html) < 0.05) AS thin FROM pages")
def page_text_share(spark, sf_dir):
    text = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    return table(spark, sf_dir, "pages").select("page_id", text.cast("long").alias("text_length"), ((F.octet_length("html") > 1000) & (text / F.octet_length("html") < 0.05)).alias("thin"))


@query("""SELECT page_id, (strlen(html) > 1000 AND length(regexp_replace(html, '<[^>]*>', '', 'g')) / strlen(html) < 0.05) OR """ + " OR ".join(f"contains(lower(html), '{m}')" for m in V.SPA_MARKERS) + """
 OR (contains(lower(html), '<body') AND contains(lower(html), '<script') AND NOT regexp_matches(lower(html), '<(p|div|h[1-6]|span|table|ul|ol|a|section|article|main|footer|nav)[ >]')) AS is_spa FROM pages""")
def page_spa_flag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.is_single_page_app(F.col("html")).alias("is_spa"))


@query("SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS hosts FROM (SELECT doc_id, list_transform(list_filter(list_zip(l, range(len(l))), lambda p: list_position(l, p[1]) = p[2] + 1), lambda p: p[1]) AS list_distinct_in_order FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+)', 1), lambda x: lower(x)) AS l FROM documents)) WHERE len(list_distinct_in_order) > 0")
def doc_email_domains(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", web.email_domains(F.col("text")).alias("hosts"))
    return own.where(F.size("hosts") > 0).select("doc_id", F.array_join("hosts", ",").alias("hosts"))


@query("""WITH t AS (SELECT doc_id, trim(split_part(text, chr(10), 1), ' ') AS name FROM documents), p AS (SELECT *, ' ' || lower(name) || ' ' AS q FROM t) SELECT doc_id,
 name <> '' AND len(regexp_split_to_array(trim(regexp_replace(name, '\\s+', ' ', 'g'), ' '), ' ')) < 6 AND NOT starts_with(lower(name), 'a ') AND NOT starts_with(lower(name), 'an ') AND NOT (""" + " OR ".join(f"contains(q, '{m}')" for m in V.PHRASE_MARKERS) + ") AS plausible FROM p")
def doc_plausible_name(spark, sf_dir):
    first = F.get(F.split("text", "\n", 2), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", O.is_plausible_name(first).alias("plausible"))


@query("SELECT DISTINCT a.p_name AS a, b.p_name AS b, CASE WHEN lower(a.p_name) = lower(b.p_name) THEN 1.0 ELSE 1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(strlen(a.p_name), strlen(b.p_name)) END AS similarity FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name AND 1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(strlen(a.p_name), strlen(b.p_name)) >= 0.85")
def name_similarity_pairs(spark, sf_dir):
    return O.similar_names(table(spark, sf_dir, "part"), "p_name", 0.85)


@query("""SELECT d.domain, coalesce(t1.o, t2.o, t3.o) AS organization, CASE WHEN t1.o IS NOT NULL THEN 'overrides' WHEN t2.o IS NOT NULL THEN 'registry' WHEN t3.o IS NOT NULL THEN 'base' END AS tier
 FROM (SELECT 's' || s_suppkey || '.example' || (s_suppkey % 4) || '.com' AS domain, s_suppkey % 4 AS k, s_suppkey AS n FROM supplier) d
 LEFT JOIN (SELECT s_suppkey AS k, 'Override ' || s_name AS o FROM supplier WHERE s_suppkey % 6 = 0) t1 ON t1.k = d.n
 LEFT JOIN (SELECT s_suppkey AS k, 'Registry ' || s_name AS o FROM supplier WHERE s_suppkey % 3 = 0) t2 ON t2.k = d.n
 LEFT JOIN (SELECT r_regionkey AS k, r_name AS o FROM region) t3 ON t3.k = d.k AND d.k < 3""")
def curated_cascade(spark, sf_dir):
    """Suppliers looked up in two exact tables and one of base domains."""
    s = table(spark, sf_dir, "supplier").withColumn("domain", F.concat(F.lit("s"), "s_suppkey", F.lit(".example"), F.col("s_suppkey") % 4, F.lit(".com")))
    base = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.concat(F.lit("example"), "r_regionkey", F.lit(".com")).alias("domain"), F.col("r_name").alias("organization"))
    tiers = [("overrides", s.where("s_suppkey % 6 = 0").select("domain", F.concat(F.lit("Override "), "s_name").alias("organization"))), ("registry", s.where("s_suppkey % 3 = 0").select("domain", F.concat(F.lit("Registry "), "s_name").alias("organization"))), ("base", base)]
    return attribution.curated(s.select("domain"), tiers, ("base",))


#: A TXT record for each supplier, of six kinds in turn.
TXT_SQL = """txt AS (SELECT s_suppkey AS id, s_suppkey % 6 AS kind, CAST(s_suppkey AS VARCHAR) AS k, CASE s_suppkey % 6 WHEN 0 THEN '"v=spf1 include:_spf.s' || s_suppkey || '.com a:mail.t' || s_suppkey || '.co.uk exists:%{i}.spf.u' || s_suppkey || '.com.br ~all"'
 WHEN 1 THEN 'v=DMARC1; p=none; rua=mailto:d@rua.s' || s_suppkey || '.com,mailto:x@t' || s_suppkey || '.com; ruf=mailto:f@ruf.s' || s_suppkey || '.com' WHEN 2 THEN 'v=DKIM1; k=rsa; p=MIGf; s=mail.s' || s_suppkey || '.io'
 WHEN 3 THEN 'google-site-verification=tok' || s_suppkey WHEN 4 THEN 'ZOOM_verify_' || s_suppkey ELSE 'nothing to see ' || s_suppkey END AS rdata FROM supplier)"""


def txt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    cat = lambda *parts: F.concat(*[k if x is None else F.lit(x) for x in parts])
    kinds = (
        cat('"v=spf1 include:_spf.s', None, ".com a:mail.t", None, ".co.uk exists:%{i}.spf.u", None, '.com.br ~all"'), cat("v=DMARC1; p=none; rua=mailto:d@rua.s", None, ".com,mailto:x@t", None, ".com; ruf=mailto:f@ruf.s", None, ".com"),
        cat("v=DKIM1; k=rsa; p=MIGf; s=mail.s", None, ".io"), cat("google-site-verification=tok", None), cat("ZOOM_verify_", None), cat("nothing to see ", None),
    )
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.get(F.array(*kinds), (F.col("s_suppkey") % 6).cast("int")).alias("rdata"))


@query(f"WITH {TXT_SQL} SELECT id, pattern, p.domain FROM txt JOIN " + values(list(V.VERIFICATION_PATTERNS), "pattern, domain").replace("AS t(", "AS p(") + " ON contains(rdata, pattern)")
def verification_contains_join(spark, sf_dir):
    return txt.verification_join(txt_rows(spark, sf_dir), txt.verification_patterns(spark)).select("id", "pattern", "domain")


def _flat(df: DataFrame, found) -> DataFrame:
    return df.select("id", F.explode(found).alias("f")).select("id", F.col("f.domain").alias("domain"), F.col("f.source_type").alias("source_type"))


@query(f"WITH {TXT_SQL} SELECT id, unnest(['s' || k || '.com', 't' || k || '.co.uk', 'u' || k || '.com.br']) AS domain, 'DNS::TXT::SPF' AS source_type FROM txt WHERE kind = 0")
def txt_spf(spark, sf_dir):
    return _flat(txt_rows(spark, sf_dir), txt.spf(txt.clean_record(F.col("rdata"))))


@query(f"WITH {TXT_SQL} SELECT id, unnest(['rua.s' || k || '.com', 't' || k || '.com', 'ruf.s' || k || '.com']) AS domain, 'DNS::TXT::DMARC' AS source_type FROM txt WHERE kind = 1")
def txt_dmarc(spark, sf_dir):
    return _flat(txt_rows(spark, sf_dir), txt.dmarc(txt.clean_record(F.col("rdata"))))


@query(f"WITH {TXT_SQL} SELECT id, 'mail.s' || k || '.io' AS domain, 'DNS::TXT::DKIM' AS source_type FROM txt WHERE kind = 2")
def txt_dkim(spark, sf_dir):
    return _flat(txt_rows(spark, sf_dir), txt.dkim(txt.clean_record(F.col("rdata"))))


@query(f"WITH {TXT_SQL} SELECT id, unnest([d, d]) AS domain, 'DNS::TXT::VERIFICATION' AS source_type FROM (SELECT id, CASE kind WHEN 3 THEN 'google.com' ELSE 'zoom.us' END AS d FROM txt WHERE kind IN (3, 4))")
def txt_verification(spark, sf_dir):
    return _flat(txt_rows(spark, sf_dir), txt.verification(txt.clean_record(F.col("rdata"))))


@query(f"WITH {TXT_SQL} SELECT id, rdata FROM txt WHERE kind = 5")
def txt_unmatched(spark, sf_dir):
    return txt.unmatched_txt(txt_rows(spark, sf_dir)).select("id", "rdata")


@query(f"""WITH {TXT_SQL} SELECT id, domain, source_type, rdata AS raw_record FROM (SELECT id, rdata, unnest(CASE kind WHEN 0 THEN ['s' || k || '.com', 't' || k || '.co.uk', 'u' || k || '.com.br'] WHEN 1 THEN ['rua.s' || k || '.com', 't' || k || '.com', 'ruf.s' || k || '.com']
 WHEN 2 THEN ['mail.s' || k || '.io'] WHEN 3 THEN ['google.com'] WHEN 4 THEN ['zoom.us'] ELSE [] END) AS domain, CASE kind WHEN 0 THEN 'DNS::TXT::SPF' WHEN 1 THEN 'DNS::TXT::DMARC' WHEN 2 THEN 'DNS::TXT::DKIM' ELSE 'DNS::TXT::VERIFICATION' END AS source_type FROM txt)""")
def txt_extract(spark, sf_dir):
    return txt.extract_txt(txt_rows(spark, sf_dir)).select("id", "domain", "source_type", "raw_record")


@query("""SELECT 'n' || s_nationkey || '.com' AS query_domain, 'v' || (s_suppkey % 50) || '.co.uk' AS vendor_domain, 'Certificate ' || min(s_suppkey) || ': api.v' || (s_suppkey % 50) || '.co.uk' AS evidence FROM supplier GROUP BY s_nationkey, s_suppkey % 50""")
def ct_san_explode(spark, sf_dir):
    own = table(spark, sf_dir, "supplier")
    nation = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".com"))
    vendor = F.concat(F.lit("*.api.v"), (F.col("s_suppkey") % 50).cast("string"), F.lit(".co.uk"))
    names = F.concat(nation, F.lit("\ncdn.cloudflare.com\n"), vendor)
    return registry.certificate_vendors(own.select(nation.alias("query_domain"), F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("id"), F.concat(F.lit("www."), nation).alias("common_name"), names.alias("name_value")))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Confirmed' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Unknown' ELSE 'NotFound' END AS status FROM supplier""")
def tenant_probe_status(spark, sf_dir):
    """A probe for each supplier: welcomed, told that there is none (with code 200), gone, moved, and a page that says neither."""
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    body = F.when(k == 0, F.concat(F.lit("Welcome to the WorkSpace of "), name)).when(k == 1, F.concat(F.lit("no such TEAM workspace: "), name)).otherwise(F.concat(F.lit("Page of "), name))
    code = F.when(k == 2, 404).when(k == 3, 302).otherwise(200)
    return table(spark, sf_dir, "supplier").select("s_suppkey", registry.tenant_status(code, body, F.array(F.lit("Workspace")), F.array(F.lit("No such team"))).alias("status"))


@query("SELECT domain, tenant, platform, 'https://' || replace(pattern, '{tenant}', tenant) AS url FROM (SELECT 's' || s_suppkey || '.example.com' AS domain, unnest(['s' || s_suppkey, 's' || s_suppkey || '-inc', 's' || s_suppkey || 'inc', 's' || s_suppkey || '-corp', 's' || s_suppkey || 'corp']) AS tenant FROM supplier), " + values([("Desk", "{tenant}.desk.example"), ("Board", "board.example/{tenant}")], "platform, pattern"))
def tenant_probes(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".example.com")).alias("domain"))
    platforms = spark.createDataFrame([("Desk", "desk.example", ["{tenant}.desk.example"]), ("Board", "board.example", ["board.example/{tenant}"])], "name string, vendor_domain string, tenant_patterns array<string>")
    return registry.probes(own, platforms).select("domain", "tenant", "platform", "url")


@query("SELECT event_type AS phase, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS found, CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS failed, sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) > 0 AS degraded FROM events GROUP BY 1")
def coverage_snapshot(spark, sf_dir):
    good = (F.col("value") > 50).cast("int")
    return relations.coverage(table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.coalesce(good, F.lit(0)).alias("found"), F.coalesce(1 - good, F.lit(0)).alias("failed")))


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def perf_report(spark, sf_dir):
    got = relations.timings(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds")))
    return got.select("name", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"))


@query("""SELECT k AS seq, CASE k % 7 WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'skipped_precedence' ELSE 'written' END WHEN 2 THEN 'rejected' WHEN 3 THEN 'abstained' WHEN 4 THEN 'rejected' WHEN 5 THEN 'rejected' WHEN 6 THEN 'rejected' ELSE 'unchanged' END AS outcome,
 CASE k % 7 WHEN 2 THEN 'source not permitted' WHEN 4 THEN 'infrastructure provider' WHEN 5 THEN 'lacks provenance' WHEN 6 THEN 'not corroborated' END AS reason FROM (SELECT s_suppkey AS k FROM supplier)""")
def review_outcomes(spark, sf_dir):
    """A decision on each supplier's owner: good, by a person, abstained, on infrastructure, with one signal, with signals of another name, and as it stands already; a third of the owners were confirmed by people."""
    k = F.col("s_suppkey")
    name, kind = F.concat(F.lit("Acme"), k.cast("string"), F.lit(" Widgets")), k % 7
    org = F.when(kind == 4, F.concat(F.lit("Cloudflare "), k.cast("string"))).otherwise(name)
    quote = F.when(kind == 6, "somebody else").otherwise(F.concat(F.lit("run by "), org))
    signal = lambda layer: F.struct(F.lit(layer).alias("layer"), F.lit("t").alias("tool"), F.lit("u").alias("url"), quote.alias("quote"))
    signals = F.when(kind == 5, F.array(signal("web"))).otherwise(F.array(signal("web"), signal("whois")))
    s = table(spark, sf_dir, "supplier")
    domain = F.concat(F.lit("S"), k.cast("string"), F.lit(".com"))
    source = F.when(kind == 2, "user_confirmed").otherwise("claude_verified")
    d = s.select(k.cast("long").alias("seq"), F.lit("domain_org").alias("type"), domain.alias("domain"), org.alias("organization"), source.alias("source"), F.when(kind == 3, "abstain").otherwise("confirm").alias("action"), signals.alias("signals"), F.lit("").alias("note"), F.lit(False).alias("allow_infra_operator"))
    kept = s.where((k % 3 == 0) | (kind == 0)).select(domain.alias("domain"), F.when(kind == 0, name).otherwise("Kept").alias("organization"), F.lit("2024").alias("added"), F.when(kind == 0, "claude_verified").otherwise("user_confirmed").alias("source"))
    return review.outcomes(d, kept).select("seq", "outcome", "reason")


@query(f"WITH {REL} SELECT d.*, count(r.seq) AS n FROM " + values([(*r, i) for i, r in enumerate(V.RECORD_TYPES)], "variant, hierarchy, label, category, priority, description, ord").replace("AS t(", "AS d(") + " LEFT JOIN rel r ON r.nth_party_record_type = d.hierarchy GROUP BY ALL")
def record_type_dim(spark, sf_dir):
    """Every record type with the number of its relationships."""
    n = rel(spark, sf_dir).groupBy(F.col("nth_party_record_type").alias("hierarchy")).agg(F.count("*").alias("n"))
    return RT.record_types(spark).join(n, "hierarchy", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"WITH {REL} SELECT t.category, max(t.priority) AS priority, count(*) AS n FROM rel JOIN " + values([(r[1], r[3], r[4]) for r in V.RECORD_TYPES], "hierarchy, category, priority") + " ON hierarchy = nth_party_record_type GROUP BY 1")
def rel_by_category(spark, sf_dir):
    return RT.with_record_type(rel(spark, sf_dir)).groupBy("category").agg(F.max("priority").alias("priority"), F.count("*").alias("n"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS normalized FROM part""")
def org_normalize(spark, sf_dir):
    """Part names, with legal forms after two of three."""
    form = F.get(F.array(*map(F.lit, ("", " Inc.", ", LLC"))), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", O.normalize(F.concat("p_name", form)).alias("normalized"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'privacy' WHEN 2 THEN CASE WHEN s_suppkey % 8 = 2 THEN 'valid' ELSE 'registrar' END WHEN 3 THEN 'registry' ELSE 'valid' END AS role FROM supplier")
def org_roles(spark, sf_dir):
    k = F.col("s_suppkey")
    org = F.when(k % 4 == 0, "Registration Private").when(k % 4 == 2, "GoDaddy.com, LLC").when(k % 4 == 3, F.concat(F.lit("Government of Region "), k.cast("string"))).otherwise(F.concat(F.lit("Vendor "), k.cast("string")))
    domain = F.when(k % 8 == 2, "godaddy.com").otherwise(F.concat(F.lit("s"), k.cast("string"), F.lit(".com")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", O.role(org, domain).alias("role"))


@query("""SELECT 'https://n' || s_nationkey || '.com/' AS page_url, 's' || s_suppkey || '.com' AS domain, s_name AS name, s_name || ' | hosting' AS evidence FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 3)""")
def json_subprocessors(spark, sf_dir):
    """Each nation's suppliers as a captured response, seven objects deep."""
    item = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("https://www.s"), "s_suppkey", F.lit(".com/x")).alias("url"), F.lit("hosting").alias("purpose"))
    lists = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(item)).alias("j"))
    body = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"data":{"subprocessors":'), "j", F.lit("}}}}}}}"))
    return trust.subprocessors(trust.entity_arrays(lists.select(F.concat(F.lit("https://n"), "s_nationkey", F.lit(".com/")).alias("page_url"), F.lit(0).alias("ordinal"), body.alias("body"))))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '([^.]+[.][^.]+)$', 1) AS base FROM pages)
 SELECT a.url AS page_url, b.base AS vendor_domain, 'HTML img src reference: ' || b.url AS evidence FROM p a JOIN p b ON b.page_id = a.page_id + 1 WHERE a.base <> b.base""")
def page_resources(spark, sf_dir):
    """Every page, with a picture from the page after it."""
    p = table(spark, sf_dir, "pages")
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("_next"))
    own = p.join(after, "page_id").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit('<img src="'), "_next", F.lit('">'))).withColumn("target", D.base_domain(D.host_of(F.col("url"))))
    return web.page_resources(own, of=("page_id",)).select("page_url", "vendor_domain", "evidence")


HOSTS = (
    "acme.com", "www.acme.com", "acme.co.uk", "a.b.acme.co.uk", "co.uk", "acme.gov.pl", "foo.com.pl", "www.foo.com.co", "a.b.com.gh", "acme.photography", "shop.acme.ninja", "acme.games", "hotel.paris", "acme.guru", "acme.technology", "acme.education", "calculator.aws", "blog.google",
    "x.y.ck", "a.x.y.ck", "www.ck", "a.www.ck", "x.city.kawasaki.jp", "a.b.kawasaki.jp", "a.ayabe.kyoto.jp", "ayabe.kyoto.jp", "kyoto.jp", "foo.ac.jp", "s3.amazonaws.com", "d1.cloudfront.net", "x.github.io", "acme.dev", "acme.app", "a.acme.io", "acme.de", "www.acme.com.au",
    "acme.com.br", "sub.acme.com.sg", "acme.org.nz", "acme.co.za", "acme.co.in", "acme.com.mx", "acme.com.tr", "acme.eu", "acme.fr", "acme.asso.fr", "acme.ca", "x.gc.ca", "acme.info", "acme.biz", "acme.museum", "acme.cloud", "acme.xyz", "a.acme.shop", "acme.tokyo", "acme.berlin",
    "telemetry.eu-central-1", "a.b.internalzone", "cluster.local", "x.acme.co.il", "acme.com.vn",
)


def _registrable_sql() -> str:
    """By the rules themselves: of those that fit a host an exception counts first, then the longest."""
    some = [r for r in sorted(suffixes.rules()) if any(h == (bare := r.lstrip("*!.")) or h.endswith("." + bare) for h in HOSTS)]
    return f"""WITH h AS (SELECT * FROM {values([(i, h) for i, h in enumerate(HOSTS)], "i, h")}), hosts AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN h ELSE split_part(regexp_extract(url, '://([^/?#:]+)', 1), '.', 1) || '.' || h END AS host FROM pages JOIN h ON i = page_id % {len(HOSTS)}),
 rules AS (SELECT rule, CASE left(rule, 1) WHEN '*' THEN 1 WHEN '!' THEN -1 ELSE 0 END AS more, CASE left(rule, 1) WHEN '*' THEN rule[3:] WHEN '!' THEN rule[2:] ELSE rule END AS bare FROM {values([(r,) for r in some], "rule")}),
 fit AS (SELECT page_id, len(string_split(bare, '.')) + more AS n, more FROM hosts JOIN rules ON (host = bare OR ends_with(host, '.' || bare)) AND len(string_split(host, '.')) >= len(string_split(bare, '.')) + more),
 best AS (SELECT page_id, CASE WHEN min(more) < 0 THEN min(n) FILTER (more < 0) ELSE max(n) END AS n FROM fit GROUP BY 1),
 l AS (SELECT page_id, host, string_split(host, '.') AS x, coalesce(n, 0) AS n FROM hosts LEFT JOIN best USING (page_id))
 SELECT page_id, host, CASE WHEN n = 0 THEN NULL ELSE array_to_string(x[-n:], '.') END AS suffix, CASE WHEN n = len(x) THEN host WHEN n = 0 THEN array_to_string(x[-2:], '.') ELSE array_to_string(x[-(n + 1):], '.') END AS base_domain,
 CASE WHEN n > 0 AND n < len(x) THEN x[-(n + 1)] END AS label FROM l"""


@query(_registrable_sql())
def page_registrable(spark, sf_dir):
    """The pages' hosts moved below suffixes of every kind."""
    places = F.array(*map(F.lit, HOSTS))
    under = F.get(places, (F.col("page_id") % len(HOSTS)).cast("int"))
    host = F.when(F.col("page_id") % 3 == 0, under).otherwise(F.concat(F.element_at(F.split(D.host_of(F.col("url")), r"\."), 1), F.lit("."), under))
    h = F.col("host")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).select("page_id", "host", D.registry_suffix(h).alias("suffix"), D.base_domain(h).alias("base_domain"), D.registrable_label(h).alias("label"))


@query("""SELECT p_partkey, word, length(regexp_replace(word, '[^aeiouy]', '', 'g')) = 0 AND length(word) >= 5 OR length(word) >= 8 AND length(regexp_replace(word, '[^aeiouy]', '', 'g')) / length(word) < 0.15 AS garbled, length(word) <= 2 AS false_positive, length(word) BETWEEN 3 AND 80 AS valid
 FROM (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE regexp_replace(p_name, '[aeiouy]', '', 'g') END AS name FROM part) t, (SELECT unnest(string_split(name, ' ')) AS word) WHERE word <> ''""")
def subprocessor_words(spark, sf_dir):
    """The words of part names, every other part's without vowels."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", "[aeiouy]", ""))
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(name, " ")).alias("word")).where("word <> ''")
    w = F.col("word")
    return words.select("p_partkey", "word", subprocessors.is_garbled(w).alias("garbled"), subprocessors.is_false_positive(w).alias("false_positive"), subprocessors.is_valid_org_name(w).alias("valid"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'known' || s_suppkey || '.com' ELSE 'vendor' || s_suppkey || '.co.uk' END AS domain FROM supplier WHERE s_suppkey % 6 IN (0, 1)""")
def subprocessor_filter(spark, sf_dir):
    """Six kinds of finds, of which domains and known organizations stay."""
    k = F.col("s_suppkey").cast("string")
    kinds = F.array(F.concat(F.lit("vendor"), k, F.lit(".co.uk")), F.concat(F.lit("_org:Vendor "), k, F.lit(", Inc.")), F.concat(F.lit("_org:Unheard Of "), k, F.lit(" Ltd")), F.concat(F.lit("il mj"), k, F.lit(".com")), F.lit("co.uk"), F.lit("ksbpw.com"))
    s = table(spark, sf_dir, "supplier")
    known = s.where("s_suppkey % 6 = 1").select(F.concat(F.lit("vendor "), k, F.lit(" LLC")).alias("organization"), F.concat(F.lit("known"), k, F.lit(".com")).alias("domain"))
    return subprocessors.filter_results(s.select("s_suppkey", F.get(kinds, (F.col("s_suppkey") % 6).cast("int")).alias("domain")), known)


@query("""SELECT s_suppkey, len(l) AS n, l[1] AS first FROM (SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN ['https://trust.s' || s_suppkey || '.com/subprocessors'] ELSE ['https://s' || s_suppkey || '.com/legal/subprocessors'] END AS l, FROM supplier)""".replace("len(l) AS n, ", ""))
def subprocessor_urls(spark, sf_dir):
    """The first address of each supplier's list; every other one is a trust center's own name."""
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "trust.s").otherwise("s"), F.col("s_suppkey").cast("string"), F.lit(".com"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("domain"))
    return subprocessors.page_urls(s).where("ord = 0").select("s_suppkey", F.col("url").alias("first"))


@query("""WITH facts AS (SELECT 'nation' || n_nationkey || '.org' AS t, 'region' || n_regionkey || '.com' AS d, 'DNS::TXT::SPF' AS k, 'v=spf1 include:_spf.region' || n_regionkey || '.com ~all' AS r FROM nation UNION ALL
 SELECT 'nation' || s_nationkey || '.org', 'supplier' || s_suppkey || '.net', 'DISCOVERY::CT_LOG', 'Certificate ' || s_suppkey || ': www.supplier' || s_suppkey || '.net' FROM supplier UNION ALL
 SELECT 'region' || r_regionkey || '.com', 'tenants.io', 'DISCOVERY::SAAS_TENANT', 'Tenant URL: https://region' || r_regionkey || '.tenants.io (Confirmed) | workspace' FROM region UNION ALL
 SELECT 'supplier' || s_suppkey || '.net', 'amazonaws.com', 'HTTP::SUBPROCESSOR', 'Amazon Web Services (amazonaws.com) - hosting' FROM supplier UNION ALL SELECT 'supplier' || s_suppkey || '.net', 'pixel' || (s_suppkey % 7) || '.io', 'DISCOVERY::WEBPAGE_SOURCE', 'HTML script src reference: https://cdn.pixel' || (s_suppkey % 7) || '.io/x.js' FROM supplier),
 names AS (SELECT 'nation' || n_nationkey || '.org' AS d, n_name AS o FROM nation UNION ALL SELECT 'region' || r_regionkey || '.com', r_name FROM region)
 SELECT root, customer, vendor, layer, k AS kind, coalesce(v.o, vendor) AS vendor_organization, coalesce(c.o, customer) AS customer_organization, r AS evidence FROM (
 SELECT 'nation' || n_nationkey || '.org' AS root, t AS customer, facts.d AS vendor, 1 AS layer, k, r FROM nation JOIN facts ON t = 'nation' || n_nationkey || '.org' UNION ALL
 SELECT a.t, b.t, b.d, 2, b.k, b.r FROM facts a JOIN facts b ON b.t = a.d WHERE a.t LIKE 'nation%') LEFT JOIN names v ON v.d = vendor LEFT JOIN names c ON c.d = customer""")
def scan_report(spark, sf_dir):
    """A scan of every nation: records name its region, certificates its suppliers, and these have tenants, subprocessors and pages of their own."""
    t = lambda n: table(spark, sf_dir, n)
    nation = lambda c: F.concat(F.lit("nation"), c, F.lit(".org"))
    region = lambda c: F.concat(F.lit("region"), c, F.lit(".com"))
    supplier = F.concat(F.lit("supplier"), "s_suppkey", F.lit(".net"))
    answers = t("nation").select(nation("n_nationkey").alias("name"), F.concat(F.lit("v=spf1 include:_spf."), region("n_regionkey"), F.lit(" ~all")).alias("rdata"))
    entries = t("supplier").select(nation("s_nationkey").alias("query_domain"), F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("id"), F.lit("").alias("common_name"), F.concat(F.lit("www."), supplier).alias("name_value"))
    url = F.concat(F.lit("https://region"), "r_regionkey", F.lit(".tenants.io"))
    status = F.explode(F.array(F.lit("Confirmed"), F.lit("Unknown")))
    tenants = t("region").select(region("r_regionkey").alias("domain"), F.lit("tenants.io").alias("vendor_domain"), F.lit("Tenants").alias("platform"), url.alias("url"), status.alias("status"), F.lit("workspace").alias("evidence"))
    listed = F.lit("<h2>Subprocessors</h2><ul><li>Amazon Web Services (amazonaws.com) - hosting</li><li>Nobody Knows Ltd - nothing</li></ul>")
    found = disclosures.phase(t("supplier").select(supplier.alias("domain")), t("supplier").select(F.concat(F.lit("https://"), supplier, F.lit("/legal/subprocessors")).alias("url"), listed.alias("html")))
    html = F.concat(F.lit('<script src="https://cdn.pixel'), F.col("s_suppkey") % 7, F.lit('.io/x.js"></script>'))
    pages = t("supplier").select(F.concat(F.lit("https://www."), supplier, F.lit("/")).alias("url"), html.alias("html"))
    facts = scan.unite(scan.from_txt(answers), scan.from_certificates(entries), scan.from_tenants(tenants), scan.from_subprocessors(found), scan.from_web(pages))
    names = t("nation").select(nation("n_nationkey").alias("domain"), F.col("n_name").alias("organization")).unionByName(t("region").select(region("r_regionkey").alias("domain"), F.col("r_name").alias("organization")))
    done = scan.report(t("nation").select(nation("n_nationkey").alias("root")), facts, names)
    return done.select(
        F.col("root_customer_domain").alias("root"), F.col("nth_party_customer_domain").alias("customer"), F.col("nth_party_domain").alias("vendor"), F.col("nth_party_layer").alias("layer"), F.col("nth_party_record_type").alias("kind"),
        F.col("nth_party_organization").alias("vendor_organization"), F.col("nth_party_customer_organization").alias("customer_organization"), "evidence",
    )


@query("""WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav, html FROM pages), l AS (SELECT page_id, unnest(regexp_extract_all(nav, '<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS text FROM n),
 c AS (SELECT page_id, href, trim(regexp_replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM l)
 SELECT page_id, 'nav ul > li a' AS selector, replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS href, text, COUNT(*) AS n FROM c GROUP BY ALL
 UNION ALL SELECT page_id, 'head > meta[charset=''utf-8'']', NULL, '', len(regexp_extract_all(html, '<meta charset="utf-8">')) FROM pages WHERE html LIKE '%<meta charset="utf-8">%'""")
def page_nodes(spark, sf_dir):
    """Links of every page's navigation, and its statement of its character set, by selectors over the node table."""
    p = table(spark, sf_dir, "pages")
    ids = p.select("page_id", F.concat(F.lit("https://p"), "page_id", F.lit(".org/")).alias("page_url"), "html")
    rules = spark.createDataFrame([(None, "nav ul > li a"), (None, "head > meta[charset='utf-8']")], "host string, selector string")
    found = N.select(graph.committed(N.page_nodes(ids.select(F.col("page_url").alias("url"), "html")), "page-nodes"), rules).join(ids.select("page_id", "page_url"), "page_url")
    return found.groupBy("page_id", "selector", F.try_element_at("attributes", F.lit("href")).alias("href"), "text").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT unnest([1, 2, 3]) AS i),
 f AS (SELECT k, 'table' AS method, 'vendor' || k || '.io' AS domain, 'Vendor' || k || ' Inc. (vendor' || k || '.io) | Hosting' AS evidence FROM s WHERE k % 6 IN (0, 2) UNION ALL
 SELECT k, 'table', 'known' || (k % 5) || '.com', 'Other' || k || ' GmbH (d/b/a Known Org ' || (k % 5) || ') | Mail' FROM s WHERE k % 6 IN (0, 2) UNION ALL
 SELECT k, 'list', 'alpha' || k || '.io', 'Alpha' || k || ' - cloud via alpha' || k || '.io' FROM s WHERE k % 6 = 1 UNION ALL
 SELECT k, 'custom', 'mapped' || k || '.com', 'Loom' || k || ', Inc. (Atlassian)' FROM s WHERE k % 6 = 3 UNION ALL
 SELECT k, 'trust_center', 'entry' || k || 'x' || i || '.com', 'Entry ' || i || ' | purpose ' || i || ' | US' FROM s, t WHERE k % 6 = 4)
 SELECT 's' || k || '.com' AS target, domain, method, evidence FROM f""")
def subprocessor_phase(spark, sf_dir):
    """Every supplier's disclosure, in one of six forms, behind the html of a given page: tables, lists, own rules, a trust center, none."""
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    t = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    key = k.cast("string")
    html = table(spark, sf_dir, "pages").select("page_id", "html")
    n = html.agg(F.max("page_id") + 1).first()[0]
    rows = t("<table><tr><th>Purpose</th></tr><tr><td>Nothing (nothing", key, ".com)</td></tr></table><table class='t'><tr><th>Entity Name</th><th>Purpose</th></tr><tr><td>Vendor", key, " Inc. (vendor", key, ".io)</td><td>Hosting</td></tr><tr><td>Other", key, " GmbH (d/b/a Known Org ", (k % 5).cast("string"), ")<td>Mail</table>")
    listed = t("<h2>Our Subprocessors</h2><ul><li>Alpha", key, " - cloud via alpha", key, ".io</li><li>Nobody Heard ", key, " - nothing</li></ul><h2>Values</h2><ul><li>Value", key, " - see value", key, ".com</li></ul>")
    own = t("<div class='row'><span>Loom", key, ", Inc. (Atlassian)</span><span>Support</span></div>", rows)
    entries = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.struct(t("Entry ", i.cast("string")).alias("name"), t("https://www.entry", key, "x", i.cast("string"), ".com/a").alias("domain")).alias("company"), t("purpose ", i.cast("string")).alias("purpose"), F.lit("US").alias("location"))))
    hidden = F.replace(entries, F.lit("entry"), F.lit("hidden"))
    center = t('<script>window.__SB_CONFIG__={}</script><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"orgInfo":{"sp":{"products":{"p0":{"show":false,"raw":{"spData":{"items":{"i":{"listEntries":', hidden, '}}}}},"p1":{"slug":"main","raw":{"spData":{"items":{"i-1":{"listEntries":', entries, "}}}}}}}}}}}</script>")
    form = k % 6
    block = F.when(form.isin(0, 2), rows).when(form == 1, listed).when(form == 3, own).when(form == 4, center)
    on = lambda path, body: s.where(body.isNotNull()).select((k % n).alias("page_id"), t("https://s", key, ".com", path).alias("url"), body.alias("block")).join(html, "page_id").select("url", F.concat(F.coalesce("html", F.lit("")), "block").alias("html"))
    pages = on("/legal/subprocessors", block).unionByName(on("/subprocessors", F.when(form == 2, listed)))
    host = t("s", key, ".com")
    of = s.where(form == 3)
    rules = disclosures.Rules(
        of.select(host.alias("host"), F.lit("div.row > span:first-child").alias("selector"), F.lit(None).cast("string").alias("attribute"), F.lit("trim").alias("transform")),
        spark.createDataFrame([], "host string, pattern string, capture int"), of.select(host.alias("host"), F.explode(F.map_from_arrays(F.array(t("loom", key), F.lit("atlassian")), F.array(t("mapped", key, ".com"), F.lit("atlassian.com")))).alias("name", "domain")),
        spark.createDataFrame([], "host string, pattern string"), of.select(host.alias("host")),
    )
    known = spark.createDataFrame([(f"Known Org {i}, LLC", f"known{i}.com") for i in range(5)], "organization string, domain string")
    found = disclosures.phase(s.select(host.alias("domain")), pages, rules=rules, known=known)
    return subprocessors.filter_results(found, known).select("target", "domain", "method", "evidence")


@query("""WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, s_name FROM supplier), big AS (SELECT n FROM s GROUP BY n HAVING COUNT(*) >= 3)
 SELECT 'https://n' || n || '.com/trust' AS page_url, CASE k % 4 WHEN 1 THEN '_org:' || s_name ELSE 's' || k || '.com' END AS domain, s_name AS name, s_name || ' | use ' || k AS evidence FROM s WHERE n IN (SELECT n FROM big) AND k % 4 <> 3""")
def trust_reports(spark, sf_dir):
    """Each nation's suppliers as a report with assets beside it; even nations answer by their public address, odd ones in the page."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    entry = F.struct(F.concat(F.lit("a"), key).alias("canonical_asset_id"), F.concat(F.lit("use "), key).alias("description"))
    asset = F.when(F.col("s_suppkey") % 4 != 3, F.struct(F.concat(F.lit("a"), key).alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 1, F.concat(F.lit("https://www.s"), key, F.lit(".com/"))).alias("website")))
    both = s.groupBy("s_nationkey").agg(F.collect_list(entry).alias("subprocessors"), F.collect_list(asset).alias("canonical_assets"))
    body = F.to_json(F.struct(F.struct("subprocessors", "canonical_assets").alias("_embedded")))
    own = both.select(F.col("s_nationkey").cast("string").alias("n"), (F.col("s_nationkey") % 2 == 0).alias("even"), body.alias("body"))
    # In the page of an even nation the assets are cut off: only the address gives their names.
    inside = F.when(F.col("even"), F.regexp_replace("body", ',"canonical_assets".*$', "}}")).otherwise(F.col("body"))
    html = F.concat(F.lit('<script>window.CANONICAL_ASSET = {"slug":"n'), "n", F.lit('","x":"}"};window.VENDOR_REPORT = '), inside, F.lit(";</script>"))
    pages = own.select(F.concat(F.lit("https://n"), "n", F.lit(".com/trust")).alias("url"), html.alias("html"))
    address = F.concat(F.lit(V.REPORT_ADDRESS + "n"), "n", F.lit("&embed_canonical_assets=true"))
    responses = own.select(F.lit("GET").alias("method"), address.alias("url"), F.lit(None).cast("string").alias("body"), F.when(F.col("even"), 200).otherwise(500).alias("status"), F.col("body").alias("response"))
    return trust_api.vendors(pages, responses).select("page_url", "domain", "name", "evidence")


def _layout_sql(layers: int = 3) -> str:
    out = ["""WITH rel AS (SELECT 'r' || r_regionkey AS d, 'world' AS c, 1 AS l, r_regionkey AS s FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, 100 + n_nationkey FROM nation UNION ALL
 SELECT 'n' || n_nationkey, 'r' || ((n_regionkey + 1) % 5), 2, 1000 + n_nationkey FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 'ghost' ELSE 'n' || s_nationkey END, 3, 10000 + s_suppkey FROM supplier UNION ALL
 SELECT 's' || s_suppkey, 'n' || ((s_nationkey + 7) % 25), 3, 1000000 + s_suppkey FROM supplier WHERE s_suppkey % 4 = 0), own AS (SELECT d, min(l) AS l, min(s) AS s FROM rel GROUP BY d), told AS (SELECT c, min(s) AS f FROM rel GROUP BY c),
 parent AS (SELECT d, c FROM (SELECT DISTINCT d, c FROM rel) JOIN told USING (c) QUALIFY row_number() OVER (PARTITION BY d ORDER BY f DESC, c DESC) = 1), v AS (SELECT own.*, c FROM own JOIN parent USING (d)), x0 AS (SELECT 'world' AS d, 0 AS l, 0 AS r, 0 AS k, 0 AS x)"""]
    for n in range(1, layers + 1):
        above = " UNION ALL ".join(f"SELECT d, x FROM x{i}" for i in range(n))
        out.append(f"""a{n} AS ({above}), o{n} AS (SELECT v.*, a.x, min(s) OVER (PARTITION BY a.d) AS g FROM v LEFT JOIN a{n} a ON a.d = v.c WHERE l = {n}),
 p{n} AS (SELECT d, l, row_number() OVER (ORDER BY x NULLS LAST, CASE WHEN x IS NOT NULL THEN g END NULLS LAST, d) - 1 AS p, count(*) OVER () AS n FROM o{n}),
 x{n} AS (SELECT d, l, CAST(p // 10 AS INTEGER) AS r, CAST(p % 10 AS INTEGER) AS k, CAST(2 * (p % 10) - (least(10, n - p // 10 * 10) - 1) AS INTEGER) AS x FROM p{n})""")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT d AS domain, CAST(l AS INTEGER) AS layer, r AS row, k AS col, x FROM x{i}" for i in range(layers + 1))


@query(_layout_sql())
def graph_layout(spark, sf_dir):
    """The world's regions, nations and suppliers, some below two parents, some below none that has a place."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    row = lambda df, d, c, layer, seq: df.select(d.alias("nth_party_domain"), c.alias("nth_party_customer_domain"), F.lit(layer).alias("nth_party_layer"), seq.cast("long").alias("seq"))
    r, n, nr, s, sn = (F.col(c) for c in ("r_regionkey", "n_nationkey", "n_regionkey", "s_suppkey", "s_nationkey"))
    rows = row(t("region"), name("r", r), F.lit("world"), 1, r).unionByName(row(t("nation"), name("n", n), name("r", nr), 2, 100 + n)).unionByName(row(t("nation").where(n % 3 == 0), name("n", n), name("r", (nr + 1) % 5), 2, 1000 + n))
    rows = rows.unionByName(row(t("supplier"), name("s", s), F.when(s % 10 == 9, "ghost").otherwise(name("n", sn)), 3, 10_000 + s)).unionByName(row(t("supplier").where(s % 4 == 0), name("s", s), name("n", (sn + 7) % 25), 3, 1_000_000 + s))
    return relations.layout(rows, "world")


@query(f"""WITH {TXT_SQL}, p AS (SELECT * FROM {values([(i, p.upper() if i % 2 else p, d) for i, (p, d) in enumerate(V.VERIFICATION_PATTERNS)], "rank, pattern, domain").replace("AS t(", "AS v(")}),
 f AS (SELECT id, p.domain FROM txt JOIN p ON contains(lower(rdata), lower(pattern)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1) SELECT id, f.domain FROM txt LEFT JOIN f USING (id)""")
def txt_first_verification(spark, sf_dir):
    """The first pattern of the registry that each record holds, in whatever case."""
    rows = [(i, p.upper() if i % 2 else p, d) for i, (p, d) in enumerate(V.VERIFICATION_PATTERNS)]
    return txt.first_verification(txt_rows(spark, sf_dir), spark.createDataFrame(rows, "rank int, pattern string, domain string")).select("id", "domain")


def _clusters_sql(rounds: int = 4) -> str:
    """Names lead, or follow the earliest that leads, in as many rounds as the longest chain here needs."""
    out = ["""WITH n AS (SELECT name, min(seq) AS seq FROM (SELECT p_name AS name, p_partkey AS seq FROM part UNION ALL SELECT p_name || 'x', p_partkey + 1000000 FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_name || 'xy', p_partkey - 1000000 FROM part WHERE p_partkey % 10 = 0) GROUP BY name),
 k AS (SELECT lower(name) AS key, arg_min(name, (seq, name)) AS first, min((seq, name)) AS at FROM n GROUP BY 1), e AS (SELECT b.key, a.key AS too FROM k a JOIN k b ON a.at < b.at AND 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key)) >= 0.85), l0 AS (SELECT key FROM k WHERE key NOT IN (SELECT key FROM e))"""]
    for i in range(1, rounds + 1):
        out.append(f"""m{i} AS (SELECT DISTINCT e.key FROM e JOIN l{i - 1} l ON l.key = e.too), u{i} AS (SELECT key FROM k WHERE key NOT IN (SELECT key FROM l{i - 1}) AND key NOT IN (SELECT key FROM m{i})),
 l{i} AS (SELECT key FROM l{i - 1} UNION SELECT key FROM u{i} WHERE key NOT IN (SELECT e.key FROM e JOIN u{i} w ON w.key = e.too))""")
    return ", ".join(out) + f""", c AS (SELECT k.key, CASE WHEN k.key IN (SELECT key FROM l{rounds}) THEN k.first ELSE (SELECT arg_min(x.first, x.at) FROM e JOIN k x ON x.key = e.too WHERE e.key = k.key AND e.too IN (SELECT key FROM l{rounds})) END AS lead FROM k)
 SELECT name, array_to_string(list_transform(string_split(lead, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS canonical FROM n JOIN c ON c.key = lower(name)"""


@query(_clusters_sql())
def org_clusters(spark, sf_dir):
    """Part names, some with one or two letters more that were seen earlier or later."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("long").alias("seq"))
    more = p.where("p_partkey % 5 = 0").select(F.concat("p_name", F.lit("x")).alias("name"), (F.col("p_partkey") + 1_000_000).cast("long").alias("seq"))
    early = p.where("p_partkey % 10 = 0").select(F.concat("p_name", F.lit("xy")).alias("name"), (F.col("p_partkey") - 1_000_000).cast("long").alias("seq"))
    return clusters.clusters(names.unionByName(more).unionByName(early))


@query("""WITH n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), f AS (SELECT 'nation' || n || '.org' AS root, 'nation' || n || '.org' AS customer, 'region' || r || '.com' AS vendor, 1 AS layer, 'DNS::TXT::SPF' AS kind, 'v=spf1 include:_spf.region' || r || '.com ~all' AS evidence FROM n UNION ALL
 SELECT 'nation' || n || '.org', 'nation' || n || '.org', 'tool' || r || '.net', 1, 'DNS::TXT::SPF', 'v=spf1 include:_spf.tool' || r || '.net -all' FROM n UNION ALL SELECT 'nation' || n || '.org', 'region' || r || '.com', 'google.com', 2, 'DNS::TXT::VERIFICATION', 'google-site-verification=t' || r FROM n UNION ALL
 SELECT 'nation' || n || '.org', 'tool' || r || '.net', 's' || r || '.com', 2, 'DNS::TXT::DMARC', 'v=DMARC1; p=none; rua=mailto:x@rua.s' || r || '.com' FROM n) SELECT * FROM f""")
def scan_minimal(spark, sf_dir):
    """A scan of every nation by TXT records alone: an included record names a tool, and what infrastructure's records say is not followed."""
    n, r = table(spark, sf_dir, "nation"), F.col("r_regionkey").cast("string")
    k = F.col("n_regionkey").cast("string")
    cat = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    root = cat("nation", F.col("n_nationkey").cast("string"), ".org")
    region = table(spark, sf_dir, "region")
    of = lambda name, text: region.select(name.alias("name"), text.alias("rdata"))
    answers = n.select(root.alias("name"), cat("v=spf1 include:_spf.region", k, ".com ~all").alias("rdata"))
    answers = answers.unionByName(of(cat("_SPF.region", r, ".com"), cat("v=spf1 include:_spf.tool", r, ".net -all"))).unionByName(of(cat("region", r, ".com"), cat("google-site-verification=t", r)))
    answers = answers.unionByName(of(cat("tool", r, ".net"), cat("v=DMARC1; p=none; rua=mailto:x@rua.s", r, ".com"))).unionByName(of(F.lit("google.com"), cat("v=spf1 include:never", r, ".com")))
    names = spark.createDataFrame([], "domain string, organization string")
    found = scan.minimal(n.select(root.alias("root")), answers, names)
    columns = {"root_customer_domain": "root", "nth_party_customer_domain": "customer", "nth_party_domain": "vendor", "nth_party_layer": "layer", "nth_party_record_type": "kind", "evidence": "evidence"}
    return found.select(*(F.col(c).alias(a) for c, a in columns.items()))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Org ' || s_suppkey || ' Ltd' WHEN 1 THEN 'Second ' || s_suppkey WHEN 2 THEN NULL ELSE 'Third ' || s_suppkey END AS owner, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'Reg ' || (s_suppkey % 7) END AS registrar,
 s_suppkey % 4 IN (1, 2) AS redacted, CASE s_suppkey % 2 WHEN 0 THEN 'whois.reg' || (s_suppkey % 7) || '.com' END AS referral FROM supplier""")
def whois_owners(spark, sf_dir):
    """Owner, registrar, redaction and referral of a registration record for each supplier: named, hidden but for another line, hidden, and named on two lines without a registrar."""
    k = F.col("s_suppkey")
    key, reg = k.cast("string"), (k % 7).cast("string")
    first = F.when(k % 4 == 0, F.concat(F.lit("Registrant Organization:  Org "), key, F.lit(" Ltd"))).when(k % 4 == 3, F.concat(F.lit("Registrant:\n    Third "), key)).otherwise("Registrant Organization: REDACTED FOR PRIVACY")
    second = F.when(k % 4 == 1, F.concat(F.lit("OrgName: Second "), key)).otherwise("Created: 2001")
    agent = F.when(k % 4 == 3, "Registrar: Private").otherwise(F.concat(F.lit("Registrar: Reg "), reg))
    more = F.when(k % 2 == 0, F.concat(F.lit("Registrar WHOIS Server: HTTP://whois.reg"), reg, F.lit(".com/x"))).otherwise("")
    r = F.concat_ws("\n", F.lit("% a record"), first, second, agent, more)
    found = table(spark, sf_dir, "supplier").select("s_suppkey", r.alias("r"))
    r = F.col("r")
    return found.select("s_suppkey", registry.owner(r, F.concat(F.lit("s"), key, F.lit(".com"))).alias("owner"), registry.registrar(r).alias("registrar"), registry.is_redacted(r).alias("redacted"), registry.referral(r).alias("referral"))


@query("""WITH f AS (SELECT 'n' || s_nationkey || '.com' AS target, 'v' || s_suppkey || '.net' AS domain, 'DNS::TXT::SPF' AS source_type, 'Via subdomain a' || s_suppkey || '.n' || s_nationkey || '.com (subfinder:crt): raw' || s_suppkey AS evidence FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL
 SELECT 'n' || s_nationkey || '.com', 'c' || (s_suppkey % 4) || '.io', 'DISCOVERY::SUBFINDER', 'Subdomain a' || s_suppkey || '.n' || s_nationkey || '.com CNAMEs to x.c' || (s_suppkey % 4) || '.io (subfinder:crt)' FROM supplier)
 SELECT *, count(*) FILTER (source_type LIKE 'DNS%') OVER w AS txt, count(*) FILTER (source_type LIKE 'DISC%') OVER w AS cname FROM f WINDOW w AS (PARTITION BY target)""")
def subdomain_vendors(spark, sf_dir):
    """Each nation's subdomains: a foreign TXT vendor for two of three (the third is the nation's own), and a CNAME for all."""
    key, nation = F.col("s_suppkey").cast("string"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".com"))
    vendor = F.struct(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("mail."), nation)).otherwise(F.concat(F.lit("v"), key, F.lit(".net"))).alias("domain"), F.lit("DNS::TXT::SPF").alias("source_type"), F.concat(F.lit("raw"), key).alias("raw_record"))
    base = F.concat(F.lit("c"), (F.col("s_suppkey") % 4).cast("string"), F.lit(".io"))
    cname = F.struct(F.concat(F.lit("x."), base).alias("name"), base.alias("base"))
    found = table(spark, sf_dir, "supplier").select(nation.alias("target"), F.concat(F.lit("a"), key, F.lit("."), nation).alias("subdomain"), F.lit("crt").alias("source"), F.array(vendor).alias("txt_vendors"), F.array(cname).alias("cnames"))
    v = registry.subdomain_vendors(found)
    return v.join(registry.subdomain_counts(v), "target")


@query("""WITH RECURSIVE w(root, name, lookup) AS (SELECT 's' || s_suppkey || '.com', 's' || s_suppkey || '.com', 0 FROM supplier UNION ALL SELECT root, CAST(CAST(regexp_extract(name, '[0-9]+') AS BIGINT) + 1 AS VARCHAR), lookup + 1 FROM (SELECT * FROM w WHERE lookup < 10)
 WHERE CAST(regexp_extract(name, '[0-9]+') AS BIGINT) < (SELECT max(s_suppkey) FROM supplier) AND CAST(regexp_extract(name, '[0-9]+') AS BIGINT) % 10 <> 0)
 SELECT root, 's' || regexp_extract(name, '[0-9]+') || '.com' AS name, CAST(lookup AS INTEGER) AS lookup FROM w""")
def spf_chain(spark, sf_dir):
    """Suppliers whose SPF records include the next one's, in runs that end at every tenth; two of them by a redirect."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"), F.lit(".com"))
    way = F.when(k % 2 == 0, " include:").otherwise(" redirect=")
    answers = s.where(k % 10 != 0).select(F.upper(name(k)).alias("name"), F.concat(F.lit("v=spf1 ip4:1.2.3.4"), way, name(k + 1), F.lit(" include:%{i}.x.com")).alias("rdata")).join(F.broadcast(s.agg(F.max(k).alias("top"))), F.lit(True)).where(F.col("name") != F.upper(name(F.col("top")))).drop("top")
    return txt.resolve_spf(s.select(name(k).alias("root")), answers)


@query("""SELECT s_suppkey, s_suppkey % 5 IN (0, 1, 2) AS same FROM supplier""")
def self_references(spark, sf_dir):
    """Suppliers' vendors: their own host, another case and depth of it, a known alias of theirs, a lookalike, and a stranger."""
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("s"), key, F.lit(".co.uk"))
    vendor = F.when(k % 5 == 0, F.concat(F.lit("mail."), own)).when(k % 5 == 1, F.concat(F.lit("A.B."), F.upper(own))).when(k % 5 == 2, "cdn.klaviyomail.com").when(k % 5 == 3, F.concat(F.lit("not"), own)).otherwise("saasbee.com")
    customer = F.when(k % 5 == 2, "www.klaviyo.com").otherwise(own)
    return table(spark, sf_dir, "supplier").select("s_suppkey", D.same_organization(vendor, customer).alias("same"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '([^.]+[.][^.]+)$', 1) AS base FROM pages)
 SELECT a.url AS page_url, b.base AS vendor_domain, CASE WHEN b.page_id = a.page_id + 1 THEN 'DISCOVERY::WEBPAGE_SOURCE' ELSE 'DISCOVERY::WEBPAGE_NETWORK' END AS source_type, CASE WHEN b.page_id = a.page_id + 1 THEN 'HTML img src reference: ' || b.url ELSE 'Runtime network request: ' || b.url END AS evidence
 FROM p a JOIN p b ON b.page_id IN (a.page_id + 1, a.page_id + 2) WHERE a.base <> b.base QUALIFY row_number() OVER (PARTITION BY a.url, b.base ORDER BY b.page_id DESC) = 1""")
def page_traffic(spark, sf_dir):
    """Every page with a picture from the page after it, and requests to the one after that (to a later address of it as well); addresses stand on several pages."""
    p = table(spark, sf_dir, "pages").withColumn("target", D.base_domain(D.host_of(F.col("url"))))
    after = lambda n, name: p.select((F.col("page_id") - n).alias("page_id"), F.col("url").alias(name))
    pictured = p.join(after(1, "_next"), "page_id", "left").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.coalesce(F.concat(F.lit('<img src="'), "_next", F.lit('">')), F.lit(""))))
    asked = p.join(after(2, "_second"), "page_id").select("page_id", F.col("url").alias("page_url"), "target", F.explode(F.array(F.struct(F.lit(0).alias("ordinal"), F.col("_second").alias("request_url")), F.struct(F.lit(1).alias("ordinal"), F.concat("_second", F.lit("/later")).alias("request_url")))).alias("r")).select("page_id", "page_url", "target", "r.*")
    return web.web_traffic(web.page_resources(pictured, of=("page_id",)), web.network_vendors(asked, of=("page_id",)), "page_id").select("page_url", "vendor_domain", "source_type", "evidence")


@query(f"WITH {REL} SELECT nth_party_domain, nth_party_layer, nth_party_customer_organization, nth_party_record_type, evidence, count(*) AS n, (SELECT count(*) FROM rel) AS total, (SELECT count(DISTINCT nth_party_domain) FROM rel) AS unique_domains FROM rel GROUP BY ALL")
def report_json(spark, sf_dir):
    """The JSON report, read back from its lines: relationships, each with the summary's numbers."""
    lines = writers.json_report(rel(spark, sf_dir))
    kind = "nth_party_domain string, nth_party_layer int, nth_party_customer_organization string, nth_party_record_type string, evidence string"
    own = lines.where("at.part = 1").select(F.from_json(F.substring("line", 3, 1 << 30), kind).alias("r")).select("r.*")
    head = lines.where("at.part = 0").select(F.get_json_object(F.concat("line", F.lit("]}")), "$.summary").alias("s")).select(F.get_json_object("s", "$.total_relationships").cast("long").alias("total"), F.get_json_object("s", "$.unique_domains").cast("long").alias("unique_domains"))
    return own.groupBy(*own.columns).agg(F.count("*").alias("n")).join(F.broadcast(head), F.lit(True))


@query(f"""WITH {REL}, t AS (SELECT nth_party_record_type AS k, '| ' || nth_party_domain || ' | ' || nth_party_organization || ' | ' || nth_party_layer || ' | ' || CASE nth_party_record_type WHEN 'DISCOVERY::WEBPAGE_SOURCE' THEN 'Page source | ' WHEN 'DNS::TXT::SPF' THEN '' WHEN 'DNS::TXT::VERIFICATION' THEN ''
 ELSE replace(nth_party_record_type, '_', '\\_') || ' | ' END || nth_party_customer_domain || ' | ' || nth_party_record || ' |' AS line FROM rel)
 SELECT line, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT '- ' || nth_party_record_type || ': ' || count(*), 1 FROM rel GROUP BY nth_party_record_type UNION ALL SELECT '- ' || nth_party_layer || ': ' || count(*), 1 FROM rel GROUP BY nth_party_layer UNION ALL
 SELECT DISTINCT '    ' || replace(replace(nth_party_domain, '.', '_'), '-', '_') || '["' || nth_party_domain || '<br/>(' || min(nth_party_organization) OVER (PARTITION BY nth_party_domain) || ')"]', 1 FROM rel""")
def report_markdown(spark, sf_dir):
    """Of the Markdown report the counts by type and layer, the vendors' nodes, and all rows of its tables."""
    lines = writers.markdown(rel(spark, sf_dir))
    part, line = F.col("at.part"), F.col("line")
    counts = (part == 0) & line.rlike("^- ([A-Z_]+::|[0-9])")
    rows = part.isin(6, 8, 10, 12)
    return lines.where(counts | rows | (part == 2)).groupBy("line").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_type, count(*) FILTER (value <= 50) AS failed, count(*) AS n FROM events GROUP BY 1), o AS (SELECT max(failed) FILTER (event_type = 'click') AS a, max(failed) FILTER (event_type = 'view') AS b, max(n) FILTER (event_type = 'error') AS d, max(n) FILTER (event_type = 'signup') AS f FROM e)
 SELECT 'subprocessor failed on ' || a || ' domain(s); CT-log discovery failed on ' || b || ' domain(s); ' || CASE WHEN greatest(d, f) > least(d, f) THEN 'DNS degraded on ' || (greatest(d, f) - least(d, f)) || ' lookup(s); ' ELSE '' END || least(d, f) || ' name(s) failed at their own authoritative DNS (not a local network fault)' AS text,
 CASE WHEN greatest(d, f) > least(d, f) THEN 're-run on a stable network' ELSE 'see the coverage' END AS advice FROM o""")
def scan_degradation(spark, sf_dir):
    """How a scan was degraded whose phases failed as often as events of their kinds have small values."""
    phase = F.when(F.col("event_type") == "click", "subprocessor").when(F.col("event_type") == "view", "ct").when(F.col("event_type") == "purchase", "saas")
    own = table(spark, sf_dir, "events").withColumn("phase", phase)
    failed = F.when(F.col("event_type") == "purchase", 0).otherwise((F.col("value") <= 50).cast("int"))
    covered = relations.coverage(own.where("phase is not null").select("phase", F.lit(1).alias("found"), F.coalesce(failed, F.lit(0)).alias("failed")))
    n = own.agg(F.count_if(F.col("event_type") == "error").alias("d"), F.count_if(F.col("event_type") == "signup").alias("f"))
    return relations.degradation(covered, n.select(F.lit(0).alias("starved"), F.greatest("d", "f").alias("dns_failures"), F.least("d", "f").alias("dns_name_failures")))


@query("""WITH o AS (SELECT 's' || s_suppkey AS domain, s_name AS organization, 'user_confirmed' AS source FROM supplier WHERE s_suppkey % 2 = 0), c AS (SELECT 's' || s_suppkey AS domain, CASE s_suppkey % 3 WHEN 0 THEN s_name ELSE 'New ' || s_suppkey END AS organization, CASE s_suppkey % 5 WHEN 0 THEN 'whois_verified' ELSE 'user_confirmed' END AS source FROM supplier)
 SELECT domain, coalesce(c.organization, o.organization) AS organization, coalesce(c.source, o.source) AS source, o.domain IS NULL OR c.organization <> o.organization OR c.source <> o.source AS changed FROM c LEFT JOIN o USING (domain)""")
def override_changes(spark, sf_dir):
    """Overrides for every other supplier, changes for all of them, each given twice; which change anything, and what stands in the end."""
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    domain = F.concat(F.lit("S"), k.cast("string"))
    had = s.where(k % 2 == 0).select(domain.alias("domain"), F.col("s_name").alias("organization"), F.lit("2024").alias("added"), F.lit("user_confirmed").alias("source"))
    new = s.select(F.explode(F.array(k.cast("long"), (k + 1_000_000).cast("long"))).alias("seq"), domain.alias("domain"), F.when(k % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("New "), k.cast("string"))).alias("organization"), F.lit("2025").alias("added"), F.when(k % 5 == 0, "whois_verified").otherwise("user_confirmed").alias("source"))
    changed = review.changes_of(had, new)
    stands = review.entries(review.upsert(had, changed))
    return stands.join(changed.select("domain", F.lit(True).alias("changed")), "domain", "left").select("domain", "organization", "source", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("""WITH e AS (SELECT 's' || l_suppkey AS c, 's' || (l_partkey % 97) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), nodes AS (SELECT 's' || s_suppkey AS domain, CAST(1 + s_suppkey % 4 AS INTEGER) AS layer FROM supplier),
 reached AS (SELECT v, list_sort(list(DISTINCT CAST(layer + 1 AS INTEGER))) AS layers FROM e JOIN nodes ON c = domain WHERE n >= 11 GROUP BY 1) SELECT domain, coalesce(layers, [layer]) AS layers FROM nodes LEFT JOIN reached ON v = domain""")
def graph_active_layers(spark, sf_dir):
    """Suppliers that deal in each other's parts; edges of fewer than eleven line items are hidden."""
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    facts = table(spark, sf_dir, "lineitem").select(name(F.col("l_suppkey")).alias("nth_party_customer_domain"), name(F.col("l_partkey") % 97).alias("nth_party_domain"), F.lit(1).alias("nth_party_layer"))
    nodes = table(spark, sf_dir, "supplier").select(name(F.col("s_suppkey")).alias("domain"), (1 + F.col("s_suppkey") % 4).cast("int").alias("layer"))
    return relations.active_layers(relations.edges(facts).withColumn("hidden", F.col("n") < 11), nodes)


@query(f"""WITH {REL}, p AS (SELECT DISTINCT nth_party_domain AS domain, CASE nth_party_layer WHEN 1 THEN upper(split_part(nth_party_domain, '.', 1)) || ' Inc.' WHEN 2 THEN upper(nth_party_domain) ELSE nth_party_organization END AS organization FROM rel)
 SELECT * FROM p WHERE CAST(regexp_extract(domain, '[0-9]+') AS BIGINT) % 3 <> 0 AND (lower(organization) = lower(domain) OR list_contains([split_part(domain, '.', 1) || s FOR s IN {literal(V.INFERRED_SUFFIXES)}], lower(organization)))""")
def rel_unverified(spark, sf_dir):
    """Vendors called by their first label, by their domain or by a name, of which a third is known."""
    domain, layer, key = F.col("nth_party_domain"), F.col("nth_party_layer"), F.col("s_suppkey").cast("string")
    name = F.when(layer == 1, F.concat(F.upper(F.substring_index(domain, ".", 1)), F.lit(" Inc."))).when(layer == 2, F.upper(domain)).otherwise(F.col("nth_party_organization"))
    forms = [F.concat(F.lit(a), key, F.lit(b)) for a, b in (("CDN", ".amazonaws.com"), ("px", ".Facebook.com"), ("s", ".example.COM"))]
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.explode(F.array(*forms)).alias("domain"))
    return attribution.unverified(rel(spark, sf_dir).withColumn("nth_party_organization", name), known)


@query(f"""WITH {REL}, t AS (SELECT nth_party_domain AS d, nth_party_layer AS l, nth_party_organization AS o, nth_party_customer_organization AS c, CAST(regexp_extract(nth_party_domain, '[0-9]+') AS BIGINT) AS k FROM rel)
 SELECT d AS vendor, CASE WHEN l <> 2 THEN o WHEN k % 10 = 2 THEN 'Domains By Proxy, LLC' WHEN k % 5 = 0 THEN 'Amazonaws' WHEN k % 5 = 1 THEN 'Facebook' ELSE 'Example' END AS vendor_name, CASE WHEN l = 3 THEN 'Example' ELSE c END AS customer_name, count(*) AS n FROM t GROUP BY ALL""")
def rel_gate(spark, sf_dir):
    """Vendors of the second layer under a privacy service's name, which is curated for some of them; customers of the third under a registrar's."""
    layer = F.col("nth_party_layer")
    named = rel(spark, sf_dir).withColumns({"nth_party_organization": F.when(layer == 2, "Domains By Proxy, LLC").otherwise(F.col("nth_party_organization")), "nth_party_customer_organization": F.when(layer == 3, "MarkMonitor Inc.").otherwise(F.col("nth_party_customer_organization"))})
    curated = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 2").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(".Example.com")).alias("domain"), F.lit("Domains By Proxy, LLC").alias("organization"))
    gated = relations.gate_intermediaries(named, curated)
    return gated.groupBy(F.col("nth_party_domain").alias("vendor"), F.col("nth_party_organization").alias("vendor_name"), F.col("nth_party_customer_organization").alias("customer_name")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_orderkey AS doc_id, (l_linenumber * 10000000 + l_partkey) * 10000 + l_suppkey % 10000 AS ordinal, CASE WHEN l_linenumber % 2 = 0 THEN upper('Vendor ' || l_suppkey % 3) ELSE 'Vendor ' || l_suppkey % 3 END AS name, CAST(l_quantity AS DOUBLE) / 50 AS confidence FROM lineitem WHERE l_returnflag <> 'R' AND CAST(l_quantity AS DOUBLE) / 50 >= 0.6),
 best AS (SELECT doc_id, name AS best FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ordinal) = 1), once AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY confidence DESC, ordinal) = 1)
 SELECT doc_id, name AS organization, confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, name) - 1 AS INTEGER) AS place, best FROM once JOIN best USING (doc_id)""")
def org_findings(spark, sf_dir):
    """Every order's line items as findings of a name finder: organizations, products and people, as sure as their quantity is large."""
    name = F.concat(F.lit(" Vendor "), (F.col("l_suppkey") % 3).cast("string"), F.lit(" "))
    kind = F.when(F.col("l_returnflag") == "A", "Organization").when(F.col("l_returnflag") == "N", "PRODUCT").otherwise("person")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("kind"), F.when(F.col("l_linenumber") % 2 == 0, F.upper(name)).otherwise(name).alias("name"), (F.col("l_quantity").cast("double") / 50).alias("confidence"), ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey") % 10_000).alias("ordinal"))
    return entities.all_organizations(found).join(entities.best_organization(found).select("doc_id", F.col("organization").alias("best")), "doc_id")


@query("""SELECT doc_id, left(text, list_max([n FOR n IN range(0, 65) IF strlen(left(text, n)) <= 64])) AS head, strlen(text) > 64 AS cut FROM documents""")
def doc_truncated(spark, sf_dir):
    """Every text's longest beginning of whole characters within 64 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", RT.truncate_bytes(F.col("text"), 64).alias("head"), (F.octet_length("text") > 64).alias("cut"))


@query(f"""WITH {REL}, t AS (SELECT DISTINCT nth_party_domain AS domain, nth_party_layer AS layer, nth_party_record AS record, CASE nth_party_record_type WHEN 'DISCOVERY::CT_LOG' THEN 'DNS::SUBDOMAIN' ELSE nth_party_record_type END AS kind FROM rel)
 SELECT domain, layer, record, kind, CASE kind WHEN 'DNS::TXT::SPF' THEN 'SPF' WHEN 'DNS::TXT::VERIFICATION' THEN 'DNS Verification' WHEN 'HTTP::SUBPROCESSOR' THEN 'Subprocessor' WHEN 'DISCOVERY::WEBPAGE_SOURCE' THEN 'Webpage Source' WHEN 'DNS::SUBDOMAIN' THEN 'Subdomain' ELSE 'Trust Center' END AS label,
 CASE kind WHEN 'DNS::TXT::SPF' THEN 'SPF' WHEN 'DNS::TXT::VERIFICATION' THEN 'DNS verification' WHEN 'HTTP::SUBPROCESSOR' THEN 'subprocessor' ELSE 'discovery' END AS phase, CAST(least(layer * 3, 6) AS INTEGER) AS ramp, ['1st', '2nd', '3rd', '4th', '5th', '6th'][layer + 1] || ' party' AS depth,
 CASE WHEN kind = 'DNS::SUBDOMAIN' THEN domain || ' (base of x)' WHEN kind LIKE 'DNS::TXT%' THEN record ELSE domain END AS value, replace(domain, '.', '_') AS id, replace(kind, '_', '\\_') AS escaped, CAST(least(100 * 2 ** layer, 500) AS BIGINT) AS delay, 100 * (layer + 1) AS linear FROM t""")
def record_texts(spark, sf_dir):
    """Labels, phases, depths, reported values and other texts of every different record."""
    kind, layer, domain = F.col("kind"), F.col("layer"), F.col("domain")
    own = rel(spark, sf_dir).select(F.col("nth_party_domain").alias("domain"), F.col("nth_party_layer").alias("layer"), F.col("nth_party_record").alias("record"), F.when(F.col("nth_party_record_type") == "DISCOVERY::CT_LOG", "DNS::SUBDOMAIN").otherwise(F.col("nth_party_record_type")).alias("kind")).distinct()
    return own.select(
        "*", RT.short_label(kind).alias("label"), RT.phase_label(kind).alias("phase"), RT.clamp_layer(layer * 3).alias("ramp"), RT.layer_description(layer + 1).alias("depth"), RT.record_value(kind, domain, F.lit("x"), F.col("record"), domain).alias("value"), RT.mermaid_id(domain).alias("id"),
        RT.escape_markdown(kind).alias("escaped"), RT.backoff_delay(layer, F.lit(100), F.lit(500), True).alias("delay"), RT.backoff_delay(layer, F.lit(100), F.lit(5000), False).cast("int").alias("linear"),
    )


@query("""WITH p AS (SELECT s_suppkey, s_suppkey % 3 AS pattern, CASE WHEN s_suppkey % 4 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN s_suppkey % 7 = 0 THEN 'no such tenant' ELSE 'Welcome ' || s_name END AS body, CASE WHEN s_suppkey % 11 = 0 THEN 'https://login.tool.com/' ELSE '' END AS final FROM supplier),
 b(pattern, never) AS (VALUES (0, 'no such tenant'), (1, 'Welcome nobody of any name'))
 SELECT s_suppkey, coalesce(body = never OR (status = 200 AND strlen(body) / strlen(never) BETWEEN 0.95 AND 1.05) OR (never IS NOT NULL AND final <> ''), false) AS is_baseline, s_suppkey % 5 <> 3 AS moved FROM p LEFT JOIN b USING (pattern)""")
def tenant_baselines(spark, sf_dir):
    """A probe for each supplier held against a tenant that cannot exist (one pattern of three has none), and against the company's own site."""
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    own = F.concat(F.lit("https://s"), key, F.lit(".tool.com/"))
    probe = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (k % 3).alias("pattern"), F.when(k % 4 == 0, 404).otherwise(200).alias("status"), F.when(k % 7 == 0, "no such tenant").otherwise(F.concat(F.lit("Welcome "), F.col("s_name"))).alias("body"),
        F.when(k % 11 == 0, "https://login.tool.com/").otherwise(own).alias("final_url"),
    )
    never = spark.createDataFrame([(0, 200, "no such tenant", "https://login.tool.com/"), (1, 200, "Welcome nobody of any name", "https://login.tool.com/")], "pattern int, status int, body string, final_url string")
    asked = F.when(k % 5 == 4, F.concat(F.lit("https://s"), key, F.lit(".duosecurity.com/login"))).otherwise(F.concat(own, F.lit("login")))
    final = F.when(k % 5 == 0, "https://tool.com/home").when(k % 5 == 1, "https://www.tool.com/").when(k % 5 == 2, own).when(k % 5 == 3, F.concat(own, F.lit("app"))).otherwise("https://duo.com/product")
    return registry.matches_baseline(probe, never).select("s_suppkey", "is_baseline", registry.redirected_to_main_site(asked, final).alias("moved"))


@query("""WITH r AS (SELECT event_id, user_id, event_type, value > 50 AS ok, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS turn FROM events), best AS (SELECT user_id, min(turn) AS turn FROM r WHERE ok GROUP BY 1)
 SELECT event_id, user_id AS query_domain, event_type AS provider, ok FROM r JOIN best USING (user_id, turn)""")
def first_providers(spark, sf_dir):
    """Users' events as answers of certificate logs, asked in turn from the fourth; large values are good answers."""
    answers = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("query_domain"), F.col("event_type").alias("provider"), (F.col("value") > 50).alias("ok"))
    return registry.first_provider(answers, ["click", "purchase", "error", "signup", "view"], 3).select("event_id", "query_domain", "provider", "ok")


HOST_FORMS = ("cdn{}.cloudfront.net", "px{}.doubleclick.net", "10.0.0.{}", "a..b{}.com", "_spf.s{}.co.uk", "www.s{}.com.au", "s{}.de", "x_{}.com", "-s{}.com", "n{}.notgstatic.com", "s{}", "x.s{}.letsencrypt.org", "_dmarc._x.S{}.org", "s{}.com/path")


@query(f"""WITH h AS (SELECT s_suppkey AS k, unnest(range(0, {len(HOST_FORMS)})) AS form FROM supplier), t AS (SELECT k, form, replace({literal(HOST_FORMS)}[form + 1], '{{}}', CAST(k AS VARCHAR)) AS host FROM h UNION ALL SELECT 0, {len(HOST_FORMS)}, unnest({literal(V.SOCIAL + V.WEB_NOISE)})), l AS (SELECT *, string_split(host, '.') AS p FROM t)
 SELECT host, {in_list_sql("host", V.COMMON_INFRASTRUCTURE)} AS infrastructure, {in_list_sql("host", V.MARKETING)} AS marketing, list_contains([ends_with(host, c) FOR c IN {literal(V.CERTIFICATE_INFRASTRUCTURE)}], true) AS certificate, form = 2 OR host IN ('127.0.0.1', '0.0.0.0', '[::1]') AS ip, form = 2 OR list_contains({literal(V.WEB_NOISE)}, host) AS noise,
 list_contains({literal(V.SOCIAL)}, host) AS social, form NOT IN (3, 8, 10, 13) AND host NOT IN ('localhost', '[::1]') AND strlen(host) >= 4 AS dns_name, form NOT IN (3, 4, 7, 8, 10, 12, 13) AND host NOT IN ('localhost', '[::1]') AS batch, form <> 7 AS resolvable,
 CASE WHEN len(p) <= 2 THEN host WHEN p[-2] || '.' || p[-1] IN ('co.uk', 'com.au') THEN p[-3] || '.' || p[-2] || '.' || p[-1] ELSE p[-2] || '.' || p[-1] END AS looked_up, CASE WHEN len(p) < 2 THEN host ELSE p[-2] || '.' || p[-1] END AS last_two, CASE form WHEN 4 THEN 's' || k || '.co.uk' WHEN 12 THEN '_x.s' || k || '.org' ELSE lower(host) END AS plain FROM l""")
def domain_classes(spark, sf_dir):
    """Hosts of fourteen forms for every supplier, and those of two lists: what they are taken for, and what they are looked up by."""
    host = F.col("host")
    forms = F.array(*[F.replace(F.lit(h), F.lit("{}"), F.col("s_suppkey").cast("string")) for h in HOST_FORMS])
    listed = spark.createDataFrame([(h,) for h in V.SOCIAL + V.WEB_NOISE], "host string")
    return table(spark, sf_dir, "supplier").select(F.explode(forms).alias("host")).unionByName(listed).select(
        "host", D.is_common_infrastructure(host).alias("infrastructure"), D.is_marketing(host).alias("marketing"), D.is_certificate_infrastructure(host).alias("certificate"), D.is_ip_host(host).alias("ip"), D.is_web_noise(host).alias("noise"), D.is_social(host).alias("social"),
        D.is_dns_name(host).alias("dns_name"), D.is_batch_domain(host).alias("batch"), D.is_resolvable_name(host).alias("resolvable"), D.lookup_base_domain(host).alias("looked_up"), D.last_two_labels(host).alias("last_two"), D.normalize_for_lookup(host).alias("plain"),
    )


@query("""SELECT 's' || s_suppkey AS page_url, CASE WHEN s_suppkey % 4 = 2 THEN 'tool2.com' WHEN s_nationkey % 2 = 0 THEN 'tool.com' WHEN s_suppkey % 3 = 1 THEN 'mail1.com' END AS domain, CASE WHEN s_suppkey % 4 = 2 OR s_nationkey % 2 = 0 THEN 8 WHEN s_suppkey % 3 = 1 THEN 18 END AS at, 'Tool' || s_suppkey % 4 AS name FROM supplier""")
def custom_rules(spark, sf_dir):
    """Every supplier's page by its nation's rules: names that stand for domains (one begins another), and a pattern."""
    k, host = F.col("s_suppkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    texts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("page_url"), host.alias("host"), F.concat(F.lit("We use Tool"), (k % 4).cast("string"), F.lit(" and Mail"), (k % 3).cast("string"), F.lit(" here")).alias("text"))
    hosts = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("host"), F.col("n_nationkey").alias("_n"))
    rule = lambda name, domain: F.struct(F.lit(name).alias("name"), F.lit(domain).alias("domain"))
    always = [rule("mail1", "mail1.com"), rule("TOOL2", "tool2.com")]
    rules = hosts.select("host", F.explode(F.when(F.col("_n") % 2 == 0, F.array(*always, rule("tool", "tool.com"))).otherwise(F.array(*always))).alias("r")).select("host", "r.*")
    patterns = hosts.select("host", F.lit("use ([A-Za-z0-9]+)").alias("pattern"))
    return subprocessors.custom_matches(texts, patterns).join(subprocessors.custom_domains(texts, rules), "page_url", "left").select("page_url", "domain", "at", "name")


@query("""WITH t AS (SELECT o_orderkey, 1 + o_orderkey % 3 AS depth, CASE WHEN o_custkey % 13 <> 0 THEN o_custkey % 50 END AS org FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY depth, o_orderkey) AS n FROM t)
 SELECT 'o' || o_orderkey AS domain, CAST(depth AS INTEGER) AS depth FROM p WHERE org IS NULL OR n = 1 OR depth = 1""")
def repeated_pages(spark, sf_dir):
    """Orders as pages still to be read, of fifty organizations that are called in two ways; some are called nothing."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(cust % 13 == 0, "N/A").otherwise(F.concat(F.lit("Vendor "), (cust % 50).cast("string"), F.when(key % 2 == 0, ", Inc.").otherwise("")))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), key.cast("string")).alias("domain"), name.alias("organization"), (1 + key % 3).cast("int").alias("depth"), key.alias("seq"))
    return subprocessors.skip_repeated(rows).select("domain", "depth")


@query("""SELECT 's' || s_suppkey || '.com' AS domain, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN 'Page Works ' || s_suppkey WHEN 2 THEN 'Recorded Goods ' || s_suppkey ELSE 'S' || s_suppkey END AS organization,
 CASE s_suppkey % 5 WHEN 0 THEN 'overrides' WHEN 1 THEN 'web' WHEN 2 THEN 'registration' ELSE 'label' END AS source, s_suppkey % 5 = 0 AS is_verified FROM supplier""")
def attribute_owners(spark, sf_dir):
    """Suppliers' owners: curated, by their page, by a record where the page only waits, by the domain where the record is redacted or missing."""
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    s = table(spark, sf_dir, "supplier").withColumn("domain", F.concat(F.lit("s"), key, F.lit(".com")))
    name = F.when(k % 5 == 1, F.concat(F.lit("Page Works "), key)).otherwise("Just a moment...")
    pages = s.where((k % 5).isin(1, 2)).select(F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.concat(F.lit('<html><script type="application/ld+json">{"@type": "Organization", "name": "'), name, F.lit('"}</script></html>')).alias("html"))
    record = F.when(k % 5 == 3, "Registrant Organization: REDACTED FOR PRIVACY").otherwise(F.concat(F.lit("Registrant Organization: Recorded Goods "), key))
    whois = s.where((k % 5).isin(1, 2, 3)).select("domain", record.alias("response"))
    return attribution.attribute(s.select("domain"), [("overrides", s.where(k % 5 == 0).select(F.upper("domain").alias("domain"), F.col("s_name").alias("organization")))], pages, whois)


@query("SELECT 'c' || o_custkey AS source_domain, o_orderpriority AS org_name, 'o' || min(o_orderkey) AS inferred_domain FROM orders GROUP BY 1, 2")
def review_pending(spark, sf_dir):
    """Orders as proposals to customers: of each customer and priority the first one."""
    pending = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_domain"), F.col("o_orderpriority").alias("org_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("inferred_domain"), F.col("o_orderkey").alias("seq"))
    return review.first_pending(pending).select("source_domain", "org_name", "inferred_domain")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"graph_bfs_layers": QUERIES["graph_bfs_layers"]} | QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
