"""Queries over tables with large keys and repeated rows."""

import datetime
import os

from tierweave import queries as Q


def deal(spark, folder, orders):
    """``orders[(orderkey, custkey)]`` with a line each from two suppliers, the later line first."""
    day = datetime.datetime(2024, 1, 1)
    lines = [(o, 7 + n, 3 + n, n, 1.0, 1.0, 0.0, 0.0, "A", "F", day) for o, _ in orders for n in (2, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, c, "F", 1.0, day, "1-URGENT") for o, c in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_order_numbers_beyond_a_bigint(spark, tmp_path):
    run = lambda name: Q.queries()[name](spark, here).collect()
    here = deal(spark, tmp_path, [(1, 1), (9_000_000, 1), (8_999_999, 2)])
    assert {(r.nth_party_domain, r.nth_party_customer_domain, r.seq) for r in run("rel_at_layer")} == {("s4.example.com", "c1.example.org", (17 * 10**7 + 8) * 10**4 + 4), ("s4.example.com", "c1.example.org", None), ("s4.example.com", "c2.example.org", None)}
    assert {(r.nth_party_customer_domain, r.evidence, r.seq is None) for r in run("rel_dedup_merge")} == {("c1.example.org", "order 000000001 | order 009000000", False), ("c2.example.org", "order 008999999", True)}
    assert {r.domain: (r.discoveries, r.organization) for r in run("graph_vendor_agg")} == {"s4.example.com": (3, "Vendor 4"), "cdn5.amazonaws.com": (3, "Vendor 5")}
    assert len(run("graph_pages")) == 4 and {r.page for r in run("graph_pages")} == {0}
    assert len(run("rel_limits_topn")) == 6 and len(run("rel_infra_filter")) == 3 and len(run("rel_marketing_filter")) == 6
    assert len(run("rel_predup")) == 2 and sum(r.n for r in run("report_json")) == 6 and sum(r.n for r in run("rel_assemble")) == 2


def test_hosts_below_suffixes_of_every_kind(spark, tmp_path):
    spark.createDataFrame([(i, f"https://shop.x{i}.org/", "") for i in (0, 2, 61)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.host, r.suffix, r.base_domain, r.label) for r in Q.queries()["page_registrable"](spark, str(tmp_path)).collect()}
    assert got == {0: ("acme.com", "com", "acme.com", "acme"), 2: ("shop.acme.co.uk", "co.uk", "acme.co.uk", "acme"), 61: ("shop.acme.com", "com", "acme.com", "acme")}


def test_addresses_that_stand_on_several_pages(spark, tmp_path):
    urls = ("http://a.one.org/", "http://b.two.org/", "http://c.three.org/", "http://a.one.org/", "http://d.four.org/", "http://e.two.org/", "http://a.one.org/", "http://b.two.org/")
    spark.createDataFrame([(i, u, None if i == 0 else "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: Q.queries()[name](spark, str(tmp_path)).collect()
    own = [(r.vendor_domain, r.evidence) for r in run("page_resources") if r.page_url == urls[0]]
    assert sorted(own) == [("four.org", f"HTML img src reference: {urls[4]}"), ("two.org", f"HTML img src reference: {urls[1]}"), ("two.org", f"HTML img src reference: {urls[7]}")]
    assert len(run("page_resources")) == 7
    got = {r.vendor_domain: (r.source_type, r.evidence.split(": ")[1]) for r in run("page_traffic") if r.page_url == urls[0]}
    assert got == {"two.org": ("DISCOVERY::WEBPAGE_SOURCE", urls[7]), "three.org": ("DISCOVERY::WEBPAGE_NETWORK", urls[2]), "four.org": ("DISCOVERY::WEBPAGE_SOURCE", urls[4])}


def test_what_grows_is_not_sent_to_every_task(spark, tmp_path, capsys):
    from tierweave.plans import disclosures

    spark.createDataFrame([(i,) for i in range(3)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    found = Q.queries()["subprocessor_urls"](spark, str(tmp_path))
    assert {r.s_suppkey: r.first for r in found.collect()} == {0: "https://trust.s0.com/subprocessors", 1: "https://s1.com/legal/subprocessors", 2: "https://trust.s2.com/subprocessors"}
    vendors = spark.read.parquet(f"{tmp_path}/supplier.parquet").selectExpr("'s' || s_suppkey || '.com' AS domain")
    vendors.selectExpr("'https://' || domain || '/legal/subprocessors' AS url").write.parquet(f"{tmp_path}/pages")
    asked = disclosures.addresses(vendors, spark.read.parquet(f"{tmp_path}/pages"))
    assert asked.count() == 3
    for df in (found, asked):
        df.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_the_view_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    here = deal(spark, tmp_path, [(o, o % 7) for o in range(60)])
    few = sorted(Q.queries()["record_texts"](spark, here).collect())
    monkeypatch.setattr(Q, "FILE_ROWS", 50)
    monkeypatch.setattr(Q, "TASK_ROWS", 10)
    sizes = Q.rel(spark, here).rdd.glom().map(len).collect()
    assert sum(sizes) == 120 and len(sizes) >= 12 and max(sizes) <= 30
    assert sorted(Q.queries()["record_texts"](spark, here).collect()) == few


def test_later_layers_leave_out_steps_of_mere_roots(spark, monkeypatch):
    """Steps of customers that nobody has as a vendor are in no join but the first; walks are as by brute force, sent or shuffled."""
    from tierweave.plans import graph

    facts = [(f"c{i}", f"s{i % 5}") for i in range(40)] * 2 + [("s0", "s1"), ("s1", "s2"), ("s2", "s0"), ("s3", "c1"), ("s4", "s4"), ("c7", "c7"), ("lone", "s0")]
    roots = [f"c{i}" for i in range(40)] + ["s4", "none"]
    want = {}
    for r in roots:
        layer, front = 0, {r}
        while front:
            want |= {(r, d): layer for d in front}
            layer, front = layer + 1, {v for c, v in facts if c in front and (r, v) not in want}
    real, sizes = graph.committed, {}
    monkeypatch.setattr(graph, "committed", lambda df, label: sizes.setdefault(label, []).append(out := real(df, label)) or out)
    rows = lambda **kw: {(r.root, r.domain): r.layer for r in graph.layers(spark.createDataFrame([(r,) for r in roots], "root string"), spark.createDataFrame(facts, "customer string, vendor string"), **kw).collect()}
    got = rows()
    assert got == want
    assert [df.count() for df in sizes["facts"]] == [47] and [df.count() for df in sizes["second-steps"]] == [8]
    monkeypatch.setattr(graph, "LIGHT", 0)
    assert rows() == want
    assert rows(max_depth=1) == {k: n for k, n in want.items() if n < 2} and len(sizes["second-steps"]) == 2


def test_resumed_rows_come_first_whatever_their_numbers(spark):
    from decimal import Decimal

    from tierweave.operators import relations

    shape = relations.SCHEMA.replace("seq bigint", "seq decimal(38,0)")
    row = lambda name, seq: ("v.com", name, 1, "c.org", "C", "r", "DNS::TXT::SPF", "c.org", "C", name, Decimal(seq))
    new, resumed = spark.createDataFrame([row("Newer Vendor", 1)], shape), spark.createDataFrame([row("Older Vendor", 10**19)], shape)
    (got,) = relations.assemble(new, resumed).collect()
    assert got.evidence == "Older Vendor | Newer Vendor" and got.seq == 10**19


def test_hosts_are_distinct_before_they_are_judged(spark, monkeypatch):
    from tierweave.operators import relations

    real, sizes = relations.committed, {}
    monkeypatch.setattr(relations, "committed", lambda df, label: sizes.setdefault(label, real(df, label)))
    rel = spark.range(300).selectExpr("'v' || id % 3 || '.com' AS nth_party_domain", "if(id % 2 = 0, 'c.org', 'x.invalid') AS nth_party_customer_domain", "'c.org' AS root_customer_domain")
    assert relations.drop_unregistrable(rel).count() == 150
    assert sorted(r.host for r in sizes["hosts"].collect()) == ["c.org", "v0.com", "v1.com", "v2.com", "x.invalid"]


def test_rows_are_shuffled_once_to_be_deduplicated(spark, capsys):
    from tierweave.operators import relations

    rows = [(f"v{i % 3}.com", f"V {i % 3}", 1 + i % 2, "c.org", "C", "r", "DNS::TXT::SPF", "c.org", "C", f"e{i % 5}", i) for i in range(40)]
    done = relations.dedup_relationships(spark.createDataFrame(rows, relations.SCHEMA).repartition(3))
    assert {(r.nth_party_domain, r.nth_party_layer, r.seq, r.evidence) for r in done.collect()} == {("v0.com", 1, 0, "e0 | e3 | e1 | e4 | e2"), ("v1.com", 2, 1, "e1 | e4 | e2 | e0 | e3"), ("v2.com", 1, 2, "e2 | e0 | e3 | e1 | e4")}
    capsys.readouterr()
    relations.drop_infrastructure(done).explain()
    assert capsys.readouterr().out.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_names_that_stay_are_joined_with_no_row(spark, monkeypatch):
    """Only the vendors' names give way, so that only their rows meet names; all are as a brute-force vote has them."""
    from collections import Counter

    from tierweave.operators import relations
    from tierweave.plans import graph

    shape = "nth_party_domain string, nth_party_organization string, nth_party_customer_domain string, nth_party_customer_organization string, root_customer_domain string, root_customer_organization string"
    rows = [(f"v{i % 10}.com", f"Vendor {i % 10}" + (" Inc" if i % 30 < 10 else ""), f"c{i}.org", f"Customer {i}", "r.net", "Root Works") for i in range(60)]
    rows += [("v1.com", None, "c1.org", "Customer 1", "r.net", "Root Works"), ("v2.com", " ", None, "Nobody", "r.net", "Root Works"), (None, None, "c2.org", "Customer 2", "", "")]
    votes = Counter((d, o) for r in rows for d, o in zip(r[::2], r[1::2]) if (d or "").strip() and (o or "").strip())
    best = {d: max((n, len(o), o) for (x, o), n in votes.items() if x == d)[2] for d, _ in votes}
    real, names = relations.told, []
    monkeypatch.setattr(relations, "told", lambda rows, kind: names.append(rows.count()) or real(rows, kind))
    monkeypatch.setattr(graph, "FEW", 1)
    done = relations.reconcile_names(spark.createDataFrame(rows, shape))
    assert Counter(map(tuple, done.collect())) == Counter(tuple(x for d, o in zip(r[::2], r[1::2]) for x in (d, best.get(d, o))) for r in rows)
    assert names == [12, 0, 0]


def test_what_relationships_were_made_of_is_deleted_once_they_are_written(spark, monkeypatch):
    import hashlib
    import time

    from tierweave.operators import relations
    from tierweave.plans import graph

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f: os.path.getsize(f) for f in files if f.endswith(".data") and os.path.exists(f)}

    def watched(df, label, *args, **kwargs):
        before = set(shuffled())
        out = real(df, label, *args, **kwargs)
        for _ in range(20 if label == "relationships" else 1):  # Spark does not wait for files to be deleted
            left[label] = sum(n for f, n in shuffled().items() if f not in before)
            if left[label]:
                time.sleep(0.1)
        return out

    real, left, setting = relations.committed, {}, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    monkeypatch.setattr(relations, "committed", watched)
    text = lambda i: "".join(hashlib.sha256(f"{i}:{k}".encode()).hexdigest() for k in range(16))
    rows = [(f"v{i % 50}.com", f"V {i % 50}", 1, f"c{i % 20}.org", "C", "r", "DNS::TXT::SPF", "c.org", "C", text(i), i) for i in range(1000)]
    assert relations.assemble(spark.createDataFrame(rows, relations.SCHEMA)).count() == 100
    assert left["relationships"] == 0 and left["hosts"] > 0
    assert spark.conf.get(graph.FREED, None) == setting
