import gzip
import json

from pyspark.sql import functions as F

from tierweave.operators import attribution, listings, registry, relations, review, trust, txt, web
from tierweave.operators import nodes as N
from tierweave.plans import graph
from tierweave.sources import readers, writers


def rel_row(seq, vendor, customer="c.com", kind="DNS::TXT::SPF", evidence="e", layer=1, org="Acme"):
    return (vendor, org, layer, customer, "Cust", "r", kind, "root.com", "Root", evidence, seq)


def rel(spark, *rows):
    return spark.createDataFrame(list(rows), relations.SCHEMA)


def test_evidence_folds_in_order(spark):
    got = relations.dedup_relationships(rel(spark, rel_row(3, "v.com", evidence="abc"), rel_row(1, "v.com", evidence="xabcx", layer=4), rel_row(2, "v.com", evidence="new"), rel_row(9, "w.com"))).orderBy("nth_party_domain").collect()
    assert [(r.nth_party_domain, r.evidence, r.nth_party_layer, r.seq) for r in got] == [("v.com", "xabcx | new", 4, 1), ("w.com", "e", 1, 9)]


def test_types_and_customers_stay_apart(spark):
    assert relations.dedup_relationships(rel(spark, rel_row(1, "v.com"), rel_row(2, "v.com", kind="CERT::SAN"), rel_row(3, "v.com", customer="d.com"))).count() == 3


def test_filters(spark):
    r = rel(spark, rel_row(1, "x.amazonaws.com"), rel_row(2, "amazon.com", kind="HTTP::SUBPROCESSOR"), rel_row(3, "facebook.com", kind="DISCOVERY::WEBPAGE_SOURCE"), rel_row(4, "facebook.com"), rel_row(5, "bad host"), rel_row(6, "v.com", customer=""))
    assert {x.seq for x in relations.drop_infrastructure(r).collect()} == {2, 3, 4, 5, 6}
    assert {x.seq for x in relations.drop_marketing(r).collect()} == {1, 2, 4, 5, 6}
    assert {x.seq for x in relations.drop_unregistrable(r).collect()} == {1, 2, 3, 4, 6}


def test_reconcile_one_name_per_domain(spark):
    r = rel(spark, rel_row(1, "v.com", org="Vee Inc"), rel_row(2, "v.com", org="Vee Inc"), rel_row(3, "v.com", org="Other"), rel_row(4, "w.com", org="GoDaddy"))
    for done in (relations.finalize(r), relations.reconcile_names(relations.gate_intermediaries(r))):
        assert {(x.nth_party_domain, x.nth_party_organization) for x in done.collect()} == {("v.com", "Vee Inc"), ("w.com", "W")}


def test_empty_relationships(spark):
    assert relations.assemble(rel(spark)).count() == 0
    assert relations.summary(rel(spark)).first().max_depth == 0


def test_layers_are_smallest(spark):
    facts = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", None)], "customer string, vendor string")
    got = {(r.root, r.domain): r.layer for r in graph.layers(spark.createDataFrame([("a",), ("c",), (None,)], "root string"), facts).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("c", "c"): 0, ("c", "a"): 1, ("c", "d"): 1, ("c", "b"): 2}
    assert graph.layers(spark.createDataFrame([("a",)], "root string"), facts, max_depth=1).count() == 3


def test_spf_resolution_is_bounded_and_safe_in_loops(spark):
    answers = spark.createDataFrame([("a.com", "v=spf1 include:b.com include:%{i}.x.com"), ("b.com", "v=spf1 redirect=a.com include:c.com")], "name string, rdata string")
    got = [r.name for r in txt.resolve_spf(spark.createDataFrame([("a.com",)], "root string"), answers).orderBy("lookup").collect()]
    assert got == ["a.com", "b.com", "c.com"]


def test_quarantine_and_nulls(spark):
    rows = spark.createDataFrame([(None,), ("",), ("something else",)], "rdata string")
    assert txt.extract_txt(rows).count() == 0
    assert [r.rdata for r in txt.unmatched_txt(rows).collect()] == ["something else"]


def test_page_names(spark):
    pages = ["<title>Home | Acme</title>", '<script type="application/ld+json">{"@type":"Organization","legalName":"Acme LLC","name":"x"}</script>', '<meta content="Site" property="og:site_name">', "<footer>© 2024 Widget Works. All</footer>", "", None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select("i", web.page_organization(F.col("html")).alias("r")).orderBy("i").collect()
    assert [(r.r and (r.r.organization, r.r.source)) for r in got] == [("Acme", "title_tag"), ("Acme LLC", "schema_org"), ("Site", "opengraph"), ("Widget Works", "copyright"), None, None]


def test_requests_beat_references(spark):
    a = spark.createDataFrame([("p", "v.com", "DISCOVERY::WEBPAGE_SOURCE", "s")], "page_url string, vendor_domain string, source_type string, evidence string")
    assert web.web_traffic(a, a.withColumn("source_type", F.lit("DISCOVERY::WEBPAGE_NETWORK"))).first().source_type.endswith("NETWORK")


def test_registration(spark):
    texts = [("Registrant Organization: REDACTED FOR PRIVACY\nOrgName: Acme Ltd\n", "acme.com"), ("Registrar: MarkMonitor\n", "x.com"), ("", "y.com")]
    got = spark.createDataFrame(texts, "t string, d string").select(registry.owner(F.col("t"), F.col("d")).alias("o"), registry.is_redacted(F.col("t")).alias("r")).collect()
    assert [r.o for r in got] == ["Acme Ltd", None, None]
    assert [r.r for r in got] == [True, True, False]


def test_attribution_order(spark):
    domains = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",), ("d.com",), (None,)], "domain string")
    tier = spark.createDataFrame([("A.com", "Curated")], "domain string, organization string")
    pages = spark.createDataFrame([("https://b.com/", "<title>Shop | Beeware</title>")], "url string, html string")
    whois = spark.createDataFrame([("c.com", "Organization: Cee Works\n")], "domain string, response string")
    got = {r.domain: (r.organization, r.source) for r in attribution.attribute(domains, [("overrides", tier)], pages, whois).collect()}
    assert got == {"a.com": ("Curated", "overrides"), "b.com": ("Beeware", "web"), "c.com": ("Cee Works", "registration"), "d.com": ("D", "label")}


def test_tables_and_lists(spark):
    html = "<table><tr><th>Entity Name</th><th>Where</th></tr><tr><td>Stripe</td><td>US</td></tr></table><ul><li><strong>Zendesk</strong> help</li></ul>"
    pages = spark.createDataFrame([("u", html), ("v", "<table></table>"), ("w", None)], "url string, html string")
    nodes = N.page_nodes(pages)
    assert [r.name for r in listings.tables(nodes).collect()] == ["Stripe"]
    assert [r.name for r in listings.lists(nodes).collect()] == ["Zendesk"]


def test_overrides(spark):
    old = spark.createDataFrame([("a.com", "A", "1", "x"), ("b.com", "B", "1", "x")], "domain string, organization string, added string, source string")
    new = spark.createDataFrame([(1, "A.com", "A1", "2", "y"), (2, "a.com", "A2", "3", "y")], "seq long, domain string, organization string, added string, source string")
    assert {(r.domain, r.organization) for r in review.upsert(old, new).collect()} == {("a.com", "A2"), ("b.com", "B")}
    assert review.remove(old, new.select("domain")).count() == 1


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Domain,Label\nAcme.com,x\nbad,y\n")
    (tmp_path / "b.json").write_text('{"domains": ["a.com", {"domain": "b.org", "label": "l"}]}')
    (tmp_path / "c.txt").write_text("# no\nc.net,zz\n")
    assert [(r.domain, r.label) for r in readers.batch_domains(spark, str(tmp_path / "a.csv")).collect()] == [("acme.com", "x")]
    assert {r.domain for r in readers.batch_domains(spark, str(tmp_path / "b.json")).collect()} == {"a.com", "b.org"}
    assert [r.domain for r in readers.batch_domains(spark, str(tmp_path / "c.txt")).collect()] == ["c.net"]
    (tmp_path / "t.tsv").write_text("# v\nA.com\tOne\na.com\tTwo\n")
    assert [(r.domain, r.organization) for r in readers.company_table(spark, str(tmp_path / "t.tsv")).collect()] == [("a.com", "Two")]
    (tmp_path / "s.jsonl").write_text('{"host": "X.a.com", "source": "s"}\nnot json\n')
    assert [r.subdomain for r in readers.subdomains(spark, str(tmp_path / "s.jsonl")).collect()] == ["x.a.com"]
    r = rel(spark, rel_row(1, "v.com"), rel_row(2, "w.com"))
    writers.export(r, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns[0] == "root_customer_domain"
    writers.write_json(r, str(tmp_path / "j"))
    own = json.loads("".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*"))))
    assert own["summary"]["total_relationships"] == 2 and [x["nth_party_domain"] for x in own["relationships"]] == ["v.com", "w.com"] and list(own["relationships"][0])[0] == "nth_party_domain"
    writers.write_json(r.limit(0), str(tmp_path / "none"), single=True)
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == {"summary": {"total_relationships": 0, "max_depth": 0, "unique_domains": 0, "unique_organizations": 0}, "relationships": []}
    assert any("| v.com |" in x.line for x in writers.markdown(r).collect())
    assert [x.line for x in writers.markdown(r.limit(0)).collect()][-1] == "No vendor relationships found."
    assert writers.mermaid(r).count() == 4


def test_fallbacks_and_broken_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# dataset_version: 2024-05 \nA.com\tOne\r\n#x.com\tNo\na.com\tTwo\nb.com\t\n")
    assert readers.company_table_version(spark, str(tmp_path / "t.tsv")) == "2024-05" and [(r.domain, r.organization) for r in readers.company_table(spark, str(tmp_path / "t.tsv")).collect()] == [("a.com", "Two")]
    (tmp_path / "u.tsv").write_text("a.com\tUnversioned")
    assert readers.company_table_version(spark, str(tmp_path / "u.tsv")) is None
    whole = gzip.compress("".join(f'{{"host": "h{i}-{i * 7919 % 1000}.a.com", "source": "s"}}\n' for i in range(5000)).encode())
    (tmp_path / "s.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    assert 0 < readers.subdomains(spark, str(tmp_path / "s.jsonl.gz")).count() < 5000
    packaged = spark.createDataFrame([("a.com", "A", "base")], "domain string, organization string, tier string")
    assert [r.organization for r in readers.or_else(lambda: readers.known_vendors(spark, str(tmp_path / "missing.json")), packaged).collect()] == ["A"]
    (tmp_path / "k.json").write_text('{"vendors": {"B.com": "B"}}')
    assert [r.domain for r in readers.or_else(lambda: readers.known_vendors(spark, str(tmp_path / "k.json")), packaged).collect()] == ["b.com"]
    detection = "struct<success_indicators: array<string>, failure_indicators: array<string>, notes: string>"
    platforms = spark.createDataFrame([("Desk", "desk.com", ["{tenant}.desk.com"], None)], f"name string, vendor_domain string, tenant_patterns array<string>, detection {detection}")
    registry_rows = spark.createDataFrame([("desk.com", [("Desk", ["x"], None), ("Board", ["b.com/{tenant}"], (["ok"], [], "n"))])], f"primary_domain string, saas_tenants array<struct<name: string, patterns: array<string>, detection: {detection}>>")
    assert {(r.name, r.tenant_patterns[0]) for r in readers.all_platforms(platforms, registry_rows).collect()} == {("Desk", "{tenant}.desk.com"), ("Board", "b.com/{tenant}")}


def test_quarantine_and_batches(spark, tmp_path):
    rows = txt.unmatched_txt(spark.createDataFrame([("a.com", 'odd "quoted", text'), ("b.com", "v=spf1 include:sendgrid.net")], "name string, rdata string"))
    out = writers.quarantine(rows, F.timestamp_seconds(F.lit(0)))
    assert tuple(out.columns) == writers.QUARANTINE and [tuple(r) for r in out.collect()] == [("1970-01-01 00:00:00 UTC", "a.com", "DNS::TXT::VERIFICATION", 'odd "quoted", text', "N/A", "No pattern matched this TXT record")]
    writers.write_quarantine(out, str(tmp_path / "q"))
    assert 'odd ""quoted"", text' in "".join(p.read_text() for p in (tmp_path / "q").glob("part-*"))
    r = rel(spark, rel_row(1, "v.com"), rel_row(2, "w.com"))
    root = r.first().root_customer_domain
    results = spark.createDataFrame([(root.upper(), True), ("gone.com", False), ("odd.com", None)], "domain string, success boolean")
    writers.write_batch(r, str(tmp_path / "b"), results)
    assert spark.read.json(str(tmp_path / "b/batch")).first().asDict() == {"total_domains": 3, "successful": 1, "failed": 2, "total_relationships": 2}


def test_degradation_and_manifest(spark):
    covered = spark.createDataFrame([("subprocessor", 8, 2, True), ("ct", 0, 0, False)], "phase string, found long, failed long, degraded boolean")
    say = lambda c, *n: tuple(relations.degradation(c, spark.createDataFrame([n], "starved long, dns_failures long, dns_name_failures long")).first())
    assert say(covered, 0, 0, 0) == ("subprocessor failed on 2 domain(s)", "see the coverage")
    assert say(covered, 3, 5, 2) == ("subprocessor starved on 3 vendor(s); DNS degraded on 3 lookup(s); 2 name(s) failed at their own authoritative DNS (not a local network fault)", "re-run on a stable network")
    assert say(covered.limit(0), 0, 0, 0) == (None, "see the coverage")
    flags = spark.createDataFrame([(1, "subprocessor", "subprocessor", False, False, False, True, "--x"), (2, "ct-logs", "ct", False, False, False, False, "--enable-ct"), (3, "ner", None, True, True, False, True, "--n"), (4, "saas", "saas", False, True, True, False, "--saas")], "ord int, name string, phase string, only boolean, enable boolean, disable boolean, dflt boolean, flag string")
    features = flags.withColumn("s", relations.feature_status(*(F.col(c) for c in ("only", "enable", "disable", "dflt", "flag")))).select("ord", "name", "phase", "s.*")
    assert [r.line for r in relations.manifest(features, covered).orderBy("ord").collect()] == [
        "subprocessor  on by default — 8 found, 2 failed  ⚠ degraded", "ct-logs       disabled (default — enable with --enable-ct)", "ner           disabled (--dns-only mode)", "saas          enabled via --saas — 0 found, 0 failed",
    ]


def test_stream(spark, tmp_path):
    from tierweave.streaming import observations

    rows = [("a.com", "TXT", "v=spf1 include:sendgrid.net", 0, "ok", "2024-01-01 00:00:00")] * 2
    spark.createDataFrame(rows, "name string, rrtype string, rdata string, ordinal int, status string, seen string").withColumn("seen", F.to_timestamp("seen")).write.parquet(str(tmp_path / "in"))
    q = observations.write_facts(observations.vendor_facts(observations.read_answers(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [r.domain for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["sendgrid.net"]
