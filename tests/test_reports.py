import pytest
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import records as R
from tierweave.operators import entities, relations, trust_probes
from tierweave.plans import graph
from tierweave.sources import config, readers, writers


def column(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, v {kind}").coalesce(1).sortWithinPartitions("i").select(f(F.col("v"))).collect()]


def test_labels_and_layers(spark):
    assert column(spark, ["DnsTxtSpf", "TRUST_CENTER::API", "X::NEW", "UNKNOWN"], R.short_label) == ["SPF", "Trust Center", "NEW", "Other"]
    assert column(spark, ["HTTP::SUBPROCESSOR", "DNS::MX"], R.phase_label) == ["subprocessor", "discovery"]
    assert column(spark, [-1.0, 0.5, 3.7, 9.0, None, float("nan")], R.clamp_layer, "double") == [1, 1, 3, 6, 1, 1]
    assert column(spark, ["a.b.co.uk", "a.b.gov.uk", "x.com", "a.x.com"], D.lookup_base_domain) == ["b.co.uk", "gov.uk", "x.com", "x.com"]
    assert column(spark, ["acme.co.uk", "www.acme.co.uk"], D.is_organizational) == [True, False]


def test_active_layers(spark):
    edges = spark.createDataFrame([("r", "a", False), ("a", "b", False), ("r", "b", None), ("a", "c", True)], "customer string, vendor string, hidden boolean")
    nodes = spark.createDataFrame([("r", 0), ("a", 1), ("b", 1), ("c", 2)], "domain string, layer int")
    assert {r.domain: r.layers for r in relations.active_layers(edges, nodes).collect()} == {"r": [0], "a": [1], "b": [1, 2], "c": [2]}


def test_entities(spark):
    text = " ".join(f"Grüße{i} und Wörter" for i in range(450))
    parts = entities.cut(text)
    assert all(len(p.encode()) <= 3000 for p in parts) and parts[0] == text[: len(parts[0])] and text.endswith(parts[-1])
    at = 0
    for p in parts:  # together they cover the text
        i = text.index(p, max(0, at - 700))
        assert i <= at
        at = max(at, i + len(p))
    assert at == len(text) and entities.cut("short") == ["short"] and entities.cut("é" * 5000, 10, 7, 3)[0] == "ééé"
    got = entities.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 3} and sum(r.doc_id == 1 for r in got) == len(parts)
    rows = [(1, "Organization", "Acme", 0.8, 0), (1, "brand", "acme", 0.9, 1), (1, "person", "Jo", 0.99, 2), (1, "company", "ab", 0.95, 3), (1, "company", " Zed ", 0.9, 4), (2, "company", "Low", 0.3, 0)]
    e = spark.createDataFrame(rows, "doc_id long, kind string, name string, confidence double, ordinal int")
    assert [(r.doc_id, r.organization) for r in entities.best_organization(e).collect()] == [(1, "ab")]
    assert [(r.organization, r.confidence) for r in entities.all_organizations(e).orderBy("place").collect()] == [("Zed", 0.9), ("acme", 0.9)]


def test_config(tmp_path):
    good = '[http]\nuser_agent = "x"\nrequest_timeout_secs = 5\n[dns]\ndoh_servers = [{url = "https://d"}]\n[analysis]\nconcurrency_per_depth = [1]\nstrategy = "unlimited"\n'
    path = tmp_path / "c.toml"
    path.write_text(good)
    assert config.load(str(path), analysis__strategy="limits", analysis__vendor_limits_per_depth=[3])["analysis"]["vendor_limits_per_depth"] == [3]
    for bad in (good.replace('"x"', '""'), good.replace("https", "http"), good.replace("[1]", "[]"), good.replace("unlimited", "budget"), good + '[patterns.regex]\nx = "("\n', "nonsense = ["):
        path.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(path))
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.toml"))


def test_certificate_payloads(spark):
    rows = [("a.com", 0, '{"results":[{"hostname":"x.com"},{"hostname":null},{"hostname":"y.com"}]}'), ("a.com", 1, "nonsense"), ("a.com", 2, "{}")]
    got = readers.merklemap_entries(spark.createDataFrame(rows, "query_domain string, ordinal int, body string")).collect()
    assert [(r.provider, r.name_value) for r in got] == [("merklemap", "x.com\ny.com")]
    rows = [("a.com", 0, '{"result":{"hits":[{"names":["x.com"]},{"cert":{"names":["y.com"]}},{"cert":{"parsed":{"subject_alt_name":{"dns_names":["z.com"]}}}},{}]}}')]
    got = readers.censys_entries(spark.createDataFrame(rows, "query_domain string, ordinal int, body string")).collect()
    assert [(r.provider, r.name_value) for r in got] == [("censys", "x.com\ny.com\nz.com")]


def test_answers_and_tiers(spark):
    rows = [("A.com", "TXT", "two", 1), ("a.com", "txt", "one", 0), ("a.com", "CNAME", "c.com", 0), ("b.com", "MX", "m", 0)]
    got = {r.name: (r.txt, r.cnames) for r in readers.txt_and_cname(spark.createDataFrame(rows, "name string, rrtype string, rdata string, ordinal int")).collect()}
    assert got == {"a.com": (["one", "two"], ["c.com"]), "b.com": ([], [])}
    t = lambda *rows: spark.createDataFrame(list(rows), "domain string, organization string")
    got = readers.assembled_vendors(t(("a.com", "Base"), ("b.com", "B")), t(("A.com", "Remote"), ("c.com", "C")), t(("c.com", "Mine")))
    assert {(r.domain, r.organization, r.tier) for r in got.collect()} == {("a.com", "Remote", "remote"), ("b.com", "B", "base"), ("c.com", "Mine", "overrides")}


def test_reports_and_checkpoints(spark, tmp_path):
    shape = relations.SCHEMA
    rows = [("v.com", "V <b>|Co", 1, "c.com", "C", "rec", "DNS::TXT::SPF", "c.com", "C", "e", 1), ("w.com", "W", 2, "v.com", "V", "rec", "HTTP::SUBPROCESSOR", "c.com", "C", "e", 2)]
    r = spark.createDataFrame(rows, shape)
    page = [x.line for x in writers.html(r).orderBy("at").collect()]
    assert page[0].startswith("<!DOCTYPE") and page[-1].endswith("</html>") and any("V &lt;b&gt;|Co" in x for x in page) and '<option value="HTTP::SUBPROCESSOR">Subprocessor</option>' in page
    writers.export(r, str(tmp_path / "m"), "markdown")
    lines = [x.value for f in sorted((tmp_path / "m").glob("part-*")) for x in spark.read.text(str(f)).collect()]
    assert lines[0] == "# Vendor relationships" and any(x.startswith("| v.com | V <b>\\|Co | 1 ") for x in lines)
    stored = spark.createDataFrame([("c.com", graph.settings_hash({"a": 1, "b": 2}))], "root string, settings string")
    assert graph.is_compatible(stored, "c.com", {"b": 2, "a": 1}) and not graph.is_compatible(stored, "c.com", {"a": 1})
    s = spark.createDataFrame([(0, 86_401, 3), (0, 86_400, 2)], "d long, now long, f int").select(trust_probes.is_stale(F.col("d"), F.col("now"), 1).alias("s"), trust_probes.is_unreliable(F.col("f"), 3).alias("u")).collect()
    assert [(x.s, x.u) for x in s] == [(True, True), (False, False)]


def test_depth_buckets_and_gradient(spark):
    rows = [("dns", 1, 2.0, True), ("dns", 1, 1.0, False), ("web", 1, 2.0, True), ("dns", 9, 1.0, False), ("dns", 4, 1.0, False)]
    got = {(r.name, r.bucket): (r.n, r.total, r.bounds) for r in relations.by_depth(spark.createDataFrame(rows, "name string, depth int, seconds double, critical boolean")).collect()}
    assert got == {("dns", 1): (2, 3.0, True), ("web", 1): (1, 2.0, False), ("dns", 4): (2, 2.0, False)} | {k: v for k, v in got.items() if v[2] is None}
    v = spark.createDataFrame([("a", i, x) for i, x in enumerate((1.0, 1.0, 4.0))], "k string, o int, v double")
    assert relations.latency_gradient(v, "k", "o", "v", 0.5, 0.1).first().gradient == pytest.approx(max(0.5, 1.3 / 2.5))
