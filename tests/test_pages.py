import base64
import json

from pyspark.sql import functions as F

from tierweave.functions import orgs as O
from tierweave.operators import attribution, registry, subprocessors, trust, trust_probes, web
from tierweave.plans import scan


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, v string").coalesce(1).sortWithinPartitions("i").select(f(F.col("v"))).collect()]


def test_page_urls(spark):
    rows = subprocessors.page_urls(spark.createDataFrame([("testdomain.com",), ("trust.vanta.com",)], "domain string")).orderBy("ord").collect()
    one, two = ([r.url for r in rows if r.domain == d] for d in ("testdomain.com", "trust.vanta.com"))
    assert len(one) >= 80 and len(set(one)) == len(one)
    for p in ("testdomain.com/subprocessors", "www.testdomain.com/subprocessors", "testdomain.com/legal/subprocessors", "testdomain.com/privacy/subprocessors", "testdomain.com/trust/subprocessors", "testdomain.com/gdpr/subprocessors", "testdomain.com/vendors"):
        assert f"https://{p}" in one
    assert one.index("https://testdomain.com/legal/subprocessors") < 15 and one.index("https://testdomain.com/subprocessors") < 15
    assert two[0] == "https://trust.vanta.com/subprocessors" and not any("trust.trust." in u for u in two)


def test_vendor_domains(spark):
    good = ["google.com", "sub.domain.io", "test-site.org", "cdn.assets.vendor.com", "aws.com", "ada.cx", "zoom.us", "elastic.co"]
    bad = ["example.com", "localhost", "test.com", "a", "nodot", "n/a.com", "none.com", "na.com", "domain.com", "b.mz", "j.ai", "xp.fh", "a.ehsi", "v.szd", None, ""]
    assert column(spark, [*good, *bad], subprocessors.is_valid_vendor_domain) == [True] * len(good) + [False] * len(bad)
    texts = ["Visit our partner at stripe.com for more info", "Contact support@sendgrid.io for help", "Check out analytics-provider.net", "Visit example.com for testing", "Email us at test@localhost", None]
    assert column(spark, texts, subprocessors.domain_in_text) == ["stripe.com", "sendgrid.io", "analytics-provider.net", None, None, None]
    assert column(spark, ["Acme Inc. provides analytics services via acme.com", "Email services company sends via mailsender.net", "Visit our blog for updates and news", "Follow us on social media platforms"], subprocessors.looks_like_vendor) == [True, True, False, False]


def test_words_and_names(spark):
    assert column(spark, ["conditions", "america", "stripe", "zendesk"], subprocessors.is_common_word) == [True, True, False, False]
    assert column(spark, ["ksbpw", "brtfd", "mnpqxzrl", "stripe", "google", "sentry", "datadog"], subprocessors.is_garbled) == [True, True, True, False, False, False, False]
    assert column(spark, ["truncated", "xm", "com", "io", "uk"], subprocessors.is_valid_suffix) == [False, False, True, True, True]
    bad = ["en-us", "zh-hans", "soc2_report", "sso_mfa", "A", "xy", "ISO/IEC 27001", "SOC 2", "PCI-DSS", "NIST 800-53", "SSAE 18", "The Salvation Army", "FTC", "W3C", "fr"]
    good = ["Google", "Amazon Web Services", "Ada Support", "Red Sift", "Microsoft Corporation"]
    assert column(spark, [*bad, *good], subprocessors.is_false_positive) == [True] * len(bad) + [False] * len(good)
    names = {"GitHub, Inc.": True, "IBM": True, "PricewaterhouseCoopers LLP": True, "AB": False, "": False, "A" * 81: False, "Some Company United Kingdom Processing": False, "This Is Way Too Many Words For A Real Organization Name": False}
    assert column(spark, names, subprocessors.is_valid_org_name) == list(names.values())


def test_result_filter(spark):
    known = spark.createDataFrame([("Cloudflare", "cloudflare.com"), ("Amazon Web Services", "aws.amazon.com"), ("Microsoft", "microsoft.com")], "organization string, domain string")
    found = ["Cloudflare", "validvendor.com", "_org:Obscurevendorxyz", "_org:valid.example.com", "_org:Cloudflare, Inc.", "_org:Amazon Web Services, Inc.", "_org:Microsoft Corporation", "il mj.com", "ac.uk", "example.co.uk", "conditions.com", "stripe.com", "ksbpw.com", "a.truncated", None]
    got = subprocessors.filter_results(spark.createDataFrame([(d, 1) for d in found], "domain string, n int"), known)
    assert got.columns == ["domain", "n"]
    assert {r.domain for r in got.collect()} == {"validvendor.com", "valid.example.com", "cloudflare.com", "aws.amazon.com", "microsoft.com", "example.co.uk", "stripe.com"}
    assert subprocessors.filter_results(got.limit(0)).count() == 0


def test_custom_rules_and_skips(spark):
    texts = spark.createDataFrame([("u1", "a.com", "We use Stripe Billing and Acme"), ("u2", "a.com", "nothing")], "page_url string, host string, text string")
    rules = spark.createDataFrame([("a.com", "acme", "acme.io"), ("a.com", "stripe", "stripe.com"), ("b.com", "we", "we.com"), ("a.com", "Stripe Billing", "billing.stripe.com")], "host string, name string, domain string")
    assert [(r.page_url, r.domain) for r in subprocessors.custom_domains(texts, rules).collect()] == [("u1", "billing.stripe.com")]
    assert {r.name for r in subprocessors.custom_matches(texts, spark.createDataFrame([("a.com", "use ([A-Z]\\w+)")], "host string, pattern string")).collect()} == {"Stripe"}
    rows = [("a.com", "Acme Inc", 1, 1), ("b.com", "ACME", 2, 2), ("c.com", "Acme", 1, 3), ("d.com", "unknown", 2, 4), ("e.com", "Unknown", 3, 5), ("f.com", None, 2, 6), ("g.com", "New One", 2, 7)]
    got = subprocessors.skip_repeated(spark.createDataFrame(rows, "domain string, organization string, depth int, seq int"))
    assert {r.domain for r in got.collect()} == {"a.com", "c.com", "d.com", "e.com", "f.com", "g.com"}


ITEMS = [{"name": f"Vendor {i}", "url": f"https://v{i}.com", "purpose": "hosting"} for i in range(6)]


def test_embedded_data(spark):
    blob = base64.b64encode(json.dumps({"vendors": ITEMS}).encode()).decode()
    pages = [
        ("p1", f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"subprocessors": ITEMS}})}</script>'), ("p2", f"<div data-x=\"{blob}\"></div>"), ("p3", f"<script>window.APP_STATE = {json.dumps({'list': {'vendors': ITEMS}})};</script>"),
        ("p4", "<p>nothing</p>"), ("p5", None), ("p6", '<script type="application/json">{"a": [1, 2</script>'),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {r.page_url: r for r in trust_probes.strategies(df).collect()}
    assert {k: (r.kind, r.path, r.name_field) for k, r in got.items()} == {"p1": ("next_data", "props.subprocessors", "name"), "p2": ("base64", "vendors", "name"), "p3": ("js_object", "list.vendors", "name")}
    read = trust_probes.execute(trust_probes.strategies(df), df).collect()
    assert len(read) == 18 and {r.address for r in read} == {x["url"] for x in ITEMS}
    assert trust_probes.strategies(df.limit(0)).count() == 0
    arrays = trust.entity_arrays(trust_probes.embedded(df))
    assert {r.page_url for r in trust_probes.confident_pages(arrays).collect()} == {"p1", "p2", "p3"}


def test_balanced_objects():
    text = 'x window.__DATA__ = {"a": "}\\"{", "b": {"c": 1}} ; y'
    assert json.loads(trust_probes.assigned_object(text, "__DATA__")) == {"a": '}"{', "b": {"c": 1}}
    assert trust_probes.assigned_object("window.X = 5", "X") is None and trust_probes.assigned_object('window.X = {"a"', "X") is None


def test_hints(spark):
    body = json.dumps({"data": {"subprocessors": ITEMS}})
    rows = [("p", 0, "https://x/api?operation=Other", "{}"), ("p", 1, "https://x/api?operationName=GetSubs", body), ("q", 0, "https://y/graphql", body), ("r", 0, "https://z/list", body)]
    caps = spark.createDataFrame(rows, "page_url string, ordinal int, url string, body string")
    assert {r.page_url: r.hint for r in trust_probes.capture_hints(caps).collect()} == {"p": "GetSubs", "q": "graphql", "r": None}
    stale = spark.createDataFrame([("p", "GetSubs"), ("q", "gone")], "page_url string, hint string")
    got = trust_probes.with_hints(caps, stale).groupBy("page_url").count().collect()
    assert {r.page_url: r["count"] for r in got} == {"p": 6, "q": 6, "r": 6}
    assert column(spark, ["https://t.com/acme/subprocessors", "https://t.com/legal/x", "https://t.com/x"], trust_probes.slug) == ["acme", None, None]


def test_arrays_and_organizations_at_any_depth(spark):
    deep = json.dumps(ITEMS)
    for i in range(30):
        deep = f'{{"k{i}": {deep}}}'
    got = trust.entity_arrays(spark.createDataFrame([("p", 0, deep), ("q", 0, None), ("r", 0, "not [json")], "page_url string, ordinal int, body string")).collect()
    assert len(got) == 1 and got[0].path.count(".") == 29 and json.loads(got[0]["items"][2]) == ITEMS[2]
    org = {"@type": "Corporation", "name": "Deep Co"}
    for _ in range(40):
        org = {"@type": "WebPage", "@graph": [{"@type": "Thing", "name": "No"}, {"publisher": org}]}
    page = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    cases = {page(org): "Deep Co", page([{"@type": "A"}, {"@type": "Brand", "name": "Brandy"}]): "Brandy", page({"@type": "Article", "author": {"@type": "Person", "name": "Jane"}}): None, page({"@type": "WebSite", "name": "Site"}): None, page({"@type": ["Organization"], "name": "X Co"}): None, page({"@type": "Organization", "legalName": "404", "name": "Fine Name"}): "Fine Name"}
    assert column(spark, cases, lambda h: web.schema_name(h)["organization"]) == list(cases.values())


def test_cascade_and_casing(spark):
    assert column(spark, ["openai, inc.", "Mongodb", "msft", "Google LLC", "acme"], O.normalize) == ["OpenAI", "MongoDB", "Microsoft", "Google", "Acme"]
    d = spark.createDataFrame([("github.com",), ("calculator.aws",), ("paypal.com",), ("mine.com",), ("x.data.com",), ("nobody.net",)], "domain string")
    known = spark.createDataFrame([("mine.com", "Mine"), ("PAYPAL.com", "My PayPal")], "domain string, organization string")
    data = spark.createDataFrame([("data.com", "Data Co"), ("github.com", "Microsoft Corporation")], "domain string, organization string")
    got = {r.domain: (r.organization, r.tier) for r in attribution.resolve_curated(d, [("overrides", known)], data).collect()}
    assert got == {"github.com": ("GitHub", "curated_correction"), "calculator.aws": ("Amazon", "brand_tld"), "paypal.com": ("My PayPal", "overrides"), "mine.com": ("Mine", "overrides"), "x.data.com": ("Data Co", "embedded_dataset"), "nobody.net": (None, None)}
    best = O.best_match(spark.createDataFrame([("Acme Inc",), ("Zzz",)], "name string"), spark.createDataFrame([("acme",), ("Acmee Corp",)], "name string"))
    assert [(r.name, r.candidate, r.similarity) for r in best.collect()] == [("Acme Inc", "acme", 1.0)]


def test_redirects(spark):
    rows = [("https://k.bamboohr.com/", "https://www.bamboohr.com/", True), ("https://k.auth0.com/x", "https://auth0.com/login", True), ("https://k.duosecurity.com", "https://duo.com/", True), ("https://jobs.lever.co/k", "https://jobs.lever.co/", True), ("https://k.zendesk.com/", "https://k.zendesk.com/hc", False), (None, "https://a.com", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(registry.redirected_to_main_site(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_parents(spark):
    got = scan.from_parents(spark.createDataFrame([("app.acme.co.uk",), ("acme.com",)], "target string")).collect()
    assert [(r.domain, r.raw_record) for r in got] == [("acme.co.uk", "Subdomain analysis: app.acme.co.uk -> acme.co.uk")]
