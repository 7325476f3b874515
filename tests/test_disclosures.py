import json

from pyspark.sql import functions as F

from tierweave.operators import trust_api
from tierweave.plans import disclosures

REPORT = {"_embedded": {"subprocessors": [{"id": f"s{i}", "canonical_asset_id": f"ca{i}", "description": d, "data_locations": ["US"]} for i, d in enumerate(("Cloud", "CDN", "Monitoring", "Auth"), 1)],
    "canonical_assets": [{"id": f"ca{i}", "name": n, "website": w} for i, (n, w) in enumerate((("AWS", "https://aws.amazon.com"), ("Cloudflare", "https://cloudflare.com"), ("Datadog", "https://datadoghq.com"), ("Okta", None)), 1)]}}


def report_page(slug, data):
    asset = f'window.CANONICAL_ASSET = {{"id":"abc-123","slug":"{slug}","name":"Acme {{Inc}}."}};' if slug else ""
    return f"<html><body><script>{asset} window.VENDOR_REPORT = {json.dumps(data)};</script></body></html>"


def few(n):
    return {"_embedded": {k: v[:n] for k, v in REPORT["_embedded"].items()}}


def center(products):
    return f'<script>window.__SB_CONFIG__ = {{}};</script><script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"orgInfo": {"sp": {"products": products}}}}})}</script>'


def product(entries, **more):
    return {**more, "raw": {"spData": {"items": {"uid-1": {"listEntries": entries}, "uid-2": {"title": "none"}}}}}


def entries(n, prefix="v", **more):
    return [{"company": {"name": f"{prefix}{i} Inc", "domain": f"www.{prefix}{i}.com"}, "purpose": f"p{i}", "location": "US", **more} for i in range(n)]


def frame(spark, pages):
    return spark.createDataFrame(list(pages.items()), "url string, html string")


def test_reports_become_strategies(spark):
    pages = frame(spark, {"https://a/": report_page("acme", REPORT), "https://b/": report_page(None, few(3)), "https://c/": report_page("x", few(1)), "https://d/": '<script>window.APP_CONFIG = {"key": "value"};</script>', "https://e/": "window.VENDOR_REPORT = {broken", "https://f/": None})
    rows = {r.page_url: r for r in trust_api.report_strategies(trust_api.vendor_reports(pages)).collect()}
    assert set(rows) == {"https://a/", "https://b/"}
    a, b = rows["https://a/"], rows["https://b/"]
    assert (a.n_items, a.slug, a.method, a.kind) == (4, "acme", "GET", "rest") and "slug=acme" in a.url and a.score >= 0.9
    assert (b.slug, b.url) == (None, "")


def test_assets_are_joined_inside_the_answer(spark):
    odd = json.loads(json.dumps(REPORT))
    odd["_embedded"]["subprocessors"].append({"id": "s9", "canonical_asset_id": "none"})
    odd["_embedded"]["canonical_assets"].append({"id": "ca1", "name": "AWS again", "website": "aws2.com"})
    plain = {"_embedded": {"subprocessors": [{"name": f" N{i} ", "website": f"https://www.n{i}.com/x", "description": "d"} for i in range(3)]}}
    pages = frame(spark, {"https://a/": report_page("a", odd), "https://b/": report_page("b", plain), "https://c/": report_page("c", REPORT)})
    got = {(r.page_url, r.domain, r.evidence) for r in trust_api.vendors(pages).collect()}
    assert {g[1:] for g in got if g[0] == "https://a/"} == {("aws2.com", "AWS again | Cloud"), ("cloudflare.com", "Cloudflare | CDN"), ("datadoghq.com", "Datadog | Monitoring"), ("_org:Okta", "Okta | Auth")}
    assert {g[1:] for g in got if g[0] == "https://b/"} == {(f"n{i}.com", f" N{i}  | d") for i in range(3)}
    # An answer of the public address is read instead of the page.
    url = "https://api.conveyor.com/public/public_vendor_reports/by_slug?slug=c&embed_canonical_assets=true"
    responses = spark.createDataFrame([("get", url, None, 200, json.dumps(few(1))), ("GET", url.replace("=c&", "=a&"), None, 404, "{}")], "method string, url string, body string, status int, response string")
    got = {(r.page_url, r.domain) for r in trust_api.vendors(pages, responses).collect()}
    assert {d for u, d in got if u == "https://c/"} == {"aws.amazon.com"} and len([1 for u, _ in got if u == "https://a/"]) == 4


def test_products_that_are_shown(spark):
    nameless = [{"company": {"name": ""}}] * 5 + entries(1)
    pages = frame(spark, {
        "https://a/": center({"p1": product(entries(4), slug="main"), "p2": product(entries(9, "hidden"), show=False), "p3": product(entries(2, "few"))}),
        "https://b/": center({"p1": product(nameless), "p2": product(entries(3), show="no")}), "https://c/": center([]), "https://d/": "__SB_CONFIG__", "https://e/": center({"x": product(entries(5))}).replace("__SB_CONFIG__", "OTHER"),
    })
    rows = {r.page_url: r for r in trust_api.product_lists(pages).collect()}
    assert set(rows) == {"https://a/", "https://b/"} and (rows["https://a/"].slug, rows["https://a/"].n_items) == ("main", 4) and rows["https://b/"].slug == "p2"
    assert {r.domain for r in trust_api.vendors(pages).where("page_url = 'https://a/'").collect()} == {f"v{i}.com" for i in range(4)}


def test_strategies_are_looked_up(spark):
    base = dict.fromkeys(f.split()[0] for f in trust_api.STRATEGY.split(", "))
    mapping = {"path": "data.list", "name_field": "name", "url_field": "site.url", "purpose_field": "use", "evidence_fields": ["name", "use"]}
    graph = {**base, **mapping, "kind": "graphql", "slug": "acme", "query": 'query L { trust(slug: "{{slug}}") }', "variables": {"b": "2", "a": "{{slug}}"}, "operation": "L"}
    given = spark.createDataFrame([
        {**graph, "page_url": "g", "url": "https://api/{{slug}}"}, {**graph, "page_url": "errors", "url": "https://bad"}, {**graph, "page_url": "other", "url": "https://api/{{slug}}", "operation": "M"},
        {**base, **mapping, "page_url": "post", "kind": "rest", "url": "https://rest", "method": "post", "body": '{"s":"{{slug}}"}', "slug": "x"}, {**base, **mapping, "page_url": "get", "kind": "rest", "url": "https://rest", "path": "", "evidence_fields": []},
    ], trust_api.STRATEGY)
    answer = json.dumps({"data": {"list": [{"name": "One", "site": {"url": "one.com"}, "use": "mail"}, {"name": "Two"}, {"name": "3"}, {"x": 1}]}})
    asked = json.dumps({"operationName": "L", "variables": {"a": "acme", "b": "2"}, "query": 'query L { trust(slug: "acme") }'})
    responses = spark.createDataFrame([
        ("POST", "https://api/acme", asked, 200, answer), ("POST", "https://bad", asked, 200, answer[:-1] + ',"errors":[{"message":"no"}]}'), ("POST", "https://rest", '{"s":"x"} ', 201, answer), ("GET", "https://rest", "", 200, '[{"name":"Bare","site":{"url":"https://bare.io"}}]'),
    ], "method string, url string, body string, status int, response string")
    got = sorted((r.page_url, r.domain, r.evidence) for r in trust_api.read(trust_api.answered(trust_api.requests(given), responses)).collect())
    assert got == [("g", "_org:Two", "Two"), ("g", "one.com", "One | mail"), ("get", "bare.io", "Bare"), ("post", "_org:Two", "Two"), ("post", "one.com", "One | mail")]
    assert trust_api.vendors(frame(spark, {"u": ""}), responses, given).count() == 5 and trust_api.vendors(frame(spark, {"u": None})).count() == 0


def test_levels_in_their_order(spark):
    table = "<table><tr><th>Vendor</th></tr><tr><td>Tab ({}.com)</td></tr></table>"
    listed = "<h2>Subprocessors</h2><ul><li>Item ({}.com) - x</li></ul>"
    pages = frame(spark, {
        "https://one.com/subprocessors": listed.format("listone"), "https://www.one.com/vendors/": table.format("tabone"), "https://two.com/subprocessors": listed.format("listtwo"), "https://two.com/nowhere": table.format("tabtwo"),
        "https://three.com/legal/subprocessors": report_page("t", REPORT) + table.format("tabthree"), "https://four.com/subprocessors": table.format("tabfour"), "https://five.com/subprocessors": None,
    })
    pages = pages.unionByName(pages.where(F.col("url").contains("one.com")))
    captures = spark.createDataFrame([("https://four.com/subprocessors", 0, "u", json.dumps({"vendors": [{"name": f"Cap {i}", "url": f"https://cap{i}.com"} for i in range(5)]}))], "page_url string, ordinal int, url string, body string")
    vendors = spark.createDataFrame([(d,) for d in ("one.com", "two.com", "three.com", "four.com", "five.com", "six.com", None, "one.com")], "domain string")
    got = {(r.target, r.method, r.domain) for r in disclosures.phase(vendors, pages, captures).collect()}
    assert {g[:2] for g in got} == {("one.com", "table"), ("two.com", "list"), ("three.com", "trust_center"), ("four.com", "capture")}
    assert {d for t, _, d in got if t == "one.com"} == {"tabone.com"} and {d for t, _, d in got if t == "two.com"} == {"listtwo.com"} and ("four.com", "capture", "cap4.com") in got
    assert disclosures.phase(vendors.limit(0), pages).count() == 0 and disclosures.phase(vendors, pages.limit(0), captures).count() == 0
