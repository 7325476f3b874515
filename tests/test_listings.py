import pytest
from pyspark.sql import functions as F

from tierweave.operators import listings, subprocessors
from tierweave.operators import nodes as N

TABLE = """<html><body><h2>Our Subprocessors</h2><table class="subprocessor-table"><thead><tr><th>Entity Name</th><th>Purpose</th><th>Location</th></tr></thead><tbody>
<tr><td>Stripe Inc.</td><td>Payment processing</td><td>United States</td></tr><tr><td>SendGrid LLC (d/b/a Twilio SendGrid)</td><td>Email delivery</td><td>United States</td></tr>
<tr><td>Sentry (sentry.io)</td><td>Error monitoring</td><td>United States</td></tr><tr><td>Amazon Web Services, Inc.</td><td>Cloud infrastructure</td><td>United States</td></tr>
<tr><td>Intercom, Inc.</td><td>Customer messaging</td><td>United States</td></tr></tbody></table></body></html>"""
LISTS = """<html><body><nav><ul><li>Home - start</li><li><b>About</b></li></ul></nav><h2>Third Party Service Providers</h2><p>We use the following subprocessors to provide our services:</p><ul class="vendor-list">
<li><strong>GitHub, Inc.</strong> - Code repository hosting</li><li><strong>Slack Technologies, Inc.</strong> - Team communication</li><li><strong>Zoom Video Communications, Inc.</strong> - Video conferencing</li>
<li><strong>Atlassian Corporation (atlassian.com)</strong> - Project management</li><li><strong>Datadog, Inc.</strong> - Application monitoring</li></ul>
<div class="processor-list"><h3>Additional Processors</h3><ol><li>Microsoft Corporation - Cloud services via azure.microsoft.com</li><li>Google LLC - Analytics and advertising</li><li>Mailgun Technologies, Inc. - Email delivery services</li>
<li>Twilio - messaging (twilio.com)</li></ol></div><h3>Our values</h3><ul><li>Honesty - always</li></ul></body></html>"""
OWN = """<html><body><p>Our subprocessors include the following companies:</p><table class="vendors"><tr><th>Company</th><th>Purpose</th></tr><tr><td>Stripe Inc. (stripe.com)</td><td>Payments</td></tr><tr><td>GitHub Inc. (github.com)</td><td>Code hosting</td></tr></table>
<table><tr><th>Company</th></tr><tr><td>Not Listed (notlisted.com)</td></tr></table><ul class="vendor-list"><li>Custom Vendor (customvendor.io)</li><li>Another Service Provider (serviceprovider.com)</li></ul></body></html>"""
LOOM = """<html><body><table><tbody><tr><td>Loom, Inc. (Atlassian)</td><td>Support</td></tr><tr><td>Mailgun Technologies, Inc. (d/b/a Sinch Email)</td><td>Email</td></tr><tr><td>Functional Software, Inc. (Sentry.io)</td><td>Error tracking</td></tr></tbody></table></body></html>"""
BULLETS = "<html><body>" + "".join(f'<div class="row"><div>{a}</div><div>•</div><div>{b}</div></div>' for a, b in (("Amazon Web Services", "Infrastructure Hosting"), ("Cloudflare", "Content Delivery"), ("Datadog", "Monitoring"), ("Vanta", "Core"), ("OpenAI, LLC", "AI Services"))) + "</body></html>"


def pages(spark, *rows):
    return spark.createDataFrame([(f"https://{h}/subprocessors", t) for h, t in rows], "url string, html string")


def domains(found):
    return {r.domain for r in found.collect()}


KNOWN = [("Stripe", "stripe.com"), ("GitHub Inc", "github.com"), ("Slack Technologies", "slack.com"), ("Datadog", "datadoghq.com"), ("Google", "google.com"), ("Mailgun Technologies", "mailgun.com"), ("Twilio SendGrid", "sendgrid.com"), ("Intercom", "intercom.com")]


def test_tables_name_vendors(spark):
    nodes = N.page_nodes(pages(spark, ("example.com", TABLE)))
    found = listings.tables(nodes)
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"Stripe Inc.", "SendGrid LLC", "Sentry", "Amazon Web Services, Inc.", "Intercom, Inc."}
    assert rows["Sentry"].domain == "sentry.io" and rows["SendGrid LLC"].other_name == "Twilio SendGrid" and rows["Stripe Inc."].evidence == "Stripe Inc. | Payment processing | United States"
    known = spark.createDataFrame(KNOWN, "organization string, domain string")
    assert domains(subprocessors.filter_results(listings.by_other_name(found, known), known)) == {"stripe.com", "sentry.io", "sendgrid.com", "intercom.com"}


def test_lists_name_vendors(spark):
    found = listings.lists(N.page_nodes(pages(spark, ("example.com", LISTS))))
    rows = {r.name: r.domain for r in found.collect()}
    assert set(rows) == {"GitHub, Inc.", "Slack Technologies, Inc.", "Zoom Video Communications, Inc.", "Atlassian Corporation", "Datadog, Inc.", "Microsoft Corporation", "Google LLC", "Mailgun Technologies, Inc.", "Twilio"}
    assert rows["Atlassian Corporation"] == "atlassian.com" and rows["Microsoft Corporation"] == "azure.microsoft.com" and rows["Twilio"] == "twilio.com"
    known = spark.createDataFrame(KNOWN, "organization string, domain string")
    assert {"github.com", "slack.com", "datadoghq.com", "google.com", "mailgun.com"} <= domains(subprocessors.filter_results(found, known))


def test_own_patterns_and_selectors(spark):
    nodes = N.page_nodes(pages(spark, ("test.com", OWN)))
    rules = lambda *s: spark.createDataFrame([("test.com", x) for x in s], "host string, selector string")
    assert domains(listings.tables(nodes, ("company", "vendor name", "organization"), rules("table.vendors", ".processor-table"))) == {"stripe.com", "github.com"}
    assert domains(listings.lists(nodes, selectors=rules("ul.vendor-list", ".processor-list li"))) == {"customvendor.io", "serviceprovider.com"}
    assert domains(listings.lists(nodes, selectors=rules("ul.vendor-list li:first-child"))) == {"customvendor.io"}


def rules(spark, host, selectors=(), patterns=(), names=(), exclusions=()):
    frame = lambda rows, schema: spark.createDataFrame([(host, *(r if isinstance(r, tuple) else (r,))) for r in rows], schema)
    return frame(selectors, "host string, selector string, attribute string, transform string"), frame(patterns, "host string, pattern string, capture int"), frame(names, "host string, name string, domain string"), frame(exclusions, "host string, pattern string")


def test_custom_rules_take_the_earliest_name(spark):
    p = pages(spark, ("test.com", LOOM), ("other.com", LOOM))
    names = (("loom", "loom.com"), ("atlassian", "atlassian.com"), ("mailgun technologies", "mailgun.com"), ("sinch email", "sinch.com"), ("functional software", "sentry.io"), ("sentry", "sentry.io"))
    own = rules(spark, "test.com", [("table tbody tr td:first-child", None, "trim")], names=names)
    found = listings.custom(p, N.page_nodes(p), *own)
    assert sorted((r.page_url, r.domain) for r in found.collect()) == [("https://test.com/subprocessors", d) for d in ("loom.com", "mailgun.com", "sentry.io")]


def test_custom_patterns_cross_elements(spark):
    p = pages(spark, ("trust.vanta.com", BULLETS))
    names = (("Amazon Web Services", "amazon.com"), ("Cloudflare", "cloudflare.com"), ("Datadog", "datadoghq.com"), ("OpenAI", "openai.com"))
    patterns = ((r"(?:^|\s)([A-Z][a-zA-Z\s]+(?:,?\s*(?:Inc|LLC|Corp|Ltd)\.?))", 1), (r"([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)*)\s*[••]\s*[A-Z]", 1))
    own = rules(spark, "trust.vanta.com", patterns=patterns, names=names, exclusions=["^(?i:Vanta|Core Product|Infrastructure|Application)$"])
    found = domains(listings.custom(p, N.page_nodes(p), *own))
    assert {"amazon.com", "cloudflare.com", "datadoghq.com", "openai.com"} <= found and "_org:Vanta" not in found


def test_selectors(spark):
    html = '<div id=a class="x y"><p>1<p>2 <b>bold</b><ul><li data-k="q r">one<li>two<ul><li>deep</ul></ul></div><p title=t>3<script>"<li>no"</script><table><tr><td>r0<td>r1<table><tr><td>in</table></table>'
    nodes = N.page_nodes(pages(spark, ("a.com", html), ("b.com", html)).unionByName(spark.createDataFrame([("https://a.com/none", None), ("https://a.com/empty", "")], "url string, html string")))
    wanted = {
        "p": ["1", "2 bold", "3"], "#a > p": ["1", "2 bold"], "div.x.y p + p b": ["bold"], "p ~ ul > li:last-child": ["two deep"], "ul li li": ["deep"], "[data-k~='r']": ["one"], "[data-k^=q], [title]": ["3", "one"], "[title$='x']": [], "li:nth-child(2)": ["two deep"],
        "table tbody > tr > td:first-child": ["in", "r0"], "td td": ["in"], "li:contains('deep')": ["deep", "two deep"], "*[title*='t']": ["3"], "x-y": [],
    }
    rules = spark.createDataFrame([("A.com", s) for s in wanted] + [(None, "b")], "host string, selector string")
    got = {s: [] for s in wanted}
    for r in N.select(nodes, rules).collect():
        if r.selector == "b":
            assert r.text == "bold"
        else:
            assert r.page_url.startswith("https://a.com")
            got[r.selector].append(r.text)
    assert {s: sorted(t) for s, t in got.items()} == wanted
    assert nodes.where("page_url like '%none' or page_url like '%empty'").count() == 2
    assert N.select(nodes, rules.limit(0)).count() == 0 and N.select(nodes.limit(0), rules).count() == 0


@pytest.mark.parametrize("selector", ["", "a:hover", "a >", "a,,b", "[x", "a::before"])
def test_selectors_not_understood(selector):
    with pytest.raises(ValueError):
        N.parse(selector)


@pytest.mark.parametrize("html", ["<", "</", "<table><td>x</table></td>", "<li><li></ul></li>" * 50, "<!-- x", "<a b='", "&#x110000;&bogus;", "<div>" * 3000, "<![CDATA[x]]><?y?>"])
def test_odd_pages_have_a_tree(html):
    rows = N.tree(html)
    assert all(r[1] is None or r[1] < r[0] <= r[2] <= rows[r[1]][2] for r in rows) and all(r[9] <= r[10] for r in rows)


def test_no_pages(spark):
    nodes = N.page_nodes(pages(spark, ("a.com", None)).limit(0))
    p = pages(spark, ("a.com", None))
    assert listings.tables(nodes).count() == listings.lists(nodes).count() == listings.custom(p, N.page_nodes(p), *rules(spark, "a.com")).count() == 0
    assert N.page_nodes(p).select(F.max("node")).first()[0] == 0
