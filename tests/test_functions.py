import random

import pytest
from pyspark.sql import functions as F

from tierweave.functions import domains as D
from tierweave.functions import fixed_values as V
from tierweave.functions import orgs as O
from tierweave.functions import records as R


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, v string").coalesce(1).sortWithinPartitions("i").select(f(F.col("v"))).collect()]


def test_base_domain(spark):
    cases = {
        "_spf.google.com": "google.com", "MAIL.Acme.co.uk": "acme.co.uk", "eu.mailgun.org": "mailgun.org", "192.168.1.1": "192.168.1.1", "com": "com", "co.uk": "co.uk", "localhost": "localhost",
        "s3.amazonaws.com": "amazonaws.com", "a.b.internalzone": "b.internalzone", "x.github.io": "github.io", "": "", "acme.com.": "acme.com", "foo.com.sg": "foo.com.sg",
    }
    assert column(spark, cases, D.base_domain) == list(cases.values())
    assert column(spark, [None], D.base_domain) == [None]


def test_labels_and_suffixes(spark):
    assert column(spark, ["www.acme.co.uk", "co.uk", "1.2.3.4", "x.unknownzone"], D.registrable_label) == ["acme", None, None, None]
    assert column(spark, ["www.acme.co.uk", "acme.de", "x.unknownzone"], D.registry_suffix) == ["co.uk", "de", None]


def test_predicates(spark):
    assert column(spark, ["_spf.a.com", "a..b", "a.b.", "nodot", "a.b", "abc.de"], D.is_dns_name) == [True, False, False, False, False, True]
    assert column(spark, ["a.com", "http://a.com", ".a.com", "a", "a_b.com"], D.is_batch_domain) == [True, False, False, False, False]
    assert column(spark, ["stripe.com", "x.github.io", "a b.com", "nodot", "", "x.zzzunknown"], D.is_non_registrable) == [False, False, True, True, True, True]
    assert column(spark, ["x.amazon.com", "notamazon.com"], D.is_common_infrastructure) == [True, False]
    assert column(spark, ["notgodaddy.com"], D.is_certificate_infrastructure) == [True]
    assert column(spark, ["[::1]", "10.1", "a.com"], D.is_ip_host) == [True, True, False]


def test_registry_suffixes_of_the_list(spark):
    cases = {
        "acme.photography": "acme.photography", "a.shop.ninja": "shop.ninja", "calculator.aws": "calculator.aws", "acme.gov.pl": "acme.gov.pl", "www.foo.com.co": "foo.com.co", "a.b.com.gh": "b.com.gh", "x.city.kawasaki.jp": "city.kawasaki.jp",
        "a.x.y.ck": "x.y.ck", "a.www.ck": "www.ck", "d111.cloudfront.net": "cloudfront.net",
    }
    assert column(spark, cases, D.base_domain) == list(cases.values())
    kept = ["acme.games", "hotel.paris", "acme.education", "x.vercel.app", "telemetry.eu-central-1", "cluster.local"]
    assert column(spark, kept, D.is_non_registrable) == [False, False, False, False, True, True]


def test_every_rule_by_definition(spark):
    from tierweave.functions import suffixes

    rules = suffixes.rules()

    def labels(name):
        own = name.split(".")
        fits = [(".".join(own[i:]), len(own) - i) for i in range(len(own))]
        exceptions = [n - 1 for tail, n in fits if "!" + tail in rules]
        return max(exceptions, default=0) or max([n for tail, n in fits if tail in rules or n > 1 and "*." + tail.partition(".")[2] in rules], default=0)

    names = [f"{x}{r.lstrip('*!.')}" for r in sorted(rules) for x in ("", "a.", "b-1.a.", "x.www.")] + ["unknown.zone", "a.b.unknownzone", "x..com", "com", "a.b.c.d.e.co.uk"]
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(4)
    got = {r.n: (r.s, r.b, r.l) for r in df.select("n", D.registry_suffix(F.col("n")).alias("s"), D.base_domain(F.col("n")).alias("b"), D.registrable_label(F.col("n")).alias("l")).collect()}
    for n in set(names):
        own, k = n.split("."), labels(n)
        suffix, label = ".".join(own[-k:]) if k else None, own[-k - 1] if 0 < k < len(own) else None
        base = n if len(own) == 1 else ".".join(own[-(k + 1 if k else 2) :])
        plain = not n.startswith(tuple(V.TECHNICAL_PREFIXES))
        assert got[n][::2] == (suffix, label or None) and (got[n][1] == base or not plain), n


def test_another_suffix_list(spark, tmp_path):
    from tierweave.functions import suffixes

    path = tmp_path / "list.dat"
    path.write_text("// ===BEGIN ICANN DOMAINS===\ncom\nweird\nvery.weird\n*.wild\n!own.wild\n// ===BEGIN PRIVATE DOMAINS===\nhost.com\n")
    suffixes.use_list(str(path))
    try:
        cases = {"a.b.very.weird": "b.very.weird", "x.host.com": "host.com", "www.acme.com": "acme.com", "a.b.c.wild": "b.c.wild", "a.own.wild": "own.wild", "x.y.net": "y.net"}
        assert column(spark, cases, D.base_domain) == list(cases.values())
        assert column(spark, ["x.host.com", "x.y.net"], D.is_non_registrable) == [False, True]
    finally:
        suffixes.use_list(None)


def test_names(spark):
    assert column(spark, ["Acme", "a tool for you", "one two three four five six", ""], O.is_plausible_name) == [True, False, False, False]
    cases = {"ACME CORP": "Acme", "foo-bar ltd.": "Foo-Bar", "company": "Company", "  ": ""}
    assert column(spark, cases, O.normalize) == list(cases.values())
    assert column(spark, ["acme.com", "co.uk"], O.domain_label) == ["Acme", "co.uk"]


def test_similarity(spark):
    r = spark.createDataFrame([("Acme", "acme"), ("", "x"), ("abcd", "abce")], "a string, b string").select(O.similarity(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [1.0, 0.0, 0.75]


def brute_pairs(names, least):
    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return row[-1]

    found = set()
    for a in set(names):
        for b in set(names):
            x, y = a.lower(), b.lower()
            if a < b and (x == y or 1 - edits(x, y) / max(len(x.encode()), len(y.encode())) >= least):
                found.add((a, b))
    return found


@pytest.mark.parametrize("least", [0.8, 0.85])
@pytest.mark.parametrize("letters", ["abc", "abcé", "aé日😀", "😀é"])
def test_similar_names_equal_brute_force(spark, letters, least):
    rng = random.Random(letters)
    names = ["éa", "ééa", "A", "aaaaaaaaB", "aaaaaaaab", "😀", "😀😀", "x" * 30 + "é", "x" * 30 + "日"]
    for _ in range(80):  # each with a copy that some edits have changed
        own = "".join(rng.choices(letters, k=rng.randint(1, 12)))
        names.append(own)
        for _ in range(rng.randint(1, 2)):
            at = rng.randint(0, len(own))
            own = own[:at] + rng.choice(letters + " ") + own[at + rng.randint(0, 1) :]
        names.append(own)
    names = [n for n in names if n]
    got = {(r.a, r.b) for r in O.similar_names(spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "n string"), "n", least).collect()}
    assert got == brute_pairs(names, least) and ("éa", "ééa") in brute_pairs(names, 0.8)


def test_records(spark):
    assert column(spark, ["a.b-c", "1x", "", "é!"], R.mermaid_id) == ["a_b_c", "n1x", "unknown", "unknown"]
    assert column(spark, ["a|b*c_d"], R.escape_markdown) == ["a\\|b\\*c\\_d"]
    assert column(spark, ["aéb", "ab"], lambda c: R.truncate_bytes(c, 2)) == ["a", "ab"]
    assert column(spark, ["SPF", "x"], R.legacy_record_type) == ["DNS::TXT::SPF", "UNKNOWN"]
    assert R.record_types(spark).count() == 23


@pytest.mark.parametrize("text", ["", ".", "..", "%{i}", "v=spf1", "a" * 300])
def test_odd_texts_do_not_raise(spark, text):
    column(spark, [text], D.base_domain)
