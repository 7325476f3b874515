import random

import pytest
from pyspark.sql import functions as F

from tierweave.operators import clusters, ranks, relations, txt
from tierweave.plans import graph, scan


def near(a, b, least):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return 1 - row[-1] / max(len(a.encode()), len(b.encode())) >= least


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    names = []
    for _ in range(40):
        own = "".join(rng.choices("abcdé", k=rng.randint(6, 12)))
        for _ in range(rng.randint(1, 6)):  # chains of names, each like the one before it
            names.append(own.title() if rng.random() < 0.3 else own)
            at = rng.randrange(len(own))
            own = own[:at] + rng.choice("abcdé") + own[at + rng.randint(0, 1) :]
    rng.shuffle(names)
    rows = [(n, i) for i, n in enumerate(names)] + [(names[3], 9999), (None, 5)]
    got = {r.name: r.canonical.lower() for r in clusters.clusters(spark.createDataFrame(rows, "name string, seq long")).collect()}
    leads, want = [], {}
    for n in names:
        if n not in want:
            lead = next((x for x in leads if x == n.lower() or near(n.lower(), x, 0.85)), None)
            same = n.lower() in leads
            if lead is None:
                leads.append(n.lower())
            want[n] = n.lower() if same or lead is None else lead
    assert got == want
    assert clusters.clusters(spark.createDataFrame([], "name string, seq long")).count() == 0


def test_first_verification_equals_brute_force(spark):
    rng = random.Random(1)
    patterns = [(i, "".join(rng.choices("aBcD=-", k=rng.randint(1, 6))), f"d{i}") for i in range(60)] + [(99, None, "x")]
    texts = ["".join(rng.choices("AbCd=-", k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "zzz", "zzz"]
    records = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id int, rdata string, rank string")
    for own in (patterns, [*patterns, (50, "", "every")], []):
        got = {r.id: r.domain for r in txt.first_verification(records, spark.createDataFrame(own, "rank int, pattern string, domain string")).collect()}
        for i, t in enumerate(texts):
            fits = sorted((k, d) for k, p, d in own if t is not None and p is not None and p.lower() in t.lower())
            assert got[i] == (fits[0][1] if fits else None), (t, fits[:2])


def test_places(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3).withColumn("v", F.col("id") * 37 % 1000).repartition(7)
    got = {r.v: r.rank for r in ranks.ranked(df, [F.col("v").desc()]).collect()}
    assert got == {v: 999 - v for v in range(1000)}
    inside = ranks.ranked_within(df, "k", ["v"]).collect()
    for k in range(3):
        own = sorted((r for r in inside if r.k == k), key=lambda r: r.v)
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.rank_of for r in own} == {len(own)}
    assert ranks.ranked(df.limit(0), ["v"]).count() == 0


def test_layout_keeps_children_near_their_parents(spark):
    rows = [("root", "b", 1, 1), ("root", "a", 1, 2), ("b", "x", 2, 3), ("a", "y", 2, 4), ("b", "w", 2, 5), ("nobody", "o", 2, 6), ("a", "root", 2, 7), ("b", "y", 2, 8)]
    rel = spark.createDataFrame([(v, c, k, s) for c, v, k, s in rows], "nth_party_domain string, nth_party_customer_domain string, nth_party_layer int, seq long")
    got = sorted(((r.layer, r.row, r.col, r.domain, r.x) for r in relations.layout(rel, "root", columns=3).collect()))
    # a was seen as a customer after b, so y's parent is a, which stands left of b.
    assert got == [(0, 0, 0, "root", 0), (1, 0, 0, "a", -1), (1, 0, 1, "b", 1), (2, 0, 0, "y", -2), (2, 0, 1, "w", 0), (2, 0, 2, "x", 2), (2, 1, 0, "o", 0)]
    assert relations.layout(rel.limit(0), "root").count() == 1


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/scan"
    roots = spark.createDataFrame([("r",)], "root string")
    facts = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "c"), ("r", None)], "customer string, vendor string")
    whole = {(r.domain, r.layer) for r in graph.layers(roots, facts, checkpoint=None).collect()}
    real, calls = graph.marked, []

    def dies(layer, folder, depth):
        if depth == 2:
            layer.write.mode("overwrite").parquet(f"{folder}/layer-{depth}")  # written, not marked
            raise RuntimeError("killed")
        return real(layer, folder, depth)

    monkeypatch.setattr(graph, "marked", dies)
    with pytest.raises(RuntimeError):
        graph.layers(roots, facts, checkpoint=folder)
    monkeypatch.setattr(graph, "marked", lambda layer, folder, depth: calls.append(depth) or real(layer, folder, depth))
    seen = roots.select("root")
    own = graph.checkpoint_folder(folder, seen, max_depth=None, stop_at_infrastructure=False, skip_unregistrable=False, limits=None)
    assert graph.resumable(spark, own) == 1
    assert {(r.domain, r.layer) for r in graph.layers(roots, facts, checkpoint=folder).collect()} == whole and calls == [2, 3, 4]
    calls.clear()
    assert {(r.domain, r.layer) for r in graph.layers(roots, facts, checkpoint=folder).collect()} == whole and not calls
    # Other settings and other roots have layers of their own.
    graph.layers(roots, facts, max_depth=1, checkpoint=folder)
    graph.layers(spark.createDataFrame([("a",)], "root string"), facts, checkpoint=folder)
    assert calls == [1, 1, 2, 3]
    # A layer that lost rows is not whole.
    spark.read.parquet(f"{own}/layer-2").limit(0).write.mode("overwrite").parquet(f"{own}/layer-2x")
    (tmp_path / "scan" / own.rsplit("/", 1)[1] / "layer-2").rename(tmp_path / "moved")
    assert graph.resumable(spark, own) == 1


def test_minimal_scan(spark):
    answers = [("R.com", "v=spf1 include:_spf.a.com include:google.com ~all"), ("_spf.a.com", "v=spf1 include:_spf.b.net -all"), ("a.com", "v=DMARC1; rua=mailto:x@c.io"), ("c.io", "v=spf1 include:_spf.r.com include:_spf.deep.io -all"), ("google.com", "v=spf1 include:_spf.never.com"), (None, "x"), ("n", None)]
    frame = spark.createDataFrame(answers, "name string, rdata string")
    names = spark.createDataFrame([("a.com", "Acme"), ("r.com", "Root")], "domain string, organization string")
    roots = spark.createDataFrame([("r.com",)], "root string")
    rows = scan.minimal(roots, frame, names).collect()
    got = {(r.nth_party_customer_domain, r.nth_party_domain, r.nth_party_layer) for r in rows}
    # What an included record includes counts for the name itself.
    assert {("r.com", "a.com", 1), ("r.com", "google.com", 1), ("r.com", "b.net", 1), ("a.com", "c.io", 2), ("c.io", "deep.io", 3)} <= got
    assert not any(c == "google.com" for c, _, _ in got) and {r.nth_party_organization for r in rows if r.nth_party_domain == "a.com"} == {"Acme"}
    assert max(r.nth_party_layer for r in scan.minimal(roots, frame, names, max_depth=2).collect()) == 2
    assert scan.minimal(roots.limit(0), frame, names).count() == 0


def test_names_beyond_a_few_are_not_sent_to_every_task(spark, monkeypatch, capsys):
    shape = "nth_party_domain string, nth_party_organization string, nth_party_customer_domain string, nth_party_customer_organization string, root_customer_domain string, root_customer_organization string"
    proxy = "Domains By Proxy, LLC"
    rows = [(f"v{i}.com", proxy if i % 2 else f"Vendor {i} Ltd", f"c{i % 5}.org", proxy if i % 3 == 0 else f"Customer {i % 5}", "r.net", "Root Works") for i in range(30)]
    rows += [("v1.com", "Vendor 1 Ltd", "v2.com", None, "r.net", ""), ("", "x", "v4.com", " ", "r.net", "Root Works"), (None, None, "c1.org", "Customer 1", "r.net", "Root Works")]
    rel = spark.createDataFrame(rows, shape)
    key = lambda df: sorted(map(str, df.collect()))
    few = {f: key(f(rel)) for f in (relations.gate_intermediaries, relations.reconcile_names)}
    assert any("v2.com" in x and "nth_party_customer_organization='Vendor 2 Ltd'" in x for x in few[relations.reconcile_names])
    assert not any("Proxy" in x for x in few[relations.gate_intermediaries])
    monkeypatch.setattr(graph, "FEW", 1)  # of the root's one name
    for f, own in few.items():
        done = f(rel)
        assert key(done) == own
        capsys.readouterr()
        done.explain()
        plan = capsys.readouterr().out.split("Initial Plan")[-1]
        assert plan.count("ShuffledHashJoin") == 2 and plan.count("BroadcastHashJoin") == 1
