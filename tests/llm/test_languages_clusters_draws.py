import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tierweave.llm import kdmeans, ppm, resampling

TEXTS = [
    ("en", "the cat and the dog, that is THE thing"), ("en", "other things; the then and there"), ("de", "der Hund und die Katze über"), ("de", "Straße und größer ist der"),
    ("el", "ΟΔΥΣΣΕΥΣ και λόγος"), (None, "der der der"), ("xx", "123 ... 456"), ("xx", None),
]


def brute_words(text):
    return [w.encode() + b" " for w in "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split(" ") if w]


def brute_tree(texts):
    tree = defaultdict(Counter)
    for t in texts:
        for w in brute_words(t or ""):
            line = b" " + w
            for i in range(1, len(line)):
                for k in range(min(i, ppm.ORDER) + 1):
                    tree[line[i - k : i]][line[i]] += 1
    return tree


def brute_probability(tree, context, byte):
    """By the definition: escape from context to context, excluding what was seen in the longer ones."""
    p, out = 1.0, set()
    while True:
        seen = {s: n for s, n in tree[context].items() if s not in out} if context in tree else {}
        if seen:
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                return p * seen[byte] / total
            p *= len(seen) / total
            out |= set(seen)
        if not context:
            return p / (256 - len(out))
        context = context[1:]


def brute_bits(tree, text):
    bits = 0.0
    for w in brute_words(text):
        line = b" " + w
        bits -= sum(math.log2(brute_probability(tree, line[max(0, i - ppm.ORDER) : i], line[i])) for i in range(1, len(line)))
    return bits


@pytest.fixture(scope="module")
def folder(spark):
    rows = [(lang, t, 1, 2, "x", "y") for lang, t in TEXTS]
    return ppm.fit(spark.createDataFrame(rows, "lang string, text string, k int, n int, code string, total string"))


def test_code_lengths_equal_brute_force(folder):
    own = ppm.trees(folder)
    assert own.langs == ["de", "el", "en"]  # a text without letters teaches nothing
    texts = ["the other dog", "über Straße!", "", "zebra (the) 12 and-then", "ΟΔΟΣ", "日本 ok", "a" * 3000, "...", "x\n\ny", "ǅ é"]
    lengths, letters = own.texts(pa.array(texts))
    for lang in own.langs:
        tree = brute_tree([t for own_lang, t in TEXTS if own_lang == lang])
        for got, t in zip(lengths[:, own.langs.index(lang)].tolist(), texts, strict=True):
            assert got / ppm.UNIT == pytest.approx(brute_bits(tree, t), abs=1e-3 + len(t) * 1e-4), (lang, t)
        for context in (b" th", b"", b"zzz", b" d", b"er ", " ü".encode()):
            assert sum(brute_probability(tree, context, b) for b in range(256)) == pytest.approx(1)
            # The stored trees as well; bytes 0 to 255 after a context of the language, as long as it is.
            code = np.array([len(context) << ppm.SHIFT | int.from_bytes(context + bytes([b]), "big") for b in range(256)])
            p = np.exp2(-own.lengths(code)[:, own.langs.index(lang)] / ppm.UNIT)
            assert p.sum() == pytest.approx(1, abs=1e-3)
            assert p == pytest.approx([brute_probability(tree, context, b) for b in range(256)], rel=1e-3, abs=1e-6)
    assert letters.tolist() == [sum(unicodedata.category(c)[0] == "L" for c in t.lower()) for t in texts]


def test_rare_contexts_are_left_out(spark):
    rows = [("en", "the then there the " * 50 + "zyx")]
    whole, pruned = (ppm.trees(ppm.fit(spark.createDataFrame(rows, "lang string, text string"), nodes)) for nodes in (1_000_000, 20))
    assert 0 < len(pruned.contexts) < len(whole.contexts)
    code = np.array([int.from_bytes(bytes([b]), "big") for b in range(256)])
    assert np.exp2(-pruned.lengths(code) / ppm.UNIT).sum() == pytest.approx(1, abs=1e-3)


def test_languages_of_odd_rows(spark):
    rows = [(i, t, lang, "clash", 0.5) for i, (lang, t) in enumerate(TEXTS * 4)]
    rows += [(None, "the dog", "en", None, None), (None, None, None, None, None), (5, "the", "en", None, None), (5, "und", "de", None, None), (900, "", "en", None, None), (901, "12 !", "en", None, None), (902, "die Katze " * 40_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = ppm.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[900].lang_pred, by[901].lang_pred, by[902].lang_pred) == ("und", "und", "de") and by[900].score == 0
    assert all((r.lang_pred == "und") == (r.score == 0) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sorted(r.lang_pred for r in got if r.doc_id is None) == ["en", "und"]
    assert {r.lang_pred for r in ppm.identify(docs.where("lang is null")).collect()} == {"und"}
    assert ppm.identify(docs.limit(0)).count() == 0


def test_held_out_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ppm.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 0


def brute_means(vectors, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**52 else scale * int(x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda z: far(v, centroids[z])) for _, v in kept]
        if n < rounds:
            for z in set(own):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == z]
                centroids[z] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    d = [far(v, centroids[z]) for (_, v), z in zip(kept, own, strict=True)]
    most = (1 << 63) - 1
    inertia = Counter()
    for z, x in zip(own, d, strict=True):
        inertia[z] += min(x, most)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, z, min(x, most), min(inertia[z], most), min(sum(inertia.values()), most), sha[z]) for (i, _), z, x in zip(kept, own, d, strict=True))


def vectors_frame(spark, vectors):
    return spark.createDataFrame([(i, v, "c", 3) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, n int")


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_clusters_equal_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 4))
    points = (centers[rng.integers(0, 6, 900)] + spread * rng.normal(size=(900, 4))).tolist()
    vectors = [(i, p) for i, p in enumerate(points)] + [(3, points[3]), (3, points[4]), (None, points[5]), (None, points[9])]
    vectors = [(i if i is not None else None, v) for i, v in vectors] + [(901, None), (902, []), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf")] * 4), (906, [1.0] * 5), (907, [0.0] * 4), (908, [0.0] * 4)]
    named = [("null" if i is None else i, v) for i, v in vectors]
    got = Counter((("null" if r.vec_id is None else r.vec_id), *r[1:]) for r in kdmeans.cluster(vectors_frame(spark, vectors), 7, 3, 4, 16).collect())
    assert got == brute_means(named, 7, 3, 4, 16, 2)


def test_ties_few_and_huge_vectors(spark):
    cases = [
        [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0])], [(1, [1.5, -0.3])], [(1, [1e30, 0.0]), (2, [-1e300, 5.0]), (3, [0.25, 0.5]), (4, [0.3, 0.5])], [(1, [20_000.0, 1.0]), (2, [3.0, 1.0]), (3, [19_000.0, 1.0])],
    ]
    for vectors in cases:
        got = Counter(tuple(r) for r in kdmeans.cluster(vectors_frame(spark, vectors), 3, 2, 2, 256).collect())
        assert got == brute_means(vectors, 3, 2, 2, 256, 2), vectors
    assert kdmeans.cluster(vectors_frame(spark, [(1, None)])).count() == 0 and kdmeans.cluster(vectors_frame(spark, cases[0]).limit(0)).count() == 0


def test_the_tree_prunes(spark):
    rng = np.random.default_rng(3)
    points = np.floor(100 * np.repeat(rng.normal(size=(8, 3)), 500, axis=0) + rng.normal(size=(4000, 3)))
    order, lows, highs, levels = kdmeans.build(points)
    assert sorted(order.tolist()) == list(range(4000)) and highs[0] == 4000 and levels[-1] == len(lows)
    centroids = points[::500].copy()
    cluster, counts, sums, compared = kdmeans.filtered(points[order], lows, highs, levels, centroids)
    assert (cluster == kdmeans.distances(points[order], centroids).argmin(1)).all() and compared < 400
    assert (counts == np.bincount(cluster, minlength=8)).all() and sums.sum() == points.sum()


DRAWS = ["the cat sat on the Mat " * 4, "the cat", "", None, "ünïcode straße 日本 " * 9, "a-b_c9 " * 30, "\x7f{x}~y" * 30, "the the the " * 400, "cat sat " * 15]


def brute_draw(docs, target, percent, least, buckets, longest, seed):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    feats = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, d in docs for f in feats(d)), Counter(bucket(f) for d in target for f in feats(d))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for i, d in docs:
        own = feats(d)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d))])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_draws_equal_brute_force(spark, longest):
    docs = [(i, t) for i, t in enumerate(DRAWS * 7)] + [(3, "the cat sat on the mat once more " * 3), (3, "the cat sat on the mat once more " * 3), (None, "on the mat " * 9), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in docs], "doc_id long, text string, rank int, columns string, part int").repartition(3)
    target = spark.createDataFrame([(1, "the mat the mat", 5), (2, None, 5), (3, "日本 cat", 5)], "item_id long, text string, doc_id int")
    got = Counter(tuple(r) for r in resampling.resample(frame, target, 40, 20, 50, longest).collect())
    assert got == brute_draw(docs, ["the mat the mat", None, "日本 cat"], 40, 20, 50, longest, 2024)


def test_draws_of_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(frame.limit(0), frame.select("text")).count() == 0
    got = resampling.resample(frame, frame.select("text").limit(0), percent=100).collect()
    assert [(r.n_features, r.rank) for r in got] == [(40, 1)]


def test_a_row_group_of_the_matrix_holds_few_blocks(spark):
    """What a task decodes at once stays the same however many blocks its split holds."""
    frame = spark.createDataFrame(list(enumerate(DRAWS * 7)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a block a document
    try:
        blocks = resampling.csr_blocks(frame, 50, 1)
        summed = int(resampling.column_sums(blocks, 50).sum())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == len(DRAWS) * 7 and max(groups) <= 4
    assert summed == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for t in DRAWS) * 7
