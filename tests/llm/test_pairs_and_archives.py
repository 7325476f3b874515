import base64
import hashlib
import io
import zipfile

import numpy as np
import pytest

import corpus_pipeline
from tierweave.llm import common, rabitq, simhash, storage, warc
from tierweave.llm.common import components


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 9), (7, 8), (8, 8), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 9: 2, 7: 7, 8: 7}
    assert components(edges.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 24))
    near = x[:40] + 0.12 * rng.standard_normal((40, 24))
    ball = x[0] + 0.05 * rng.standard_normal((60, 24))
    v = np.concatenate([x, near, ball, x[:3]]).astype(np.float32)
    rows = [(i, v[i].tolist(), "l", 1) for i in range(len(v))]
    odd = [(1000, None, "", 0), (1001, [], "", 0), (1002, [0.0] * 24, "", 0), (1003, [float("nan")] * 24, "", 0), (1004, [1.0, None], "", 0), (1005, [1.0, 0.0], "", 0), (1006, [2.0, 0.0], "", 0)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links string, node int")
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([min(root[i], *root[link[i]]) if link[i].any() else root[i] for i in range(len(u))])
        if (new == root).all():
            break
        root = new
    for block in (2048, 16):
        got = {r.vec_id: r for r in rabitq.near_duplicates(d, block=block, share=500).collect()}
        assert len(got) == len(rows) + len(odd)
        assert [got[i].n_links for i in range(len(u))] == link.sum(1).tolist()
        assert [got[i].component_id for i in range(len(u))] == root.tolist()
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1005))
        assert (got[1006].n_links, got[1006].component_id, got[1006].kept) == (1, 1005, False)
    assert rabitq.near_duplicates(d.limit(0)).count() == 0


def test_a_hot_bucket_makes_more_shares(spark):
    # One bucket holds a third of 3000 vectors: with blocks of 10, each of its vectors is dealt 100 times.
    sizes = spark.createDataFrame([(1000,)] + [(4,)] * 500, "size long")
    dealt = 1000 * 100 + 500 * 4
    for share in (50, 1000):
        assert rabitq.share_count(sizes, 10, share) == -(-dealt // share)
    assert rabitq.share_count(sizes.limit(0), 10, 50) == 1


def test_stored_forms_and_keys():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((300, 33))
    u /= np.linalg.norm(u, axis=1)[:, None]
    levels, step, left = rabitq.quantised(u)
    assert set(np.unique(levels % 2)) == {1.0} and np.abs(levels).max() == 15
    assert np.allclose(np.linalg.norm(u - levels * step[:, None], axis=1), left) and left.mean() < 0.15
    assert (rabitq.unpacked([x.tobytes() for x in rabitq.packed(levels)], 33) == levels).all()
    for scheme in (rabitq.Scheme(4, 2, 1, 3), rabitq.Scheme(2, 1, 2, 3)):
        own = rabitq.keys(levels, scheme)
        assert own.shape[1] * own.shape[2] == scheme.copies and own.max() < 66**2 and (rabitq.keys(levels[:3], scheme) == own[:3]).all()
        assert all(len(set(k)) == len(k) for v in own.tolist() for k in v)
        # Every pair that shares keys is met first in exactly one of them.
        a, b = np.triu_indices(300, 1)
        big = rabitq.largest(levels, scheme)
        table, key = rabitq.first_met(big[a], big[b], scheme, 33)
        for i, j, t, k in zip(a.tolist(), b.tolist(), table.tolist(), key.tolist(), strict=True):
            shared = [(x, y) for x in range(scheme.tables) for y in set(own[i, x].tolist()) & set(own[j, x].tolist())]
            assert ((t, k) in shared and t == min(shared)[0]) if shared else t == -1


def test_settings_meet_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    u, w = rng.standard_normal((2, 20_000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w -= (w * u).sum(1)[:, None] * u
    v = 0.9 * u + np.sqrt(1 - 0.81) * w / np.linalg.norm(w, axis=1)[:, None]
    r = rabitq.rotation(64, 0)
    for n in (50_000, 10**7):
        scheme = rabitq.settings(n, 64, 0.9, 1e-3)
        table, _ = rabitq.first_met(rabitq.largest(rabitq.quantised(u @ r)[0], scheme), rabitq.largest(rabitq.quantised(v @ r)[0], scheme), scheme, 64)
        assert (table < 0).mean() <= 1e-3
    assert rabitq.settings(100, 1, 0.9, 1e-4).copies <= 2


def test_bounds_hold_for_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    u = rng.standard_normal((400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.standard_normal((400, 64))
    w -= (w * u).sum(1)[:, None] * u
    v = 0.9 * u + np.sqrt(1 - 0.81) * w / np.linalg.norm(w, axis=1)[:, None]
    r = rabitq.rotation(64, 0)
    pdf = lambda x: dict(zip(("levels", "step", "left"), rabitq.quantised(x @ r), strict=True)) | {"factor": np.abs(x @ r).sum(1) / 8}
    both = {k: np.concatenate((pdf(u)[k], pdf(v)[k])) for k in ("levels", "step", "left", "factor")}
    own = rabitq.Stored.__new__(rabitq.Stored)
    own.levels, own.left, own.factor, own.turned = both["levels"], both["left"], both["factor"], (both["levels"] * both["step"][:, None]).astype(np.float32)
    a, b = rabitq.open_pairs(own, np.arange(400), np.arange(400, 800), 0.9, 5.0)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert all((i, 400 + i) in found for i in range(400)) and len(found) < 0.05 * 400 * 400


def test_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    u = rng.standard_normal((2, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    got = []
    for seed in range(400):
        r = rabitq.rotation(64, 100 + seed)
        signs, factor = u[:1] @ r > 0, np.abs(u[:1] @ r).sum(1) / 8
        got.append(float(rabitq.estimates(signs, factor, u[1:] @ r)[0][0, 0]))
    assert abs(np.mean(got) - u[0] @ u[1]) < 0.02


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("wide", [False, True])
def test_archive_reader(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment PK\x05\x06 within"
        with z.open(zipfile.ZipInfo("a/b.txt"), "w", force_zip64=wide) as f:
            f.write(b"hello world")
        z.writestr(zipfile.ZipInfo("empty"), b"")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    a = warc.Archive(Bytes(out.getvalue()), len(out.getvalue()))
    assert a.read("a/b.txt") == b"hello world" and a.read("a/b.txt", 6, 5) == b"world" and a.read("empty") == b""
    with pytest.raises(KeyError):
        a.read("packed")
    with pytest.raises(ValueError):
        warc.Archive(Bytes(b"no archive"), 10)


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(6):
            z.writestr(zipfile.ZipInfo(f"m{i}"), f"member {i}".encode() * 5)
    a = warc.Archive(Bytes(out.getvalue()), len(out.getvalue()))
    assert [a.read(f"m{i}") for i in range(6)] == [f"member {i}".encode() * 5 for i in range(6)]


def test_pages_round_trip(spark):
    html = ["<p>same</p>", "<p>same</p>", "", None, "é\r\n\r\nWARC/1.1", "y" * 200_000, "<p>same</p>", "lonely"]
    rows = [(i, f"http://x/ü {i}\r\n" if i % 2 else None, h, "z") for i, h in enumerate(html)] + [(None, None, "only null", "z"), (7, "u", "lonely", "z")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(d, package_bytes=1000)
    got = warc.read_archives(manifest, with_payload=True).collect()
    assert len(got) == len(rows) and manifest.count() > 1
    by = {}
    for r in got:
        by.setdefault(r.page_id, r)
    groups = {}
    for i, h in enumerate(html):
        groups.setdefault(h or "", []).append(i)
    for i, h in enumerate(html):
        last = max(groups[h or ""])
        r = by[i]
        assert r.payload_bytes == len((h or "").encode()) and r.payload_digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
        assert (bytes(r.payload) if r.payload is not None else None) == ((h or "").encode() if i == last else None)
    assert by[None].record_type == "response" and sum(r.page_id == 7 and r.record_type == "response" for r in got) == 2
    assert warc.read_archives(warc.write_archives(d.limit(0))).count() == 0


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    prose = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(150)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)] + [(50, prose[3], "en", "s", 1), (51, "short", "en", "s", 1), (52, prose[4] + " me@x.org", "en", "s", 1), (53, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "PII redaction", "best-fit packing"]
    docs = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 50 not in left and 51 not in left and 53 not in left and all(i in left for i in range(40))
    assert "me@x.org" not in left.get(52, "")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == set(left)


def test_tables_are_released(spark):
    common.release()
    found = simhash.simhash_components(spark.createDataFrame([(i, "one two three four" if i < 3 else f"w{i} x y z") for i in range(9)], "doc_id long, text string"))
    assert {r.component_id for r in found.collect() if r.doc_id < 3} == {0}
    paths = list(common.WRITTEN)
    assert paths and all(storage.system(p)[0].get_file_info(storage.system(p)[1]).type.name == "Directory" for p in paths)
    # Of the rounds of components only the last table is left.
    assert len([p for p in paths if "simhash-cc" in p or "/cc-" in p]) <= 1
    assert common.release() == len(paths) and common.release() == 0
    assert all(storage.system(p)[0].get_file_info(storage.system(p)[1]).type.name == "NotFound" for p in paths)


def test_pipeline_of_odd_rows(spark, tmp_path):
    prose = "the cat and the dog went over the hill to see what was on the other side of it and came home in the evening "
    good = [f"{prose}{i} once more they told us that number {i * 7} was the best of all these days and {prose}" for i in range(12)]
    rows = [(i, t, "en", "s", 1, "own") for i, t in enumerate(good)] + [(3, good[3], "en", "s", 1, "twice"), (None, good[5] + " more words", None, None, None, None), (50, None, "en", None, None, None), (51, "", "zz", None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == frame.columns and docs.count() <= len(rows), name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name
    assert docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count() and corpus_pipeline.STAGES[-1][1](spark, frame.limit(0), "").count() == 0
