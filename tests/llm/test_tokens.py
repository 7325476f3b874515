import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierweave.llm import bpe, coder, idstore, packing, prefix
from tierweave.llm.words import WordTable, library, vocabulary

ODD = [
    "", "a  b\n c", "<|endoftext|> x<|startoftext|>y!!<|endoftext|>z", "İstanbul ΣΑΣ é é \xa0x\x1cy 日本語", "it's  we'll\t\n z 'S DON'T ''s !'s x", "  lead", "trail  ", "\n\n x \n", "x y 1234 12a3 a1 !!??  ,,", "ÿÀ×÷ß Straße", "café's",
    "ﬁ ½ ²", "a \nb", " ", "\n", " a", "\n\n\n   \n\n a\n\n b    c\t d", "w" * 900, "same words same words same words",
]


def docs(spark, texts=(*ODD, None)):
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts)] + [(None, "no id", "y", None), (3, "again", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, piece double")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_encode_as_the_library(name):
    path = vocabulary(name)
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("ab é'sT.1 \n<|>ß日") for _ in range(80)) for _ in range(150))]
    offsets, ids = WordTable(path).encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library(path).encode(t, add_special_tokens=False).ids, repr(t)


def test_encode_and_decode(spark):
    lib = library(vocabulary("byte_bpe_50k.json"))
    got = bpe.encode_documents(docs(spark))
    assert got.count() == len(ODD) + 3
    for r in got.join(docs(spark).select(F.col("doc_id").alias("i"), "text"), F.col("i") == F.col("doc_id")).where("doc_id <> 3").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_documents(got.where("doc_id <> 3")).collect()}
    assert all(back[i] == t for i, t in enumerate(ODD) if i != 3)
    assert bpe.encode_documents(docs(spark).limit(0)).count() == 0


def test_batches_share_one_table_of_words(spark, monkeypatch):
    texts = ["same words here", "other words", None, "same  same", "x" * 70_000 + " words"]
    whole = {(r.doc_id, r.ids_sha256) for r in bpe.encode_documents(docs(spark, texts), with_ids=False).collect()}
    assert {(r.doc_id, r.ids_sha256) for r in bpe.encode_documents(docs(spark, texts), with_ids=False, batch_bytes=8).collect()} == whole
    lib = library(vocabulary("byte_bpe_50k.json"))
    assert all((i, hashlib.sha256(np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) in whole for i, t in enumerate(texts))
    rows = bpe.distinct_words(docs(spark, texts), 3, 8).where("bucket >= 0").collect()
    words = [w for r in rows for w in _words(r.data)]
    assert len(words) > len(set(words)) and set(words) == {w.encode() for t in [*texts, "no id", "again"] if t for w in bpe.cuts(t)}


def _words(data):
    lens, raw = bpe._unpacked(data)
    ends = np.cumsum(lens)
    return [raw[e - n : e] for n, e in zip(lens.tolist(), ends.tolist(), strict=True)]


def test_any_order_of_rows_and_small_tables_give_the_same_ids(spark, monkeypatch):
    texts = [f"word{i} word{i % 7} shared words é{i}" for i in range(300)]
    lib = library(vocabulary("byte_bpe_50k.json"))
    want = sorted(hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in texts)
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mixed = own.repartition(6).orderBy(F.rand())  # each reading gives another order
    assert sorted(r.ids_sha256 for r in bpe.encode_documents(mixed, with_ids=False, batch_bytes=500).collect()) == want
    monkeypatch.setattr(bpe, "MOST_WORDS", 5)
    monkeypatch.setattr(bpe, "BUCKET", 100)
    assert sorted(r.ids_sha256 for r in bpe.encode_documents(own, with_ids=False).collect()) == want


def test_words_of_another_reading_are_refused(spark, tmp_path):
    import pyarrow as pa

    folder = f"file://{tmp_path}"
    own = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").coalesce(1)
    path = vocabulary("byte_bpe_50k.json")
    assert bpe.store_batches(bpe.encode_words(bpe.distinct_words(own, 8), path), folder) == 1
    number = int(bpe.distinct_words(own, 8).first().batch)
    assert len(bpe.read_batch(folder, number, bpe.batch_words(pa.array(["a b c"]))[2], 8)[2]) == 3
    with pytest.raises(ValueError):
        bpe.read_batch(folder, number, bpe.batch_words(pa.array(["a b d"]))[2], 8)


def test_prefix_counts_equal_every_encoding(spark):
    lib = library(vocabulary("byte_bpe_50k.json"))
    short = [t[:60] for t in ODD]
    for r in prefix.prefix_counts(docs(spark, short)).where("doc_id <> 3 and doc_id is not null").collect():
        t = short[r.doc_id]
        assert list(r["counts"]) == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], repr(t)


def test_token_counts_and_budgets(spark):
    lib = library(vocabulary("byte_bpe_50k.json"))
    for r in prefix.count_tokens(docs(spark), limit=5).where("doc_id <> 3 and doc_id is not null").collect():
        t = ODD[r.doc_id] if r.doc_id < len(ODD) else ""
        counts = [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), counts[-1], counts[-1] > 5)
        assert r.fits_chars == max(i for i, c in enumerate(counts) if c <= 5)


@pytest.mark.parametrize("n", [0, 1, 255, 512, 513, 3000, 70_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for x in (rng.integers(0, 65535, n), np.zeros(n, int), rng.integers(0, 3, n), np.full(n, 65534), np.tile(np.arange(7), n // 7 + 1)[:n], rng.zipf(1.3, n) % 49_408):
        assert (coder.decode(coder.encode(x)) == x).all()
    with pytest.raises(ValueError):
        coder.encode(np.array([65535]))


def test_full_counts_are_halved(monkeypatch):
    monkeypatch.setattr(coder, "MOST", 40)
    x = np.random.default_rng(1).zipf(1.5, 60_000) % 900
    assert (coder.decode(coder.encode(x)) == x).all()


def test_coder_learns():
    x = np.tile(np.arange(100, 130), 2000)
    assert len(coder.encode(x)) < len(x) / 8


def test_coder_beats_order_0_and_zlib_on_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    offsets, ids = WordTable(vocabulary("word_bpe_49k.json")).encode(texts)
    ids = np.insert(ids, offsets[1:], 2)
    n = np.bincount(ids)
    n = n[n > 0] / len(ids)
    size = len(coder.encode(ids)) / len(ids)
    assert size < -(n * np.log2(n)).sum() / 8
    assert size < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes())) / len(ids)


def test_blocks_stand_alone():
    ids = np.random.default_rng(5).zipf(1.4, 5000) % 3000
    data = idstore.chunk_bytes([5], np.array([5000]), ids, block=1024)
    assert (idstore.read_chunk(data)[2] == ids).all()
    assert data.endswith(coder.encode(ids[4000:]))  # five blocks of 1000 ids, each from an empty model


def test_damage_is_found():
    ids = np.arange(2000) % 77
    data = bytearray(idstore.chunk_bytes([5], np.array([2000]), ids))
    assert (idstore.read_chunk(bytes(data))[2] == ids).all()
    data[-40] ^= 255
    with pytest.raises(ValueError):
        idstore.read_chunk(bytes(data))


def test_id_files(spark):
    lib = library(vocabulary("word_bpe_49k.json"))
    got = idstore.read_ids(idstore.write_ids(docs(spark)), with_ids=True).orderBy("start").collect()
    assert len(got) == len(ODD) + 3 and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        if r.doc_id not in (3, None):
            assert list(r.ids) == [*lib.encode(ODD[r.doc_id] if r.doc_id < len(ODD) else "", add_special_tokens=False).ids, 2]
    assert idstore.read_ids(idstore.write_ids(docs(spark).limit(0))).count() == 0


def test_packing(spark):
    texts = ["w " * n for n in (1, 5, 9, 30, 30, 31, 64, 7, 200, 0)] * 3
    got = packing.pack(docs(spark, texts), size=64, with_ids=True).toPandas()
    lib = library(vocabulary("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        if i != 3:
            own = got[got.doc_id == i].sort_values("piece")
            ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
            assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()) for k in range(0, len(ids), 64)]
            assert [x for p in own.ids for x in p] == ids and own.start.tolist() == [64 * k for k in range(len(own))]
    got = got.sort_values(["sequence_id", "offset"])
    for _, s in got.groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2
    assert packing.pack(docs(spark).limit(0)).count() == 0


def test_configurations_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(5):
        sizes, need = np.sort(rng.choice(np.arange(17, 101), 6, replace=False)), rng.integers(1, 500, 6)
        configs, copies = packing.configurations(sizes, need, 100)
        assert (configs @ sizes <= 100).all() and np.allclose(copies @ configs, need)
        worth = np.linalg.solve(configs, np.ones(6))  # by duality: no configuration at all is worth more than one bin
        every = [(c, s) for c, s in itertools.chain.from_iterable(_configs(sizes, 100, k) for k in range(6))]
        assert worth.min() >= -1e-9 and max(c @ worth for c, _ in every) <= 1 + 1e-6


def _configs(sizes, room, k):
    for own in itertools.combinations_with_replacement(range(len(sizes)), k):
        if sum(sizes[i] for i in own) <= room:
            yield np.bincount(own, minlength=len(sizes)).astype(float) if own else np.zeros(len(sizes)), own


def test_groups_are_few_and_equal():
    own = packing._rounded({n: 7 for n in range(1, 4096)}, 4096, 16)
    assert len(own) == 16 and len({sum(k for _, k in x) for x in own.values()}) <= 2
    assert all(n <= top for top, x in own.items() for n, _ in x)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length(seed):
    rng = random.Random(seed)
    lengths = [rng.choice((4096, rng.randint(1, 4096), rng.randint(1, 300))) for _ in range(3000)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = packing.plan(dict(counts))
    placed: dict[int, int] = {}
    for own, copies in bins:
        assert copies > 0 and sum(own) <= 4096
        for n in own:
            placed[n] = placed.get(n, 0) + copies
    assert placed == counts
    assert sum(c for _, c in bins) <= 1.01 * -(-sum(lengths) // 4096) + 1


def test_long_text_without_spaces_is_counted():
    lib, own = library(vocabulary("byte_bpe_50k.json")), prefix.PrefixCounts(vocabulary("byte_bpe_50k.json"))
    text = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FA5, 40_000)))
    got = own.text(text)
    assert len(got) == 40_001 and got[-1] > 65_535
    for i in (1, 7, 20_000, 39_999, 40_000):
        assert got[i] == len(lib.encode(text[:i], add_special_tokens=False).ids)


HOSTILE = ["2323\r\n\xa0\x1f1Word", "a\x1c\x1d b", " \x1fx", "\u3000\u3000 x", "x\x85\x85 's", "'re 've'll'd '", "!'re", "foo  <|endoftext|>  x", "\n <|endoftext|>", "<|endoftext|", "日本語 テキスト", "e\u0301\u0301 x", "x\u2028 \u2029y", " " * 40 + "z", "\x1f" * 9 + " "]
PARTS = ["\x1c", "\x1f", "\x1e\x1d", "\xa0", "\u3000", "\x85", " ", "  ", "\n", "\r\n", "\t", "'s", "'re", "'l", "'", "<|endoftext|>", "<|endof", "|>", "Word", "the", " and", "12", "½", "日本", "é", "ß", "😀", "!", "--", "_", "\u200b", "\u0301", "ǅ", "x" * 20]


def test_every_prefix_of_hostile_strings():
    lib, own, rng = library(vocabulary("byte_bpe_50k.json")), prefix.PrefixCounts(vocabulary("byte_bpe_50k.json")), random.Random(5)
    texts = HOSTILE + ["".join(rng.choices(PARTS, k=rng.randint(1, 9))) for _ in range(10_000)]
    for t in texts:
        want = [len(e.ids) for e in lib.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)]
        assert own.text(t).tolist() == want, repr(t)
        if rng.random() < 0.01:
            own.trim(0)


def test_special_strings_part_words():
    lib, own = library(vocabulary("byte_bpe_50k.json")), prefix.PrefixCounts(vocabulary("byte_bpe_50k.json"))
    for t in ("日本<|endoftext|>語", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b <|endof", "x\n\n<|endoftext|>\n y!!<|endoftext|>!'s", "日!<|<|endoftext|>'re \n", "本" * 300 + "<|endoftext|>" + "x" * 300):
        assert own.text(t).tolist() == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t


def test_long_words_take_linear_time():
    own, rng = prefix.PrefixCounts(vocabulary("byte_bpe_50k.json")), np.random.default_rng(1)
    for low, high in ((0x4E00, 0x9FA5), (0x61, 0x7B), (0xE00, 0xE30)):
        text = "".join(map(chr, rng.integers(low, high, 30_000)))
        began = time.process_time()
        own.text(text)
        assert time.process_time() - began < 2, (low, time.process_time() - began)


def test_counts_of_empty_tables(spark):
    assert prefix.count_tokens(docs(spark).limit(0)).count() == 0 and prefix.prefix_counts(docs(spark).limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "two words"), (7, "two words"), (7, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in prefix.count_tokens(twice).collect())[0] == 0 and prefix.count_tokens(twice).count() == 3
