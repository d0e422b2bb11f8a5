"""Operators over documents, against brute force and exact libraries."""

import hashlib
import json
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe, langid, media, neardup, packing, quality, sharding, substrings
from shelfmark.llm.textcols import utf8, word_bounds

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, piece string, size string, feature string, key string, sig string"


def sample(seed=1, n=120):
    """Texts with nulls, copies, near copies, repeated lines, other scripts, and a long one."""
    r = random.Random(seed)
    voc = ["the", "of", "and", "haus", "straße", "año", "été", "x1", "don't", "42", "b|c", "###", "Zug.", "漢字", "🎉"] + [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(voc) for _ in range(r.choice([1, 3, 12, 13, 14, 40, 90]))) for _ in range(n)]
    texts = base + base[:20] + [t + " tail" for t in base[20:50]] + ["\n".join([base[50]] * 4), base[51].replace(" ", "\t\n")]
    texts += [None, "", "   \n\t", "a" * 3000, " ".join(r.choice(voc) for _ in range(9000)), "same line\n" * 30, "'tis 's don't I'LL we'll\r\n\r\n  x", "<|endoftext|> a<|endoftext|>"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs():
    rows = sample()
    return rows + [rows[3], (None, rows[4][1]), (5, "another text of a repeated id with more than thirteen words in it so that windows do count")]


@pytest.fixture(scope="module")
def df(spark, docs):
    # columns named like the operators' own must not disturb them
    langs = [None, "en", "de"]
    return spark.createDataFrame([(k, t, langs[(k or 0) % 3], "s", 1, "c", "c", "c", "c", "c", "c") for k, t in docs], SCHEMA).repartition(3).cache()


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_word_bounds():
    texts = ["", " a  b\x0bc\x1c", "é x\n", "z"]
    data, offsets = utf8(pa.array(texts))
    starts, ends, first = word_bounds(data, offsets)
    body = data.tobytes()
    got = [[body[a:b].decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [brute.words(t) for t in texts]


@pytest.mark.parametrize("bucket_windows", [250_000, 50])
def test_substrings(df, docs, bucket_windows):
    out = substrings.deduplicate(df, bucket_windows=bucket_windows)
    same(out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.substrings(docs))
    for r in out.where("n_removed > 0").select("text", "kept_sha256").collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("bucket_windows", [250_000, 20])
def test_rows_of_one_id_are_told_apart_by_whole_hashes(spark, monkeypatch, bucket_windows):
    """Two texts of one doc_id that agree in 16 bits of their hash, and a row that is there three times."""
    r = random.Random(11)
    old = " ".join(f"o{i}" for i in range(20))
    rows = [(7, " ".join(f"n{i}{r.randrange(10**6)}" for i in range(14)) + (" " + old if i == 5 else "")) for i in range(600)]
    hashes = [h.h & 65535 for h in spark.createDataFrame([(t,) for _, t in rows], "t string").select(F.xxhash64("t").alias("h")).collect()]
    assert len(set(hashes)) < len(rows)  # some do agree
    rows += [(1, old), (8, old), (8, old), (8, old)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket_windows=bucket_windows)
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.substrings(rows))


def test_every_bucket_may_be_large(spark, docs, df, monkeypatch):
    monkeypatch.setattr(substrings, "MARKS", 4)  # buckets share marks
    same(substrings.deduplicate(df, bucket_windows=20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.substrings(docs))


def test_substrings_of_a_large_group(spark):
    rows = [(i, "start " * (i % 3) + " ".join(f"p{j}" for j in range(30))) for i in range(200)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), bucket_windows=20)
    same(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.substrings(rows))


def test_window_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "mix", lambda x: x & np.uint64(0))
    ids = np.array([*range(13), *range(13), *range(1, 14)])
    order, heads = substrings._same_windows(ids, np.array([0, 13, 26]))
    assert sorted(np.diff([*heads, 3]).tolist()) == [1, 2] and set(order.tolist()) == {0, 1, 2}


@pytest.mark.parametrize("weights", ["ones", "counts"])
@pytest.mark.parametrize("block, block_bytes", [(4096, 32 << 20), (3, 32 << 20), (4096, 500)])
def test_near_duplicates(df, docs, weights, block, block_bytes):
    got = neardup.classes(df, weights=weights, bucket_block=block, cluster_block=block, block_bytes=block_bytes)
    same(got.select("doc_id", "class_id").collect(), brute.classes(docs, counts=weights == "counts"))


def test_keep_one(df, docs):
    kept = [r.doc_id for r in neardup.keep_one(df).collect()]
    classes = brute.classes(docs)
    assert {c for _, c in classes if c is not None} <= set(kept)
    assert Counter(kept) == Counter(k for k, c in classes if k == c)


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(5)
    e = r.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = r.random(300) * 3 + 0.1, r.random(300) * 3 + 0.1
    s = neardup.dart_signatures(np.r_[e, e], np.r_[a, b], np.repeat([0, 1], 300), 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_quality_counts(df, docs):
    got = quality.judge(df).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(k, *brute.quality(t)) for k, t in docs])
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and (r.rejected_by == "base") == r.base_failed


def test_quality_order_does_not_change_the_verdict(df, monkeypatch):
    verdicts = []
    for order in (list(quality.rules()), list(quality.rules())[::-1]):
        monkeypatch.setattr(quality, "cascade_order", lambda *a, order=order: order)
        verdicts.append(Counter(map(tuple, quality.judge(df).select("doc_id", "kept").collect())))
    assert verdicts[0] == verdicts[1]


def test_the_cascade_tries_what_rejects_most_for_its_cost_first(spark):
    words = " ".join(f"word{i}" for i in range(30))
    texts = [f"{words} {i}" for i in range(40)] + [f"{words} ### ### ###{i}" for i in range(4)] + [" ".join("a b c d e f g h i j k l m n o p q r s t u v".split()) + f" {i}" for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = quality.cascade_order(docs, "doc_id", "text")
    assert order[:2] == ["word_length", "symbols"] and set(order) == set(quality.rules())  # nine short-worded, four with symbols
    assert quality.cascade_order(docs.repartition(5), "doc_id", "text") == order


def test_samples_are_never_empty():
    from shelfmark.llm.shared import sample_bound

    for total in (10**3, 10**6, 10**9, 10**11, 10**15):
        assert abs(sample_bound(1000, total) / (1 << 63) * total - 1000) < 1
    assert sample_bound(1000, 0) == sample_bound(1000, 10) == (1 << 63) - 1


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_equals_the_library(df, docs, exact):
    got = bpe.decode(bpe.encode(df)).collect()
    want = []
    for k, t in docs:
        ids = exact.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), exact.decode(ids, skip_special_tokens=False)))
    same(got, want)


def test_bpe_on_random_strings(exact):
    r = random.Random(9)
    parts = list("abcdestrelvm  \t\n\r.,!?019é ßñ漢字🎉　 ॐ ''") + ["<|endoftext|>", "'s", "'re", "'ll", " '", "<|endof"]
    coder = bpe.bpe(bpe.vocabulary_path(), bpe.class_table())
    for _ in range(30):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(200)]
        ids, ends = coder.encode_batch(*utf8(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]
        assert coder.decode_batch(ids, ends) == texts


def test_bpe_of_long_words(exact):
    r = random.Random(3)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    coder = bpe.bpe(bpe.vocabulary_path(), bpe.class_table())
    texts = [letters, "the cat " + letters[:5000] + " sat", "ab" * 4000, "aab" * 3000 + "zq" * 300, "é漢" * 900]
    ids, ends = coder.encode_batch(*utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]


def test_bpe_decodes_incomplete_characters(exact):
    coder = bpe.bpe(bpe.vocabulary_path(), bpe.class_table())
    r = random.Random(4)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(20)]
        assert coder.decode_batch(np.array(ids, np.int32), np.array([0, 20])) == [exact.decode(ids, skip_special_tokens=False)]


def test_every_code_point_has_the_library_class(exact):
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    classes = bpe._classes(bpe.class_table())
    for point in random.Random(2).sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 20_000):
        together = [len(cut.pre_tokenize_str(p + chr(point))) == 1 for p in "a1!"]
        assert classes[point] == (together.index(True) if True in together else bpe.SPACE) or (together == [False, False, True] and classes[point] == bpe.OTHER)


@pytest.mark.parametrize("leaf_rows", [50_000, 20])
def test_packing(df, docs, exact, leaf_rows):
    rows = packing.pack(packing.pieces(df, capacity=256), capacity=256, leaf_rows=leaf_rows).collect()
    texts = Counter((k, tuple(exact.encode(t or "", add_special_tokens=False).ids) + (0,)) for k, t in docs)
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
        assert any(k == r.doc_id and len(ids) >= r.start + r.length and zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 for k, ids in texts)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(len(ids) * n for (_, ids), n in texts.items())
    assert sum(r.length for r in rows) == total
    for (k, ids), n in texts.items():
        if sum(m for (q, _), m in texts.items() if q == k) == 1:
            lengths = [r.length for r in sorted(by_doc[k], key=lambda r: r.piece)]
            assert lengths == ([len(ids)] if len(ids) <= 256 else [len(ids) % 256 or 256] + [256] * ((len(ids) - 1) // 256))
    assert len(bins) <= (1.25 if leaf_rows < 100 else 1.1) * -(-total // 256)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit(np.array([5, 7, 3, 4, 1]), 10)
    assert bins.tolist() == [1, 0, 0, 1, 1] and offsets.tolist() == [0, 0, 7, 5, 9]


def test_packing_small_bins_find_large_ones_in_other_partitions(spark):
    """Each partition's leftovers fit those of others: the tree goes on until nothing joins."""
    r = random.Random(6)
    rows = [(i, 0, 0, r.choice([200, 180, 56, 76, 130, 126]), 0) for i in range(2000)]
    bins = {gain: packing.pack(spark.createDataFrame(rows, packing.PIECE), capacity=256, leaf_rows=30, least_gain=gain).select("sequence_id").distinct().count() for gain in (0.0, 1.0)}
    together = int(packing.best_fit(np.array([x[3] for x in rows]), 256)[0].max()) + 1
    assert together <= bins[0.0] <= 1.1 * together and bins[0.0] <= bins[1.0]  # partitions of 30 items lose some fits for good


def test_packing_repeated_rows_part(spark):
    rows = [(1, 0, 0, 100, 5)] * 900
    out = packing.pack(spark.createDataFrame(rows, packing.PIECE).repartition(3), capacity=256, leaf_rows=20)
    assert out.count() == 900 and out.select("sequence_id").distinct().count() <= 460


def test_packing_items_that_never_join(spark):
    rows = [(i, 0, 0, 150, 0) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECE), capacity=256, leaf_rows=20)
    assert out.select("sequence_id").distinct().count() == 300 and out.count() == 300


def test_shards(df, docs):
    rows = sharding.kd_shards(sharding.document_rows(df), shards=5).collect()
    same([(r.doc_id, r["size"], r.text_crc32) for r in rows], [(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in docs])
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("ids", ["large", "negative", "null", "hashed"])
def test_shards_of_unequal_sizes_and_any_ids(spark, ids):
    r = random.Random(2)
    number = {"large": lambda i: 2**40 + i, "negative": lambda i: -i * 2**33, "null": lambda i: None, "hashed": lambda i: r.randrange(-(2**63), 2**63)}[ids]
    rows = [(number(i), "x" * int(r.lognormvariate(4, 1.2)), r.choice(["de", "en", None]), f"host{r.randrange(300)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    dims = sharding.document_rows(docs)
    if ids != "null":
        assert dims.select("d0").distinct().count() > 5000 and dims.agg(F.min("d0"), F.max("d0")).first()[:] == (1, 2**31 - 1)
    assert dims.select("d2").distinct().count() == 300 and dims.select("d3").distinct().count() == 3
    loads = [r["bytes"] for r in sharding.kd_shards(dims).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    mean = sum(len(t) + 8 for _, t, *_ in rows) / 24
    assert len(loads) == 24 and max(abs(x - mean) for x in loads) < 0.01 * mean + max(len(t) for _, t, *_ in rows) / 2


def test_shards_do_not_depend_on_file_splits(spark, docs):
    rows = [(k, t, "en", "s") for k, t in dict(docs).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = [Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.kd_shards(sharding.document_rows(df.repartition(n))).collect()) for n in (1, 7)]
    assert told[0] == told[1]


def test_shards_follow_the_tree(spark):
    """The cuts by brute force: at each node the widest dimension's weighted quantile, one row's bytes off at most."""
    r = random.Random(4)
    docs = spark.createDataFrame([(r.randrange(10**9), "y" * r.randrange(50, 90), r.choice("abc"), r.choice("stuvw")) for _ in range(1500)], "doc_id long, text string, lang string, source string")
    dims = sharding.document_rows(docs)
    rows = [x.asDict() for x in sharding.kd_shards(dims, shards=6).join(dims, ["doc_id", "size", "text_crc32", "tie", "d0", "d1", "d2", "d3"]).collect()]
    whole = [max(x[f"d{d}"] for x in rows) - min(x[f"d{d}"] for x in rows) for d in range(4)]

    def cut(own, first, k):
        if k == 1:
            assert {x["shard"] for x in own} == {first}
            return
        wide = [(max(x[f"d{d}"] for x in own) - min(x[f"d{d}"] for x in own)) / max(1, whole[d]) for d in range(4)]
        d, half = wide.index(max(wide)), k // 2
        left = [x for x in own if x["shard"] < first + half]
        right = [x for x in own if x["shard"] >= first + half]
        key = lambda x: (x[f"d{d}"], x["tie"])
        assert max(map(key, left)) < min(map(key, right))
        want = sum(x["size"] for x in own) * half / k
        assert abs(sum(x["size"] for x in left) - want) <= 0.002 * sum(x["size"] for x in own) / k + 98
        cut(left, first, half)
        cut(right, first + half, k - half)

    cut(rows, 0, 6)


def test_shards_are_near_equal_even_with_one_value(spark):
    docs = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("the same text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("x").alias("source"))
    got = {r.shard: r["count"] for r in sharding.kd_shards(sharding.document_rows(docs)).groupBy("shard").count().collect()}
    assert len(got) == 24 and max(got.values()) - min(got.values()) <= 12


def test_language(spark):
    r = random.Random(8)
    stems = {"aa": ["kala", "mano", "tilu", "sora"], "bb": ["drungst", "schelp", "krant", "wurz"], "cc": ["éto", "ñuça", "àlla", "írré"]}
    rows = [(i, " ".join(r.choice(stems[lang]) for _ in range(8)), lang) for i in range(300) for lang in [r.choice(list(stems))]]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "", None), (1003, "漢字", None), (1004, "kala mano", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where(~langid.held_out()))
    got = {x.doc_id: x for x in langid.predict(docs, model).collect()}
    truth = {k: v for k, _, v in rows if k < 1000}
    assert all(got[k].lang_pred == v for k, v in truth.items()) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in model.languages and got[1004].lang_pred == "aa"
    held = {x.doc_id: x.h for x in docs.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, h in held.items())
    nothing = langid.predict(docs, langid.learn(docs.limit(0)))
    assert {(x.lang_pred, x.score) for x in nothing.collect()} == {("und", 0.0)}


def test_codes_keep_languages_apart():
    for n in (2, 4, 7, 30):
        c = langid.code(n).astype(int)
        apart = ((c.shape[1] - c @ c.T) // 2)[~np.eye(n, dtype=bool)]
        assert apart.min() >= (c.shape[1] // 4 if n > 2 else 1)


def test_media(df, docs):
    got = media.features(media.store(df)).collect()
    want = []
    for k, t in docs:
        p = media.payload_of((t or "").encode())
        want.append((k, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    same([tuple(r)[:5] for r in got], want)
    assert all(json.loads(r.feature)["continuity_errors"] == 0 for r in got)


def test_media_faults_are_seen():
    stream = media.mux(bytes(range(250)) * 1000 + b"\xff" * (576 - 250_000 % 576))
    told = media.demux(stream)
    assert told["continuity_errors"] == 0 and told["pts"] == [3600 * k for k in range(len(told["pts"]))] and len(told["random_access"]) == -(-len(told["pts"]) // 8)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert media.demux(b"".join(packets[:20] + packets[21:]))["continuity_errors"] == 1
    broken = bytearray(stream)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        media.demux(bytes(broken))


def test_empty_tables(df):
    none = df.limit(0)
    assert substrings.deduplicate(none).count() == 0
    assert neardup.classes(none).count() == 0
    assert quality.judge(none).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == 0
    assert packing.pack(packing.pieces(none)).count() == 0
    assert sharding.kd_shards(sharding.document_rows(none)).count() == 0
    assert media.features(media.store(none)).count() == 0
