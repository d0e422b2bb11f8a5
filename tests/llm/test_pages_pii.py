"""WARC archives, pseudonyms and the pipeline."""

import gzip
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import pii, warc
from shelfmark.llm.shared import materialize

from . import brute, brute_pii
from .test_texts import sample, same


def pages(n=60):
    r = random.Random(3)
    bodies = ["x" * 999, "x" * 1000, "é" * 500, "\r\n\r\nWARC/1.0 z" * 90, "", "<p>" + "longer " * 400]
    return [(i, r.choice([*bodies, f"own {i} " * r.randint(1, 300), None])) for i in range(n)]


def read_back(spark, df, folder, **how):
    """(records, archives): pages written, normalised, published below a folder and read by the sidecars."""
    uri = f"file://{folder}"
    names = materialize(warc.publish(warc.normalize(warc.write_archives(warc.decide(df), **how)), uri), "names")
    return warc.read_files(names, uri).collect(), names.collect()


def test_warc(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(k, f"http://h/{k} \n", h, 1) for k, h in rows], "page_id long, url string, html string, digest int")
    for most in (8 << 20, 3000):
        folder = tmp_path / str(most)
        got, names = read_back(spark, df, folder, most_bytes=most)
        same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], brute.revisits(rows))
        assert sorted(p.name for p in folder.iterdir()) == sorted(x for n in names for x in (n.archive, n.archive + ".idx"))  # no half files
        for n in names:  # a file is a WARC file as a whole, and each line of its sidecar is a record
            content = (folder / n.archive).read_bytes()
            index = [tuple(map(int, line.split())) for line in (folder / (n.archive + ".idx")).read_text().splitlines()]
            assert gzip.decompress(content).count(b"WARC/1.0\r\nWARC-Type") == len(index) == n.records and len(content) == n.bytes
            assert [a for a, _ in index] == [0, *[a + k for a, k in index[:-1]]] and sum(index[-1]) == len(content)
            assert all(zlib.decompress(content[a : a + k], wbits=31).startswith(b"WARC/1.0\r\n") for a, k in index)
        at = {(n.archive, *map(int, line.split())) for n in names for line in (folder / (n.archive + ".idx")).read_text().splitlines()}
        assert {(r.archive, r.offset, r.length) for r in got} == at and len(got) == len(at)


def test_warc_accepts_several_streams(spark):
    one = [warc.record(k, None, b"p%d" % k, "d", None, "2000-01-01T00:00:00Z") for k in range(3)]
    content = gzip.compress(one[0] + one[1]) + gzip.compress(one[2])
    got = warc.normalize(spark.createDataFrame([("a", bytearray(content))], "archive string, content binary")).first()
    assert len(got.offsets) == 3 and gzip.decompress(got.content) == b"".join(one)


def test_warc_rows_without_keys(spark, tmp_path):
    rows = [(None, None, None), (None, None, "x" * 1000), (4, None, "x" * 1000), (4, "u", "x" * 1000), (1, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, _ = read_back(spark, df, tmp_path / "a")
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(None, "response", None): 1, (None, "revisit", 4): 1, (4, "response", None): 2, (1, "response", None): 1})
    assert read_back(spark, df.limit(0), tmp_path / "b") == ([], [])


def test_warc_of_a_long_page(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "long text " * 1_000_000), (2, "u", "é"), (3, "u", "long text " * 1_000_000)], "page_id long, url string, html string")
    got, names = read_back(spark, df, tmp_path, most_bytes=1 << 20)
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in got} == {(1, 10_000_000, "revisit"), (2, 2, "response"), (3, 10_000_000, "response")}


def test_a_broken_payload_is_seen(spark, tmp_path):
    body = gzip.compress(warc.record(1, None, b"text", "0" * 40, None, "2000-01-01T00:00:00Z"))
    names = materialize(warc.publish(spark.createDataFrame([("a.warc.gz", bytearray(body), [0], [len(body)])], "archive string, content binary, offsets array<long>, lengths array<long>"), f"file://{tmp_path}"), "names")
    with pytest.raises(Exception, match="does not match"):
        warc.read_files(names, f"file://{tmp_path}").collect()


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def replaced(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in pii.pseudonymize(rows, key).orderBy("doc_id").collect()]


def test_formats_are_kept(spark):
    texts = [
        "4845168114407329", "4845-1681-1440-7329", "4845 1681 1440 7329", "378282246310005",
        "+1 (017) 555-7713", "(017) 555-7713", "97.51.17.173", "a.Bc9@mail7.example.com",
        "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "2020-02-29", "29.02.2020", "29/02/2020", "02/29/2020",
        'token = "69ed38d471cb4c994c5dd53b42f8be44ceb3f0d5"', "password=Abc123xyz",
    ]
    got = replaced(spark, texts)
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    for old, new in zip(texts, got):
        assert old != new
        if "." in old and old.count(".") == 3 and "@" not in old:
            assert all(int(x) < 256 for x in new.split("."))
        elif "token" in old:
            assert re.fullmatch(r'token = "[0-9a-f]{40}"', new)
        else:
            assert shape(old) == shape(new)
    assert all(map(luhn, got[:4])) and got[0] == got[1].replace("-", "") == got[2].replace(" ", "")
    assert got[4].endswith(got[5])
    assert got[11].split("-") == got[12].split(".")[::-1] == got[13].split("/")[::-1]
    for x in got[8:10]:
        s = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert got == replaced(spark, texts) and got[0] != replaced(spark, texts, "other")[0]


def test_whole_documents_equal_plain_python(spark):
    r = random.Random(12)
    values = ["4845168114407329", "378282246310005", "4845 1681 1440 7329", "+1 (817) 555-7713", "(017) 555-7713", "212-555-0147", "+44 20 7946 0958", "+390612345678", "97.51.17.173", "a.Bc9@mail7.example.com", "x" * 90 + "@" + "a." * 30 + "example.com",
              "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "2020-02-29", "1/2/2020", "12/1/2020", "3/14/2020", "02/29/2020", "1.02.2020", "29.02.2020", "token = 69ed38d471cb4c994c5dd53b42f8be44", "db_password=Abc123xyz", "300.1.2.3", "1234", "+", "-", "é", "word", "(", "99"]
    made = ["".join(r.choice(values) + r.choice([" ", ", ", "\n", "; "]) for _ in range(r.randrange(1, 12))) for _ in range(150)]
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + made + [None, "", "  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: (x.text, x.n_pseudonyms, x.pii_kinds) for x in pii.pseudonymize(rows, "k").collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute_pii.pseudonymized(t, "k"), t
    assert {"email", "secret", "iban", "date", "ssn", "phone", "ipv4", "card"} == {x for _, _, kinds in got.values() for x in kinds}


def test_formats_are_parts_that_the_permutation_keeps(spark):
    """No two values of a format share a pseudonym, and each keeps its own shape."""
    groups = {
        "one digit each": [f"{d}/{m}/2020" for d in range(1, 10) for m in range(1, 10)],
        "month first": [f"{m:02d}/{d}/2021" for m in (1, 3, 5) for d in range(13, 32)],
        "one and two": [f"{d}.{m}.1999" for d in range(1, 10) for m in (10, 11, 12)],
        "plan": [f"({a}) 555-{n:04d}" for a in (212, 313, 989) for n in range(60)],
        "no plan": [f"({a:03d}) 555-{n:04d}" for a in (17, 111, 211) for n in range(60)],
        "hexadecimal": [f"key: {k:08x}" for k in range(0xDEAD0000, 0xDEAD0100)],
        "letters": [f"key: ghij{k:04d}" for k in range(200)],
    }
    groups = {k: [x.replace("key:", "api_key:") for x in v] for k, v in groups.items()}
    got = replaced(spark, [x for v in groups.values() for x in v])
    at = 0
    plan = re.compile(r"\([2-9](?!11)[0-8]\d\) [2-9](?!11)\d\d-\d{4}")
    for name, old in groups.items():
        new, at = got[at : at + len(old)], at + len(old)
        assert len(set(new)) == len(old) and all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, b in zip(old, new)) == (name not in ("hexadecimal", "letters"))
        if name == "month first":
            assert all(int(x.split("/")[1]) > 12 for x in new)
        if "plan" in name:
            assert all(bool(plan.fullmatch(x)) == (name == "plan") for x in new)
        if name == "hexadecimal":
            assert all(re.fullmatch("api_key: [0-9a-f]{8}", x) for x in new)


def test_keys(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id int, text string")
    for key in (None, ""):
        with pytest.raises(ValueError, match="key"):
            pii.pseudonymize(df, key)
    drawn = pii.session_key(spark)
    assert len(drawn) == 64 and pii.session_key(spark) == drawn
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.session_key(spark) == "mine"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_invalid_values_and_prose_stay(spark):
    texts = ["4845168114407328", "300.1.2.3", "2021-02-29", "000-12-3456", "DE89370400440532013001", "Apache License, Version 2.0.", "CC BY-NC 4.0", "no. 12, 1998", "a @ b", None, "", "§ é 漢"]
    assert replaced(spark, texts) == texts


def test_values_side_by_side_are_all_found(spark):
    values = ["+1 (826) 555-4081", "190.137.223.204", "AT61 1904 3002 3457 3201", "2024-01-02", "+44 20 7946 0958", "4845168114407329", "123-45-6789", "a.b@c.example.org"]
    pairs = [(a, b) for a in values for b in values]
    got = replaced(spark, [f"x {a} {b} y" for a, b in pairs] + values)
    alone = dict(zip(values, got[len(pairs) :]))
    assert all(alone[v] != v for v in values)
    assert [g for g in got[: len(pairs)]] == [f"x {alone[a]} {alone[b]} y" for a, b in pairs]


def test_values_behind_failing_candidates_are_found(spark):
    card, phone, iban, mark = "4845 1681 1440 7329", "+44 20 7946 0958", "DE89 3704 0044 0532 0130 00", "\ue000"
    forms = ["1234 {c}", "{p} {c}", "{p} {p} {c} {c}", "{p} 12 {c} {i}", "DE88 3704 0044 0532 0130 00 {c} 1234", "1234 1234 {c} 9 {p}", mark + "{c}" + mark + " {p} " + mark, "{c}, {p}; " * 300]
    got = replaced(spark, [f.format(c=card, p=phone, i=iban) for f in forms] + [card, phone, iban, "+442079460958", "+12025550123", "(202) 555-0123", "+35312345678"])
    c, p, i, compact, us, local, irish = got[len(forms) :]
    assert c != card and p != phone and i != iban
    for form, new in zip(forms, got):
        if "{p} 12" in form:  # digits that may belong to the number are replaced with it
            assert new.startswith("+44 ") and new.endswith(f" {c} {i}") and "7946" not in new
        else:
            assert new == form.format(c=c, p=p, i=i)
    assert compact == p.replace(" ", "") and us[2:] == re.sub("[^0-9]", "", local) and irish.startswith("+353")


def test_secrets_are_replaced_whole(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(5000))
    heads = ["token=", "db_password=", "aws_secret_access_key=", "client_secret: ", "X-Api-Key: ", 'my-token = "']
    texts = [h + v for h in heads for v in (long, long[:700], "hunter2")] + ["password=jo.5@mail1.example.com", "jo.5@mail1.example.com"]
    got = replaced(spark, texts)
    for old, new in zip(texts[:-2], got):
        head = next(h for h in heads if old.startswith(h))
        a, b = old[len(head) :], new[len(head) :]
        assert new.startswith(head) and len(a) == len(b) and a != b
        assert all(a[k : k + 24] != b[k : k + 24] for k in range(0, len(a) - 23, 12))
    assert got[-2] == "password=" + got[-1] != texts[-2]
    assert replaced(spark, ["secret: ...", "xpassword=abcdefghij", "tokens: 12"]) == ["secret: ...", "xpassword=abcdefghij", "tokens: 12"]


def test_linked_inside_texts(spark):
    card, mail = "4845168114407329", "jo.5@mail1.example.com"
    got = replaced(spark, [f"pay {card} now, {mail}; {card}\n", f"{mail} {card}." + " filler" * 20_000])
    new = re.findall(r"\d{16}", got[0]) + re.findall(r"\d{16}", got[1])
    assert len(set(new)) == 1 and len(new) == 3 and len(set(re.findall(r"\S+@\S+\.com", " ".join(got)))) == 1
    assert got[0].startswith("pay ") and got[0].endswith("\n") and got[1].endswith(" filler" * 20_000)


def test_permutation_is_one_to_one(spark):
    rows = spark.range(90).selectExpr("cast(id as string) as s").select(F.lpad("s", 2, "0").alias("s"))
    got = [r[0] for r in rows.select(pii._permuted_digits(F.col("s"), "k", "t")).collect()]
    days = spark.range(2000).select(pii._days(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "k").alias("d"))
    assert len(set(got)) == 90 and days.distinct().count() == 2000 and days.where("d < date'1890-01-01' or d > date'2100-04-09'").count() == 0


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a@b.com", "x", "y")], "doc_id int, text string, n_pseudonyms string, pii_kinds string")
    got = pii.pseudonymize(df, "k").collect()[0]
    assert got.n_pseudonyms == 1 and got.pii_kinds == ["email"] and pii.pseudonymize(df.limit(0), "k").count() == 0


def test_pipeline(spark, tmp_path):
    rows = [(k, t, ["en", "de"][k % 2] if k % 5 else None, f"s{k % 3}", 0) for k, t in sample(seed=7, n=60)]
    rows += [(900, "Ask jo.5@mail1.example.com or pay 4845168114407329 for all of these many words here please", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    lang = stages["language"](spark, docs, str(tmp_path))
    before = {k: t for k, t, *_ in rows}
    assert lang.columns == corpus_pipeline.COLUMNS and all(r.text == before[r.doc_id] and any(map(str.isalpha, r.text)) for r in lang.collect())
    kept = stages["near_duplicates"](spark, lang, str(tmp_path))
    same([(r.doc_id,) for r in kept.collect()], [(k,) for k, c in brute.classes([(r.doc_id, r.text) for r in lang.collect()]) if k == c])
    cut = stages["repeated_passages"](spark, kept, str(tmp_path))
    by = {k: n for k, _, n, _ in brute.substrings([(r.doc_id, r.text) for r in kept.collect()])}
    for r in cut.collect():
        assert len(brute.words(r.text)) == len(brute.words(before[r.doc_id])) - by[r.doc_id] and r.n_chars == len(r.text)
    safe = stages["personal_data"](spark, cut, str(tmp_path))
    told = {r.doc_id: r.text for r in safe.collect()}
    assert "4845168114407329" not in told[900] and "jo.5@" not in told[900]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    sizes = defaultdict(int)
    for r in packed.collect():
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048 and {r.doc_id for r in packed.select("doc_id").collect()} == set(told)


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, columns of the stages' own names, and an empty table."""
    text = "the quick fox and the dog walk over the hill with nine good friends and one old cat today"
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text + " again", "en", None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (None, None, "en", "s", 1), (4, "12 34", "de", "s", 2)]
    rows = [(*x, "c", 0.5, "c", "c", 1) for x in rows] + [(k, f"{text} {k} more", "en", "s", 1, "c", 0.5, "c", "c", 1) for k in range(10, 30)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, n_words string, text_key string, sequence_id long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == corpus_pipeline.COLUMNS
            kept = got.collect()
            assert name == "language" or {x.doc_id for x in kept} >= {1} or docs is not odd
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.count() == docs.count()
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((x.doc_id or 0) for x in stages["near_duplicates"](spark, odd, "").collect()) == [0, 1, 1, 2, 3, 4] and stages["personal_data"](spark, odd, "").count() == odd.count()
