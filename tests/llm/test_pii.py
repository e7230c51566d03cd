import datetime
import re

from pyspark.sql import functions as F

from lumenlog.llm import pii
from lumenlog.llm.pii import op9_pii, pseudonymised

from .fixtures import awkward, clashing, empty


def luhn(s):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(re.sub(r"\D", "", s))))) % 10 == 0


def shape(s):
    return re.sub("[0-9]", "9", s)


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [(r.text, r.n_pii, r.pii) for r in pseudonymised(df, "k").orderBy("doc_id").collect()]


def test_kinds_and_formats(spark):
    cards = ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004", "340000000000009"]
    other = ["+1 (017) 555-7713", "+442071838750", "555-123-4567", "97.51.17.173", "078-05-1120", "1999-12-31", "2000/02/29", "12/25/2020", "25/12/2020", "31/12/2020", "31.12.1999", "31-12-1999"]
    mails = ["und.34@mail7.example.com", "A@b.co", "desleleenpa.90@mail2.example.com"]
    texts = [f"é🙂 {v}, then {v}." for v in cards + other + mails]
    for (text, n, _), v in zip(run(spark, texts), cards + other + mails):
        got = re.fullmatch(r"é🙂 (.*), then (.*)\.", text, re.S)
        assert got and got[1] == got[2], (text, v)
        assert got[1] != v and n == 2, (text, v)
        if v in cards:
            assert luhn(got[1]) and shape(got[1]) == shape(v)
        elif v in mails:
            assert got[1].split("@")[1] == v.split("@")[1] and [c.isdigit() for c in got[1]] == [c.isdigit() for c in v]
        elif v.count(".") == 3:
            assert all(0 <= int(o) < 256 for o in got[1].split("."))
        else:
            assert shape(got[1]) == shape(v)
    for (text, *_), fmt in zip(run(spark, ["1999-12-31", "2000/02/29", "12/25/2020", "25/12/2020", "31.12.1999"]), ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y"]):
        datetime.datetime.strptime(text, fmt)


def test_what_fails_validation_stays(spark):
    texts = ["4111111111111112", "300.1.2.3", "1.2.3.4.5", "666-12-3456", "000-12-3456", "2021-02-30", "1700-01-01", "99/99/2020", "12345678901234567890", "29/02/2021", "a@b", "3.14159", "01.002.3.4", "x 2024 y", "", None, "Version 2.0."]
    assert [(t or "", n) for t, n, _ in run(spark, texts)] == [(t or "", 0) for t in texts]


def test_permutations(spark):
    """Every value of a small format gets a pseudonym of its own."""
    pairs = spark.range(7 * 13).select(F.floor(F.col("id") / 13).alias("a"), (F.col("id") % 13).alias("b"))
    got = {tuple(r.p) for r in pairs.select(pii.feistel("k", "t", F.col("a"), F.col("b"), F.lit(7), F.lit(13)).alias("p")).collect()}
    assert got == {(a, b) for a in range(7) for b in range(13)}
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(i) for i in range(0, 146097, 37)]
    made = [t for t, *_ in run(spark, [d.strftime("%m/%d/%Y") for d in days] + [f"{d:02}/{m:02}/1999" for d in range(13, 32) for m in (1, 3, 12)])]
    assert len(set(made)) == len(made)
    digits = run(spark, [f"555-01{i:02}-{j:04}".replace("-01", "-1", 1) for i in range(20) for j in range(0, 9999, 333)])
    assert len({t for t, *_ in digits}) == len(digits)
    mails = run(spark, [f"{a}{b}{i}@x.org" for a in "abcz" for b in "klm" for i in range(12)])
    assert len({t for t, *_ in mails}) == len(mails)


def test_all_documents(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    values = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[a-z]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.])|(?<!\d)\d{16}(?!\d)", re.A)
    linked: dict[str, str] = {}
    for r in op9_pii(spark, small).collect():
        old, new = values.findall(docs[r.doc_id]), values.findall(r.text)
        assert values.sub("", docs[r.doc_id]) == values.sub("", r.text) and len(old) == len(new)
        for a, b in zip(old, new):
            valid = not re.fullmatch(r"\d{16}", a) or luhn(a)
            assert (a != b) == valid and linked.setdefault(a, b) == b
        assert r.n_pii == sum(a != b for a, b in zip(old, new))
    assert len(set(linked.values())) == len(linked)


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    got = pseudonymised(clashing(df), "k")
    assert {"row", "n", "key"} <= set(got.columns)
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert pseudonymised(empty(spark), "k").collect() == []
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_key_is_a_setting(spark, small):
    spark.conf.unset(pii.KEY_SETTING)
    first = pii.session_key(spark)
    assert len(first) == 64 and pii.session_key(spark) == first
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) != first
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == "mine"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert {(r.doc_id, r.text) for r in op9_pii(spark, small).collect()} == {(r.doc_id, r.text) for r in pseudonymised(docs, "mine").collect()}
    spark.conf.unset(pii.KEY_SETTING)
