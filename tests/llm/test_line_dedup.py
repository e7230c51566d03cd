import random
import unicodedata
from collections import Counter

from lumenlog.llm.line_dedup import line_dedup, op8_line_dedup

from .fixtures import SCHEMA, awkward, clashing, empty


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def brute(rows, least=20):
    """(doc_id, kept text) of each row; rows in order of doc_id, null first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen: dict[str, None] = {}
    out = []
    for i in order:
        doc_id, text = rows[i][0], rows[i][1]
        kept = []
        for line in (text or "").split("\n"):
            if len(line) >= least or any(unicodedata.category(c)[0] in "LN" for c in line):
                if line in seen:
                    continue
                fresh = len(line) < least or not any(len(x) >= least and within_one(line, x) for x in seen if abs(len(x) - len(line)) <= 1 and (x[: len(x) // 2 - 1] == line[: len(x) // 2 - 1] or x[-(len(x) // 2) + 2 :] == line[-(len(x) // 2) + 2 :]))
                seen[line] = None
                if not fresh:
                    continue
            kept.append(line)
        out.append((doc_id, "\n".join(kept) if text is not None else None))
    return Counter(out)


def test_all_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(rows)
    texts = dict(rows)
    got = Counter()
    for r in op8_line_dedup(spark, small).collect():
        gone = {int(x) for x in r.removed_lines.split(",") if x}
        assert len(gone) == r.n_removed
        got[r.doc_id, "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in gone)] += 1
    assert got == want
    assert Counter((r.doc_id, r.text) for r in line_dedup(spark.read.parquet(f"{small}/documents.parquet")).collect()) == want


def test_one_edit_everywhere(spark):
    r = random.Random(8)
    rows, n = [], 0
    for length in (20, 21, 22, 60, 255, 256, 257, 511, 512, 513, 514, 1100):
        line = "".join(r.choice("abé🙂 ") for _ in range(length))
        texts = [line]
        for p in sorted({0, 1, 2, length // 2 - 1, length // 2, length // 2 + 1, length - 2, length - 1, r.randrange(length), r.randrange(length)}):
            texts += [line[:p] + "X" + line[p + 1 :], line[:p] + "Y" + line[p:], line[:p] + line[p + 1 :], line[:p] + "ZZ" + line[p + 2 :]]
        r.shuffle(texts)
        for t in texts:
            rows.append((n, t, None, None, None))
            n += 1
    got = line_dedup(spark.createDataFrame(rows, SCHEMA))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute(rows)


def test_awkward_rows(spark):
    long_line = "z" * 70_000
    extra = ["This is a line that repeats\nand more", "This is a line that repeats", "this is a line that repeats\nThis is a line that repeats", long_line, long_line[:-1] + "y", "short\nshort\nshort", "é" * 25 + "\n" + "é" * 24 + "\n" + "é" * 23]
    df, rows = awkward(spark, extra)
    got = line_dedup(clashing(df))
    assert set(clashing(df).columns) <= set(got.columns)
    assert Counter((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) == brute(rows)
    assert line_dedup(empty(spark)).collect() == []
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_lines_go_if_equal(spark):
    rows = [(0, "Menu\nHome\n\n--\na first line of its own", None, None, None), (1, "Home\nHomes\n--\n\nMenu\n漢", None, None, None), (2, "漢\nMenu\n \na first line of its own\na first line of its owm", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(docs).collect()}
    assert got == {0: (rows[0][1], 0), 1: ("Homes\n--\n\n漢", 2), 2: (" ", 4)}


def test_one_result_however_files_are_split(spark, small):
    """Rows are known by file and place, so tasks of other sizes give the same lines."""
    results = []
    for size in ("64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            results.append(Counter((r.doc_id, r.removed_lines) for r in op8_line_dedup(spark, small).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1] and any(x for _, x in results[0])
