import base64
import json

from pyspark.sql import functions as F

from lumenlog.functions.ids import shard_depth
from lumenlog.functions.text import glob_pattern
from lumenlog.operators.metrics import request_ledger
from lumenlog.operators.reading import with_turns
from lumenlog.sources import ledgers, sinks
from lumenlog.streaming import folds


def test_sessions_with_damaged_lines(spark, tmp_path):
    good = {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hello"}}
    said = {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "sessionId": "s", "message": {"model": "m", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "b"}]}}
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps(said), '{"type": "us']) + "\n\n")
    messages, bad = ledgers.read_sessions(spark, "project", str(tmp_path))
    assert [(r.message_id, r.role, r.text, r.model) for r in messages.orderBy("lineno").collect()] == [("u1", "user", "hello", None), ("u2", "assistant", "a\nb", "m")]
    assert sorted((r.lineno, r.kind) for r in bad.collect()) == [(2, "interior"), (4, "torn")]


def test_tree_export(spark, tmp_path):
    node = lambda parent, role, text: {"parent": parent, "message": {"author": {"role": role}, "content": {"parts": [text]}}}
    tree = [{"id": "c", "title": "t", "current_node": "d", "mapping": {"a": {"parent": None, "message": None}, "b": node("a", "user", "q"), "x": node("b", "assistant", "old"), "d": node("b", "assistant", "new")}}]
    (tmp_path / "e.json").write_text(json.dumps(tree))
    got = {r.message_id: (r.role, r.is_active) for r in ledgers.read_tree_export(spark, str(tmp_path)).collect()}
    assert got == {"a": (None, True), "b": ("user", True), "x": ("assistant", False), "d": ("assistant", True)}


def test_blobs_round_trip(spark):
    rows = spark.createDataFrame([(1, base64.b64encode(b"abc").decode()), (2, base64.b64encode(b"abc").decode()), (3, None)], "id long, data string")
    named, blobs = sinks.extract_blobs(rows, "data", "id")
    assert blobs.count() == 1 and "data" not in named.columns
    assert sorted(map(tuple, sinks.restore_blobs(named, blobs, "data").collect())) == sorted(map(tuple, rows.collect()))


def test_thread_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "event_id long, thread_id string")
    sinks.write_thread_log(rows, str(tmp_path / "log"))
    sinks.write_thread_log(rows, str(tmp_path / "log"))  # a repeated batch doubles nothing
    sinks.write_thread_log(rows.limit(0), str(tmp_path / "log"), batch=1)
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 50 and back.select("thread_id", "shard").distinct().count() == 7


def test_shards_and_globs():
    assert [shard_depth(n) for n in (0, 1024, 1025, 262_145)] == [0, 0, 1, 2]
    import re

    assert re.match(glob_pattern("/a/*.py"), "/a/b/c.py") and not re.match(glob_pattern("/a/?.py"), "/a/bc.py") and re.match(glob_pattern("[!x]*"), "abc")


def _parts(spark, tmp_path, rows, n):
    for i in range(n):
        rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_ledger_fold_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"r{i % 9}", f"2024-0{1 + i % 3}", i * 7 % 31, None if i % 4 else float(i)) for i in range(200)], "thread_id long, request_key string, month string, tokens long, cost double")
    folds.ledger_fold(_parts(spark, tmp_path, rows, 4), str(tmp_path / "out"), str(tmp_path / "cp"), ["tokens"]).awaitTermination()
    got = folds.newest_ledger(spark, str(tmp_path / "out"))
    want = request_ledger(rows, ["tokens"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_turns_carried_across_batches(spark, tmp_path):
    rows = spark.createDataFrame([(t, i, "user" if (i + t) % 3 == 0 else "assistant") for t in range(4) for i in range(30)], "thread_id long, event_id long, role string")
    for lo in (0, 10, 20):
        rows.filter(F.col("event_id").between(lo, lo + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folds.with_turns(stream).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.sql("select thread_id, event_id, turn_no from carried").collect()))
    assert got == sorted(map(tuple, with_turns(rows).select("thread_id", "event_id", "turn_no").collect()))


def test_streaming_dedup_and_activity(spark, tmp_path):
    rows = spark.createDataFrame([(i % 6, i % 11, i) for i in range(120)], "thread_id long, key long, at long")
    stream = _parts(spark, tmp_path, rows, 3)
    q = folds.activity_stream(stream, "thread_id", "at").writeStream.format("memory").queryName("active").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from active").collect())) == sorted(map(tuple, rows.groupBy("thread_id").agg(F.min("at"), F.max("at")).collect()))
    q = folds.deduplicated(stream, ["thread_id", "key"]).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from firsts").first()[0] == rows.select("thread_id", "key").distinct().count()


def _jsonl(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_turns_of_line_shapes(spark, tmp_path):
    env = lambda kind, text, **more: {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": kind, "message": text, **more}}
    (tmp_path / "e").mkdir(), (tmp_path / "r").mkdir(), (tmp_path / "s").mkdir()
    _jsonl(tmp_path / "e" / "a.jsonl", [{"type": "session_meta", "payload": {"model": "m1"}}, env("user_message", "q1"), env("agent_message", "a"), env("agent_message", "b"), env("user_message", "q2"), env("agent_message", ""), env("user_message", "q3"), env("agent_message", "c", model="m2")])
    got = [(r.role, r.text, r.model) for r in ledgers.read_sessions(spark, "envelope", str(tmp_path / "e"))[0].orderBy("lineno").collect()]
    assert got == [("user", "q1", "m1"), ("assistant", "a\nb", "m1"), ("user", "q2", "m1"), ("user", "q3", "m1"), ("assistant", "c", "m2")]
    _jsonl(tmp_path / "r" / "a.jsonl", [{"type": "system", "content": "s"}, {"type": "user", "content": "q"}, {"type": "reasoning", "summary": "hm"}, {"type": "assistant", "content": "a"}, {"type": "tool_result", "content": "r"}, {"type": "user", "content": "q"}])
    got = [(r.role, r.text) for r in ledgers.read_sessions(spark, "roles", str(tmp_path / "r"))[0].orderBy("lineno").collect()]
    assert got == [("system", "s"), ("user", "q"), ("assistant", "hm\na\nr"), ("user", "q")]
    _jsonl(tmp_path / "s" / "a.jsonl", [{"step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "content": "<user_request>\ndo it\n</user_request>"}, {"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "content": "ok"}])
    got = [(r.role, r.text) for r in ledgers.read_sessions(spark, "steps", str(tmp_path / "s"))[0].orderBy("lineno").collect()]
    assert got == [("user", "do it"), ("assistant", "ok")]


def test_results_pair_with_calls(spark):
    steps = spark.createDataFrame([("t", i, k) for i, k in enumerate(["result", "call", "call", "result", "text", "result", "call"])], "thread_id string, event_id long, kind string")
    got = [r.call_id for r in ledgers.paired_results(steps).orderBy("event_id").collect()]
    assert got == ["orphan-1", "agtool-1", "agtool-2", "agtool-2", "orphan-3", "agtool-3"]


def test_ledger_segments(spark, tmp_path):
    for name, n in (("l.jsonl", 6), ("l.jsonl.2", 1), ("l.jsonl.10", 2), ("l.jsonl.20240101T000000Z", 3), ("l.jsonl.20240101T000000Z.2", 4), ("l.jsonl.20240101T000000Z.10", 5)):
        (tmp_path / name).write_text(f'{{"n": {n}}}\n{{"n": 0.5}}\n{{"torn')
    rows = ledgers.ledger_rows(spark, str(tmp_path / "l.jsonl")).orderBy("segment_no", "lineno").select(F.try_variant_get("payload", "$.n", "double").alias("n")).collect()
    assert [r.n for r in rows] == [x for n in range(1, 7) for x in (float(n), 0.5)]
    for _ in range(2):
        sinks.append_rows(spark.range(25), str(tmp_path / "out"), 3, most_rows=10)
    assert spark.read.json(str(tmp_path / "out")).count() == 25


def test_poll_isolates_failures(spark, tmp_path):
    rows = spark.createDataFrame([(f"job {i} failed",) for i in range(120)] + [("other: /a/b",)], "message string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def counts():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        return folds.fault_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()

    def broken():
        raise RuntimeError("no such store")

    said = folds.poll({"broken": broken, "counts": counts})
    assert "no such store" in said["broken"] and said["counts"] is None
    want = [("job N failed", 1), ("job N failed", 10), ("job N failed", 100), ("other: <path>", 1)]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    assert folds.poll({"counts": counts}) == {"counts": None}  # nothing is new
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_drains_take_the_newest(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(25)], "doc_id long, text string")
    embedder = lambda: lambda texts: [[len(t), 1.0] for t in texts]
    seen = []
    for batch in (0, 1, 1, 2):
        folds.drain(docs, str(tmp_path / "v"), embedder, batch, most=10)
        seen.append(sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "v")).collect()))
    assert seen == [list(range(15, 25)), list(range(5, 25)), list(range(5, 25)), list(range(25))]
    sinks.save_vectors(spark.read.parquet(str(tmp_path / "v")), str(tmp_path / "side"), "m1")
    assert sinks.load_vectors(spark, str(tmp_path / "side"), "m1").count() == 25
