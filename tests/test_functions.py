import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.paths import extracted, normalized, tool_operation
from lumenlog.functions.query import Both, Either, Phrase, Without, alternatives, classify, expression, phrases_of, terms, time_bound
from lumenlog.functions.stemming import stem


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "controll": "control", "sky": "sky", "é": "é"}
    assert {w: stem(w) for w in pairs} == pairs


def test_paths():
    assert normalized("a/../b.py", "/w") == "/w/b.py" and normalized("C:\\x\\y.py") == "C:/x/y.py" and normalized("~/a/./b") == "~/a/b"
    assert [normalized(x) for x in ("node_modules/x.js", "http://x/y.z", "", None, "..", "a/../..", "x\ny", "z" * 401, "'.git/config'")] == [None] * 9
    assert normalized('"src/a.py" ', "/w/") == "/w/src/a.py"


def test_touched_paths():
    def run(command, cwd="/w"):
        return extracted("Bash", json.dumps({"command": command}), cwd)

    assert run("cat src/a.py|head; ls -la --file=b.toml e.g. github.com x.exe") == [("/w/src/a.py", "run"), ("/w/b.toml", "run")]
    assert run("cd lab && pytest tests/x.py") == [("/w/lab/tests/x.py", "run")] and run("cd - && cat x.py") == [("/w/x.py", "run")] and run("cd /abs; cat x.py", None) == [("/abs/x.py", "run")]
    assert len(run(" ".join(f"f{i}.py" for i in range(30)))) == 8
    assert extracted("read_file", '{"filename": "b.md", "path": "a.md"}', "/w") == [("/w/a.md", "read")]
    assert extracted("edit", '{"files": ["a", {"path": "b"}, {"x": 1}, 3], "paths": "c"}') == [("c", "edit"), ("a", "edit"), ("b", "edit")]
    assert extracted("apply_patch", "*** Add File: n.py\n*** Move File: a.py -> b.py\n*** Delete File: d.py") == [("n.py", "write"), ("a.py", "edit"), ("b.py", "edit"), ("d.py", "delete")]
    assert extracted("x", '{"diff": "--- a/o.py\\n+++ b/o.py\\n--- /dev/null\\n"}') == [("o.py", "edit")]
    assert extracted("webfetch", '{"path": "a.md"}') == [] and extracted("Bash", None) == [] and extracted(None, "[1]") == []
    assert len(extracted("write", json.dumps({"paths": [f"p{i}" for i in range(100)]}))) == 64


def test_tool_operation(spark):
    names = ["Write", "mcp__fs__read_file", "str_replace_editor", "Glob", "Bash", None, "threads", "mcp_fs_rm", "tools_call", "concatenate"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    assert [r[0] for r in df.orderBy("i").select(tool_operation(F.col("n"))).collect()] == ["write", "read", "edit", "search", "run", None, None, "delete", None, None]


def test_queries_are_classified():
    kinds = {"": "browse", "  ": "browse", "a b": "tsquery", "a|b": "or", "get_x": "code", "a::b": "code", "a.b": "code", "end. of": "tsquery", "a_b AND c|d": "tsquery", '"x AND y" z': "tsquery"}
    assert {q: classify(q)[0] for q in kinds} == kinds
    assert classify("a AND b")[1] and not classify('"a AND b"')[1]


def test_expressions():
    p = lambda *w: Phrase(w)
    assert expression("a b") == Both(p("a"), p("b")) and expression('"a b" c-d') == Both(p("a", "b"), p("c", "d"))
    assert expression("a OR b AND c NOT d e") == Either(p("a"), Both(p("b"), Without(p("c"), Both(p("d"), p("e")))))
    for broken in ("AND a", "a OR", "a AND NOT b", 'a "b'):
        assert all(isinstance(x, Phrase) for x in phrases_of(expression(broken))) and not isinstance(expression(broken), Either)
    assert expression("") == p() and expression("...") == p()


def test_ranking_terms():
    assert terms("How did we fix the auth-bug, (really)?") == ["fix", "auth", "bug", "really"]
    assert terms('"Exact Words" AND foo| the') == ["exact words", "foo|"] and terms("the of") == ["the", "of"] and terms("`get_x`") == ["get_x"] and terms("") == []
    assert alternatives('a b OR "c"|d|| OR ') == ["a b", "c", "d"]


def test_time_bounds():
    now = datetime(2024, 3, 10, 12, tzinfo=UTC)
    assert time_bound("36h", now) == datetime(2024, 3, 9, tzinfo=UTC) and time_bound("1w", now) == datetime(2024, 3, 3, 12, tzinfo=UTC)
    assert time_bound("2024-03-01T10:00:00Z", now) == datetime(2024, 3, 1, 10, tzinfo=UTC) and time_bound("2024-03-01", now).tzinfo
    with pytest.raises(ValueError):
        time_bound("last week", now)
    assert time_bound("last week", now, strict=False) is None
