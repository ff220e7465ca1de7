import json
import os

import pytest

from quarry.cli import ask, call
from quarry.operators import state as K
from quarry.plans.report import graph_report, text_table
from quarry.plans.scan import TABLES, Options, Scanned, scan
from quarry.sources import files as S
from quarry.streaming.incremental import parse_new_files


@pytest.mark.parametrize(
    "content,text,kind",
    [
        (b"\xef\xbb\xbfabc", "abc", "utf-8-bom"), (b"abc", "abc", "utf-8"), (b"", "", "utf-8"), ("żółw".encode(), "żółw", "utf-8"), ("﻿hi".encode("utf-16-le"), "hi", "utf-16-le"), ("﻿hi😀".encode("utf-16-be"), "hi😀", "utf-16-be"),
        ("package main".encode("utf-16-le"), "package main", "utf-16-le"), ("package main".encode("utf-16-be"), "package main", "utf-16-be"), (b"caf\xe9 au lait", "café au lait", "unknown-non-utf8"), (bytes(range(1, 9)) * 20, None, "binary"), (b"\xff\x80\x00\x00" * 9 + b"\x81", None, "binary"),
        (b"\xff\xfe\x00\xd8a\x00", "?a", "utf-16-le"),
    ],
)
def test_decode(content, text, kind):
    assert S.decode(content) == (text, kind)


def test_roots(tmp_path):
    assert S.check_root(str(tmp_path)) == str(tmp_path)
    for bad in ("/", "/etc", "/usr/share", str(tmp_path / "none")):
        with pytest.raises(ValueError):
            S.check_root(bad)
    with pytest.raises(ValueError):
        S.check_root(str(tmp_path), allow_temp=False)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "code"
    for name, text in {
        "main.go": "package main\n\nvar Version = \"1\"\n\nfunc main() { run(2) }\n\nfunc run(n int) { helper.Go(n) }\n", "lib/helper.go": "package helper\n\nfunc Go(n int) {}\n\nfunc unused() {}\n", "tool.py": "def tool():\n    return work()\n",
        "vendor/x.go": "package x\nfunc X() {}\n", ".git/y.py": "def y(): pass\n", "notes.txt": "func no() {}", "a%b/z.py": "def z(): pass\n", "page.erb": "<% def card %><% end %>", "empty.go": "", "broken.bin.py": "",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "broken.bin.py").write_bytes(bytes(range(1, 9)) * 30)
    (root / "big.py").write_text("x = 1\n" * 200_000)
    os.link(root / "tool.py", root / "tool_link.py")
    return root


def test_listing_and_pruning(spark, tree):
    found = S.one_of_hard_links(S.source_files(S.listing(spark, str(tree))))
    assert sorted(r.rel_path for r in found.collect()) == ["broken.bin.py", "lib/helper.go", "main.go", "page.erb", "tool.py"]
    only = S.source_files(S.listing(spark, str(tree)), only=["go", "nonsense"], skip_dirs=["lib "])
    assert sorted(r.rel_path for r in only.collect()) == ["main.go", "page.erb"]


def test_scan_and_questions(spark, tree, tmp_path):
    state = str(tmp_path / "state")
    first = scan(spark, str(tree), state)
    assert (first.session, first.parsed, first.functions, first.variables, first.errors) == (1, 5, 6, 1, 0)
    r = Scanned(spark, state)
    assert {x.name for x in r.functions.collect()} == {"main", "run", "Go", "unused", "tool", "card"}
    assert {x.name for x in ask(r, "unreferenced").collect()} == {"main", "unused", "tool", "card"}
    assert [x.callee_name for x in ask(r, "missing").collect()] == ["helper.Go", "work"]
    assert {x.name: x.tag for x in ask(r, "dead").collect()} == {"main": "entry", "unused": "dead", "tool": "dead", "card": "dead"}
    assert [x.name for x in ask(r, "tree", "main").collect()][:2] == ["main", "run"]
    assert ask(r, "files").count() == 4
    again = scan(spark, str(tree), state)
    assert (again.session, again.parsed) == (2, 0) and r.functions.count() == 6
    os.utime(tree / "tool.py", (1, 1))
    (tree / "tool.py").write_text("def tool2():\n    pass\n")
    os.utime(tree / "tool.py", (5, 5))
    third = scan(spark, str(tree), state)
    assert third.parsed == 1 and {x.name for x in r.functions.collect()} == {"main", "run", "Go", "unused", "tool2", "card"}
    for _ in range(2):
        last = scan(spark, str(tree), state, Options(incremental=False))
    assert sorted(x.id for x in r.sessions.collect()) == [last.session - 2, last.session - 1, last.session]
    assert r.functions.select("session_id").distinct().count() <= 3


def test_caches_and_files_that_are_gone(spark, tree, tmp_path):
    state = str(tmp_path / "state")
    r = Scanned(spark, state)
    assert scan(spark, str(tree), state).cached == 0
    before = {(x.name, x.file_path, x.hash) for x in r.functions.collect()}
    for name in ("main.go", "lib/helper.go", "tool.py"):
        os.utime(tree / name, (9, 9))
    touched = scan(spark, str(tree), state)
    assert (touched.parsed, touched.cached, touched.gone) == (0, 3, 0) and touched.function_changes == {"unchanged": 5} and touched.variable_changes == {"unchanged": 1}
    assert {(x.name, x.file_path, x.hash) for x in r.functions.collect()} == before
    full = scan(spark, str(tree), state, Options(incremental=False))
    assert (full.parsed, full.cached) == (0, 5)
    (tree / "main.go").unlink()
    (tree / "lib/helper.go").write_text("package helper\n\nfunc Go(n int) { x() }\n\nfunc more() {}\n")
    os.utime(tree / "lib/helper.go", (11, 11))
    last = scan(spark, str(tree), state)
    assert (last.parsed, last.cached, last.gone) == (1, 0, 1) and last.function_changes == {"changed": 1, "gone": 1, "new": 1}
    assert {x.name for x in r.functions.collect()} == {"Go", "more", "tool", "card"} and r.globals.count() == 0
    assert (last.functions, last.variables) == (4, 0) == tuple(r.sessions.orderBy("id").tail(1)[0][-2:])
    assert {x.caller_id for x in r.deps.collect()} <= {x.id for x in r.functions.collect()}
    assert all(len(K.Snapshots(spark, state)._list(t)) <= 2 for t in TABLES)
    assert scan(spark, str(tree), state, Options(incremental=False, use_parse_cache=False)).parsed == 4


def test_reports(spark, tree, tmp_path):
    state = str(tmp_path / "state")
    scan(spark, str(tree), state)
    r = Scanned(spark, state)
    report = graph_report(r.functions, r.deps).split("\n")
    assert report[1].startswith("  functions 6, calls 3") and "  1. Go (lib/helper.go:3): 2 callers" in report and "  2. run (main.go:7): 1 callers" in report and "Never called: 4" in report
    rows = [{"a": 1, "b": "x\ny", "c": {"k": 2}}, {"a": None, "b": "", "c": {}}]
    assert text_table(["a", "b", "c"], rows).split("\n") == ["a  c", "-  ---", "1  k=2", "    | x", "    | y", "", "    | ", "(2 rows)"]


def test_rpc(spark, tree, tmp_path):
    state = str(tmp_path / "state")
    scan(spark, str(tree), state, Options(only=["python"]))
    r = Scanned(spark, state)
    assert len(call(r, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 17
    (text,) = call(r, {"id": 2, "method": "tools/call", "params": {"name": "top_functions", "arguments": {"n": "1"}}})["result"]["content"]
    assert text["type"] == "text" and [x["name"] for x in json.loads(text["text"])] == ["tool"]
    (text,) = call(r, {"id": 7, "method": "tools/call", "params": {"name": "get_function_body", "arguments": {"func_id": "tool"}}})["result"]["content"]
    assert text["text"] == "def tool():\n    return work()"
    assert call(r, {"id": 3, "method": "tools/call", "params": {"name": "find_callers", "arguments": {}}})["result"]["isError"]
    assert call(r, {"id": 4, "method": "tools/call", "params": {"name": "nope"}})["result"]["isError"]
    (session,) = call(r, {"id": 5, "method": "resources/read", "params": {"uri": "db://sessions/latest"}})["result"]["contents"]
    assert json.loads(session["text"])[0]["id"] == 1
    hello = call(r, {"id": 0, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}})["result"]
    assert hello["protocolVersion"] == "2024-11-05" and "tools" in hello["capabilities"] and call(r, {"method": "notifications/initialized"}) is None
    tools = {t["name"]: t["inputSchema"] for t in call(r, {"id": 6, "method": "tools/list"})["result"]["tools"]}
    assert tools["find_callers"]["required"] == ["func_name"] and "required" not in tools["top_functions"]
    assert call(r, {"id": 8, "method": "nope"})["error"]["code"] == -32601


def test_stream_parses_new_files_once(spark, tree, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for name, want in ((None, 6), ("new.go", 7)):
        if name:
            (tree / name).write_text("package p\nfunc New() {}\n")
        query = parse_new_files(spark, f"file://{tree}", out, mark)
        assert query.awaitTermination(120) and not query.exception()
        assert spark.read.parquet(out).count() == want


def test_upserts(spark):
    old = spark.createDataFrame([("f", "a", 1, "h"), ("f", "b", 2, "h"), ("f", "c", 3, None)], "file_path string, name string, line_start int, hash string")
    new = spark.createDataFrame([("f", "a", 1, "h"), ("f", "b", 2, "i"), ("f", "d", 4, "h"), ("f", "c", 3, None)], old.schema)
    got = {r.name: r.status for r in K.upsert_status(old, new, K.FUNCTION_KEY).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "new"}
    assert K.upserted(old, new.limit(0), K.FUNCTION_KEY).count() == 3 and K.upserted(old.limit(0), new, K.FUNCTION_KEY).count() == 4


def test_snapshots(spark, tmp_path):
    store = K.Snapshots(spark, str(tmp_path))
    assert store.read("t", "a long").count() == 0
    for n in range(3):
        store.write("t", spark.range(n).withColumnRenamed("id", "a"))
    assert store.read("t", "a long, b string").columns == ["a", "b"] and store.read("t", "a long").count() == 2
    store.drop_old("t")
    assert store._list("t") == [2, 3]
