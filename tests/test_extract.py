import ast
import inspect

import pytest

from quarry.functions import extract, lex
from quarry.sources.languages import LANGUAGES, by_extension, load_config, named, registered

LANG = {x.name: x for x in LANGUAGES}

GO = """package shop

import "fmt"

const (
	Limit = 10
	rate, name = 1.5, "x"
)

var total int
var a, b string = "q", "r"

// func hidden() {}
func Add(x, y int, s string) (int, error) {
	if x > 0 && y > 0 {
		return fmt.Sprintf("}{ %d", helper(x)), nil
	}
	for i := range y { total += i }
	f := func() int { return 1 }
	return f(), nil
}

func (c *Cart) sum() int { return c.all.Total() }

func Map[T any](in []T) interface{ Len() int } {
	return nil
}

func init() {}
"""

SMALL = {
    "python": ("def hello(n):\n    return greet(n)\n\nclass A:\n    def m(self):\n        x = '''def no(): pass'''\n\n        return x\n\nLIMIT = 3\n", ["hello", "m"], ["LIMIT"]),
    "java": ("package a.b;\npublic class M {\n  private int add(int a, int b) { return sum(a, b); }\n  String s() { return \"}\"; }\n}\n", ["add", "s"], []),
    "javascript": ("const A = 1;\nlet b = 2;\nfunction greet(n) { return `}${n}`; }\nasync function other() { greet(1); }\n", ["greet", "other"], ["A", "b"]),
    "typescript": ("export const A: number = 1;\nfunction id<T>(x: T): T { return x; }\n", ["id"], ["A"]),
    "csharp": ("class P {\n  static int Add(int a) { return Sum(a); }\n}\n", ["Add"], []),
    "cpp": ("#include <x>\nint total = 0;\nint add(int a, int b) { return a + b; }\nstatic void go() { add(1, 2); }\nint later(int a);\n", ["add", "go"], ["total"]),
    "rust": ("const MAX: u32 = 5;\npub fn add<'a>(x: &'a i32) -> i32 { helper(x) }\nfn main() { println!(\"}\"); }\n", ["add", "main"], ["MAX"]),
    "ruby": ("LIMIT = 2\ndef add(a)\n  if a\n    [1].each do |x|\n      put(x)\n    end\n  end\nend\n\ndef ok?\n  true\nend\n", ["add", "ok?"], ["LIMIT"]),
    "swift": ("let top = 1\nfunc go(_ x: Int) -> Int { return add(x) }\n", ["go"], ["top"]),
    "kotlin": ("val top = 1\nfun go(x: Int): Int { return add(x) }\n", ["go"], ["top"]),
    "php": ("<?php\n$top = 1;\nfunction go($x) { return add($x); }\n", ["go"], ["top"]),
    "lua": ("top = 1\nfunction M.go(x)\n  if x then\n    y(x)\n  end\nend\n", ["M.go"], ["top"]),
    "scala": ("val top = 1\ndef go(x: Int): Int = { add(x) }\n", ["go"], ["top"]),
    "erb": ("<% def card(x) %>\n<% if x %>\n<b><%= x %></b>\n<% end %>\n<% end %>\n<% def two %><% end %>\n", ["card", "two"], []),
}


def test_go():
    rows = extract.functions_of(GO, "s/shop.go", LANG["go"])
    assert [r["name"] for r in rows] == ["Add", "Map", "init", "sum"]
    add = rows[0]
    assert (add["line_start"], add["line_end"], add["package_name"]) == (14, 21, "shop")
    assert add["dependencies"] == ["Sprintf", "fmt.Sprintf", "helper", "f"] and add["call_count"] == 3 and add["statement_count"] == 11
    assert add["parameters"] == '(x, y int, s string)' and add["return_types"] == "(int, error)" and add["parameter_count"] == 2
    assert add["cyclomatic"] == 4 and add["return_count"] == 3 and add["anonymous_funcs"] == 1 and add["visibility"] == "public"
    assert rows[3]["is_method"] and rows[3]["receiver"] == "(c *Cart)" and rows[3]["visibility"] == "private"
    found = {g["name"]: (g["var_type"], g["is_const"], g["visibility"]) for g in extract.globals_of(GO, "s/shop.go", LANG["go"])}
    assert found == {"Limit": ("int", True, "public"), "rate": ("float64", True, "private"), "name": ("string", True, "private"), "total": ("int", False, "private"), "a": ("string", False, "private"), "b": ("string", False, "private")}


@pytest.mark.parametrize("name", sorted(SMALL))
def test_languages(name):
    text, functions, variables = SMALL[name]
    rows = extract.functions_of(text, "f", LANG[name])
    assert [r["name"] for r in rows] == functions
    assert [g["name"] for g in extract.globals_of(text, "f", LANG[name])] == variables
    assert all(r["body"] and 1 <= r["line_start"] <= r["line_end"] <= len(text.split("\n")) for r in rows)


BODIES = {
    "scala": ("""object A {
  def go(x: Int): Int = { add(x) }
  def two(y: Int) = { f(y) }
  def three(z: Int): Int = z + g(z)
  def four: Int = 4
  def five(a: Int)(b: Int): Int =
    h(a) +
      b
  def six(x: Int): Int
  def seven() { print('{') }
  val s = \"\"\" def no() = 1 \"\"\"
  def eight[T](x: T): T => T = y => y
}
""", [("go", 2, 2, ["add"]), ("two", 3, 3, ["f"]), ("three", 4, 4, ["g"]), ("four", 5, 5, []), ("five", 6, 8, ["h"]), ("seven", 10, 10, []), ("eight", 12, 12, [])]),
    "kotlin": ("""fun one(x: Int) = x + g(1)
fun two(): Int {
  return 1
}
interface I { fun no(x: Int): Int }
fun three(x: Int): String = when (x) {
  1 -> a()
  else -> b()
}
fun String.four(): Int =
    this.length
""", [("one", 1, 1, ["g"]), ("two", 2, 4, []), ("three", 6, 9, ["a", "b"]), ("four", 10, 11, [])]),
    "rust": ("""fn a(c: char) -> bool { c == '{' }
fn b<'a>(x: &'a str) -> &'a str { x }
fn c() { let s = r#"}"{"#; d('\\''); let t = "}
{"; }
trait T { fn no(&self) -> i32; }
""", [("a", 1, 1, []), ("b", 2, 2, []), ("c", 3, 4, ["d"])]),
    "typescript": ("""function a(): { b: number } {
  return { b: c(1) };
}
function d(x: { y: string }): Promise<{ z: number }> { return e(); }
declare function f(x: number): void;
function g<T>(x: T): x is T { return true; }
""", [("a", 1, 3, ["c"]), ("d", 4, 4, ["e"]), ("g", 6, 6, [])]),
    "ruby": ("""def a(x)
  y = if x
    1
  else
    2
  end
  z = x.map do |q|
    q
  end
  return unless y
  puts "end" if z
  while x do
    x -= 1
  end
  self.class
end
def b = 3
private def d
  case 1
  when 2 then foo(3)
  end
end
""", [("a", 1, 16, []), ("b", 17, 17, []), ("d", 18, 22, ["foo"])]),
    "lua": ("""function f(x)
  for i=1,2 do
    if x then y(i) elseif z then w() else v() end
  end
  repeat
    q()
  until x
  local g = function() return 1 end
end
local function h() end
""", [("f", 1, 9, ["y", "w", "v", "q"]), ("h", 10, 10, [])]),
}


@pytest.mark.parametrize("name", sorted(BODIES))
def test_where_bodies_end(name):
    text, want = BODIES[name]
    assert [(r["name"], r["line_start"], r["line_end"], r["dependencies"]) for r in extract.functions_of(text, "f", LANG[name])] == want


@pytest.mark.parametrize(
    "body,count",
    [("{}", 1), ("{ a(); b() }", 3), ("{ if x := f(); x > 0 { return 1 } else if y { a() } else { b() } }", 10), ("{ for i := 0; i < 3; i++ { c() } }", 6), ("{\nfor k := range m {\n_ = k\ncontinue }\n}", 4), ("{ switch t := z.(type) {\ncase int:\n d()\ndefault: e()\n} }", 4), ("{ var q int\nw := []T{{1}, {2}}\ngo func() { g() }()\nch <- 1\ni++\nx = a +\n b\n}", 9), ("{ select { case <-c: return 2 } }", 3), ("{ f(func() error { return nil }, T{a: 1}) }", 4)],
)
def test_statements(body, count):
    assert lex.statements(body) == count


@pytest.mark.parametrize("text", ["", "package x\n", "// only\n/* comments */\n"])
def test_nothing_to_find(text):
    assert extract.functions_of(text, "f.go", LANG["go"]) == [] and extract.globals_of(text, "f.go", LANG["go"]) == []


def test_homoglyphs_stay_apart():
    rows = extract.functions_of("package p\nfunc Scan() {}\nfunc Sc\u0430n() {}\nfunc 处理() {}\n", "f.go", LANG["go"])
    assert [r["name"] for r in rows] == ["Scan", "Sc\u0430n", "处理"]


@pytest.mark.parametrize("module", [lex, extract, inspect])
def test_python_against_ast(module):
    text = inspect.getsource(module)
    want = sorted((n.name, n.lineno, n.end_lineno) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
    got = sorted((r["name"], r["line_start"], r["line_end"]) for r in extract.functions_of(text, "m.py", LANG["python"]))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_config(tmp_path):
    assert load_config(str(tmp_path / "none.yaml")) is LANGUAGES
    (tmp_path / "c.yaml").write_text('languages:\n  - name: toy\n    extensions: [".toy"]\n    function_regex: "proc (?P<name>\\\\w+)\\\\("\n    single_comment: ["#"]\n')
    (toy,) = load_config(str(tmp_path / "c.yaml"))
    assert toy.body == "brace" and by_extension((toy,)) == {".toy": toy}
    assert [r["name"] for r in extract.functions_of("proc run() { x1(); } # proc no() {}", "a.toy", toy)] == ["run"]
    assert [x.name for x in registered((toy,))] == [*LANG, "toy"] and registered(LANGUAGES) == LANGUAGES
    assert {LANG[x].root_node() for x in ("go", "rust", "scala")} == {"source_file"} and LANG["cpp"].root_node() == "translation_unit"
    assert named(["py", "JS", "nope"]) == {"python", "javascript"}
