"""Source files with known functions and variables, one for each row of a table: {k} stands for its number.

FILES: language -> (extension, text). FUNCTIONS: (language, name, first line, last line, callees in
order). VARIABLES: (language, name, line, constant). GO: what a Go function has besides.
"""

from __future__ import annotations

FILES = {
    "go": (".go", """package shop{k}

import "fmt"

const Limit{k} = 10
var (
	total{k} int
	rate{k}, name{k} = 1.5, "}"
)

// func hidden{k}() {}
func Add{k}(x, y int, s string) (int, error) {
	if x > 0 && y > 0 {
		return fmt.Sprintf("}{ %d", helper{k}(x)), nil
	}
	for i := range y { total{k} += i }
	f := func() int { return 1 }
	return f(), nil
}

func (c *Cart{k}) sum{k}() int { return c.all.Total{k}() }

func Map{k}[T any](in []T) interface{ Len() int } {
	return nil
}
"""),
    "python": (".py", """import os{k}

LIMIT{k} = 3
def hello{k}(n):
    return greet{k}(n)

class A{k}:
    def m{k}(self):
        x = '''def no{k}(): pass'''

        return os.path(x)

async def last{k}(a,
                  b):
    await f(a)
"""),
    "java": (".java", """package a.b{k};
public class M{k} {
  private int add{k}(int a, int b) { return sum{k}(a, b); }
  // int no{k}(int a) { return 1; }
  public static String s{k}() {
    return "}";
  }
}
"""),
    "kotlin": (".kt", """val top{k} = 1
fun go{k}(x: Int): Int { return add{k}(x) }
fun one{k}(x: Int) = x + g(1)
fun three{k}(x: Int): String = when (x) {
  1 -> a{k}()
  else -> "}"
}
"""),
    "javascript": (".js", """const A{k} = 1;
let b{k} = 2;
function greet{k}(n) { return `}${n}` + h(n); }
async function other{k}() {
  greet{k}(1); // function no{k}() {}
}
"""),
    "typescript": (".ts", """export const A{k}: number = 1;
function id{k}<T>(x: T): T { return x; }
function shape{k}(): { b: number } {
  return { b: c{k}(1) };
}
declare function no{k}(f: number): void;
"""),
    "csharp": (".cs", """class P{k} {
  static int Add{k}(int a) { return Sum{k}(a); }
  public async Task<int> Go{k}() {
    return await Add{k}(1); /* int No() { } */
  }
}
"""),
    "cpp": (".cc", """#include <x>
int total{k} = 0;
int add{k}(int a, int b) { return a + b; }
static void go{k}() {
  add{k}(1, 2);
  puts(R"x(})x");
}
int later{k}(int a);
"""),
    "rust": (".rs", """const MAX{k}: u32 = 5;
pub fn add{k}<'a>(x: &'a i32) -> i32 { helper{k}(x) }
fn brace{k}(c: char) -> bool { c == '{' }
fn raw{k}() {
  let s = r#"}"{"#;
  d{k}(s);
}
"""),
    "ruby": (".rb", """LIMIT{k} = 2
def add{k}(a)
  y = if a
    [1].each do |x|
      put{k}(x)
    end
  end
  return unless y
  y
end

def ok{k}?
  true
end
"""),
    "swift": (".swift", """let top{k} = 1
func go{k}(_ x: Int) -> Int { return add{k}(x) }
func text{k}() -> String {
  return \"\"\" } \"\"\" + f(1)
}
"""),
    "php": (".php", """<?php
$top{k} = 1;
function go{k}($x) { return add{k}($x); } # function no{k}() {}
function &two{k}() {
  return '}';
}
"""),
    "lua": (".lua", """top{k} = 1
function M.go{k}(x)
  if x then
    y{k}(x)
  elseif z then
    w{k}(x)
  end
end
local function two{k}() return 1 end
"""),
    "scala": (".scala", """val top{k} = 1
def go{k}(x: Int): Int = { add{k}(x) }
def two{k}(y: Int) = {
  f{k}('{')
}
def three{k}(z: Int): Int = z + g(z)
def five{k}(a: Int)(b: Int): Int =
  h{k}(a) +
    b
"""),
    "erb": (".erb", """<% def card{k}(x) %>
<% if x %>
<b><%= x %></b>
<% show{k}(x) %>
<% end %>
<% end %>
"""),
}

FUNCTIONS = [
    ("go", "Add{k}", 12, 19, "Sprintf,fmt.Sprintf,helper{k},f"), ("go", "sum{k}", 21, 21, "Total{k},all.Total{k}"), ("go", "Map{k}", 23, 25, ""),
    ("python", "hello{k}", 4, 5, "greet{k}"), ("python", "m{k}", 8, 11, "path"), ("python", "last{k}", 13, 15, "f"),
    ("java", "add{k}", 3, 3, "sum{k}"), ("java", "s{k}", 5, 7, ""),
    ("kotlin", "go{k}", 2, 2, "add{k}"), ("kotlin", "one{k}", 3, 3, "g"), ("kotlin", "three{k}", 4, 7, "a{k}"),
    ("javascript", "greet{k}", 3, 3, "h"), ("javascript", "other{k}", 4, 6, "greet{k}"),
    ("typescript", "id{k}", 2, 2, ""), ("typescript", "shape{k}", 3, 5, "c{k}"),
    ("csharp", "Add{k}", 2, 2, "Sum{k}"), ("csharp", "Go{k}", 3, 5, "Add{k}"),
    ("cpp", "add{k}", 3, 3, ""), ("cpp", "go{k}", 4, 7, "add{k},puts"),
    ("rust", "add{k}", 2, 2, "helper{k}"), ("rust", "brace{k}", 3, 3, ""), ("rust", "raw{k}", 4, 7, "d{k}"),
    ("ruby", "add{k}", 2, 10, "put{k}"), ("ruby", "ok{k}?", 12, 14, ""),
    ("swift", "go{k}", 2, 2, "add{k}"), ("swift", "text{k}", 3, 5, "f"),
    ("php", "go{k}", 3, 3, "add{k}"), ("php", "two{k}", 4, 6, ""),
    ("lua", "M.go{k}", 2, 8, "y{k},w{k}"), ("lua", "two{k}", 9, 9, ""),
    ("scala", "go{k}", 2, 2, "add{k}"), ("scala", "two{k}", 3, 5, "f{k}"), ("scala", "three{k}", 6, 6, "g"), ("scala", "five{k}", 7, 9, "h{k}"),
    ("erb", "card{k}", 1, 6, "show{k}"),
]

VARIABLES = [
    ("go", "Limit{k}", 5, True), ("go", "total{k}", 7, False), ("go", "rate{k}", 8, False), ("go", "name{k}", 8, False), ("python", "LIMIT{k}", 3, False), ("kotlin", "top{k}", 1, True), ("javascript", "A{k}", 1, True), ("javascript", "b{k}", 2, False),
    ("typescript", "A{k}", 1, True), ("cpp", "total{k}", 2, False), ("rust", "MAX{k}", 1, True), ("ruby", "LIMIT{k}", 1, False), ("swift", "top{k}", 1, True), ("php", "top{k}", 2, False), ("lua", "top{k}", 1, False), ("scala", "top{k}", 1, True),
]

#: name, package, parameters, results, receiver, visibility, complexity, parameters' groups, returns, statements, anonymous functions, depth of calls
GO = [
    ("Add{k}", "shop{k}", "(x, y int, s string)", "(int, error)", "", "public", 4, 2, 3, 11, 1, 1),
    ("sum{k}", "shop{k}", "()", "int", "(c *Cart{k})", "private", 1, 0, 1, 2, 0, 0),
    ("Map{k}", "shop{k}", "(in []T)", "interface{ Len() int }", "", "public", 1, 1, 1, 2, 0, 0),
]
