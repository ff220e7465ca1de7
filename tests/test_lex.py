import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import lex
from quarry.functions.hashing import fnv1a, function_hash, variable_hash


def test_lines():
    x = lex.Lines("l0\nl1\n")
    assert len(x) == 3 and x.content(1) == "l0" and x.content(3) == "" and x.of(0) == 1 and x.of(3) == 2 and x.offset(2) == 3


@pytest.mark.parametrize(
    "text,close",
    [("{}", 1), ("{ a { b } c }", 12), ('{ "}" }', 6), ("{ '}' }", 6), ("{ `}` }", 6), ("{ // }\n}", 7), ("{ /* } */ }", 10), ('{ R"x(})x" }', 11), ('{ "\\"}" }', 8)],
)
def test_match_brace(text, close):
    assert lex.match_brace(text, 0) == close


def test_match_brace_without_an_end():
    with pytest.raises(ValueError):
        lex.match_brace("{ {}", 0)


code = st.recursive(st.sampled_from(["a;", '"}"', "'{'", "/* { */", "// }\n", "`{`", " "]), lambda x: st.lists(x, max_size=4).map(lambda v: "{" + "".join(v) + "}"), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(code)
def test_balanced_code_matches(inner):
    text = "{" + inner + "}tail"
    assert lex.match_brace(text, 0) == len(text) - 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab"\'`/*\n{}\\', max_size=40))
def test_blanking_keeps_length_and_lines(text):
    out = lex.blank(text)
    assert len(out) == len(text) and out.count("\n") == text.count("\n")


def test_comment_mask():
    lines = ["// a", "x", "/* b", "c */", "/* d */ y", "# e"]
    assert lex.comment_mask(lines, ["//"], [("/*", "*/")]) == [True, False, True, True, False, False]


def test_masks():
    comment, string = lex.masks("// a\nx = `l1\nl2`\n/* b\n c */\ny")
    assert comment == [True, False, False, True, True, False] and string == [False, False, True, False, False, False]


def test_calls():
    calls = lex.call_stats('foo(bar(1), "baz(2)") // qux()\nif (x) { a.b1() }')
    assert calls.names == ["foo", "bar", "b1"] and calls.count == 3 and calls.depth == 2
    assert lex.call_stats("f(1)").count == 0
    both = lex.call_stats("scan.New(x); Close()", lex.GO_BLACKLIST, qualified=True)
    assert both.names == ["New", "scan.New"] and both.count == 1


def test_nesting():
    assert [lex.call_nesting(x) for x in ("ff()", "ff(gg())", "ff((1), gg(hh()))", "")] == [0, 1, 2, 0]


@pytest.mark.parametrize("value,kind", [('"a"', "string"), ("true", "bool"), ("nil", "untyped nil"), ("12", "int"), ("1.5", "float64"), ("0x1E", "float64"), ("&T{}", "T"), ("make(x)", "make"), ("x", "")])
def test_infer_type(value, kind):
    assert lex.infer_type(value) == kind


def test_indent():
    assert [lex.count_indent(x) for x in ("a", "  a", "\ta", " \t a")] == [0, 2, 4, 6]


def test_erb():
    assert [c.strip() for _, c in lex.erb_blocks("<% def a %><%= x %><%# y %><% end %>")] == ["def a", "end"]


def test_hashes():
    assert fnv1a(b"a") == "af63dc4c8601ec8c" and fnv1a(b"a", 128) == "d228cb696f1a8caf78912b704e4a8964"
    row = {"name": "f", "body": "x", "dependencies": ["b", "a"], "line_end": 3}
    assert function_hash(row) == function_hash(row | {"line_end": 9, "dependencies": ["a", "b"]}) != function_hash(row | {"body": "y"})
    assert variable_hash({"name": "a"}) != variable_hash({"name": "b"})
