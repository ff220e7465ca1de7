"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of languages.
ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "kt": "kotlin", "cpp": "cpp", "cs": "csharp", "rs": "rust", "rb": "ruby"}
#: Fixed value: what counts as a call in text without a syntax tree.
CALL = r"(?:(\w+)\.)?(\w+)\s*\("
#: Strings and comments of C-like languages.
C_LIKE_OPAQUE = r"""(?s)/\*.*?(?:\*/|\z)|//[^\n]*|"[^"\\\n]*(?:\\.[^"\\\n]*)*"?|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?|`[^`]*`?"""
_WORD = r"[\p{L}\p{N}_]"
LEXED_CALL = rf"(?:({_WORD}+)\.)?({_WORD}+)[ \t\r\n\f]*\("


def indent(line: Column) -> Column:
    """Leading blanks; a tab counts four."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^[ \t]*", 0), "\t", "    "))


def lines(text: Column) -> Column:
    """All lines; a final line end opens one more, empty line."""
    return F.split(text, "\n", -1)


def variable_visibility(name: Column) -> Column:
    return F.when(name.rlike("^[A-Z]"), "public").otherwise("private")


def function_visibility(name: Column) -> Column:
    return F.when(name.rlike("^[a-z]"), "private").otherwise("public")


def calls(text: Column) -> Column:
    """array<struct<prefix, name>> of calls, names of one character left out."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), F.regexp_extract_all(text, F.lit(CALL), F.lit(2)), lambda p, n: F.struct(p.alias("prefix"), n.alias("name")))
    return F.filter(pairs, lambda x: F.length(x["name"]) > 1)


def without_strings(text: Column) -> Column:
    """The text with a blank for each string and comment of a C-like language."""
    return F.regexp_replace(text, C_LIKE_OPAQUE, " ")


def lexed_calls(clean: Column, skip: list[str]) -> Column:
    """array<string> of the callees in text without strings and comments, one a call; `skip` and names of one character are no calls unless a dot precedes them or they are longer."""
    pairs = F.zip_with(F.regexp_extract_all(clean, F.lit(LEXED_CALL), F.lit(1)), F.regexp_extract_all(clean, F.lit(LEXED_CALL), F.lit(2)), lambda p, n: F.struct(p.alias("prefix"), n.alias("name")))
    return F.transform(F.filter(pairs, lambda x: (F.length(x["name"]) > 1) & ((x["prefix"] != "") | ~x["name"].isin(skip))), lambda x: x["name"])


def paren_depth(text: Column) -> Column:
    """The most parentheses open at once."""
    marks = F.regexp_replace(text, r"[^()]", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = F.when(c == "(", acc["open"] + 1).when(c == ")", F.greatest(acc["open"] - 1, F.lit(0))).otherwise(acc["open"])
        return F.struct(now.alias("open"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), start, step, lambda acc: acc["most"])


def preview(body: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(body), 1, n), "\n")


def language_name(alias: Column) -> Column:
    out = F.lower(alias)
    for short, name in ALIASES.items():
        out = F.when(F.lower(alias) == short, name).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def is_upper(name: Column) -> Column:
    return (F.upper(name) == name) & (name != "")


def control_share(text: Column, head: int = 512) -> Column:
    """The share of control characters, tabs and line ends aside, among the first `head` bytes in UTF-8."""
    pairs = F.regexp_extract_all(F.hex(F.substring(F.encode(text, "UTF-8"), 1, head)), F.lit("(..)"), F.lit(1))
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda x: (x < "20") & ~x.isin("09", "0A", "0D"))) / F.size(pairs)).otherwise(0.0)
