"""Lexical primitives for source text, in plain Python; they run inside the Arrow operators.

One scanner knows strings and comments. Everything else (brace matching, masks, call extraction)
works on text in which the scanner has blanked them, so each rule is stated once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

from quarry.functions import columns


@dataclass(frozen=True)
class Syntax:
    """How a language writes comments and strings."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'", "`")
    raw: tuple[str, ...] = ("`",)  # without escapes, may span lines
    long: tuple[str, ...] = ()  # quotes that may span lines, with escapes
    cpp_raw: bool = False
    rust_raw: bool = False
    chars: bool = False  # one character between apostrophes; a lone apostrophe is no string


C_LIKE = Syntax(cpp_raw=True)
PYTHON = Syntax(line=("#",), block=(), quotes=('"', "'"), raw=(), long=('"""', "'''"))
RUBY = Syntax(line=("#",), block=(("=begin", "=end"),), quotes=('"', "'", "`"), raw=())
LUA = Syntax(line=("--",), block=(("--[[", "]]"), ("[[", "]]")), quotes=('"', "'"), raw=())
PHP = Syntax(line=("//", "#"), quotes=('"', "'"), raw=())
RUST = Syntax(quotes=(), raw=(), long=('"',), rust_raw=True, chars=True)
SCALA = Syntax(quotes=('"',), raw=(), long=('"""',), chars=True)
KOTLIN = Syntax(quotes=('"', "'"), raw=(), long=('"""',))
SWIFT = Syntax(quotes=('"',), raw=(), long=('"""',))


@lru_cache(maxsize=32)
def _scanner(s: Syntax) -> re.Pattern:
    parts = []
    if s.cpp_raw:
        parts.append(r'(?P<string0>\bR"(?P<delim>[^()\\\s]{0,16})\((?:.|\n)*?(?:\)(?P=delim)"|\Z))')
    if s.rust_raw:
        parts.append(r'(?P<string1>\bb?r(?P<hashes>#*)"(?:.|\n)*?(?:"(?P=hashes)|\Z))')
    if s.chars:
        parts.append(r"(?P<quotechar>'(?:\\(?:u\{[^}\n]*\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|[^'\\\n])')")
    for i, (a, b) in enumerate(sorted(s.block, key=lambda x: -len(x[0]))):
        parts.append(rf"(?P<block{i}>{re.escape(a)}(?:.|\n)*?(?:{re.escape(b)}|\Z))")
    parts += [rf"(?P<line{i}>{re.escape(a)}[^\n]*)" for i, a in enumerate(s.line)]
    parts += [rf"(?P<long{i}>{re.escape(q)}(?:\\.|.|\n)*?(?:{re.escape(q)}|\Z))" for i, q in enumerate(s.long)]
    for i, q in enumerate(s.quotes):
        body = rf"[^{q}]*(?:{q}|\Z)" if q in s.raw else rf"(?:\\(?:.|\n)|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)"
        parts.append(rf"(?P<quote{i}>{re.escape(q)}{body})")
    return re.compile("|".join(parts))


def blank(text: str, syntax: Syntax = C_LIKE, strings: bool = True, comments: bool = True) -> str:
    """The text, as long as before, with the contents of strings and comments replaced by blanks; line ends stay."""

    def gone(m: re.Match) -> str:
        kind = m.lastgroup or ""
        comment = m.group(0) if any(m.group(0).startswith(x) for x in (*syntax.line, *(b[0] for b in syntax.block))) and not kind.startswith(("quote", "long", "string")) else ""
        if (comment and not comments) or (not comment and not strings):
            return m.group(0)
        return "".join("\n" if c == "\n" else " " for c in m.group(0))

    return _scanner(syntax).sub(gone, text)


def match_brace(text: str, open_at: int, syntax: Syntax = C_LIKE, pair: str = "{}") -> int:
    """Index of the brace that closes the one at open_at, outside strings and comments; ValueError if there is none."""
    return match_in_blank(blank(text, syntax), open_at, pair)


def match_in_blank(clean: str, open_at: int, pair: str = "{}") -> int:
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(clean, open_at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.start()
    raise ValueError(f"no closing {pair[1]!r} for the one at {open_at}")


def masks(text: str, syntax: Syntax = C_LIKE) -> tuple[list[bool], list[bool]]:
    """(lines that are comment only, lines that begin inside a string), in one pass."""
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    comment, string = [False] * len(lines), [False] * len(lines)
    no_comments = blank(text, syntax, strings=False)
    for i, x in enumerate(lines):
        comment[i] = bool(x.strip()) and not no_comments[starts[i] : starts[i] + len(x)].strip()
    for m in _scanner(syntax).finditer(text):
        if (m.lastgroup or "").startswith(("quote", "long", "string", "delim")):
            first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
            for i in range(first + 1, last + 1):
                string[i] = True
    return comment, string


def comment_mask(lines: list[str], single: list[str], block: list[tuple[str, str]]) -> list[bool]:
    """Per line: it begins with a comment mark, lies in an open block, or opens one that its line doesn't close."""
    out, closing = [], None
    for raw in lines:
        line = raw.strip()
        if closing:
            out.append(True)
            if closing in line:
                closing = None
            continue
        mark = any(line.startswith(s) for s in single)
        for a, b in block:
            if not mark and a in line and b not in line.split(a, 1)[1]:
                closing, mark = b, True
        out.append(mark)
    return out


def count_indent(line: str) -> int:
    """Leading blanks; a tab counts four."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


@dataclass
class Lines:
    """Offsets of a text's lines; a final line end opens one more, empty line. Lines count from 1."""

    text: str
    starts: list[int] = field(init=False)

    def __post_init__(self):
        self.starts = [0] + [m.end() for m in re.finditer("\n", self.text)]

    def __len__(self) -> int:
        return len(self.starts)

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def offset(self, line: int) -> int:
        return self.starts[line - 1]

    def content(self, line: int) -> str:
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.text)
        return self.text[self.starts[line - 1] : end]


CALL = re.compile(columns.CALL)

#: Names that are not taken for calls of Go functions.
GO_BLACKLIST = frozenset([
    "if", "else", "for", "range", "switch", "case", "default", "break", "continue", "return", "go", "defer", "select", "var", "const", "type", "struct", "interface", "func",
    "map", "chan", "package", "import", "make", "new", "append", "len", "cap", "copy", "delete", "close", "panic", "recover", "print", "println", "nil", "true", "false", "iota",
    "string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "complex64", "complex128", "bool", "byte", "rune",
    "uintptr", "any", "error", "Close", "Read", "Write", "Seek", "Stat", "Open", "Create", "OpenFile", "ReadFile", "WriteFile", "ReadAll", "ReadDir", "Mkdir", "MkdirAll",
    "Remove", "RemoveAll", "Rename", "Scan", "Scanf", "Scanln", "Sscanf", "Split", "Join", "Contains", "HasPrefix", "HasSuffix", "Replace", "ReplaceAll", "Trim", "TrimSpace",
    "ToLower", "ToUpper", "Index", "LastIndex", "Atoi", "Itoa", "ParseInt", "FormatInt", "ParseFloat", "Set", "Get", "Load", "Store", "LoadOrStore", "LoadAndDelete", "Error",
    "Errorf", "Wrap", "Wrapf", "Is", "As", "Unwrap", "Context", "Cancel", "Deadline", "Done", "Err", "Marshal", "Unmarshal", "MarshalIndent", "Decode", "Encode", "Run", "Log",
    "Logf", "Fatal", "Fatalf", "Fail", "FailNow", "Skip", "Exec", "Query", "QueryRow", "Prepare", "Begin", "Commit", "Rollback", "Ping",
])
CONTROL = frozenset([
    "if", "for", "while", "switch", "return", "catch", "function", "func", "def", "fn", "elif", "else", "match", "with", "and", "or", "not", "in", "is", "lambda", "assert", "del",
    "print", "except", "raise", "yield", "sizeof", "typeof", "unless", "until", "when", "foreach",
])


@dataclass
class Calls:
    names: list[str]
    count: int
    depth: int


def call_stats(body: str, skip: frozenset[str] = CONTROL, syntax: Syntax = C_LIKE, qualified: bool = False, least: int = 2) -> Calls:
    """Distinct callees in order of appearance, number of calls, and how deep parentheses nest.

    A name of fewer than `least` characters is no call; a name after a dot is taken even if `skip` has
    it, unless `qualified` asks for both the plain and the dotted name (then `skip` holds for either).
    """
    clean = blank(body, syntax)
    names: dict[str, None] = {}
    count = 0
    for prefix, name in CALL.findall(clean):
        if len(name) < least or (name in skip and (not prefix or qualified)):
            continue
        count += 1
        names[name] = None
        if qualified and prefix:
            names[f"{prefix}.{name}"] = None
    depth = most = 0
    for c in re.findall(r"[()]", clean):
        depth = depth + 1 if c == "(" else max(0, depth - 1)
        most = max(most, depth)
    return Calls(list(names), count, most)


def call_nesting(clean: str) -> int:
    """How deep calls stand in calls' arguments: 0 for a lone call, 1 for f(g())."""
    stack, most, depth = [], 0, 0
    for m in re.finditer(r"(\w)?\s*\(|\)", clean):
        if m.group() == ")":
            if stack and stack.pop():
                depth -= 1
        else:
            call = m.group(1) is not None
            stack.append(call)
            depth += call
            most = max(most, depth)
    return max(0, most - 1)


def infer_type(value: str) -> str:
    """The type of a Go value, by ordered rules."""
    v = value.strip()
    if v[:1] in ('"', "`"):
        return "string"
    if v[:1] == "'":
        return "rune"
    if v in ("true", "false"):
        return "bool"
    if v == "nil":
        return "untyped nil"
    if re.match(r"[-+]?\d", v):
        return "float64" if re.search(r"[.eE]", v) else "int"
    if m := re.match(r"&?([\w.\[\]*]+)\s*\{", v):
        return m.group(1)
    if m := re.match(r"(func)\b", v):
        return "func"
    if m := re.match(r"([\w.]+)\s*\(", v):
        return m.group(1)
    return ""


def cyclomatic(clean: str, documented: bool = True) -> int:
    """1 + branches. documented: cases and short circuits count too; else only if, for (twice with range) and select arms."""
    n = 1 + len(re.findall(r"\b(?:if|for)\b", clean))
    if documented:
        return n + len(re.findall(r"\bcase\b|&&|\|\|", clean))
    return n + len(re.findall(r"\brange\b", clean)) + len(re.findall(r"\bselect\b", clean)) + len(re.findall(r"\bcase\b[^:\n]*<-", clean))


_GO_PIECE = re.compile(r"[{}()\[\];\n]|[^{}()\[\];\n]+")
_HEAD = re.compile(r"(?:else\s+)?(if|for|switch|select)\b(.*)", re.S)


def _simple_statement(piece: str) -> int:
    """1 for a statement that counts; jumps and constants do not."""
    piece = re.sub(r"^(?:case\b(?:(?!:(?!=)).)*|default\s*|\w+):(?!=)\s*", "", piece.strip(), flags=re.S)
    return int(bool(piece) and not re.match(r"(?:break|continue|goto|fallthrough|const|else|case|default)\b", piece))


def statements(clean: str) -> int:
    """Statements and blocks of a Go body in braces, its own block included.

    Simple statements in the head of an if, for or switch count, a range clause does not; nor do the
    contents of composite literals, but the bodies of functions in them do.
    """
    count, frames = 0, [["block", "", 0, False]]  # kind, piece so far, open brackets, whether the piece has been counted

    def ended(frame: list) -> int:
        kind, piece, _, done = frame
        frame[1], frame[3] = "", False
        return 0 if kind == "other" or done else _simple_statement(piece.replace("\0", " "))

    for m in _GO_PIECE.finditer(clean):
        token, frame = m.group(), frames[-1]
        if token == "{":
            tail = frame[1].rsplit("\0", 1)[-1].strip()
            head = _HEAD.match(re.sub(r"^(?:case\b(?:(?!:(?!=)).)*|default\s*|\w+):(?!=)\s*", "", tail, flags=re.S)) if frame[0] != "other" and not frame[2] else None
            if re.search(r"\b(?:struct|interface)$", tail):
                kind = "other"
            elif re.search(r"\bfunc\b", tail):
                kind = "block"
            elif head:
                kind = "arms" if head.group(1) in ("switch", "select") else "block"
                parts = head.group(2).split(";")
                count += 1 + sum(bool(re.search(r":?=(?!=)|\+\+|--", x)) and not re.search(r"\brange\b|[=!<>]=", x) for x in (parts[:1] + parts[2:] if len(parts) > 1 else []))
                frame[3] = True
            elif frame[0] != "other" and not frame[2] and (tail in ("", "else") or re.fullmatch(r"(?:case\b.*|default\s*|\w+):", tail, re.S)):
                kind = "block"
                frame[3] = True
            else:
                kind = "other"
            count += kind == "block"
            frames.append([kind, "", 0, False])
        elif token == "}":
            count += ended(frame)
            if len(frames) > 1:
                frames.pop()
            frames[-1][1] += "\0"
        elif token in "([":
            frame[2] += 1
            frame[1] += token
        elif token in ")]":
            frame[2] = max(0, frame[2] - 1)
            frame[1] += token
        elif token in ";\n" and not frame[2]:
            piece = frame[1].rsplit("\0", 1)[-1].strip()
            in_head = token == ";" and _HEAD.match(piece) and not frame[3]
            goes_on = token == "\n" and re.search(r"[+\-*/%&|^<>=!,.]$", piece) and not piece.endswith(("++", "--"))
            if in_head or goes_on:
                frame[1] += token
            else:
                count += ended(frame)
        else:
            frame[1] += token
    return count


def split_top(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            parts.append(text[last:i].strip())
            last = i + 1
    parts.append(text[last:].strip())
    return [p for p in parts if p]


def erb_blocks(text: str) -> list[tuple[int, str]]:
    """(offset, code) of template tags that hold statements; output and comment tags hold none."""
    return [(m.start(1), m.group(1)) for m in re.finditer(r"<%(?![=#%])-?((?:.|\n)*?)-?%>", text)]


def is_ruby_end(line: str) -> bool:
    return line.strip() in ("end", "end,", "end)") or line.strip().startswith("end ")


def opens_ruby_block(line: str) -> bool:
    return bool(re.match(r"\s*(?:def|class|module|if|unless|case|begin|for|while|until)\b", line)) or bool(re.search(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$", line))


_RUBY_OPENS = re.compile(r"(?:^|[;=(\[,{|&!]|<<|\b(?:then|else|do|and|or|not|in|private|public|protected|private_class_method|module_function)\b)\s*(?:(?:if|unless|case|begin|class|module)\b|(?P<loop>while|until|for)\b|def\b(?P<sign>[^;]*))(?!\s*:)")
_RUBY_DO = re.compile(r"(?<![.:\w])do\b(?!\s*:)")
_END = re.compile(r"(?<![.:\w])end\b(?!\s*:)")


def end_depth(line: str, language: str) -> int:
    """By how much a line without strings and comments changes the number of blocks that `end` closes."""
    closed = len(_END.findall(line))
    if language == "lua":
        return len(re.findall(r"\b(?:function|if|do)\b", line)) - closed
    opened, loops = 0, 0
    for m in _RUBY_OPENS.finditer(line):
        endless = m.group("sign") is not None and re.match(r"\s+[\w.]+[?!]?\s*(?:\([^)]*\))?\s*=(?![=~])", m.group("sign"))
        opened += not endless
        loops += m.group("loop") is not None
    return opened + max(0, len(_RUBY_DO.findall(line)) - loops) - closed
