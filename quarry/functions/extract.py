"""Functions, calls and globals of one source file: pure Python, text in, rows out."""

from __future__ import annotations

import re

from quarry.functions import lex
from quarry.sources.languages import Language


def package_of(language: str, clean: str) -> str:
    """The first package or namespace clause; for Python the first imported name."""
    patterns = {"go": r"^\s*package\s+(\w+)", "python": r"^\s*(?:import|from)\s+(\w+)", "java": r"^\s*package\s+([\w.]+)"}
    m = re.search(patterns.get(language, r"^\s*(?:package|namespace)\s+([\w.]+)"), clean, re.M)
    return m.group(1) if m and language != "ruby" else ""


def functions_of(text: str, path: str, language: Language) -> list[dict]:
    """One row a function, in the order of their names' places."""
    if language.name == "erb":
        return _erb(text, path)
    clean = lex.blank(text, language.syntax)
    lines, package, rows = lex.Lines(text), package_of(language.name, clean), []
    for m in re.finditer(language.function_regex, clean, re.M):
        name = m.groupdict().get("name")
        if not name or (name in lex.CONTROL and language.name not in ("go", "ruby")):
            continue
        found = _end(clean, m, language, lines)
        if found is None:
            continue
        opened, end = found
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        rows.append(_row(text, clean, path, package, language, name, start, opened, end, m, lines))
    if language.name == "go":
        rows.sort(key=lambda r: r["is_method"])
    return rows


def _end(clean: str, m: re.Match, language: Language, lines: lex.Lines) -> tuple[int, int] | None:
    """(where the function's body begins, where it ends), or None for a declaration."""
    first = lines.of(m.start() + len(m.group()) - len(m.group().lstrip()))
    if language.body == "indent":
        depth, last = lex.count_indent(lines.content(first)), first
        inside = clean.split("\n")
        for number in range(first + 1, len(lines) + 1):
            line = inside[number - 1]
            if line.strip():
                closes = line.strip()[0] in ")]}" or number == first + 1 and ":" not in clean[m.start() : lines.offset(number)]
                if lex.count_indent(line) <= depth and not closes:
                    break
                last = number
            elif lines.content(number).strip() and lex.count_indent(lines.content(number)) > depth:
                last = number
        return m.end(), lines.offset(last) + len(lines.content(last))
    if language.body == "end":
        depth, rows = 0, clean.split("\n")
        for number in range(first, len(lines) + 1):
            depth += lex.end_depth(rows[number - 1], language.name)
            if depth <= 0:
                return m.end(), lines.offset(number) + len(lines.content(number))
        return None
    try:
        after = lex.match_in_blank(clean, clean.index("(", m.end() - 1), "()") + 1 if clean[m.end() - 1 : m.end()] == "(" else m.end()
        opened = _body_at(clean, after, language)
        if opened is None:
            return None
        if clean[opened] == "=":
            return opened, _expression_end(clean, opened + 1, lex.count_indent(lines.content(first)))
        return opened, lex.match_in_blank(clean, opened) + 1
    except ValueError:
        return None


def _body_at(clean: str, at: int, language: Language) -> int | None:
    """The brace, or the sign of equality, that opens a body after a parameter list; None if a statement ends before."""
    depth, marks = 0, re.compile(r"=>|[()\[\]{;=\n]")
    while m := marks.search(clean, at):
        c, i, at = m.group(), m.start(), m.end()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                return None
        elif depth == 0 and c == "{":
            before = clean[:i].rstrip()
            # a type: of a Go result, or of an object after a colon
            if re.search(r"\b(?:interface|struct)$", before) or language.name == "typescript" and before[-1:] in ":|&<,":
                at = lex.match_in_blank(clean, i) + 1
                continue
            return i
        elif depth == 0 and c == "=" and language.expressions:
            return i
        elif depth == 0 and c in ";=":
            return None
        elif depth == 0 and c == "\n" and language.expressions and not re.match(r"\s*[{=:]", clean[i:]) and not clean[:i].rstrip().endswith((":", ",", "=>")):
            return None
    return None


def _expression_end(clean: str, at: int, indent: int) -> int:
    """Where an expression ends that begins at `at`: at a line end outside brackets after which no deeper line and no operator goes on."""
    depth, start = 0, at
    for m in re.compile(r"[(\[{)\]}\n;]").finditer(clean, at):
        c, i = m.group(), m.start()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return start + len(clean[start:i].rstrip())
        elif depth == 0 and clean[start:i].strip():
            following = re.match(r"\s*\n([ \t]*)(\S\w*)?", clean[i:]) if c == "\n" else None
            goes_on = following and following.group(2) and (lex.count_indent(following.group(1)) > indent or following.group(2) in ("else", "catch", "finally") or following.group(2)[0] in ".?:&|+-*/")
            if not goes_on:
                return start + len(clean[start:i].rstrip())
    return start + len(clean[start:].rstrip())


def _row(text: str, clean: str, path: str, package: str, language: Language, name: str, start: int, opened: int, end: int, m: re.Match, lines: lex.Lines) -> dict:
    go = language.name == "go"
    body = text[start:end]
    calls = lex.call_stats(clean[opened:end], lex.GO_BLACKLIST if go else lex.CONTROL, language.syntax, qualified=go, least=1 if language.built_in else 2)
    row = {
        "name": name, "package_name": package, "language": language.name, "file_path": path, "line_start": lines.of(start), "line_end": lines.of(max(start, end - 1)), "body": body,
        "dependencies": calls.names, "call_count": calls.count, "nesting_depth": lex.call_nesting(clean[m.end() : end]), "parameters": "", "return_types": "", "receiver": "", "is_method": False,
        "visibility": "", "cyclomatic": 0, "parameter_count": 0, "return_count": 0, "statement_count": 0, "anonymous_funcs": 0,
    }
    if go:
        first = clean.find("(", m.end() - 1)
        close = lex.match_in_blank(clean, first, "()")
        inner = clean[opened:end]
        parameters = text[first + 1 : close].strip()
        row |= {
            "parameters": f"({parameters})", "return_types": text[close + 1 : opened].strip(), "receiver": (m.groupdict().get("receiver") or "").strip(), "is_method": bool(m.groupdict().get("receiver")),
            "visibility": "private" if name[0].islower() and name[0].isascii() else "public", "cyclomatic": lex.cyclomatic(inner), "parameter_count": _parameter_groups(parameters),
            "return_count": len(re.findall(r"\breturn\b", inner)), "statement_count": lex.statements(inner), "anonymous_funcs": len(re.findall(r"\bfunc\s*\(", inner)),
        }
    return row


def _parameter_groups(parameters: str) -> int:
    """Go parameters by declaration: `a, b int` is one."""
    parts = lex.split_top(parameters)
    typed = [p for p in parts if len(p.split(None, 1)) > 1]
    return len(typed) or len(parts)


def _erb(text: str, path: str) -> list[dict]:
    rows, lines, stack = [], lex.Lines(text), []
    for at, code in lex.erb_blocks(text):
        if m := re.match(r"\s*def\s+(\w+[?!]?)", code):
            stack.append((m.group(1), at))
        elif lex.opens_ruby_block(code.rstrip()):
            stack.append((None, at))
        elif lex.is_ruby_end(code) and stack:
            name, start = stack.pop()
            if name:
                body = text[start : at + len(code)]
                calls = lex.call_stats(body, lex.GO_BLACKLIST, lex.RUBY)
                rows.append({"name": name, "package_name": "", "language": "erb", "file_path": path, "line_start": lines.of(start), "line_end": lines.of(at + len(code)), "body": body, "dependencies": [c for c in calls.names if c != name], "call_count": calls.count, "nesting_depth": calls.depth, "parameters": "", "return_types": "", "receiver": "", "is_method": False, "visibility": "", "cyclomatic": 0, "parameter_count": 0, "return_count": 0, "statement_count": 0, "anonymous_funcs": 0})
    return rows


def globals_of(text: str, path: str, language: Language) -> list[dict]:
    """Top-level variables and constants; a grouped declaration gives a row a name."""
    clean = lex.blank(text, language.syntax)
    if language.name == "go":
        return _go_globals(text, clean, path)
    if not language.global_regex:
        return []
    lines, package = lex.Lines(text), package_of(language.name, clean)
    depth = _depths(clean)
    out = []
    for m in re.finditer(language.global_regex, clean, re.M):
        at = m.start("name")
        if depth[at] or (language.body == "indent" and m.group()[:1] in " \t") or m.group("name") in lex.CONTROL:
            continue
        groups = m.groupdict()
        constant = (groups.get("const") or "") in ("const", "val", "let" if language.name == "swift" else "const")
        out.append(_global(m.group("name"), (groups.get("type") or "").strip(), language.name, package, path, lines.of(at), constant))
    return out


def _global(name: str, type_: str, language: str, package: str, path: str, line: int, constant: bool) -> dict:
    return {"name": name, "var_type": type_, "language": language, "package_name": package, "visibility": "public" if "A" <= name[:1] <= "Z" else "private", "file_path": path, "line_num": line, "is_const": constant}


def _depths(clean: str) -> list[int]:
    out, depth, at = [], 0, 0
    for m in re.finditer(r"[(\[{)\]}]", clean):
        out += [max(depth, 0)] * (m.start() - at)
        opens = m.group() in "([{"
        depth -= not opens
        out.append(max(depth, 0))
        depth += opens
        at = m.end()
    return out + [max(depth, 0)] * (len(clean) - at)


def _go_globals(text: str, clean: str, path: str) -> list[dict]:
    lines, package, depth, out = lex.Lines(text), package_of("go", clean), _depths(clean), []
    for m in re.finditer(r"^(var|const)\b[ \t]*(\()?", clean, re.M):
        if depth[m.start()]:
            continue
        if m.group(2):
            close = lex.match_in_blank(clean, m.end() - 1, "()")
            specs = [(m.end() + x.start(), x.group()) for x in re.finditer(r"[^\n;]+", clean[m.end() : close]) if depth[m.end() + x.start()] == 1]
        else:
            specs = [(m.end(), clean[m.end() :].split("\n", 1)[0])]
        for at, spec in specs:
            head = re.match(r"\s*([\w\s,]*?\w)(?:[ \t]+([^=\n]+?))?\s*(=|$)", spec)
            if not head:
                continue
            names = [n.strip() for n in head.group(1).split(",")]
            type_ = (head.group(2) or "").strip()
            last = names[-1].split()
            if len(last) > 1 and not type_:
                names[-1], type_ = last[0], " ".join(last[1:])
            values = lex.split_top(text[at + spec.index("=") + 1 : at + len(spec)]) if "=" in spec else []
            for i, name in enumerate(names):
                if re.fullmatch(r"[^\W\d]\w*", name):
                    out.append(_global(name, type_ or (lex.infer_type(values[i]) if i < len(values) else ""), "go", package, path, lines.of(at + spec.find(name)), m.group(1) == "const"))
    return out
