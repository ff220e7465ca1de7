"""The language dimension: what counts as a source file and how each language is read."""

from __future__ import annotations

from dataclasses import dataclass, field

from quarry.functions import lex
from quarry.functions.columns import ALIASES


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    function_regex: str
    body: str = "brace"  # brace, indent or end
    single_comment: tuple[str, ...] = ("//",)
    block_comment: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    syntax: lex.Syntax = field(default=lex.C_LIKE)
    global_regex: str | None = None
    expressions: bool = False  # a function's body may be an expression after a sign of equality
    built_in: bool = True

    def root_node(self) -> str:
        """The type of the node that a syntax tree of this language begins with."""
        return ROOT_NODES.get(self.name, "source_file")


#: Syntax trees of other languages than these begin with a source_file.
ROOT_NODES = {"python": "module", "java": "program", "javascript": "program", "typescript": "program", "cpp": "translation_unit", "ruby": "program", "csharp": "compilation_unit", "php": "program", "lua": "program"}

_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|virtual|override|async|unsafe|sealed|partial|extern)\s+)*"
_TYPED = rf"^[ \t]*{_MODIFIERS}[\w.]+(?:<[^>;{{}}]*>)?(?:\[\])*[?*&]*\s+[*&]*(?P<name>\w+)\s*\("

#: Functions and globals of each built-in language. The extensions are fixed values. Patterns run on text without strings and comments.
LANGUAGES = (
    Language("go", (".go",), r"^func\s+(?P<receiver>\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?\("),
    Language("python", (".py",), r"^[ \t]*(?:async\s+)?def\s+(?P<name>\w+)\s*\(", "indent", ("#",), (('"""', '"""'), ("'''", "'''")), lex.PYTHON, r"^(?P<name>[A-Za-z_]\w*)\s*(?::[^=\n]+)?=(?!=)"),
    Language("java", (".java",), _TYPED, global_regex=r"^[ \t]*(?:public|private|protected|static|final|\s)*(?P<type>[\w<>\[\]]+)\s+(?P<name>\w+)\s*(?:=|;)"),
    Language("kotlin", (".kt", ".kts"), r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)\s*\(", syntax=lex.KOTLIN, expressions=True, global_regex=r"^[ \t]*(?:\w+\s+)*?(?P<const>val|var)\s+(?P<name>\w+)"),
    Language("javascript", (".js", ".jsx", ".mjs"), r"\bfunction\s*\*?\s+(?P<name>[\w$]+)\s*\(", global_regex=r"^(?:export\s+)?(?P<const>const|let|var)\s+(?P<name>[\w$]+)"),
    Language("typescript", (".ts", ".tsx"), r"\bfunction\s*\*?\s+(?P<name>[\w$]+)\s*(?:<[^>(]*>)?\(", global_regex=r"^(?:export\s+)?(?P<const>const|let|var)\s+(?P<name>[\w$]+)"),
    Language("csharp", (".cs",), _TYPED, global_regex=r"^(?:public|private|protected|internal|static|readonly|const|\s)*(?P<type>[\w<>\[\]]+)\s+(?P<name>\w+)\s*(?:=|;)"),
    Language("cpp", (".cpp", ".cxx", ".cc", ".c", ".h", ".hpp"), r"^[ \t]*(?:[\w:]+(?:\s*<[^>;{}]*>)?[\s*&]+)+(?P<name>\w+)\s*\(", global_regex=r"^(?:static\s+|extern\s+|constexpr\s+|(?P<const>const)\s+)*(?P<type>[\w:]+(?:<[^>]*>)?[\s*&]+)(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:=|;)"),
    Language("rust", (".rs",), r"\bfn\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\(", syntax=lex.RUST, global_regex=r"^(?:pub(?:\([^)]*\))?\s+)?(?P<const>const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:\s*(?P<type>[^=;]+)"),
    Language("ruby", (".rb",), r"^[ \t]*(?:(?:private|protected|public|module_function|private_class_method)[ \t]+)?def\s+(?:self\.)?(?P<name>\w+[?!]?)", "end", ("#",), (("=begin", "=end"),), lex.RUBY, r"^(?P<name>[A-Za-z_$]\w*)\s*=(?![=~])"),
    Language("swift", (".swift",), r"\bfunc\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\(", syntax=lex.SWIFT, global_regex=r"^(?:\w+\s+)*?(?P<const>let|var)\s+(?P<name>\w+)"),
    Language("php", (".php",), r"\bfunction\s+&?(?P<name>\w+)\s*\(", "brace", ("//", "#"), (("/*", "*/"),), lex.PHP, r"^(?:(?P<const>const)\s+|\$)(?P<name>\w+)\s*="),
    Language("lua", (".lua",), r"\bfunction\s+(?P<name>\w+(?:[.:]\w+)*)\s*\(", "end", ("--",), (("--[[", "]]"),), lex.LUA, r"^(?:local\s+)?(?P<name>[A-Za-z_]\w*)\s*=(?!=)"),
    Language("scala", (".scala",), r"\bdef\s+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*(?=[(:={])", syntax=lex.SCALA, expressions=True, global_regex=r"^[ \t]*(?:\w+\s+)*?(?P<const>val|var)\s+(?P<name>\w+)"),
    Language("erb", (".erb",), r"^\s*def\s+(?P<name>\w+[?!]?)", "end", ("#",), (), lex.RUBY),
)


def by_extension(languages: tuple[Language, ...] = LANGUAGES) -> dict[str, Language]:
    """Extension -> language; of two languages with one extension, the first has it."""
    out: dict[str, Language] = {}
    for language in languages:
        for ext in language.extensions:
            out.setdefault(ext.lower(), language)
    return out


def load_config(path: str) -> tuple[Language, ...]:
    """Languages of a YAML file; a list that is not empty replaces the built-in one, a missing file keeps it."""
    import os

    import yaml

    if not os.path.exists(path):
        return LANGUAGES
    with open(path, encoding="utf-8") as file:
        rows = (yaml.safe_load(file) or {}).get("languages") or []
    made = [Language(r["name"], tuple(r["extensions"]), r["function_regex"], r.get("body_strategy") or "brace", tuple(r.get("single_comment") or ()), tuple(map(tuple, r.get("block_comment") or ())), built_in=False) for r in rows]
    known = {x.name: x for x in LANGUAGES}
    return tuple(_with_syntax(x, known) for x in made) or LANGUAGES


def registered(configured: tuple[Language, ...]) -> tuple[Language, ...]:
    """The built-in languages, and of the configured ones what no built-in language reads: all extensions that are new."""
    from dataclasses import replace

    known = by_extension(LANGUAGES)
    more = [replace(x, extensions=new) for x in configured if x not in LANGUAGES and (new := tuple(e for e in x.extensions if e.lower() not in known))]
    return (*LANGUAGES, *more)


def _with_syntax(language: Language, known: dict[str, Language]) -> Language:
    from dataclasses import replace

    same = known.get(language.name)
    syntax = same.syntax if same else lex.Syntax(line=language.single_comment, block=language.block_comment)
    return replace(language, syntax=syntax, global_regex=same.global_regex if same else None)


def named(names: list[str], languages: tuple[Language, ...] = LANGUAGES) -> set[str]:
    """Canonical names of the given ones or their short forms; unknown names are left out."""
    full = {ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names}
    return full & {x.name for x in languages}
