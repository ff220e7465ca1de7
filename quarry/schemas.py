"""The relations of a scanned code base. Names are snake_case; keys are never null."""

from __future__ import annotations

FUNCTIONS = (
    "id long, session_id long, name string, package_name string, language string, file_path string, line_start int, line_end int, body string, hash string, "
    "call_count int, nesting_depth int, parameters string, return_types string, receiver string, is_method boolean, visibility string, cyclomatic int, "
    "parameter_count int, return_count int, statement_count int, anonymous_funcs int"
)
FUNCTION_DEPS = "caller_id long, callee_name string"
GLOBAL_VARS = "id long, session_id long, name string, var_type string, language string, package_name string, visibility string, file_path string, line_num int, is_const boolean, hash string"
SCAN_SESSIONS = "id long, project_root string, scan_time timestamp, duration_ms long, file_count int, func_count int, var_count int"
TYPE_DEFS = "session_id long, name string, kind string, language string, package_name string, file_path string, line_start int, line_end int, body string, fields string"
FILE_CACHE = "file_path string, mtime long, hash string, session_id long"

#: What the parser finds in a file, nested.
_FUNCTION = "name string, package_name string, language string, file_path string, line_start int, line_end int, body string, dependencies array<string>, call_count int, nesting_depth int, parameters string, return_types string, receiver string, is_method boolean, visibility string, cyclomatic int, parameter_count int, return_count int, statement_count int, anonymous_funcs int, hash string"
_GLOBAL = "name string, var_type string, language string, package_name string, visibility string, file_path string, line_num int, is_const boolean, hash string"


def _struct(ddl: str) -> str:
    return "array<struct<" + ",".join(":".join(x.strip().split(" ", 1)) for x in ddl.split(", ")) + ">>"


PARSED = f"file_path string, language string, mtime long, encoding string, content_hash string, functions {_struct(_FUNCTION)}, globals {_struct(_GLOBAL)}, error string"
PARSE_CACHE = f"file_path string, language string, content_hash string, encoding string, functions {_struct(_FUNCTION)}, globals {_struct(_GLOBAL)}, session_id long"

#: Columns of a function in every listing; line_count is derived.
BRIEF = ["id", "name", "package_name", "language", "file_path", "line_start", "line_end", "line_count", "nesting_depth", "call_count", "cyclomatic", "parameter_count", "return_count", "statement_count", "anonymous_funcs", "is_method", "visibility"]
