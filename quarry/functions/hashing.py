"""Hashes of contents, functions and variables, as hexadecimal text.

Scans use SHA-256, which runs outside the interpreter; FNV-1a gives values that other stores of the
same relations hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

#: Offset bases and primes of FNV-1a.
FNV64 = (0xCBF29CE484222325, 0x100000001B3)
FNV128 = (0x6C62272E07BB014262B821756295C58D, 0x0000000001000000000000000000013B)


def fnv1a(data: bytes, bits: int = 64) -> str:
    h, prime = FNV64 if bits == 64 else FNV128
    mask = (1 << bits) - 1
    for byte in data:
        h = ((h ^ byte) * prime) & mask
    return f"{h:0{bits // 4}x}"


def content_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def sha(data: bytes, bits: int = 128) -> str:
    return hashlib.sha256(data).hexdigest()[: bits // 4]


FUNCTION_FIELDS = [
    "name", "package_name", "language", "file_path", "line_start", "body", "call_count", "nesting_depth", "parameters", "return_types", "receiver", "is_method", "visibility",
    "cyclomatic", "parameter_count", "return_count", "statement_count", "anonymous_funcs",
]
VARIABLE_FIELDS = [
    "name", "var_type", "language", "package_name", "visibility", "file_path", "line_num", "is_const",
]


def _text(value: object) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def function_hash(row: dict, digest: Callable[[bytes, int], str] = sha) -> str:
    """Over the fields without separators, dependencies sorted; line_end is left out, so a body alone decides."""
    return digest("".join([*(_text(row.get(f, "")) for f in FUNCTION_FIELDS), *sorted(row.get("dependencies") or [])]).encode(), 128)


def variable_hash(row: dict, digest: Callable[[bytes, int], str] = sha) -> str:
    return digest("".join(_text(row.get(f, "")) for f in VARIABLE_FIELDS).encode(), 128)
