"""Named modes over a scanned state folder, for a command line and for JSON-RPC calls.

python -m quarry.cli scan ROOT STATE [--lang go,py] [--max-size N] [--skip-dirs a,b] [--full] [--config FILE] [--no-temp]
python -m quarry.cli query STATE MODE[=PARAM] [--format json|text]
python -m quarry.cli graph STATE          the report on the latest session's call graph
python -m quarry.cli serve STATE          JSON-RPC requests on standard input, a line each
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import queries as Q


def positive(text: str, default: int) -> int:
    """A positive number, or the default for anything else."""
    return int(text) if text.isdigit() and int(text) > 0 else default


def dead(r) -> DataFrame:
    """Orphans of the latest session, tagged."""
    last = r.functions.agg(F.max("session_id").alias("session_id"))
    return G.orphan_tags(r.functions.join(F.broadcast(last), "session_id"), r.deps)  # one row


MODES: dict[str, Callable[..., DataFrame]] = {
    "summary": lambda r, p: Q.summary(r.functions, r.deps, r.globals, r.sessions),
    "functions": lambda r, p: Q.functions_by_language(r.functions, p) if p else Q.all_functions(r.functions),
    "func": lambda r, p: Q.function_detail(r.functions, [x.strip() for x in p.split(",") if x.strip()]),
    "body": lambda r, p: Q.function_body(r.functions, int(p)) if p.lstrip("-").isdigit() else Q.function_body_by_name(r.functions, p),
    "vars": lambda r, p: Q.variables_by_language(r.globals, p) if p else Q.variables(r.globals),
    "deps": lambda r, p: Q.dependency_stats(r.functions, r.deps),
    "calls": lambda r, p: Q.callers(r.functions, r.deps, p),
    "dead": lambda r, p: dead(r),
    "unreferenced": lambda r, p: Q.unreferenced(r.functions, r.deps),
    "missing": lambda r, p: Q.missing(r.functions, r.deps),
    "top": lambda r, p: Q.longest(r.functions, positive(p, 10)),
    "deep": lambda r, p: Q.deeply_nested(r.functions, positive(p, 3)),
    "complexity": lambda r, p: Q.most_complex(r.functions, positive(p, 10)),
    "params": lambda r, p: Q.many_parameters(r.functions, positive(p, 5)),
    "anon": lambda r, p: Q.with_anonymous(r.functions),
    "files": lambda r, p: Q.files_by_size(r.functions),
    "types": lambda r, p: Q.type_definitions(r.types, p or None),
    "tree": lambda r, p: G.call_tree(r.functions, r.deps, p),
    "hot": lambda r, p: G.hot(r.functions, r.deps, positive(p, 10)),
    "graph": lambda r, p: G.statistics(r.functions),
    "session": lambda r, p: Q.latest_session(r.sessions),
}
REQUIRED = {"func", "body", "calls", "tree"}

#: The RPC tools and resources, with the mode and the argument that each one is.
TOOLS = {
    "get_summary": ("summary", None), "list_functions": ("functions", "language"), "get_function": ("func", "name"), "get_function_body": ("body", "func_id"), "list_variables": ("vars", "language"),
    "analyze_deps": ("deps", None), "find_callers": ("calls", "func_name"), "find_dead_code": ("unreferenced", None), "find_missing_deps": ("missing", None), "top_functions": ("top", "n"), "deep_nesting": ("deep", "threshold"),
    "high_complexity": ("complexity", "limit"), "many_params": ("params", "threshold"), "find_anonymous": ("anon", None), "file_metrics": ("files", None), "list_types": ("types", "kind"), "get_func_tree": ("tree", "name"),
}
RESOURCES = {"db://summary": "summary", "db://functions": "functions", "db://variables": "vars", "db://files": "files", "db://types": "types", "db://sessions/latest": "session"}
ABOUT = {
    "summary": "Totals over all sessions, with functions and variables by language", "functions": "All functions, or those of a language", "func": "Functions of exactly these names, comma separated", "body": "The body of one function, by id or name",
    "vars": "Top-level variables, all or of a language", "deps": "Callers and callees of each function name", "calls": "Functions that call a name", "unreferenced": "Functions whose name no call has", "missing": "Callees without a function",
    "top": "The longest functions", "deep": "Functions with calls nested at least so deep", "complexity": "The most complex functions", "params": "Functions with at least so many parameters", "anon": "Functions that hold anonymous ones",
    "files": "Sums and maxima by file", "types": "Type definitions, all or of a kind", "tree": "All names that a function reaches, with their depth", "session": "The latest session",
}
PROTOCOL = "2024-11-05"


def ask(relations, mode: str, param: str = "") -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    if mode in REQUIRED and not param:
        raise ValueError(f"mode {mode!r} needs a value")
    return MODES[mode](relations, param)


def to_json(rows: DataFrame) -> list:
    """The rows of an answer for a reader: a listing goes to the caller whole."""
    return [json.loads(x) for x in rows.toJSON().toLocalIterator()]


def described(name: str) -> dict:
    """A tool as tools/list names it: what it answers, and its argument as a JSON schema."""
    mode, argument = TOOLS[name]
    schema: dict = {"type": "object", "properties": {argument: {"type": "string"}} if argument else {}}
    return {"name": name, "description": ABOUT[mode], "inputSchema": schema | ({"required": [argument]} if mode in REQUIRED else {})}


def _answer(method: str, relations, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}, "resources": {}, "logging": {}}, "serverInfo": {"name": "quarry", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [described(n) for n in TOOLS]}
    if method == "tools/call":
        mode, argument = TOOLS[params["name"]]
        rows = to_json(ask(relations, mode, str((params.get("arguments") or {}).get(argument, "")) if argument else ""))
        if mode == "body":
            if not rows:
                raise LookupError("no such function")
            return {"content": [{"type": "text", "text": rows[0]["body"]}], "isError": False}
        return {"content": [{"type": "text", "text": json.dumps(rows, ensure_ascii=False)}], "isError": False}
    if method == "resources/list":
        return {"resources": [{"uri": u, "name": m, "description": ABOUT[m], "mimeType": "application/json"} for u, m in RESOURCES.items()]}
    if method == "resources/read":
        uri = params["uri"]
        return {"contents": [{"uri": uri, "mimeType": "application/json", "text": json.dumps(to_json(ask(relations, RESOURCES[uri])), ensure_ascii=False)}]}
    raise NotImplementedError(method)


def call(relations, request: dict) -> dict | None:
    """The JSON-RPC answer to a request; None for a notification. What a tool cannot answer is a result that says so."""
    method, params = str(request.get("method")), request.get("params") or {}
    if "id" not in request:
        return None
    out = {"jsonrpc": "2.0", "id": request["id"]}
    try:
        return out | {"result": _answer(method, relations, params)}
    except NotImplementedError:
        return out | {"error": {"code": -32601, "message": f"no method {method!r}"}}
    except (KeyError, ValueError, LookupError) as e:
        if method != "tools/call":
            return out | {"error": {"code": -32602, "message": f"{type(e).__name__}: {e}"}}
        return out | {"result": {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}]}}


def main(argv: list[str] | None = None) -> None:
    from quarry.plans.report import graph_report, text_table
    from quarry.plans.scan import Options, Scanned, scan
    from quarry.sources.files import MAX_SIZE, check_root
    from quarry.sources.languages import LANGUAGES, load_config, registered

    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("scan")
    p.add_argument("root")
    p.add_argument("state")
    p.add_argument("--lang", default="")
    p.add_argument("--max-size", type=int, default=MAX_SIZE)
    p.add_argument("--skip-dirs", default="")
    p.add_argument("--full", action="store_true")
    p.add_argument("--config", default="")
    p.add_argument("--no-temp", action="store_true")
    p = sub.add_parser("query")
    p.add_argument("state")
    p.add_argument("mode")
    p.add_argument("--format", choices=["json", "text"], default="json")
    sub.add_parser("graph").add_argument("state")
    sub.add_parser("serve").add_argument("state")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    if args.command == "scan":
        comma = lambda s: [x for x in s.split(",") if x.strip()] or None
        languages = registered(load_config(args.config)) if args.config else LANGUAGES
        options = Options(comma(args.lang), args.max_size, comma(args.skip_dirs), False if args.full else None, languages)
        print(scan(spark, check_root(args.root, not args.no_temp), args.state, options))
    elif args.command == "query":
        mode, _, param = args.mode.partition("=")
        answer = ask(Scanned(spark, args.state), mode, param)
        print(json.dumps(to_json(answer), indent=2, ensure_ascii=False) if args.format == "json" else text_table(answer.columns, to_json(answer)))
    elif args.command == "graph":
        relations = Scanned(spark, args.state)
        print(graph_report(relations.functions, relations.deps))
    else:
        relations = Scanned(spark, args.state)
        for line in sys.stdin:
            if line.strip() and (answer := call(relations, json.loads(line))) is not None:
                print(json.dumps(answer, ensure_ascii=False), flush=True)


if __name__ == "__main__":
    main()
