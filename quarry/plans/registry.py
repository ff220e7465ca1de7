"""The engine's named queries over the driver's tables, each with the SQL that DuckDB runs to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.functions.hashing import function_hash, variable_hash
from quarry.functions.lex import CONTROL
from quarry.operators import graph as G
from quarry.operators import queries as Q
from quarry.operators import state as K
from quarry.plans import planted as P
from quarry.plans.adapters import Relations, oracle
from quarry.sources import files as S
from quarry.sources.languages import LANGUAGES, Language, registered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LANGUAGE, SESSION = "brand#13", 2


def add(name: str, run: Callable[[Relations], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Relations(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = sql


COLUMNS = "id, name, package_name, language, file_path, line_start, line_end, line_end - line_start + 1 as line_count, nesting_depth, call_count, cyclomatic, parameter_count, return_count, statement_count, anonymous_funcs, is_method, visibility"
TIES = "file_path, line_start, id"
QUALIFIED = "case when package_name <> '' then package_name || '.' || name else name end"
STATS = """select n.name, coalesce(a.c, 0) as caller_count, coalesce(b.c, 0) as callee_count, n.total_call_count
 from (select name, max(call_count) as total_call_count from functions group by name) n
 left join (select callee_name as name, count(distinct caller_id) as c from function_deps group by callee_name) a on a.name = n.name
 left join (select f.name, count(distinct d.callee_name) as c from functions f join function_deps d on d.caller_id = f.id group by f.name) b on b.name = n.name"""
NODES = f"select session_id, id, name, package_name, {QUALIFIED} as qualified from functions"
HITS = """select e.session_id, e.caller_id, e.callee_name, n.id as callee_id, 0 as strategy from edges e join nodes n on n.session_id = e.session_id and n.qualified = e.callee_name where strpos(e.callee_name, '.') > 0
 union all select e.session_id, e.caller_id, e.callee_name, n.id, 1 from edges e join nodes n on n.session_id = e.session_id and n.qualified = e.package_name || '.' || e.callee_name where e.package_name <> ''
 union all select e.session_id, e.caller_id, e.callee_name, n.id, 3 from edges e join (select session_id, name, min(id) as id from nodes group by session_id, name having count(*) = 1) n on n.session_id = e.session_id and n.name = e.callee_name"""
EDGES = "select n.session_id, d.caller_id, d.callee_name, n.package_name from function_deps d join nodes n on n.id = d.caller_id"
RESOLVED = "select session_id, caller_id, callee_name, callee_id, strategy from (select *, min(strategy) over (partition by session_id, caller_id, callee_name) as least from hits) where strategy = least"


def graph_oracle(body: str) -> str:
    return oracle(body, nodes=NODES, edges=EDGES, hits=HITS, resolved=RESOLVED)


METRICS = """select session_id, file_path, language, max(line_end) as total_lines, count(*) as func_count, avg(cyclomatic) as avg_cyclomatic, max(cyclomatic) as max_cyclomatic,
 cast(sum(parameter_count) as bigint) as total_parameters, max(parameter_count) as max_parameters, cast(sum(return_count) as bigint) as total_returns, cast(sum(statement_count) as bigint) as total_statements,
 cast(sum(anonymous_funcs) as bigint) as total_anon_funcs, count(*) filter (where visibility = 'public') as public_funcs, count(*) filter (where visibility <> 'public') as private_funcs,
 count(*) filter (where is_method = 1) as methods_count from functions group by session_id, file_path, language"""


def some_names(r: Relations, n: int = 3) -> list[str]:
    """Names to ask for: the first by id, as a user would type them."""
    return [x.name for x in r.functions.filter(F.col("id") <= n).orderBy("id").select("name").collect()]


def first_name(r: Relations) -> str:
    return r.functions.filter("id = 1").select("name").first()[0]


def with_lines(functions: DataFrame) -> DataFrame:
    """Functions with a body of as many lines as they have."""
    line = F.transform(F.sequence(F.lit(1), (F.col("line_end") - F.col("line_start") + 1).cast("int")), lambda i: F.concat(F.col("body"), F.lit(" "), i.cast("string")))
    return functions.withColumn("body", F.array_join(line, "\n"))


def dead(r: Relations) -> DataFrame:
    """Orphans of the latest session, each with its tag."""
    return G.orphan_tags(r.functions.join(F.broadcast(r.functions.agg(F.max("session_id").alias("session_id"))), "session_id"), r.deps)  # one row


FIRST = "(select name from functions where id = 1)"
SOME = "(select name from functions where id <= 3)"



def summary(r: Relations) -> DataFrame:
    """The summary, its maps as text."""
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    rows = Q.summary(r.functions, r.deps, r.globals, r.sessions)
    return rows.select(*(shown(c) if c.endswith("lang_dist") else c for c in rows.columns))


add("q1_summary", summary, oracle(
    "select (select string_agg(language || '=' || cast(n as varchar), ',' order by language) from (select language, count(*) as n from functions group by language)) as lang_dist, (select string_agg(language || '=' || cast(n as varchar), ',' order by language) from (select language, count(*) as n from global_vars group by language)) as var_lang_dist, (select count(*) from scan_sessions) as sessions, (select max(id) from scan_sessions) as latest_session, (select count(*) from functions) as functions, (select cast(sum(line_end - line_start + 1) as bigint) from functions) as total_lines, (select count(*) from global_vars) as variables, (select count(*) from function_deps) as edges"))
add("q1_function_languages", lambda r: Q.language_distribution(r.functions), oracle("select language, count(*) as n from functions group by language"))
add("q1_variable_languages", lambda r: Q.language_distribution(r.globals), oracle("select language, count(*) as n from global_vars group by language"))
add("q2_functions", lambda r: Q.all_functions(r.functions), oracle(f"select {COLUMNS} from functions"))
add("q3_functions_by_language", lambda r: Q.functions_by_language(r.functions, LANGUAGE), oracle(f"select id, name, package_name, language, file_path, line_start, line_end, body, call_count, nesting_depth, visibility from functions where language = '{LANGUAGE}'"))
add("q4_function_detail", lambda r: Q.function_detail(r.functions, some_names(r)), oracle(f"select cast(p.position as integer) as position, {COLUMNS} from functions join (select name as wanted, row_number() over (order by min(id)) as position from functions where name in {SOME} and id <= 3 group by name) p on p.wanted = name"))
add("q5_function_body", lambda r: Q.function_body(r.functions, 42), oracle("select id, body from functions where id = 42"))
add("q5_function_body_by_name", lambda r: Q.function_body_by_name(r.functions, first_name(r)), oracle(f"select name, body from functions where name = {FIRST} order by {TIES} limit 1"))
add("q6_variables", lambda r: Q.variables(r.globals), oracle("select id, name, var_type, language, file_path, line_num, is_const from global_vars"))
add("q7_variables_by_language", lambda r: Q.variables_by_language(r.globals, "lang2"), oracle("select id, name, var_type, language, file_path, line_num, is_const from global_vars where language = 'lang2'"))
add("q8_dependency_stats", lambda r: Q.dependency_stats(r.functions, r.deps), oracle(STATS))
add("q8t_most_called", lambda r: Q.most_called(r.functions, r.deps), oracle("select * from stats where caller_count > 0 order by caller_count desc, name limit 10", stats=STATS))
add("q8t_never_called", lambda r: Q.never_called_count(r.functions, r.deps), oracle("select count(*) filter (where caller_count = 0) as never_called from stats", stats=STATS))
add("q8t_widest", lambda r: Q.widest(r.functions, r.deps), oracle("select * from stats where callee_count > 0 order by callee_count desc, name limit 5", stats=STATS))
add("q9_callers", lambda r: Q.callers(r.functions, r.deps, "ext.F3"), oracle(f"select {COLUMNS} from functions join function_deps on caller_id = id where callee_name = 'ext.F3'"))
add("q10_callees", lambda r: Q.callees(r.deps, 7), oracle("select caller_id, callee_name from function_deps where caller_id = 7"))
add("q11_session_edges", lambda r: Q.session_edges(r.functions, r.deps, SESSION), oracle(f"select caller_id, string_agg(callee_name, ',' order by callee_name) as callees, count(*) as n from function_deps join functions on id = caller_id where session_id = {SESSION} group by caller_id"))
add("q12_unreferenced", lambda r: Q.unreferenced(r.functions, r.deps), oracle(f"select {COLUMNS} from functions where name not in (select callee_name from function_deps)"))
add("q13_missing", lambda r: Q.missing(r.functions, r.deps), oracle("select distinct callee_name from function_deps d where not exists (select 1 from functions f where f.name = d.callee_name)"))
add("q13t_missing_in_project", lambda r: Q.missing_in_project(r.functions, r.deps, Q.KNOWN_CALLS), oracle(
    "select distinct callee_name from function_deps d where not exists (select 1 from functions f where f.name = d.callee_name) and not exists (select 1 from (select unnest(string_split('" + " ".join(Q.STD_PREFIXES) + "', ' ')) as p) where starts_with(callee_name, p) and length(callee_name) > length(p)) and callee_name not in (select unnest(string_split('" + " ".join(Q.KNOWN_CALLS) + "', ' ')))"))
add("q14_top", lambda r: Q.longest(r.functions), oracle(f"select {COLUMNS} from functions order by line_count desc, {TIES} limit 10"))
add("q15_deep", lambda r: Q.deeply_nested(r.functions), oracle(f"select {COLUMNS} from functions where nesting_depth >= 3"))
add("q16_complexity", lambda r: Q.most_complex(r.functions), oracle(f"select {COLUMNS} from functions where cyclomatic > 0 order by cyclomatic desc, line_count desc, {TIES} limit 10"))
add("q17_params", lambda r: Q.many_parameters(r.functions), oracle(f"select {COLUMNS} from functions where parameter_count >= 5"))
add("q18_anonymous", lambda r: Q.with_anonymous(r.functions), oracle(f"select {COLUMNS} from functions where anonymous_funcs > 0"))
add("q19_file_metrics", lambda r: Q.files_by_size(r.functions), oracle(METRICS))
add("q20_types", lambda r: Q.type_definitions(r.types), oracle("select name, kind, language, file_path, line_start, line_end from type_defs"))
add("q21_types_by_kind", lambda r: Q.type_definitions(r.types, "machinery"), oracle("select name, kind, language, file_path, line_start, line_end from type_defs where kind = 'machinery'"))
add("q24_distinct_by_language", lambda r: Q.distinct_by_language(r.functions, r.globals), oracle(
    "select 'functions' as relation, language, count(distinct (file_path, name, line_start)) as n from functions group by language union all select 'variables', language, count(distinct (file_path, name, line_num)) from global_vars group by language"))
add("q25_distinct_totals", lambda r: Q.distinct_totals(r.functions, r.globals), oracle("select (select count(*) from (select distinct file_path, name, line_start from functions)) as functions, (select count(*) from (select distinct file_path, name, line_num from global_vars)) as variables"))
add("q26_session_totals", lambda r: Q.session_totals(r.sessions), oracle("select count(*) as sessions, max(id) as latest_session from scan_sessions"))
add("q27_latest_session", lambda r: Q.latest_session(r.sessions), oracle("select id, project_root, duration_ms, file_count, func_count, var_count from scan_sessions order by id desc limit 1"))
add("q28_functions_of_session", lambda r: Q.functions_of_session(r.functions, SESSION), oracle(f"select {COLUMNS} from functions where session_id = {SESSION}"))
add("q29_listing_by_file", lambda r: Q.listing_by_file(r.functions), oracle("select file_path, string_agg(name || ':' || cast(line_start as varchar), ',' order by line_start, id) as listing, count(*) as n from functions group by file_path"))
add("q30_function_report", lambda r: Q.function_report(with_lines(r.functions), r.deps, some_names(r)), oracle(
    f"select f.id, f.name, array_to_string(list_transform(range(1, least(20, line_end - line_start + 1) + 1), lambda i: f.body || ' ' || cast(i as varchar)), chr(10)) as preview, coalesce((select string_agg(callee_name, ',' order by callee_name) from function_deps where caller_id = f.id), '') as callees, coalesce((select string_agg(g.name, ',' order by g.name) from function_deps d join functions g on g.id = d.caller_id where d.callee_name = f.name), '') as callers from functions f where f.name in {SOME}"))
add("g1_resolved_edges", lambda r: G.resolved_edges(r.functions, r.deps), graph_oracle("select * from resolved"))
add("g2_orphans", lambda r: G.orphans(r.functions, r.deps), graph_oracle(f"select {COLUMNS} from functions where id not in (select callee_id from resolved)"))
add("g3_hot", lambda r: G.hot(r.functions, r.deps), graph_oracle(f"select f.id, f.name, f.file_path, f.line_start, count(r.callee_id) as callers from functions f left join resolved r on r.callee_id = f.id group by f.id, f.name, f.file_path, f.line_start order by callers desc, {TIES} limit 10"))
add("g4_orphan_tags", lambda r: G.orphan_tags(r.functions, r.deps), graph_oracle(
    "select f.id, f.name, f.file_path, case when ends_with(file_path, '_test.go') then 'test' when contains(file_path, '/testdata') then 'fixture' when name = 'init' then 'runtime' when name = 'main' and package_name = 'main' then 'entry' when name in (select callee_name from function_deps) then 'cgap' else 'dead' end as tag from functions f where id not in (select callee_id from resolved)"))
add("q23_dead", dead, graph_oracle(
    "select f.id, f.name, f.file_path, case when ends_with(file_path, '_test.go') then 'test' when contains(file_path, '/testdata') then 'fixture' when name = 'init' then 'runtime' when name = 'main' and package_name = 'main' then 'entry' when name in (select callee_name from function_deps) then 'cgap' else 'dead' end as tag from functions f where session_id = (select max(session_id) from functions) and id not in (select callee_id from resolved)"))
add("g5_call_tree", lambda r: G.call_tree(r.functions, r.deps, first_name(r)), oracle(
    "select w.name, w.depth, f.id is not null as known, f.id, coalesce((select string_agg(distinct callee_name, ',' order by callee_name) from function_deps where caller_id = f.id), '') as callees from (select name, min(depth) as depth from walk group by name) w left join first f on f.name = w.name",
    first="select name, id from (select name, id, row_number() over (partition by name order by file_path, line_start, id) as k from functions) where k = 1",
    walk=f"select name, depth from (with recursive t(name, depth) using key (name) as (select {FIRST} as name, 0 as depth union select d.callee_name, min(t.depth + 1) from t join first f on f.name = t.name join function_deps d on d.caller_id = f.id where d.callee_name not in (select name from recurring.t) group by d.callee_name) select name, depth from t)"))
add("g7_graph_statistics", lambda r: G.statistics(r.functions), oracle(
    f"select count(*) as nodes, cast(sum(call_count) as bigint) as total_calls, round(avg(nesting_depth), 6) as avg_nesting, max(nesting_depth) as max_nesting from (select *, row_number() over (partition by {QUALIFIED} order by {TIES}) as k from functions) where k = 1"))
add("a2_most_calling", lambda r: G.most_calling(r.functions), oracle(f"select {COLUMNS} from functions order by call_count desc, {TIES} limit 10"))


# Text functions and sources over documents, pages and file paths


def lexed(r: Relations) -> DataFrame:
    """Pages outside strings and comments: calls, distinct callees, depth of parentheses."""
    clean = r.table("pages").select("page_id", C.without_strings(F.col("html")).alias("clean"))
    calls = clean.select("page_id", "clean", C.lexed_calls(F.col("clean"), sorted(CONTROL)).alias("calls"))
    return calls.select("page_id", F.size("calls").cast("long").alias("call_count"), F.array_join(F.array_sort(F.array_distinct("calls")), ",").alias("callees"), C.paren_depth(F.col("clean")).alias("depth"))


OPAQUE = C.C_LIKE_OPAQUE.replace("'", "''")
_WORD = "[\\pL\\pN_]"
SQL_CALL = f"(?:({_WORD}+)\\.)?({_WORD}+)[ \\t\\r\\n\\f]*\\("
CLEAN = f"select page_id, regexp_replace(html, '{OPAQUE}', ' ', 'g') as clean from pages"
DEPTH = """select page_id, cast(coalesce(max(total - least(0, low)), 0) as integer) as depth from (
 select page_id, total, min(total) over (partition by page_id order by k rows unbounded preceding) as low from (
 select page_id, k, sum(case c when '(' then 1 else -1 end) over (partition by page_id order by k rows unbounded preceding) as total from (
 select page_id, unnest(string_split(marks, '')) as c, generate_subscripts(string_split(marks, ''), 1) as k from (select page_id, regexp_replace({text}, '[^()]', '', 'g') as marks from {pages})) where c <> '')) group by page_id"""
LEXED = f"""with clean as ({CLEAN}), depths as ({DEPTH.format(text="clean", pages="clean")}), calls as (
 select page_id, list_transform(list_filter(list_zip(regexp_extract_all(clean, '{SQL_CALL}', 1), regexp_extract_all(clean, '{SQL_CALL}', 2)), lambda x: length(x[2]) > 1 and (x[1] <> '' or not list_contains(string_split('{" ".join(sorted(CONTROL))}', ' '), x[2]))), lambda x: x[2]) as calls from clean)
select page_id, cast(len(calls) as bigint) as call_count, array_to_string(list_sort(list_distinct(calls)), ',') as callees, coalesce(depth, 0) as depth from calls left join depths using (page_id)"""


def decoded(r: Relations) -> DataFrame:
    """Documents as raw bytes in several encodings through the decoder: encoding, characters and content hash."""
    import pandas as pd

    def run(frames):
        from quarry.functions.hashing import content_hash
        from quarry.sources.files import decode

        for frame in frames:
            rows = [decode(bytes(x or b"")) for x in frame.content]
            yield pd.DataFrame({"doc_id": frame.doc_id, "encoding": [k for _, k in rows], "n_chars": [len(t or "") for t, _ in rows], "content_hash": [content_hash(t or "") for t, _ in rows]})

    text, kind, number = F.col("text"), F.col("doc_id") % 9, F.col("doc_id").cast("string")
    utf16 = F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))
    content = F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(kind == 2, utf16).when(kind == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(kind == 4, F.concat(F.unhex(F.lit("0102030405060708")), F.encode(F.substring(text, 1, 8), "UTF-8")))
    bare, latin, zeros = F.concat(F.lit("package main "), number), F.concat(F.lit("café "), number), F.concat(F.unhex(F.lit("FF8000")), F.unhex(F.lit("0000")), F.encode(number, "UTF-8"))
    content = content.when(kind == 5, F.encode(bare, "UTF-16LE")).when(kind == 6, F.encode(bare, "UTF-16BE")).when(kind == 7, F.encode(latin, "ISO-8859-1")).when(kind == 8, zeros).otherwise(F.encode(text, "UTF-8"))
    return r.table("documents").select("doc_id", F.coalesce(content, F.lit(b"")).alias("content")).mapInPandas(run, "doc_id long, encoding string, n_chars long, content_hash string")


CONTROL_BYTES = "len(list_filter(regexp_extract_all(left(hex(encode({text})), 1024), '..'), lambda x: x < '20' and x not in ('09', '0A', '0D'))) > 0.3 * len(regexp_extract_all(left(hex(encode({text})), 1024), '..'))"
DECODED = """select doc_id, case when gone then 'binary' else encoding end as encoding, case when gone or t is null then 0 else length(t) end as n_chars, sha256(case when gone or t is null then '' else t end) as content_hash
 from (select *, kind = 8 and length(cast(doc_id as varchar)) <= 10 or coalesce({binary}, false) as gone from (select doc_id, kind, case when text is null and kind < 5 then 'utf-8' else list_extract(['utf-8', 'utf-8-bom', 'utf-16-le', 'utf-16-be', 'utf-8', 'utf-16-le', 'utf-16-be', 'unknown-non-utf8', 'binary'], cast(kind + 1 as integer)) end as encoding,
 case kind when 4 then chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || left(text, 8) when 5 then 'package main ' || doc_id when 6 then 'package main ' || doc_id when 7 then 'café ' || doc_id when 8 then '' else text end as t from (select doc_id, text, doc_id % 9 as kind from documents)))""".format(binary=CONTROL_BYTES.format(text="t"))


def value_shapes(r: Relations) -> DataFrame:
    """Go values of every shape that the rules tell apart, with the numbers and names of events in them."""
    word, number = F.col("event_type"), F.col("event_id").cast("string")
    made = [F.concat(F.lit('"'), word, F.lit('"')), F.concat(F.lit("`"), word, F.lit("`")), F.lit("'x'"), F.lit("true"), F.lit(" nil"), F.concat(F.lit("-"), number), F.concat(number, F.lit(".5e3")), F.concat(F.lit("0x"), number, F.lit("E")),
            F.concat(F.lit("&pkg."), word, F.lit("{1}")), F.concat(F.lit("[]"), word, F.lit("{}")), F.lit("func() int { return 1 }"), F.concat(F.lit("pkg."), word, F.lit("(1)")), F.concat(word, F.lit(" + 1")), F.col("props"), F.col("value").cast("string")]
    value = F.element_at(F.array(*made), (F.col("event_id") % len(made) + 1).cast("int"))

    def run(frames):
        import pandas as pd

        from quarry.functions.lex import infer_type

        for frame in frames:
            yield pd.DataFrame({"event_id": frame.event_id, "type": [infer_type(x or "") for x in frame.shape_], "type_of_field": [infer_type(x or "") for x in frame.field]})

    return r.table("events").select("event_id", value.alias("shape_"), F.get_json_object("props", "$.k").alias("field")).mapInPandas(run, "event_id long, type string, type_of_field string")


_SHAPES = "['\"' || event_type || '\"', '`' || event_type || '`', chr(39) || 'x' || chr(39), 'true', ' nil', '-' || event_id, event_id || '.5e3', '0x' || event_id || 'E', '&pkg.' || event_type || '{1}', '[]' || event_type || '{}', 'func() int { return 1 }', 'pkg.' || event_type || '(1)', event_type || ' + 1', props, 'x']"
_GO_TYPE = r"""case when regexp_matches(v, '^\s*["`]') then 'string' when regexp_matches(v, '^\s*' || chr(39)) then 'rune' when trim(v) in ('true', 'false') then 'bool' when trim(v) = 'nil' then 'untyped nil' when regexp_matches(v, '^\s*[-+]?[0-9]') then case when regexp_matches(v, '[.eE]') then 'float64' else 'int' end
 when regexp_matches(v, '^\s*&?[\w.\[\]*]+\s*\{') then regexp_extract(v, '^\s*&?([\w.\[\]*]+)\s*\{', 1) when regexp_matches(v, '^\s*func\b') then 'func' when regexp_matches(v, '^\s*[\w.]+\s*\(') then regexp_extract(v, '^\s*([\w.]+)\s*\(', 1) else '' end"""
VALUE_TYPES = f"select event_id, case when event_id % 15 = 14 and value is not null then 'float64' when event_id % 15 = 14 then '' else ({_GO_TYPE}) end as type, case when json_extract_string(props, '$.k') is null then '' else ({_GO_TYPE.replace('v,', 'k,').replace('trim(v)', 'trim(k)')}) end as type_of_field from (select *, list_extract({_SHAPES}, cast(event_id % 15 + 1 as integer)) as v, json_extract_string(props, '$.k') as k from events)"


def extracted(r: Relations) -> DataFrame:
    """A planted file for each part, the languages in turn, through the parser."""
    number = F.col("p_partkey").cast("string")
    at = (F.col("p_partkey") % len(P.FILES) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    path = F.concat(F.lit("planted/"), number, pick([ext for ext, _ in P.FILES.values()]))
    files = r.table("part").select(path.alias("rel_path"), pick(list(P.FILES)).alias("language"), F.lit(0).cast("long").alias("mtime"), F.replace(pick([t for _, t in P.FILES.values()]), F.lit("{k}"), number).cast("binary").alias("content"))
    return S.parse(files)


def found(r: Relations) -> DataFrame:
    return extracted(r).select(F.explode("functions").alias("f")).select("f.*")


def values(rows: list[tuple]) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


def planted(columns: str, names: str, rows: list[tuple]) -> str:
    """SQL over the planted rows (language first) of each part's file."""
    kinds = values([(i, x, ext) for i, (x, (ext, _)) in enumerate(P.FILES.items())])
    return f"select {columns} from (select p_partkey, cast(p_partkey as varchar) as k, 'planted/' || cast(p_partkey as varchar) || ext as file_path, language from part join (values {kinds}) kinds(kind, language, ext) on p_partkey % {len(P.FILES)} = kind) files join (values {values(rows)}) planted(language, {names}) using (language)"


add("x1_go_functions", lambda r: found(r).filter("language = 'go'").select("file_path", "name", "package_name", "parameters", "return_types", "receiver", "visibility", "cyclomatic", "parameter_count", "return_count", "statement_count", "anonymous_funcs", "nesting_depth"),
    planted("file_path, replace(name, '{k}', k) as name, replace(package_name, '{k}', k) as package_name, parameters, return_types, replace(receiver, '{k}', k) as receiver, visibility, cyclomatic, parameter_count, return_count, statement_count, anonymous_funcs, nesting_depth", "name, package_name, parameters, return_types, receiver, visibility, cyclomatic, parameter_count, return_count, statement_count, anonymous_funcs, nesting_depth", [("go", *row) for row in P.GO]))
add("x3_functions", lambda r: found(r).select("file_path", "language", "name", "line_start", "line_end", F.array_join("dependencies", ",").alias("callees")),
    planted("file_path, language, replace(name, '{k}', k) as name, line_start, line_end, replace(callees, '{k}', k) as callees", "name, line_start, line_end, callees", P.FUNCTIONS))
add("x4_variables", lambda r: extracted(r).select(F.explode("globals").alias("g")).select("g.file_path", "g.language", "g.name", "g.line_num", "g.is_const"),
    planted("file_path, language, replace(name, '{k}', k) as name, line_num, is_const", "name, line_num, is_const", P.VARIABLES))
add("x8_x9_callees", lambda r: found(r).select("file_path", F.explode("dependencies").alias("callee")).groupBy("file_path", "callee").agg(F.count("*").alias("n")),
    "select file_path, callee, count(*) as n from (" + planted("file_path, unnest(string_split(replace(callees, '{k}', k), ',')) as callee", "name, line_start, line_end, callees", P.FUNCTIONS) + ") where callee <> '' group by all")
add("x12_files_without_errors", lambda r: extracted(r).select("file_path", "encoding", F.size("functions").alias("functions"), F.size("globals").alias("globals"), F.coalesce("error", F.lit("")).alias("error")),
    planted("file_path, 'utf-8' as encoding, functions, globals, '' as error", "functions, globals", [(x, sum(f[0] == x for f in P.FUNCTIONS), sum(v[0] == x for v in P.VARIABLES)) for x in P.FILES]))


def file_rows(r: Relations) -> DataFrame:
    """A file listing made from part: paths of several folders and extensions, with sizes and times."""
    ext = F.element_at(F.array(*map(F.lit, [".go", ".py", ".JS", ".txt", ".erb", ".rs"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ["src", "vendor/x", "a/.hidden", "lib/build", "pkg/p%20", "deep/er"])), (F.col("p_partkey") % 7 % 6 + 1).cast("int"))
    return r.table("part").select(F.concat(folder, F.lit("/f"), F.col("p_partkey").cast("string"), ext).alias("rel_path"), (F.col("p_partkey") * 700).alias("length"), (F.col("p_partkey") % 50).alias("mtime"))


FILES = "select list_extract(['src', 'vendor/x', 'a/.hidden', 'lib/build', 'pkg/p%20', 'deep/er'], cast(p_partkey % 7 % 6 + 1 as integer)) || '/f' || cast(p_partkey as varchar) || list_extract(['.go', '.py', '.JS', '.txt', '.erb', '.rs'], cast(p_partkey % 6 + 1 as integer)) as rel_path, p_partkey * 700 as length, p_partkey % 50 as mtime from part"
KEPT = "not regexp_matches(rel_path, '(^|/)(vendor|build)/') and not regexp_matches(rel_path, '(^|/)[.][^/]*/') and not regexp_matches(rel_path, '%[^/]*/')"
LANG = "case when ends_with(rel_path, '.go') then 'go' when ends_with(rel_path, '.py') then 'python' when ends_with(rel_path, '.JS') then 'javascript' when ends_with(rel_path, '.erb') then 'erb' when ends_with(rel_path, '.rs') then 'rust' end"
OLD = "select file_path, name, line_start, body || cast(call_count as varchar) as hash from functions where id % 5 <> 0"
NEW = "select file_path, name, line_start, case when id % 7 = 0 then 'x' else body || cast(call_count as varchar) end as hash from functions where id % 3 <> 0"


def old_and_new(r: Relations) -> tuple[DataFrame, DataFrame]:
    """Two scans' functions, one row a key: some gone, some new, some changed."""
    digest = F.concat("body", F.col("call_count").cast("string"))
    key = K.FUNCTION_KEY
    old = r.functions.filter("id % 5 <> 0").select(*key, digest.alias("hash")).groupBy(*key).agg(F.min("hash").alias("hash"))
    new = r.functions.filter("id % 3 <> 0").select(*key, F.when(F.col("id") % 7 == 0, "x").otherwise(digest).alias("hash")).groupBy(*key).agg(F.min("hash").alias("hash"))
    return old, new


def old_and_new_variables(r: Relations) -> tuple[DataFrame, DataFrame]:
    key = K.VARIABLE_KEY
    old = r.globals.filter("id % 4 <> 0").groupBy(*key).agg(F.min("var_type").alias("hash"))
    new = r.globals.filter("id % 3 <> 0").groupBy(*key).agg(F.max("var_type").alias("hash"))
    return old, new


def split_by_cache(r: Relations) -> DataFrame:
    """Every file by path and content hash, with what the cache holds for it: a third is there, another third by another hash."""
    files = file_rows(r).select(F.col("rel_path").alias("file_path"), F.col("mtime").cast("string").alias("content_hash"), "length")
    held = files.filter("length % 3 < 2").select("file_path", F.when(F.col("length") % 3 == 0, F.col("content_hash")).otherwise("older").alias("content_hash"), F.col("length").alias("cached_length"))
    hits, misses = K.split_by_cache(files.drop("length"), held)
    return hits.unionByName(misses.withColumn("cached_length", F.lit(None).cast("long")))


UPSERT = "select file_path, name, {line}, case when o.file_path is null then 'new' when n.file_path is null then 'gone' when o.hash = n.hash then 'unchanged' else 'changed' end as status from o full join n using (file_path, name, {line})"
add("f7_indent", lambda r: r.table("pages").select("page_id", F.explode(C.lines(F.col("html"))).alias("line")).select("page_id", C.indent(F.col("line")).alias("indent")).groupBy("page_id").agg(F.sum("indent").alias("indent"), F.count("*").alias("n_lines")),
    "select page_id, cast(sum(length(replace(regexp_extract(line, '^[ \\t]*'), chr(9), '    '))) as bigint) as indent, count(*) as n_lines from (select page_id, unnest(string_split(html, chr(10))) as line from pages) group by page_id")
add("f8_line_count", lambda r: r.table("documents").select("doc_id", F.size(C.lines(F.col("text"))).alias("n_lines")), "select doc_id, len(string_split(text, chr(10))) as n_lines from documents")
add("f11_visibility", lambda r: r.globals.select("id", C.variable_visibility(F.col("name")).alias("as_variable"), C.function_visibility(F.col("name")).alias("as_function")), oracle("select id, case when regexp_matches(name, '^[A-Z]') then 'public' else 'private' end as as_variable, case when regexp_matches(name, '^[a-z]') then 'private' else 'public' end as as_function from global_vars"))
add("f9_all_upper", lambda r: r.globals.select("id", C.is_upper(F.col("name")).alias("all_upper")), oracle("select id, upper(name) = name and name <> '' as all_upper from global_vars"))
add("f13_value_type", value_shapes, VALUE_TYPES)
add("f19_paren_depth", lambda r: r.table("pages").select("page_id", C.paren_depth(F.col("html")).alias("depth")), "select page_id, coalesce(depth, 0) as depth from pages left join (" + DEPTH.format(text="html", pages="pages") + ") using (page_id)")
add("f24_qualified_name", lambda r: r.functions.select("id", G.qualified(F.col("package_name"), F.col("name")).alias("qualified")), oracle(f"select id, {QUALIFIED} as qualified from functions"))
for n in (20, 50):
    add(f"f28_preview_{n}", lambda r, n=n: r.table("documents").select("doc_id", C.preview(F.col("text"), n).alias("preview")), f"select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, {n}), chr(10)) as preview from documents")
add("x10_calls", lambda r: r.table("pages").select("page_id", F.explode(C.calls(F.col("html"))).alias("c")).groupBy("page_id", F.col("c.name").alias("name")).agg(F.count("*").alias("n")),
    "select page_id, name, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '(?:(\\w+)\\.)?(\\w+)\\s*\\(', 2)) as name from pages) where length(name) > 1 group by page_id, name")
add("x10_lexed_calls", lexed, LEXED)
add("s2_kept_dirs", lambda r: file_rows(r).filter(S.kept_dirs(F.col("rel_path"))), f"select * from ({FILES}) where {KEPT}")
add("s4_s6_source_files", lambda r: S.source_files(file_rows(r), only=["go", "py"]), f"select * from (select *, {LANG} as language from ({FILES})) where {KEPT} and length <= 1048576 and language in ('go', 'python', 'erb')")
add("s5_language", lambda r: file_rows(r).select("rel_path", C.extension(F.col("rel_path")).alias("ext")), f"select rel_path, lower(regexp_extract(rel_path, '([.][^./]+)$', 1)) as ext from ({FILES})")
add("s8_changed_files", lambda r: S.changed_since(file_rows(r), file_rows(r).filter("length % 3 = 0").select(F.col("rel_path").alias("file_path"), (F.col("mtime") + F.when(F.col("mtime") > 40, 1).otherwise(0)).alias("mtime"))).select("rel_path", "length", "mtime"), f"select rel_path, length, mtime from ({FILES}) where not (length % 3 = 0 and mtime <= 40)")
add("s13_s18_decoded", decoded, DECODED)
add("s17_control_share", lambda r: r.table("documents").select("doc_id", (C.control_share(F.col("text")) > 0.3).alias("is_binary")), "select doc_id, " + CONTROL_BYTES.format(text="text") + " as is_binary from documents")
add("s19_parse_cache", split_by_cache, f"select rel_path as file_path, cast(mtime as varchar) as content_hash, case when length % 3 = 0 then length end as cached_length from ({FILES})")
add("s22_languages", lambda r: r.spark.createDataFrame([(x.name, e, x.body) for x in LANGUAGES for e in x.extensions], "name string, extension string, body string"),
    "select name, unnest(string_split(extensions, ' ')) as extension, body from (values ('go', '.go', 'brace'), ('python', '.py', 'indent'), ('java', '.java', 'brace'), ('kotlin', '.kt .kts', 'brace'), ('javascript', '.js .jsx .mjs', 'brace'), ('typescript', '.ts .tsx', 'brace'), ('csharp', '.cs', 'brace'), ('cpp', '.cpp .cxx .cc .c .h .hpp', 'brace'), ('rust', '.rs', 'brace'), ('ruby', '.rb', 'end'), ('swift', '.swift', 'brace'), ('php', '.php', 'brace'), ('lua', '.lua', 'end'), ('scala', '.scala', 'brace'), ('erb', '.erb', 'end')) t(name, extensions, body)")
add("k2_function_upsert", lambda r: K.upsert_status(*old_and_new(r), K.FUNCTION_KEY), oracle(UPSERT.format(line="line_start"), o=f"select file_path, name, line_start, min(hash) as hash from ({OLD}) group by all", n=f"select file_path, name, line_start, min(hash) as hash from ({NEW}) group by all"))
add("k2_next_snapshot", lambda r: K.upserted(*old_and_new(r), K.FUNCTION_KEY), oracle("select * from n union all select o.* from o anti join n using (file_path, name, line_start)", o=f"select file_path, name, line_start, min(hash) as hash from ({OLD}) group by all", n=f"select file_path, name, line_start, min(hash) as hash from ({NEW}) group by all"))
add("k3_edges", lambda r: r.deps.groupBy("caller_id").agg(F.collect_list("callee_name").alias("dependencies")).select(F.col("caller_id").alias("id"), "dependencies").transform(S.edges_of), oracle("select distinct caller_id, callee_name from function_deps"))
add("k4_variable_upsert", lambda r: K.upsert_status(*old_and_new_variables(r), K.VARIABLE_KEY), oracle(UPSERT.format(line="line_num"), o="select file_path, name, line_num, min(var_type) as hash from global_vars where id % 4 <> 0 group by all", n="select file_path, name, line_num, max(var_type) as hash from global_vars where id % 3 <> 0 group by all"))
add("k5_latest_per_key", lambda r: K.latest_by_key(r.table("events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type"), "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
add("k7_file_metrics", lambda r: Q.file_metrics(K.current_functions(r.functions)), oracle(METRICS.replace("from functions", "from current"), current="select f.* from functions f join (select file_path, max(session_id) as session_id from functions group by file_path) using (file_path, session_id)"))
add("k9_retained_sessions", lambda r: K.retained(r.sessions).select("id"), oracle("select id from scan_sessions order by id desc limit 3"))
add("k9_repointed", lambda r: K.repointed(r.functions.select("id", "session_id"), r.functions.select(F.col("session_id").alias("id")).distinct(), 2), oracle("select id, case when session_id >= 2 then session_id else 3 end as session_id from functions"))


# Text functions in Python, over whole tables


def blanked(r: Relations) -> DataFrame:
    """The hash of each page without strings, comments and white space, by the scanner that extraction uses."""
    import pandas as pd

    def run(frames):
        import re

        from quarry.functions.hashing import content_hash
        from quarry.functions.lex import Syntax, blank

        for frame in frames:
            yield pd.DataFrame({"page_id": frame.page_id, "code": [content_hash(re.sub(r"[ \t\r\n\f]", "", blank(x or "", Syntax()))) for x in frame.html]})

    return r.table("pages").select("page_id", "html").mapInPandas(run, "page_id long, code string")


def hashed(r: Relations) -> DataFrame:
    """The hashes of functions and variables by their fields."""
    import pandas as pd

    def run(make):
        def rows(frames):
            for frame in frames:
                yield pd.DataFrame({"id": frame["id"], "hash": [make(x) for x in frame.to_dict("records")]})

        return rows

    f = r.functions.mapInPandas(run(function_hash), "id long, hash string").withColumn("relation", F.lit("functions"))
    return f.unionByName(r.globals.mapInPandas(run(variable_hash), "id long, hash string").withColumn("relation", F.lit("variables")))


def toy_functions(r: Relations) -> DataFrame:
    """Functions of a configured language, which no built-in one reads, by its pattern; names of one character are no calls there."""
    toy = Language("toy", (".toy", ".go"), r"proc (?P<name>\w+)\(", single_comment=("#",), built_in=False)
    number = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("proc run"), number, F.lit("() {\n  x(y"), number, F.lit("(1));\n}\n// proc no() {}\n"))
    files = r.table("part").select(F.concat(F.lit("toy/"), number, F.element_at(F.array(F.lit(".toy"), F.lit(".go")), (F.col("p_partkey") % 2 + 1).cast("int"))).alias("rel_path"), F.lit(100).alias("length"), F.lit(0).cast("long").alias("mtime"), text.cast("binary").alias("content"))
    languages = registered((toy,))
    return S.parse(S.source_files(files, languages), languages).select("file_path", "language", F.explode("functions").alias("f")).select("file_path", "language", "f.name", "f.line_start", "f.line_end", F.array_join("f.dependencies", ",").alias("callees"))


def links(r: Relations) -> DataFrame:
    return file_rows(r).select(F.col("rel_path").alias("path"), F.when(F.col("mtime") > 0, F.concat(F.lit("8:"), F.col("mtime").cast("string"))).alias("inode"))


_ALIASES = ["PY", "js", "Go", "kt", "cs", "rs", "rb", "cpp", "ts", "None"]
FUNCTION_TEXT = "name || package_name || language || file_path || line_start || body || call_count || nesting_depth || is_method || visibility || cyclomatic || parameter_count || return_count || statement_count || anonymous_funcs"
VARIABLE_TEXT = "name || var_type || language || file_path || line_num || is_const"
add("f1_f6_blanked", blanked, f"select page_id, sha256(regexp_replace(clean, '[ \\t\\r\\n\\f]', '', 'g')) as code from ({CLEAN})")
add("f14_root_node", lambda r: r.spark.createDataFrame([(x.name, x.root_node()) for x in LANGUAGES], "name string, root string"),
    "select * from (values ('go', 'source_file'), ('python', 'module'), ('java', 'program'), ('kotlin', 'source_file'), ('javascript', 'program'), ('typescript', 'program'), ('csharp', 'compilation_unit'), ('cpp', 'translation_unit'), ('rust', 'source_file'), ('ruby', 'program'), ('swift', 'source_file'), ('php', 'program'), ('lua', 'program'), ('scala', 'source_file'), ('erb', 'source_file')) t(name, root)")
add("f22_f23_hashes", hashed, oracle(f"select id, left(sha256({FUNCTION_TEXT}), 32) as hash, 'functions' as relation from functions union all select id, left(sha256({VARIABLE_TEXT}), 32), 'variables' from global_vars"))
add("f29_relative_path", lambda r: file_rows(r).select("rel_path", S.relative(F.concat(F.lit("file:///base/code/"), "rel_path"), "/base/code").alias("relative"), S.relative(F.replace(F.concat(F.lit("C:\\base\\code\\"), "rel_path"), F.lit("/"), F.lit("\\")), "C:\\base\\code").alias("from_windows")), f"select rel_path, rel_path as relative, rel_path as from_windows from ({FILES})")
add("f30_language_alias", lambda r: r.table("part").select("p_partkey", C.language_name(F.element_at(F.array(*map(F.lit, _ALIASES)), (F.col("p_partkey") % 10 + 1).cast("int"))).alias("language")), "select p_partkey, list_extract(['python', 'javascript', 'go', 'kotlin', 'csharp', 'rust', 'ruby', 'cpp', 'typescript', 'none'], cast(p_partkey % 10 + 1 as integer)) as language from part")
add("s3_skip_dirs", lambda r: S.source_files(file_rows(r), skip_dirs=[" er ", ""]).select("rel_path", "language"), f"select rel_path, language from (select *, {LANG} as language from ({FILES})) where {KEPT} and length <= 1048576 and language is not null and not regexp_matches(rel_path, '(^|/)er/')")
add("s7_repeated_links", lambda r: S.repeated_links(links(r)), f"select rel_path as path from (select rel_path, min(rel_path) over (partition by mtime) as first from ({FILES}) where mtime > 0) where rel_path <> first")
add("k8_next_session", lambda r: r.spark.range(1).select(F.lit(K.new_session(r.spark, r.sessions, "root")).cast("long").alias("session")), oracle("select max(id) + 1 as session from scan_sessions"))
add("x5_regex_functions", toy_functions, "select 'toy/' || cast(p_partkey as varchar) || '.toy' as file_path, 'toy' as language, 'run' || cast(p_partkey as varchar) as name, 1 as line_start, 3 as line_end, 'y' || cast(p_partkey as varchar) as callees from part where p_partkey % 2 = 0")
