"""The fixed questions over a scanned code base, as lazy DataFrames.

Functions take the relations they read. Where an order or a limit is part of the answer, ties go by
file_path, line_start and id, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schemas import BRIEF

TIES = ["file_path", "line_start", "id"]

#: Package prefixes and call names taken for standard library calls in the missing report.
STD_PREFIXES = [
    "fmt.", "os.", "strings.", "bytes.", "time.", "sync.", "sort.", "regexp.", "flag.", "strconv.", "io.", "math.", "path.", "filepath.", "unicode.", "encoding.", "database/",
    "context.", "hash.", "log.", "net.", "http.", "crypto.", "json.", "xml.", "bufio.", "embed.", "errors.", "reflect.", "runtime.", "syscall.", "testing.",
]

KNOWN_CALLS = [
    "Print", "Printf", "Println", "Fprintf", "Sprintf", "Sscanf", "Sprint", "Sprintln", "Errorf", "Fprint", "Fprintln", "Open", "Read", "Write", "Close", "Stat", "ReadFile",
    "WriteFile", "ReadDir", "Mkdir", "MkdirAll", "Remove", "RemoveAll", "Rename", "Chdir", "Chmod", "Getwd", "TempDir", "Executable", "Exit", "IsNotExist", "IsExist", "SameFile",
    "Stdin", "Stdout", "Stderr", "Split", "Join", "Contains", "HasPrefix", "HasSuffix", "Replace", "ReplaceAll", "Trim", "TrimSpace", "TrimRight", "TrimLeft", "TrimPrefix",
    "ToLower", "ToUpper", "Index", "IndexByte", "LastIndex", "Count", "Atoi", "Itoa", "ParseInt", "ParseFloat", "FormatInt", "ParseBool", "NewBuffer", "NewReader", "Buffer",
    "Bytes", "Grow", "WriteByte", "WriteString", "Sleep", "Since", "Now", "Duration", "Second", "Millisecond", "Wait", "Add", "Done", "NewWaitGroup", "Lock", "Unlock", "RWMutex",
    "Mutex", "Once", "Pool", "Slice", "Strings", "Float64s", "Search", "SearchStrings", "MustCompile", "Compile", "FindAllStringSubmatch", "FindStringSubmatchIndex", "StringVar",
    "BoolVar", "Int64Var", "IntVar", "Arg", "NArg", "Parse", "Append", "Cap", "Len", "Make", "New", "Copy", "Delete", "Error", "Err", "NewError", "QueryRow", "Query", "Exec",
    "Prepare", "Scan", "Rows", "Stmt", "Tx", "Valid", "IsLetter", "IsUpper", "IsDigit", "IsSpace", "NewScanner", "NewDelimiter", "NewEncoder", "NewDecoder", "Marshal",
    "Unmarshal", "MarshalIndent", "New128a", "New128", "New64", "New64a", "Sum", "Fatal", "Fatalf", "Logf", "Log", "Fail", "FailNow", "Run", "Helper", "Short", "Background",
    "TODO", "WithCancel", "WithTimeout", "WithDeadline", "Listen", "Dial", "Accept", "Handler", "HandleFunc", "Serve", "Rel", "Dir", "Base", "Ext", "Abs", "ToSlash", "WalkDir",
    "SetErrorLogger", "NewQuery", "NewQueryCursor", "NextMatch", "CaptureNameForId", "RootNode", "NamedChildCount", "ChildByFieldName", "Content", "StartPoint", "EndPoint",
    "Child", "ChildCount", "Type", "Parent",
]


def brief(functions: DataFrame) -> DataFrame:
    return functions.withColumn("line_count", F.col("line_end") - F.col("line_start") + 1).select(*BRIEF)


def summary(functions: DataFrame, deps: DataFrame, globals_: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of totals over all sessions, with the number of functions and variables by language."""
    by_lang = functions.groupBy("language").agg(F.count("*").alias("n"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("lines"))
    f = by_lang.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("functions"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("lang_dist"))
    v = globals_.groupBy("language").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("variables"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("var_lang_dist"))
    e = deps.agg(F.count("*").alias("edges"))
    s = sessions.agg(F.count("*").alias("sessions"), F.max("id").alias("latest_session"))
    return s.crossJoin(f).crossJoin(v).crossJoin(e)  # one row each


def language_distribution(relation: DataFrame) -> DataFrame:
    return relation.groupBy("language").agg(F.count("*").alias("n"))


def all_functions(functions: DataFrame) -> DataFrame:
    return brief(functions).orderBy(*TIES)


def functions_by_language(functions: DataFrame, language: str) -> DataFrame:
    picked = functions.filter(F.col("language") == language)
    return picked.select("id", "name", "package_name", "language", "file_path", "line_start", "line_end", "body", "call_count", "nesting_depth", "visibility").orderBy(*TIES)


def function_detail(functions: DataFrame, names: list[str]) -> DataFrame:
    """Functions of exactly these names, in the names' order."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name")).cast("int").alias("position")
    return functions.filter(F.col("name").isin(names)).withColumn("line_count", F.col("line_end") - F.col("line_start") + 1).select(place, *BRIEF).orderBy("position", *TIES)


def function_body(functions: DataFrame, id_: int) -> DataFrame:
    return functions.filter(F.col("id") == id_).select("id", "body")


def function_body_by_name(functions: DataFrame, name: str) -> DataFrame:
    return functions.filter(F.col("name") == name).orderBy(*TIES).limit(1).select("name", "body")


def variables(globals_: DataFrame) -> DataFrame:
    return globals_.select("id", "name", "var_type", "language", "file_path", "line_num", "is_const").orderBy("file_path", "line_num", "id")


def variables_by_language(globals_: DataFrame, language: str) -> DataFrame:
    return variables(globals_.filter(F.col("language") == language))


def dependency_stats(functions: DataFrame, deps: DataFrame) -> DataFrame:
    """Per function name: distinct callers of that name, distinct callees of all its functions, largest call count."""
    names = functions.groupBy("name").agg(F.max("call_count").alias("total_call_count"))
    callers = deps.groupBy(F.col("callee_name").alias("name")).agg(F.count_distinct("caller_id").alias("caller_count"))
    callees = deps.join(functions.select(F.col("id").alias("caller_id"), "name"), "caller_id").groupBy("name").agg(F.count_distinct("callee_name").alias("callee_count"))
    out = names.join(callers, "name", "left").join(callees, "name", "left")
    return out.select("name", F.coalesce("caller_count", F.lit(0)).alias("caller_count"), F.coalesce("callee_count", F.lit(0)).alias("callee_count"), "total_call_count").orderBy(F.desc("caller_count"), "name")


def most_called(functions: DataFrame, deps: DataFrame, n: int = 10) -> DataFrame:
    return dependency_stats(functions, deps).filter("caller_count > 0").orderBy(F.desc("caller_count"), "name").limit(n)


def never_called_count(functions: DataFrame, deps: DataFrame) -> DataFrame:
    return dependency_stats(functions, deps).agg(F.count_if(F.col("caller_count") == 0).alias("never_called"))


def widest(functions: DataFrame, deps: DataFrame, n: int = 5) -> DataFrame:
    return dependency_stats(functions, deps).filter("callee_count > 0").orderBy(F.desc("callee_count"), "name").limit(n)


def callers(functions: DataFrame, deps: DataFrame, name: str) -> DataFrame:
    wanted = deps.filter(F.col("callee_name") == name).select(F.col("caller_id").alias("id"))
    return brief(functions.join(wanted, "id")).orderBy(*TIES)


def callees(deps: DataFrame, id_: int) -> DataFrame:
    return deps.filter(F.col("caller_id") == id_).select("caller_id", "callee_name").orderBy("callee_name")


def session_edges(functions: DataFrame, deps: DataFrame, session: int) -> DataFrame:
    """Per function of a session, its callees in order."""
    mine = functions.filter(F.col("session_id") == session).select(F.col("id").alias("caller_id"))
    return deps.join(mine, "caller_id").groupBy("caller_id").agg(F.array_join(F.sort_array(F.collect_list("callee_name")), ",").alias("callees"), F.count("*").alias("n"))


def unreferenced(functions: DataFrame, deps: DataFrame) -> DataFrame:
    """Functions whose plain name no edge of any session has; a left anti join, as names are never null."""
    out = functions.join(deps.select(F.col("callee_name").alias("name")).distinct(), "name", "left_anti")
    return brief(out).orderBy(F.desc("line_count"), *TIES)


def missing(functions: DataFrame, deps: DataFrame) -> DataFrame:
    names = functions.select(F.col("name").alias("callee_name"))
    return deps.select("callee_name").distinct().join(names, "callee_name", "left_anti").orderBy("callee_name")


def is_standard(name: Column, known: list[str]) -> Column:
    """Whether a callee counts as a standard library call: a known prefix with more after it, or a known name."""
    out = name.isin(known) if known else F.lit(False)
    for prefix in STD_PREFIXES:
        out = out | (name.startswith(prefix) & (F.length(name) > len(prefix)))
    return out


def missing_in_project(functions: DataFrame, deps: DataFrame, known: list[str]) -> DataFrame:
    return missing(functions, deps).filter(~is_standard(F.col("callee_name"), known))


def longest(functions: DataFrame, n: int = 10) -> DataFrame:
    return brief(functions).orderBy(F.desc("line_count"), *TIES).limit(n if n > 0 else 10)


def deeply_nested(functions: DataFrame, threshold: int = 3) -> DataFrame:
    return brief(functions.filter(F.col("nesting_depth") >= threshold)).orderBy(F.desc("nesting_depth"), F.desc("line_count"), *TIES)


def most_complex(functions: DataFrame, n: int = 10) -> DataFrame:
    return brief(functions.filter("cyclomatic > 0")).orderBy(F.desc("cyclomatic"), F.desc("line_count"), *TIES).limit(n if n > 0 else 10)


def many_parameters(functions: DataFrame, threshold: int = 5) -> DataFrame:
    return brief(functions.filter(F.col("parameter_count") >= threshold)).orderBy(F.desc("parameter_count"), F.desc("line_count"), *TIES)


def with_anonymous(functions: DataFrame) -> DataFrame:
    return brief(functions.filter("anonymous_funcs > 0")).orderBy(F.desc("anonymous_funcs"), F.desc("line_count"), *TIES)


def file_metrics(functions: DataFrame) -> DataFrame:
    """Per file: its last line, counts, sums, maxima and the average complexity of its functions."""
    public = F.col("visibility") == "public"
    return functions.groupBy("session_id", "file_path", "language").agg(
        F.max("line_end").cast("long").alias("total_lines"), F.count("*").alias("func_count"), F.avg(F.col("cyclomatic").cast("double")).alias("avg_cyclomatic"), F.max("cyclomatic").cast("int").alias("max_cyclomatic"),
        F.sum("parameter_count").cast("long").alias("total_parameters"), F.max("parameter_count").cast("int").alias("max_parameters"), F.sum("return_count").cast("long").alias("total_returns"), F.sum("statement_count").cast("long").alias("total_statements"),
        F.sum("anonymous_funcs").cast("long").alias("total_anon_funcs"), F.count_if(public).alias("public_funcs"), F.count_if(~public).alias("private_funcs"), F.count_if(F.col("is_method").cast("int") == 1).alias("methods_count"),
    )


def files_by_size(functions: DataFrame) -> DataFrame:
    return file_metrics(functions).orderBy(F.desc("total_lines"), "file_path", "session_id", "language")


def type_definitions(types: DataFrame, kind: str | None = None) -> DataFrame:
    picked = types if kind is None else types.filter(F.col("kind") == kind)
    return picked.select("name", "kind", "language", "file_path", "line_start", "line_end").orderBy("file_path", "line_start", "name")


def distinct_by_language(functions: DataFrame, globals_: DataFrame) -> DataFrame:
    f = functions.groupBy("language").agg(F.count_distinct("file_path", "name", "line_start").alias("n")).withColumn("relation", F.lit("functions"))
    v = globals_.groupBy("language").agg(F.count_distinct("file_path", "name", "line_num").alias("n")).withColumn("relation", F.lit("variables"))
    return f.unionByName(v).select("relation", "language", "n")


def distinct_totals(functions: DataFrame, globals_: DataFrame) -> DataFrame:
    f = functions.dropDuplicates(["file_path", "name", "line_start"]).agg(F.count("*").alias("functions"))
    v = globals_.dropDuplicates(["file_path", "name", "line_num"]).agg(F.count("*").alias("variables"))
    return f.crossJoin(v)  # one row each


def session_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("sessions"), F.max("id").alias("latest_session"))


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("id")).limit(1).select("id", "project_root", "duration_ms", "file_count", "func_count", "var_count")


def functions_of_session(functions: DataFrame, session: int) -> DataFrame:
    return brief(functions.filter(F.col("session_id") == session))


def listing_by_file(functions: DataFrame) -> DataFrame:
    names = F.transform(F.sort_array(F.collect_list(F.struct("line_start", "id", "name"))), lambda x: F.concat(x["name"], F.lit(":"), x["line_start"].cast("string")))
    return functions.groupBy("file_path").agg(F.array_join(names, ",").alias("listing"), F.count("*").alias("n"))


def function_report(functions: DataFrame, deps: DataFrame, names: list[str], preview: int = 20) -> DataFrame:
    """Per function of these names: its first lines, callees and callers."""
    own = functions.filter(F.col("name").isin(names)).select("id", "name", F.array_join(F.slice(F.split("body", "\n"), 1, preview), "\n").alias("preview"))
    down = deps.join(own.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").groupBy(F.col("caller_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("callee_name")), ",").alias("callees"))
    up = deps.filter(F.col("callee_name").isin(names)).join(functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
    up = up.groupBy(F.col("callee_name").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("caller")), ",").alias("callers"))
    return own.join(down, "id", "left").join(up, "name", "left").select("id", "name", "preview", F.coalesce("callees", F.lit("")).alias("callees"), F.coalesce("callers", F.lit("")).alias("callers"))
