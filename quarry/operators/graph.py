"""The call graph of a session: resolved edges, orphans, hot functions, statistics and call trees."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.queries import brief


def qualified(package: Column, name: Column) -> Column:
    return F.when(package != "", F.concat_ws(".", package, name)).otherwise(name)


def nodes(functions: DataFrame) -> DataFrame:
    return functions.select("session_id", "id", "name", "package_name", qualified(F.col("package_name"), F.col("name")).alias("qualified"))


KEY = ["session_id", "caller_package", "callee_name"]


def _edges(functions: DataFrame, deps: DataFrame) -> DataFrame:
    """The edges with their caller's session and package."""
    callers = functions.select("session_id", F.col("id").alias("caller_id"), F.col("package_name").alias("caller_package"))
    return deps.join(callers, "caller_id")


def targets(functions: DataFrame, asked: DataFrame) -> DataFrame:
    """(session_id, caller_package, callee_name, strategy, callee_id) of distinct (session_id, caller_package, callee_name).

    0: a dotted callee equal to qualified names; 1: the callee in the caller's own package; 3: a plain
    name that exactly one function of the session has. Rules 0 and 1 link all namesakes; the first
    rule that finds a function holds. Which one that is takes names only, so no rule multiplies rows
    before it is chosen.
    """
    n = nodes(functions)
    named = n.select("session_id", F.col("qualified").alias("key"), F.col("id").alias("callee_id"))
    some = named.select("session_id", "key").distinct()
    alone = n.groupBy("session_id", F.col("name").alias("callee_name")).agg(F.count("*").alias("n"), F.min("id").alias("single")).filter("n = 1").drop("n")
    own = F.when(F.col("caller_package") != "", F.concat_ws(".", "caller_package", "callee_name"))
    dotted = F.when(F.instr("callee_name", ".") > 0, F.col("callee_name"))
    found = (
        asked.withColumns({"own": own, "dotted": dotted})
        .join(some.select("session_id", F.col("key").alias("dotted"), F.lit(True).alias("has_dotted")), ["session_id", "dotted"], "left")
        .join(some.select("session_id", F.col("key").alias("own"), F.lit(True).alias("has_own")), ["session_id", "own"], "left")
        .join(alone, ["session_id", "callee_name"], "left")
    )
    strategy = F.when(F.col("has_dotted"), 0).when(F.col("has_own"), 1).when(F.col("single").isNotNull(), 3)
    chosen = found.withColumn("strategy", strategy).filter("strategy is not null")
    by_name = chosen.filter("strategy < 3").withColumn("key", F.when(F.col("strategy") == 0, F.col("dotted")).otherwise(F.col("own"))).join(named, ["session_id", "key"])
    columns = [*KEY, "strategy", "callee_id"]
    return by_name.select(*columns).unionByName(chosen.filter("strategy = 3").withColumnRenamed("single", "callee_id").select(*columns))


def resolved_edges(functions: DataFrame, deps: DataFrame) -> DataFrame:
    """(session_id, caller_id, callee_name, callee_id, strategy): each edge with what targets() finds for it."""
    edges = _edges(functions, deps)
    return edges.join(targets(functions, edges.select(*KEY).distinct()), KEY).select("session_id", "caller_id", "callee_name", "callee_id", "strategy")


def orphans(functions: DataFrame, deps: DataFrame) -> DataFrame:
    called = targets(functions, _edges(functions, deps).select(*KEY).distinct()).select(F.col("callee_id").alias("id")).distinct()
    return brief(functions.join(called, "id", "left_anti"))


def hot(functions: DataFrame, deps: DataFrame, n: int = 10) -> DataFrame:
    """Functions by the number of resolved edges that end there, functions without any included. Edges are counted before they meet namesakes."""
    asked = _edges(functions, deps).groupBy(*KEY).agg(F.count("*").alias("n"))
    called = targets(functions, asked.select(*KEY)).join(asked, KEY).groupBy(F.col("callee_id").alias("id")).agg(F.sum("n").alias("callers"))
    out = functions.select("id", "name", "file_path", "line_start").join(called, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return out.orderBy(F.desc("callers"), "file_path", "line_start", "id").limit(n)


def orphan_tags(functions: DataFrame, deps: DataFrame, extra: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Orphans with the first tag that applies: test, fixture, runtime, entry, extra ones, cgap (an edge has its name), dead."""
    path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    named = deps.select(F.col("callee_name").alias("name")).distinct().withColumn("called", F.lit(True))
    rows = orphans(functions, deps).join(named, "name", "left")
    tag = F.when(path.endswith("_test.go"), "test").when(path.contains("/testdata"), "fixture").when(F.col("name") == "init", "runtime").when((F.col("name") == "main") & (F.col("package_name") == "main"), "entry")
    for label, condition in extra or []:
        tag = tag.when(condition, label)
    return rows.select("id", "name", "file_path", tag.when(F.col("called"), "cgap").otherwise("dead").alias("tag"))


def statistics(functions: DataFrame) -> DataFrame:
    """Over one node a qualified name (its first by file and line): calls in all, mean and largest nesting."""
    n = functions.withColumn("qualified", qualified(F.col("package_name"), F.col("name")))
    one = n.groupBy("qualified").agg(F.min_by(F.struct("call_count", "nesting_depth"), F.struct("file_path", "line_start", "id")).alias("x"))
    return one.agg(F.count("*").alias("nodes"), F.sum("x.call_count").alias("total_calls"), F.round(F.avg("x.nesting_depth"), 6).alias("avg_nesting"), F.max("x.nesting_depth").cast("int").alias("max_nesting"))


def most_calling(functions: DataFrame, n: int = 10) -> DataFrame:
    return brief(functions).orderBy(F.desc("call_count"), "file_path", "line_start", "id").limit(n)


def call_tree(functions: DataFrame, deps: DataFrame, root: str) -> DataFrame:
    """(name, depth, known, id, callees): all names that the root reaches, each at its least depth.

    Breadth-first by name, a level a job: the frontier meets the edges of its names' first
    definitions, and names seen before drop out, which ends cycles; the last level is the first empty
    one, however deep. Each level is written to the checkpoint folder once, and the names seen so far
    now and then, so the plan stays short. A name without a definition is a leaf.
    """
    first = functions.groupBy("name").agg(F.min_by(F.struct("id", "file_path", "line_start"), F.struct("file_path", "line_start", "id")).alias("d")).select("name", F.col("d.id").alias("id"))
    if not first.filter(F.col("name") == root).limit(1).count():
        raise LookupError(f"no function is named {root!r}")
    step = first.join(deps, F.col("id") == F.col("caller_id")).select(F.col("name").alias("caller"), "callee_name")
    from quarry.plans.shared import checkpointed

    step = checkpointed(step)
    seen = frontier = first.filter(F.col("name") == root).select("name", F.lit(0).alias("depth"))
    for depth in itertools.count(1):
        reached = step.join(frontier.select(F.col("name").alias("caller")), "caller", "left_semi").select(F.col("callee_name").alias("name")).distinct()
        frontier = checkpointed(reached.join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = checkpointed(seen)
    lists = step.groupBy(F.col("caller").alias("name")).agg(F.array_join(F.sort_array(F.collect_set("callee_name")), ",").alias("callees"))
    out = seen.join(first, "name", "left").join(lists, "name", "left")
    return out.select("name", "depth", F.col("id").isNotNull().alias("known"), "id", F.coalesce("callees", F.lit("")).alias("callees")).orderBy("depth", "name")
