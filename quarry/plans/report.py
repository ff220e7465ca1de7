"""Answers as text for a terminal: a table of any answer, and the report on a session's call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph as G

SHOWN_ORPHANS = 20  # named in the report; all are counted


def _cell(value: object) -> str:
    if isinstance(value, dict):
        return " ".join(f"{k}={v}" for k, v in sorted(value.items()))
    return "" if value is None else str(value)


def text_table(columns: list[str], rows: list[dict]) -> str:
    """Columns side by side; a column with line ends goes below its row instead, indented."""
    cells = [[_cell(r.get(c)) for c in columns] for r in rows]
    long = [any("\n" in row[i] for row in cells) for i in range(len(columns))]
    width = [max([len(c), *(len(row[i]) for row in cells)]) for i, c in enumerate(columns)]
    line = lambda row: "  ".join(x.ljust(w) for x, w, below in zip(row, width, long, strict=True) if not below).rstrip()
    out = [line(columns), line(["-" * w for w in width])]
    for row in cells:
        out.append(line(row))
        for i, below in enumerate(long):
            if below:
                out += [f"    | {x}" for x in row[i].split("\n")]
    return "\n".join([*out, f"({len(rows)} rows)"])


def graph_report(functions: DataFrame, deps: DataFrame) -> str:
    """Totals of the latest session's call graph, its functions with the most calls, the most called ones, and orphans."""
    last = functions.agg(F.max("session_id").alias("session_id"))
    mine = functions.join(F.broadcast(last), "session_id")  # one row
    totals = G.statistics(mine).first()
    out = ["Call graph", f"  functions {totals.nodes}, calls {totals.total_calls or 0}, mean nesting {totals.avg_nesting or 0:.1f}, deepest {totals.max_nesting or 0}"]
    calling = [r for r in G.most_calling(mine).collect() if r.call_count]
    if calling:
        out += ["", "Most calls made"] + [f"  {i}. {r.name} ({r.language}): {r.call_count} calls, nesting {r.nesting_depth}" for i, r in enumerate(calling, 1)]
    hot = [r for r in G.hot(mine, deps).collect() if r.callers]
    if hot:
        out += ["", "Most called"] + [f"  {i}. {r.name} ({r.file_path}:{r.line_start}): {r.callers} callers" for i, r in enumerate(hot, 1)]
    orphans = G.orphans(mine, deps)
    n = orphans.count()
    if n:
        out += ["", f"Never called: {n}"] + [f"  {r.name} ({r.language}, {r.file_path}:{r.line_start})" for r in orphans.orderBy("file_path", "line_start", "id").limit(SHOWN_ORPHANS).collect()]
        out += [f"  and {n - SHOWN_ORPHANS} more"] * (n > SHOWN_ORPHANS)
    return "\n".join(out)
