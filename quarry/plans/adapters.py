"""The relations of a code base made from the driver's tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS_SQL = """
select p_partkey as id, 1 + p_partkey % 3 as session_id, replace(p_name,' ','_') || '_' || cast(p_partkey % 20 as varchar(20)) as name,
 case when p_partkey % 7 = 0 then '' else lower(p_type) end as package_name, lower(p_brand) as language, p_type || '/' || p_brand || '.src' as file_path,
 p_partkey % 1000 + 1 as line_start, p_partkey % 1000 + p_size as line_end, p_size % 9 as nesting_depth, p_partkey % 13 as call_count, p_size % 12 as cyclomatic,
 p_partkey % 8 as parameter_count, p_partkey % 5 as return_count, p_size as statement_count, p_partkey % 4 as anonymous_funcs, p_partkey % 2 as is_method,
 case when p_partkey % 3 = 0 then 'private' else 'public' end as visibility, p_name as body from {part}
"""
DEPS_SQL = """
select distinct l.l_partkey as caller_id, case when l.l_returnflag = 'R' then 'ext.' || l.l_linestatus || cast(l.l_linenumber as varchar(20))
 when l.l_returnflag = 'A' and f.package_name <> '' then f.package_name || '.' || f.name else f.name end as callee_name
 from {lineitem} l join {functions} f on f.id = l.l_suppkey
"""
GLOBALS_SQL = """
select s_suppkey as id, 1 + s_suppkey % 3 as session_id, case when s_suppkey % 2 = 0 then 'MAX_' else 'cfg_' end || cast(s_suppkey % 40 as varchar(20)) as name,
 case when s_acctbal < 3000 then 'int' when s_acctbal < 6000 then 'string' else '' end as var_type, 'lang' || cast(s_nationkey % 5 as varchar(20)) as language,
 'pkg/' || cast(s_nationkey as varchar(20)) || '.src' as file_path, s_suppkey % 50 + 1 as line_num, s_suppkey % 2 as is_const from {supplier}
"""
SESSIONS_SQL = """
select cast(o_orderkey as bigint) as id, 'root/' || o_orderstatus as project_root, o_orderdate as scan_time, cast(o_custkey as bigint) as duration_ms,
 o_custkey % 100 as file_count, o_custkey % 1000 as func_count, o_custkey % 10 as var_count from {orders}
"""
TYPES_SQL = """
select 1 + c_custkey % 3 as session_id, replace(c_name, '#', '_') as name, lower(c_mktsegment) as kind, 'lang' || cast(c_nationkey % 5 as varchar(20)) as language,
 'types/' || cast(c_nationkey as varchar(20)) || '.src' as file_path, c_custkey % 500 + 1 as line_start, c_custkey % 500 + 1 + c_nationkey as line_end from {customer}
"""

ORACLE_WITH = (
    "with functions as (" + FUNCTIONS_SQL.format(part="part") + "), function_deps as (" + DEPS_SQL.format(lineitem="lineitem", functions="functions") + "), global_vars as (" + GLOBALS_SQL.format(supplier="supplier")
    + "), scan_sessions as (" + SESSIONS_SQL.format(orders="orders") + "), type_defs as (" + TYPES_SQL.format(customer="customer") + ")"
)


def oracle(body: str, **more: str) -> str:
    """SQL over the adapted relations; more: further named subqueries, in order."""
    return ORACLE_WITH + "".join(f", {name} as ({sql})" for name, sql in more.items()) + "\n" + body


@dataclass
class Relations:
    """The relations of one code base, each a lazy DataFrame."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def functions(self) -> DataFrame:
        return self.spark.sql(FUNCTIONS_SQL, part=self.table("part"))

    @cached_property
    def deps(self) -> DataFrame:
        return self.spark.sql(DEPS_SQL, lineitem=self.table("lineitem"), functions=self.functions)

    @cached_property
    def globals(self) -> DataFrame:
        return self.spark.sql(GLOBALS_SQL, supplier=self.table("supplier"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self.spark.sql(SESSIONS_SQL, orders=self.table("orders"))

    @cached_property
    def types(self) -> DataFrame:
        return self.spark.sql(TYPES_SQL, customer=self.table("customer"))
