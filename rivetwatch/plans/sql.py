"""Read-only SQL over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import register_table

# Plan nodes that only read.  A statement is accepted when its parsed plan has no command in it.
_COMMAND = "org.apache.spark.sql.catalyst.plans.logical.Command"
_WRITES = ("InsertInto", "CreateTable", "ReplaceTable", "Delete", "Update", "Merge", "Drop", "Alter", "Load", "SetCatalog")


def check_read_only(spark: SparkSession, query: str) -> str:
    """Reject commands and writes by what the statement parses to, not by its words.

    A column called ``update_ts`` or a literal ``'DROP'`` is therefore fine.
    """
    text = (query or "").strip().rstrip(";").strip()
    if not text:
        raise ValueError("empty SQL")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    command = spark._jvm.java.lang.Class.forName(_COMMAND)
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if command.isInstance(node) or name.startswith(_WRITES):
            raise ValueError(f"only read-only queries are allowed, not {name}")
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            # format.`path` would read any file; only names that the session knows are tables.
            if parts.size() > 1 and not spark.catalog.tableExists(".".join(f"`{parts.apply(i)}`" for i in range(parts.size()))):
                raise ValueError("only registered tables can be read")
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return text


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run one read-only statement; ``tables`` are registered under safe names first."""
    for name, df in (tables or {}).items():
        register_table(df, name)
    return spark.sql(check_read_only(spark, query))


def slice_sql(spark: SparkSession, query: str, source: DataFrame) -> DataFrame:
    """Free-form SELECT over ``{source}``; filters and columns are pushed into the source scan."""
    if "{source}" not in query:
        raise ValueError("the query must reference {source}")
    probe = re.sub(r"\{source\}", "source", query)
    text = check_read_only(spark, probe)
    if not re.match(r"(?is)\s*(select|with)\b", text):
        raise ValueError("only SELECT or WITH queries are allowed here")
    return spark.sql(query.strip().rstrip(";"), source=source)


def example_queries(table: str) -> list[str]:
    t = re.sub(r"[^A-Za-z0-9_]", "_", table)
    return [
        f"SELECT machine_id, min(timestamp) AS since, max(timestamp) AS until FROM {t} GROUP BY machine_id",
        f"SELECT date_trunc('DAY', timestamp) AS day, max(pressure) AS peak FROM {t} GROUP BY 1 ORDER BY 1",
        f"SELECT count_if(rpm IS NULL) AS silent, count(*) AS readings FROM {t}",
    ]
