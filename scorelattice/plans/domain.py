"""The shipped tables read as score evidence.

Suppliers are models, part brands are benchmarks and a line item is one
published result record.  Everything here is derived from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scores import half_up
from ..session import configure, spread

# The display categories, three brand numbers each.
CATEGORIES = (
    "knowledge", "reasoning", "math", "coding", "agentic",
    "instruction", "chat", "vision", "embedding", "other",
)
# Domain limits given to the benchmarks.
DOMAIN_MIN, DOMAIN_MAX, SCALE_MAX = 42000.0, 64000.0, 60000.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for row-by-row heavy work, shared out if it is stored in few parts."""
    return spread(table(spark, folder, name))


def models(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    return table(spark, folder, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.lpad(F.col("s_suppkey").cast("string"), 12, "0").alias("model_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("vendor"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") >= 3000).alias("open_weights"),
        F.col("s_acctbal").alias("price"),
    )


def benchmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmarks with category, direction and one of the three domain kinds."""
    number = F.regexp_extract("benchmark_id", "([0-9]+)$", 1).cast("long")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return (
        table(spark, folder, "part")
        .select(F.col("p_brand").alias("benchmark_id"))
        .distinct()
        .withColumn("no", number)
        .select(
            "benchmark_id",
            "no",
            F.when(F.col("no") == 9, "math").otherwise(F.col("benchmark_id")).alias("benchmark_name"),
            F.get(names, (F.col("no") / 3).cast("int")).alias("category"),
            (F.col("no") % 2 == 1).alias("higher_is_better"),
            F.lit(SCALE_MAX).alias("scale_max"),
            F.when(F.col("no") % 5 == 0, "raw_only")
            .when(F.col("no") % 7 == 0, None)
            .otherwise("bounded")
            .alias("norm_kind"),
            F.lit(DOMAIN_MIN).alias("norm_min"),
            F.lit(DOMAIN_MAX).alias("norm_max"),
        )
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Mean price per (supplier, brand); a cell is published if it holds a
    returned item taxed at one percent, which leaves natural gaps."""
    li = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    published = (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0.01)
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_brand")
        .agg(
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(published).alias("hits"),
        )
        .where(F.col("hits") > 0)
        .select(
            F.lpad(F.col("l_suppkey").cast("string"), 12, "0").alias("model_id"),
            F.col("p_brand").alias("benchmark_id"),
            half_up(F.col("s").cast("double") / F.col("n"), 2).alias("value"),
        )
    )


_CATEGORY_LIST = ", ".join(f"'{c}'" for c in CATEGORIES)

# The same readings for the SQL check, as named common table expressions.
CTES = {
    "models": """models AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS model_id, s_name AS name, n_name AS vendor,
         CASE WHEN s_acctbal >= 0 THEN s_acctbal >= 3000 END AS open_weights, s_acctbal AS price
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "benchmarks": f"""benchmarks AS (
  SELECT benchmark_id, no, CASE WHEN no = 9 THEN 'math' ELSE benchmark_id END AS benchmark_name,
         ([{_CATEGORY_LIST}])[no // 3 + 1] AS category, no % 2 = 1 AS higher_is_better,
         CAST({SCALE_MAX} AS DOUBLE) AS scale_max,
         CASE WHEN no % 5 = 0 THEN 'raw_only' WHEN no % 7 = 0 THEN NULL ELSE 'bounded' END AS norm_kind,
         CAST({DOMAIN_MIN} AS DOUBLE) AS norm_min, CAST({DOMAIN_MAX} AS DOUBLE) AS norm_max
  FROM (SELECT DISTINCT p_brand AS benchmark_id,
               CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS no FROM part))""",
    "cells": """cells AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS model_id, p_brand AS benchmark_id,
         floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand
  HAVING count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax = 0.01) > 0)""",
    "unit_cells": """unit_cells AS (
  SELECT *, floor(unit * 100 * 10 + 0.5) / 10 AS pct FROM (
    SELECT model_id, benchmark_id, value, category, norm_kind, higher_is_better,
           CASE WHEN higher_is_better THEN u ELSE 1 - u END AS unit
    FROM (SELECT c.*, b.* EXCLUDE (benchmark_id),
                 CASE WHEN norm_kind = 'bounded' AND value BETWEEN norm_min AND norm_max
                        THEN (value - norm_min) / (norm_max - norm_min)
                      WHEN norm_kind IS NULL AND value BETWEEN 0 AND scale_max THEN value / scale_max END AS u
          FROM cells c JOIN benchmarks b USING (benchmark_id)) q))""",
}
_NEEDS = {"unit_cells": ("cells", "benchmarks")}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named expressions and what they build on."""
    wanted: list[str] = []
    for name in names.split():
        for need in (*_NEEDS.get(name, ()), name):
            if need not in wanted:
                wanted.append(need)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(CTES[n] for n in wanted) + "\n" + body


def exact_mean_sql(expr: str) -> str:
    return f"(CAST(sum(CAST({expr} AS DECIMAL(28,12))) AS DOUBLE) / count({expr}))"
