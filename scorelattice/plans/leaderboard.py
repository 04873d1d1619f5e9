"""Ranking, averages, gauges and chart tables over the score cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import categories as C, marts as M, ranking as R
from ..session import staged
from . import domain as D
from .registry import query

_OVERALL_SQL = """
r AS (SELECT c.model_id, c.benchmark_id, rank() OVER (PARTITION BY c.benchmark_id
        ORDER BY CASE WHEN higher_is_better THEN -value ELSE value END) AS rk
      FROM cells c JOIN benchmarks USING (benchmark_id)),
n AS (SELECT (SELECT count(*) FROM benchmarks) AS total, (SELECT count(*) FROM models) + 1 AS penalty),
s AS (SELECT m.model_id, m.name, m.vendor, count(r.rk) AS covered,
             count(*) FILTER (WHERE r.rk = 1) AS firsts, any_value(total) AS total,
             coalesce(sum(r.rk), 0) + (any_value(total) - count(r.rk)) * any_value(penalty) AS rank_sum
      FROM models m CROSS JOIN n LEFT JOIN r ON r.model_id = m.model_id GROUP BY m.model_id, m.name, m.vendor),
o AS (SELECT *, covered / total < 0.6 AS low,
             rank() OVER (PARTITION BY covered / total < 0.6 ORDER BY rank_sum, firsts DESC) AS place FROM s),
overall AS (SELECT model_id, name, vendor, CAST(CASE WHEN NOT low THEN place END AS BIGINT) AS rank,
       CAST(rank_sum AS DOUBLE) / total AS avg_rank, firsts, covered / total AS coverage, covered, total,
       CASE WHEN low THEN 'incomplete_coverage' END AS unranked_reason FROM o)
"""
_OVERALL = D.with_ctes("models cells benchmarks", "").rstrip() + "," + _OVERALL_SQL


def _overall(spark, folder):
    return R.coverage_ranking(
        D.models(spark, folder).select("model_id", "name", "vendor"),
        D.cells(spark, folder),
        D.benchmarks(spark, folder),
    )


#: The whole overall ranking.
OVERALL_SQL = _OVERALL + "SELECT * FROM overall"


@query(OVERALL_SQL)
def coverage_ranking(spark, folder):
    return _overall(spark, folder)


@query(
    _OVERALL
    + """SELECT model_id, rank, covered, row_number() OVER (
    ORDER BY rank IS NULL, rank, covered DESC, name, model_id) AS place FROM overall"""
)
def leaderboard_order(spark, folder):
    rows = staged(_overall(spark, folder))
    keys = [
        F.coalesce("rank", F.lit(2**62)), -F.col("covered"), F.col("name"), F.col("model_id"),
    ]
    return R.ordered_places(rows, keys).select("model_id", "rank", "covered", "place")


@query(
    D.with_ctes(
        "models cells benchmarks",
        """SELECT model_id, benchmark_id, value, rank() OVER (PARTITION BY benchmark_id
    ORDER BY CASE WHEN higher_is_better THEN -value ELSE value END) AS rank
    FROM cells JOIN benchmarks USING (benchmark_id)""",
    )
)
def competition_rank(spark, folder):
    ranks = R.benchmark_ranks(D.cells(spark, folder), D.benchmarks(spark, folder))
    return ranks.select("model_id", "benchmark_id", "value", "rank")


@query(
    D.with_ctes(
        "models cells benchmarks",
        """SELECT * FROM (SELECT model_id, benchmark_id, value, row_number() OVER (PARTITION BY benchmark_id
    ORDER BY CASE WHEN higher_is_better THEN -value ELSE value END, name, model_id) AS place
    FROM cells JOIN benchmarks USING (benchmark_id) JOIN models USING (model_id)) WHERE place <= 6""",
    )
)
def top6_per_benchmark(spark, folder):
    directed = D.cells(spark, folder).join(
        D.benchmarks(spark, folder).select("benchmark_id", "higher_is_better"), "benchmark_id"
    )
    top = R.top_per_benchmark(directed, D.models(spark, folder))
    return top.select("model_id", "benchmark_id", "value", F.col("place").cast("long").alias("place"))


@query(
    D.with_ctes(
        "cells benchmarks",
        """SELECT benchmark_id, min(value) AS min, max(value) AS max,
    CASE WHEN any_value(higher_is_better) THEN max(value) ELSE min(value) END AS best,
    CASE WHEN any_value(higher_is_better) THEN min(value) ELSE max(value) END AS worst,
    floor(CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) / count(value) * 1e6 + 0.5) / 1e6 AS avg,
    count(value) AS count FROM benchmarks LEFT JOIN cells USING (benchmark_id) GROUP BY benchmark_id""",
    )
)
def column_stats(spark, folder):
    stats = R.column_stats(D.cells(spark, folder), D.benchmarks(spark, folder))
    return stats.withColumn("avg", S.half_up(F.col("avg"), 6))


_BEST = """best AS (SELECT benchmark_id, model_id, value FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_id
  ORDER BY CASE WHEN higher_is_better THEN -value ELSE value END, name, model_id) AS rn
  FROM cells JOIN benchmarks USING (benchmark_id) JOIN models USING (model_id)) WHERE rn = 1)
"""


@query(D.with_ctes("models cells benchmarks", "").rstrip() + "," + _BEST + "SELECT * FROM best")
def best_model_per_benchmark(spark, folder):
    return R.best_models(
        D.cells(spark, folder), D.benchmarks(spark, folder), D.models(spark, folder)
    )


@query(
    D.with_ctes("models cells benchmarks", "").rstrip() + "," + _BEST
    + "SELECT model_id, count(*) AS leads FROM best GROUP BY model_id"
)
def leads_per_model(spark, folder):
    return R.leads_per_model(best_model_per_benchmark(spark, folder))


@query(
    D.with_ctes(
        "cells benchmarks",
        """SELECT model_id, benchmark_id, value, floor(t * 1e6 + 0.5) / 1e6 AS t,
    floor((0.24 + t * 0.58) * 1e6 + 0.5) / 1e6 AS alpha, value = CASE WHEN higher_is_better THEN hi ELSE lo END AS is_best
    FROM (SELECT *, CASE WHEN higher_is_better THEN span ELSE 1 - span END AS t FROM (
      SELECT *, CASE WHEN hi <> lo THEN (value - lo) / (hi - lo) END AS span FROM (
        SELECT *, min(value) OVER (PARTITION BY benchmark_id) AS lo, max(value) OVER (PARTITION BY benchmark_id) AS hi
        FROM cells JOIN benchmarks USING (benchmark_id))))""",
    )
)
def heatmap_cells(spark, folder):
    heat = R.heat_cells(D.cells(spark, folder), D.benchmarks(spark, folder))
    return heat.withColumn("t", S.half_up(F.col("t"), 6)).withColumn(
        "alpha", S.half_up(F.col("alpha"), 6)
    )


@query(
    D.with_ctes(
        "models cells benchmarks",
        """SELECT 'scored' AS list, model_id FROM models WHERE model_id IN
      (SELECT model_id FROM cells JOIN benchmarks USING (benchmark_id) WHERE category = 'embedding')
    UNION ALL SELECT 'unscored', model_id FROM models WHERE model_id NOT IN
      (SELECT model_id FROM cells JOIN benchmarks USING (benchmark_id) WHERE category = 'embedding')""",
    )
)
def class_cohort(spark, folder):
    models, cells = D.models(spark, folder), D.cells(spark, folder)
    cohort = D.benchmarks(spark, folder).where(
        S.comparison_class(F.col("category")) == "embedding"
    )
    scored = R.scored_models(models, cells, cohort)
    unscored = R.unscored_models(models, cells, cohort)
    return scored.select(F.lit("scored").alias("list"), "model_id").unionByName(
        unscored.select(F.lit("unscored").alias("list"), "model_id")
    )


@query(
    D.with_ctes(
        "models cells",
        """SELECT model_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, name, model_id) AS place
    FROM models LEFT JOIN (SELECT * FROM cells WHERE benchmark_id = 'Brand#12') USING (model_id)""",
    )
)
def column_sort(spark, folder):
    models, cells = D.models(spark, folder), D.cells(spark, folder)
    column = R.column_order(models, cells, "Brand#12")
    keys = [F.col("value").isNull(), -F.col("value"), F.col("name"), F.col("model_id")]
    return R.ordered_places(column, keys).select("model_id", "value", "place")


@query(
    D.with_ctes(
        "unit_cells",
        "SELECT model_id, benchmark_id, value, floor(unit * 1e6 + 0.5) / 1e6 AS unit, pct FROM unit_cells",
    )
)
def normalized_scores(spark, folder):
    cells = C.normalised(D.cells(spark, folder), D.benchmarks(spark, folder))
    return cells.select(
        "model_id", "benchmark_id", "value", S.half_up(F.col("unit"), 6).alias("unit"), "pct"
    )


@query(
    D.with_ctes(
        "models unit_cells",
        f"""SELECT m.model_id, k.category, floor(v * 1e6 + 0.5) / 1e6 AS radar_value FROM models m CROSS JOIN (SELECT unnest({list(D.CATEGORIES)}) AS category) k
    LEFT JOIN (SELECT model_id, category, {D.exact_mean_sql('unit')} AS v FROM unit_cells GROUP BY model_id, category) r ON r.model_id = m.model_id AND r.category = k.category""",
    )
)
def category_radar(spark, folder):
    radar = C.category_radar(
        D.models(spark, folder), D.cells(spark, folder), D.benchmarks(spark, folder), D.CATEGORIES
    )
    return radar.withColumn("radar_value", S.half_up(F.col("radar_value"), 6))


_COVERED = f"""t AS (SELECT category, count(*) AS total FROM benchmarks
      WHERE coalesce(norm_kind, '') <> 'raw_only' GROUP BY category),
covered AS (SELECT category, model_id, {D.exact_mean_sql('unit')} AS avg, count(*) AS n, any_value(total) AS total
  FROM unit_cells JOIN t USING (category) WHERE unit IS NOT NULL AND coalesce(norm_kind, '') <> 'raw_only'
  GROUP BY category, model_id HAVING count(*) = any_value(total))
"""


@query(
    D.with_ctes("unit_cells", "").rstrip() + "," + _COVERED
    + "SELECT category, model_id, floor(avg * 1e6 + 0.5) / 1e6 AS avg, n, total FROM covered"
)
def category_full_avg(spark, folder):
    rows = C.covered_category_averages(D.cells(spark, folder), D.benchmarks(spark, folder))
    return rows.withColumn("avg", S.half_up(F.col("avg"), 6))


@query(
    D.with_ctes("unit_cells", "").rstrip() + "," + _COVERED
    + """SELECT category, model_id, floor(avg * 1e6 + 0.5) / 1e6 AS avg, coalesce(n, 0) AS n, total FROM (
    SELECT t.category, model_id, avg, n, t.total, row_number() OVER (PARTITION BY t.category ORDER BY avg DESC NULLS LAST, model_id) AS rn
    FROM t LEFT JOIN covered c ON c.category = t.category) WHERE rn = 1"""
)
def category_leaders(spark, folder):
    rows = C.category_leaders(D.cells(spark, folder), D.benchmarks(spark, folder))
    return rows.withColumn("avg", S.half_up(F.col("avg"), 6))


@query(
    D.with_ctes(
        "models unit_cells",
        f"""SELECT model_id, floor(m * 10 + 0.5) / 10 AS pct,
    CAST(floor(coalesce(present, 0) / (SELECT count(*) FROM benchmarks WHERE coalesce(norm_kind, '') <> 'raw_only') * 100 + 0.5) AS BIGINT) AS coverage_pct
    FROM models LEFT JOIN (SELECT model_id, {D.exact_mean_sql('pct')} AS m, count(pct) AS present
                           FROM unit_cells GROUP BY model_id) USING (model_id)""",
    )
)
def overall_gauge(spark, folder):
    return C.overall_gauge(
        D.models(spark, folder), D.cells(spark, folder), D.benchmarks(spark, folder)
    )


_FIELD = f"""field AS (SELECT b.benchmark_id, b.category, floor(m * 10 + 0.5) / 10 AS field_pct FROM benchmarks b
  LEFT JOIN (SELECT benchmark_id, {D.exact_mean_sql('pct')} AS m FROM unit_cells GROUP BY benchmark_id) USING (benchmark_id))
"""


@query(
    D.with_ctes("unit_cells", "").rstrip() + "," + _FIELD
    + f"SELECT category, floor({D.exact_mean_sql('field_pct')} * 10 + 0.5) / 10 AS field_pct FROM field GROUP BY category"
)
def field_average(spark, folder):
    return C.category_field_average(D.cells(spark, folder), D.benchmarks(spark, folder))


@query(
    D.with_ctes("unit_cells", "").rstrip() + "," + _FIELD
    + """SELECT model_id, benchmark_id, pct, field_pct FROM unit_cells JOIN field USING (benchmark_id)
    WHERE pct IS NOT NULL OR field_pct IS NOT NULL"""
)
def model_profile(spark, folder):
    return M.model_profile(D.cells(spark, folder), D.benchmarks(spark, folder))


@query(
    D.with_ctes(
        "benchmarks",
        f"""SELECT category, count(benchmark_id) AS count FROM (SELECT unnest({list(D.CATEGORIES)}) AS category)
    LEFT JOIN benchmarks USING (category) GROUP BY category""",
    )
)
def catalog_share(spark, folder):
    benchmarks = D.benchmarks(spark, folder)
    names = F.explode(F.array(*[F.lit(c) for c in D.CATEGORIES])).alias("category")
    return C.catalog_share(benchmarks, spark.range(1).select(names))


def _chosen(spark, folder):
    """The first four suppliers by id; every cell of theirs is shown."""
    return [f"{i:012d}" for i in range(4)]


_SLOT_SQL = ", ".join(
    f"max(CASE WHEN model_id = '{i:012d}' THEN p END) AS s{i}" for i in range(4)
)


@query(
    D.with_ctes("unit_cells", "").rstrip() + f""", radar AS (
    SELECT model_id, category, floor({D.exact_mean_sql('unit')} * 100 * 10 + 0.5) / 10 AS p FROM unit_cells GROUP BY model_id, category)
    SELECT category, {_SLOT_SQL} FROM (SELECT DISTINCT category FROM benchmarks) LEFT JOIN radar USING (category) GROUP BY category"""
)
def category_pivot(spark, folder):
    return M.category_pivot(
        D.cells(spark, folder), D.benchmarks(spark, folder), _chosen(spark, folder)
    )


@query(
    D.with_ctes("unit_cells", "").rstrip() + f""", c AS (SELECT *, pct AS p FROM unit_cells)
    SELECT * FROM (SELECT benchmark_id, category, {_SLOT_SQL} FROM c GROUP BY benchmark_id, category)
    WHERE coalesce(s0, s1, s2, s3) IS NOT NULL"""
)
def benchmark_pivot(spark, folder):
    return M.benchmark_pivot(
        D.cells(spark, folder), D.benchmarks(spark, folder), _chosen(spark, folder)
    )


@query(
    D.with_ctes(
        "models unit_cells",
        """SELECT benchmark_id, model_id, name, pct, row_number() OVER (PARTITION BY benchmark_id
    ORDER BY pct DESC, name, model_id) AS spread_rank FROM unit_cells JOIN models USING (model_id) WHERE pct IS NOT NULL""",
    )
)
def benchmark_spread(spark, folder):
    return M.benchmark_spread(
        D.cells(spark, folder), D.benchmarks(spark, folder), D.models(spark, folder)
    )


_FLOW = """used AS (SELECT benchmark_id, category, max(pct) AS top_pct FROM unit_cells WHERE pct IS NOT NULL GROUP BY ALL),
labels AS (SELECT DISTINCT category FROM used),
raw AS (SELECT 0 AS tier, category AS label, NULL AS benchmark_id, category, NULL AS top_pct FROM labels
  UNION ALL SELECT 1, CASE WHEN benchmark_name IN (SELECT category FROM labels) THEN benchmark_name || ' ·' ELSE benchmark_name END,
         benchmark_id, u.category, top_pct FROM used u JOIN (SELECT benchmark_id, benchmark_name FROM benchmarks) USING (benchmark_id)),
nodes AS (SELECT *, row_number() OVER (ORDER BY tier, coalesce(benchmark_id, ''), category) - 1 AS node_id FROM raw)
"""


@query(
    D.with_ctes("unit_cells", "").rstrip() + "," + _FLOW
    + "SELECT CAST(tier AS INTEGER) AS tier, label, benchmark_id, node_id FROM nodes"
)
def sankey_nodes(spark, folder):
    nodes = M.flow_nodes(D.cells(spark, folder), D.benchmarks(spark, folder))
    return nodes.select("tier", "label", "benchmark_id", "node_id")


@query(
    D.with_ctes("unit_cells", "").rstrip() + "," + _FLOW
    + """SELECT h.node_id AS source, b.node_id AS target, greatest(b.top_pct, 1.0) AS link_value
    FROM nodes b JOIN nodes h ON h.tier = 0 AND h.category = b.category WHERE b.tier = 1"""
)
def sankey_links(spark, folder):
    return M.flow_links(M.flow_nodes(D.cells(spark, folder), D.benchmarks(spark, folder)))


@query(
    D.with_ctes(
        "benchmarks",
        "SELECT category, string_agg(benchmark_id, ',' ORDER BY benchmark_id) AS columns, count(*) AS n FROM benchmarks GROUP BY category",
    )
)
def category_columns(spark, folder):
    return M.column_groups(D.benchmarks(spark, folder))


@query(
    D.with_ctes(
        "models cells",
        """SELECT model_id, benchmark_id,
    CAST(CAST(floor(value / 10000 + 0.5) AS BIGINT) AS VARCHAR) AS score_text,
    CASE WHEN open_weights IS NULL THEN 'Not supplied' WHEN open_weights THEN 'yes' ELSE 'no' END AS weights_text
    FROM cells JOIN models USING (model_id)""",
    )
)
def formatted_cells(spark, folder):
    cells = D.cells(spark, folder).join(D.models(spark, folder), "model_id")
    return cells.select(
        "model_id",
        "benchmark_id",
        S.format_score(F.col("value") / 10000, F.lit(100.0)).alias("score_text"),
        S.format_open_weights(F.col("open_weights")).alias("weights_text"),
    )
