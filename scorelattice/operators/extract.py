"""Turning snapshots into claims: one row per published score.

Snapshots arrive as rows with a text ``content``; which fields to read comes
from configuration columns joined to them, so one job serves every source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsonpath
from ..functions.lexemes import exact_records, fixed_text, score_field, text_field, with_spelled_numbers
from ..functions.text import loose_number, strict_number_error
from ..session import dimension_join

# Name starts of run metrics that describe the run, not its quality.
METADATA_METRIC_PREFIXES = (
    "num_", "finish_reason", "batch_size", "inference_", "training_",
    "prompt_truncated", "max_prob", "platt_coef", "platt_intercept",
)
# How many date marks make a late window, and which mark opens it.
MANY_MARKS, LATE_MARK, SOME_MARKS, EARLY_MARK = 12, 16, 4, 5


def json_claims(snapshots: DataFrame, config: DataFrame) -> DataFrame:
    """One claim per JSON record that has a text model and a score.

    ``config`` has one row per source: ``collection_path`` and the field names
    ``model_field``, ``score_field``, ``metric_field``, ``rank_field``.
    """
    # Paths are taken apart once a source, not once a snapshot.
    located = config.withColumn("_steps", jsonpath.steps(F.col("collection_path")))
    listed = dimension_join(snapshots, located, "source_id").select(
        "source_id",
        "snapshot_id",
        "collection_path",
        "model_field",
        "score_field",
        "metric_field",
        "rank_field",
        exact_records("content", F.col("_steps")).alias("records"),
    )
    records = listed.select("*", F.posexplode("records").alias("i", "r")).drop("records")
    return records.select(
        "source_id",
        "snapshot_id",
        F.concat("collection_path", F.lit("["), "i", F.lit("]")).alias("record_path"),
        text_field(F.col("r"), F.col("model_field")).alias("model_raw"),
        score_field(F.col("r"), F.col("score_field")).alias("score_raw"),
        text_field(F.col("r"), F.col("metric_field")).alias("metric_raw"),
        score_field(F.col("r"), F.col("rank_field")).alias("rank_raw"),
    ).where(F.col("model_raw").isNotNull() & F.col("score_raw").isNotNull())


def fallback_claims(rows: DataFrame) -> DataFrame:
    """Leaderboard entries whose model and score sit under one of several names."""
    return rows.withColumn(
        "model_raw", F.coalesce("model_id", "model", "fullname", F.lit("unknown"))
    ).withColumn("score_raw", F.coalesce("value", "score"))


def category_claims(
    documents: DataFrame, category: str, path: str = "leaderboards",
    model: str = "name", score: str = "resolved",
) -> DataFrame:
    """Results of the one leaderboard with the given name; none if not unique."""
    row = f"struct<{model}: string, {score}: string>"
    schema = f"struct<{path}: array<struct<name: string, results: array<{row}>>>>"
    boards = F.from_json("content", schema)[path]
    at = F.transform(boards, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    named = F.filter(at, lambda x: x["b"]["name"] == category)
    return (
        documents.select("*", named.alias("hits"))
        .where(F.size("hits") == 1)
        .select("snapshot_id", F.get("hits", F.lit(0)).alias("hit"))
        .select("snapshot_id", "hit.i", F.posexplode("hit.b.results").alias("row_index", "r"))
        .where(F.col(f"r.{model}").isNotNull() & F.col(f"r.{score}").isNotNull())
        .select(
            "snapshot_id",
            F.col(f"r.{model}").alias("model_raw"),
            F.col(f"r.{score}").alias("score_raw"),
            F.format_string(f"$.{path}[%d].results[%d]", "i", "row_index").alias("record_path"),
        )
    )


def is_quality_metric(name: Column) -> Column:
    lowered = F.lower(name)
    described = [lowered.startswith(p) for p in METADATA_METRIC_PREFIXES]
    hit = described[0]
    for cond in described[1:]:
        hit = hit | cond
    return ~hit


def run_claims(documents: DataFrame) -> DataFrame:
    """Metrics of evaluation runs, in either of the two published shapes.

    Grouped runs carry flat ``metrics``; listed runs carry ``stats`` whose name
    is an object.  Both are read in one pass and merged with ``coalesce``.  Scores
    keep the spelling of the source (1.2300, 1e16).
    """
    exact = with_spelled_numbers(documents.select("snapshot_id", "content"), "content")
    grouped_schema = (
        "struct<groups: array<struct<runs: array<struct<run_name: string, model: string, "
        "metrics: array<struct<name: string, split: string, mean: string, value: string>>>>>>>"
    )
    listed_schema = (
        "array<struct<run_spec: struct<adapter_spec: struct<model: string>>, "
        "stats: array<struct<name: struct<name: string, split: string>, mean: string, value: string>>>>"
    )
    grouped = F.transform(
        F.flatten(F.transform(F.from_json("content", grouped_schema)["groups"], lambda g: g["runs"])),
        lambda r: F.struct(
            F.coalesce(r["run_name"], r["model"], F.lit("unknown")).alias("model_raw"),
            F.transform(
                r["metrics"],
                lambda m: F.struct(
                    m["name"].alias("metric_raw"),
                    m["split"].alias("split_raw"),
                    F.coalesce(m["mean"], m["value"]).alias("score_raw"),
                ),
            ).alias("metrics"),
        ),
    )
    listed = F.transform(
        F.from_json("content", listed_schema),
        lambda r: F.struct(
            F.coalesce(r["run_spec"]["adapter_spec"]["model"], F.lit("unknown")).alias("model_raw"),
            F.transform(
                r["stats"],
                lambda m: F.struct(
                    m["name"]["name"].alias("metric_raw"),
                    m["name"]["split"].alias("split_raw"),
                    F.coalesce(m["mean"], m["value"]).alias("score_raw"),
                ),
            ).alias("metrics"),
        ),
    )
    # A list document read as one object would come out as an object of nulls,
    # so the document's first character picks the shape.
    runs = F.when(F.ltrim("content").startswith("["), listed).otherwise(grouped)
    metrics = (
        exact.select("snapshot_id", F.explode_outer(runs).alias("run"))
        .select("snapshot_id", "run.model_raw", F.explode_outer("run.metrics").alias("m"))
        .select("snapshot_id", "model_raw", "m.*")
    )
    return metrics.where(
        F.col("metric_raw").isNotNull()
        & is_quality_metric(F.col("metric_raw"))
        & F.col("score_raw").try_cast("double").isNotNull()
    )


def csv_claims(
    cells: DataFrame, model: str, score: str, metric: str | None = None, skip_blank: bool = True
) -> DataFrame:
    """CSV rows as claims; blank models or scores are left out or marked."""
    model_raw, score_raw = F.trim(F.col(model)), F.trim(F.col(score))
    blank = (F.coalesce(model_raw, F.lit("")) == "") | (F.coalesce(score_raw, F.lit("")) == "")
    rows = cells.where(~blank) if skip_blank else cells
    return rows.select(
        "file_path",
        "row_index",
        F.coalesce(model_raw, F.lit("unknown")).alias("model_raw"),
        F.coalesce(score_raw, F.lit("")).alias("score_raw"),
        (F.col(metric) if metric else F.lit(score)).alias("metric_raw"),
        loose_number(score_raw).alias("score_numeric"),
        F.when(blank, "needs_review").otherwise("parser_verified").alias("capture_status"),
    )


def unpivot_claims(
    wide: DataFrame, ids: Sequence[str], metric_columns: Mapping[str, str]
) -> DataFrame:
    """One claim per row and score column; ``metric_columns`` is metric -> column."""
    renamed = wide.select(
        *ids, *[F.col(c).cast("string").alias(m) for m, c in metric_columns.items()]
    )
    return renamed.unpivot(list(ids), list(metric_columns), "metric_raw", "score_raw")


def renamed_claims(rows: DataFrame, fields: Mapping[str, str], locator: Sequence[str]) -> DataFrame:
    """A flat table through a fixed field map; values stay source text."""
    return rows.select(
        *locator, *[F.col(column).cast("string").alias(field) for field, column in fields.items()]
    )


def batch_verdicts(
    claims: DataFrame, snapshot: str, identity: Sequence[str], dimensions: int, records: DataFrame
) -> DataFrame:
    """One verdict per snapshot: its claims are complete, or the first reason not.

    Identities are counted before snapshots, so the per-snapshot step only sees
    counters and one large snapshot costs no more than its rows.
    """
    bad_score = strict_number_error(F.col("score_raw"), F.lit("decimal"))
    per_identity = claims.groupBy(snapshot, *identity).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.trim("model_raw"), F.lit("")) == "").alias("no_model"),
        F.count_if(F.col("score_raw").isNull() | bad_score.isNotNull()).alias("bad_score"),
    )
    per_snapshot = per_identity.groupBy(snapshot).agg(
        F.sum("n").alias("claims"),
        F.max("n").alias("most"),
        F.sum("no_model").alias("no_model"),
        F.sum("bad_score").alias("bad_score"),
    )
    expected = records.groupBy(snapshot).agg(F.count(F.lit(1)).alias("records"))
    joined = expected.join(per_snapshot, snapshot, "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("records", "claims", "most", "no_model", "bad_score")}
    verdict = (
        F.when(n["records"] == 0, "BATCH_EMPTY")
        .when(n["no_model"] > 0, "MODEL_VALUE_MISSING")
        .when(n["bad_score"] > 0, "SCORE_VALUE_INVALID")
        .when(n["most"] > 1, "DUPLICATE_MODEL_DIMENSION")
        .when(n["claims"] != n["records"] * dimensions, "INCOMPLETE_ACCOUNTING")
    )
    return joined.select(snapshot, *[n[c].alias(c) for c in ("records", "claims")], verdict.alias("verdict"))


def whole_batches(claims: DataFrame, verdicts: DataFrame, snapshot: str) -> DataFrame:
    """Claims of snapshots without a failing verdict, all or nothing."""
    return claims.join(verdicts.where(F.col("verdict").isNull()).select(snapshot), snapshot, "left_semi")


def rank_map_verdicts(ranks: DataFrame, members: DataFrame) -> DataFrame:
    """Per board: its ranks are 1..n, each once, over exactly the member set."""
    per_rank = ranks.groupBy("board", "rank").agg(F.count(F.lit(1)).alias("n"))
    shape = per_rank.groupBy("board").agg(
        F.sum("n").alias("n"), F.count("rank").alias("distinct_ranks"),
        F.min("rank").alias("low"), F.max("rank").alias("high"),
    )
    listed = ranks.select("board", "member").distinct().withColumn("ranked", F.lit(1))
    known = members.select("board", "member").distinct().withColumn("known", F.lit(1))
    gaps = (
        known.join(listed, ["board", "member"], "full")
        .groupBy("board")
        .agg(F.count_if(F.col("ranked").isNull() | F.col("known").isNull()).alias("mismatched"))
    )
    is_permutation = (
        (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("distinct_ranks") == F.col("n"))
    )
    return gaps.join(shape, "board", "left").select(
        "board",
        F.coalesce("n", F.lit(0)).alias("n"),
        "mismatched",
        F.coalesce(is_permutation & (F.col("mismatched") == 0), F.lit(False)).alias("valid"),
    )


def reread_outcomes(claims: DataFrame, records: DataFrame, locator: Sequence[str]) -> DataFrame:
    """Compare claims with the record their locator names: pass, fail or uncertain."""
    found = records.select(
        *locator, F.col("model_raw").alias("_m"), F.col("score_raw").alias("_s"), F.lit(True).alias("_f")
    )
    same = F.col("model_raw").eqNullSafe(F.col("_m")) & F.col("score_raw").eqNullSafe(F.col("_s"))
    return claims.join(found, list(locator), "left").withColumn(
        "outcome",
        F.when(F.col("_f").isNull(), "uncertain").when(same, "pass").otherwise("fail"),
    ).drop("_m", "_s", "_f")


def contains_outcomes(claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Whether the snapshot's text holds the claim's score at all."""
    return claims.join(snapshots.select("snapshot_id", "content"), "snapshot_id").withColumn(
        "outcome", F.when(F.contains("content", F.col("score_raw")), "pass").otherwise("uncertain")
    ).drop("content")


def mean_of_means(wide: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean over categories of the mean over their tasks, per row.

    Blank and ``-`` cells do not count; a row without any number is left out.
    Everything is within the row, so nothing is shuffled.
    """

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(values) > 0, total / F.size(values))

    per_category = [
        mean(F.array_compact(F.array(*[F.col(t).try_cast("double") for t in tasks])))
        for tasks in categories.values()
    ]
    rows = wide.withColumn("_means", F.array_compact(F.array(*per_category)))
    return (
        rows.where(F.size("_means") > 0)
        .withColumn("categories_computed", F.size("_means"))
        .withColumn("overall", mean(F.col("_means")))
        .withColumn("score_raw", fixed_text(F.col("overall"), 2))
        .drop("_means")
    )


def windowed_mean(performances: DataFrame, marks: DataFrame, snapshot: Sequence[str] = ()) -> DataFrame:
    """Mean pass rate from the default start mark to the last mark, else over all dates.

    ``performances`` has ``model_raw, mark, pass_rate``; marks are the distinct
    dates.  Both are taken snapshot by snapshot where ``snapshot`` names its
    columns.  Only marks are ordered, and there are few of them.
    """
    keys = list(snapshot) or ["_one"]
    if not snapshot:
        performances, marks = performances.withColumn("_one", F.lit(1)), marks.withColumn("_one", F.lit(1))
    ordered = marks.groupBy(*keys).agg(F.array_sort(F.collect_set("mark")).alias("m"))
    n = F.size("m")
    opening = F.when(n > MANY_MARKS, F.get("m", F.least(F.lit(LATE_MARK - 1), n))).when(
        n > SOME_MARKS, F.get("m", F.lit(EARLY_MARK - 1))
    ).otherwise(F.get("m", F.lit(0)))
    # A default start behind the last mark leaves the window open at its start; the end stays.
    window = ordered.select(*keys, opening.alias("start"), F.get("m", n - 1).alias("end"))
    rate = F.col("pass_rate").cast("decimal(28,6)")
    # Without marks every row counts.
    inside = F.col("end").isNull() | ((F.col("start").isNull() | (F.col("mark") >= F.col("start"))) & (F.col("mark") <= F.col("end")))
    return (
        performances.join(window, keys, "left")
        .groupBy(*keys, "model_raw")
        .agg(
            F.sum(F.when(inside, rate)).alias("in_sum"),
            F.count(F.when(inside, rate)).alias("in_n"),
            F.count_if(inside).alias("in_rows"),
            F.sum(rate).alias("all_sum"),
            F.count(rate).alias("all_n"),
        )
        .select(
            *snapshot,
            "model_raw",
            F.when(F.col("in_rows") > 0, F.col("in_sum").cast("double") / F.col("in_n"))
            .otherwise(F.col("all_sum").cast("double") / F.col("all_n"))
            .alias("mean_rate"),
        )
        .where(F.col("mean_rate").isNotNull())
        .withColumn("score_raw", fixed_text(F.col("mean_rate"), 1))
    )


def prefix_map_mean(records: DataFrame, prefix: str = "pass_", snapshot: Sequence[str] = ()) -> DataFrame:
    """Mean of the numeric entries with a name prefix in ``results[domain][name]``, by snapshot and model."""
    entries = (
        records.select(*snapshot, "model_raw", F.explode("results").alias("domain", "metrics"))
        .select(*snapshot, "model_raw", F.explode("metrics").alias("metric", "value"))
        .where(F.col("metric").startswith(prefix))
        .withColumn("value", F.col("value").try_cast("double"))
        .where(F.col("value").isNotNull())
    )
    total = F.sum(F.col("value").cast("decimal(28,9)")).cast("double")
    return (
        entries.groupBy(*snapshot, "model_raw")
        .agg((total / F.count(F.lit(1))).alias("mean_rate"), F.count(F.lit(1)).alias("n"))
        .withColumn("score_raw", fixed_text(F.col("mean_rate"), 4))
    )


def accuracy_per_model(problems: DataFrame, snapshot: Sequence[str] = ()) -> DataFrame:
    """Share of correct answers per snapshot and model with the number of scored problems."""
    scored = problems.where(
        (F.coalesce("model_raw", F.lit("")) != "") & F.col("correct").try_cast("double").isNotNull()
    )
    total = F.sum(F.col("correct").cast("decimal(28,6)")).cast("double")
    return (
        scored.groupBy(*snapshot, "model_raw")
        .agg((total / F.count(F.lit(1))).alias("accuracy"), F.count(F.lit(1)).alias("num_problems"))
        .withColumn("score_raw", fixed_text(F.col("accuracy"), 4))
    )


def register_extractor(name: str, fn, schema: str, known: dict) -> None:
    """Add a page parser; ``fn`` maps an iterator of pandas batches to another."""
    if name in known:
        raise ValueError(f"extractor {name} is already registered")
    known[name] = (fn, schema)


def run_extractor(snapshots: DataFrame, name: str, known: dict) -> DataFrame:
    """Apply a registered parser to the snapshots of its parser group."""
    fn, schema = known[name]
    return snapshots.where(F.col("parser_name") == name).mapInPandas(fn, schema)
