"""Digests, reconciles and integrity checks over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.digests import derived_id, row_text, typed_text
from ..functions.rules import first_failure
from ..session import staged
from .ordering import sequential_position

_LIMBS = 4
_LIMB_DIGITS = 15
# Limbs are added up in pieces of so many bits, whose sums stay within 64 bits up to 2^43 rows.
_PIECE_BITS, _PIECES = 20, 3


def _limb(digest: Column, i: int) -> Column:
    """Fifteen hex digits of a row digest as an exact number."""
    part = F.substring(digest, 1 + i * _LIMB_DIGITS, _LIMB_DIGITS)
    return F.conv(part, 16, 10).cast("long")


def _piece(limb: str, k: int) -> Column:
    return F.shiftright(limb, k * _PIECE_BITS).bitwiseAND(F.lit(2**_PIECE_BITS - 1))


def _limb_sum(i: int) -> Column:
    """The sum of a limb from those of its pieces."""
    parts = [F.col(f"_s{i}_{k}").cast("decimal(19,0)") * F.lit(2 ** (k * _PIECE_BITS)).cast("decimal(13,0)") for k in range(_PIECES)]
    return F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0)).cast("decimal(38,0)")


def multiset_digest(
    df: DataFrame, groups: Sequence[str], line: Column, count: str = "row_count", digest: str = "digest"
) -> DataFrame:
    """Digest of the rows of each group that ignores order and keeps multiplicity.

    Row digests are added up limb by limb, an additive multiset hash: addition
    commutes, so partial sums merge in any order and no group's rows are ever
    gathered or sorted.
    """
    hashed = df.select(*groups, F.sha2(line, 256).alias("_h"))
    limbs = hashed.select(*groups, *[_limb(F.col("_h"), i).alias(f"_l{i}") for i in range(_LIMBS)])
    sums = limbs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias(count),
        *[F.sum(_piece(f"_l{i}", k)).alias(f"_s{i}_{k}") for i in range(_LIMBS) for k in range(_PIECES)],
    )
    parts = [_limb_sum(i).cast("string") for i in range(_LIMBS)]
    return sums.select(
        *groups, count, F.sha2(F.concat_ws(":", F.col(count), *parts), 256).alias(digest)
    )


def real_text(value: Column) -> Column:
    """Exact text of a double: sign, binary exponent and 52-bit mantissa.

    Decimal spellings differ between engines; scaling by powers of two is exact
    in all of them.  NaN, the infinities and negative zero are spelled apart.
    """
    size = F.abs(value)
    near = F.floor(F.log2(size))
    scaled = size / F.pow(F.lit(2.0), near)
    # The logarithm may miss by one next to a power of two.
    exponent = near + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    mantissa = F.when(scaled >= 2, scaled / 2).when(scaled < 1, scaled * 2).otherwise(scaled)
    digits = (mantissa * F.lit(2.0**52)).cast("long").cast("string")
    sign = F.when(value < 0, "-").otherwise("+")
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(value == 0, F.when(value.cast("string") == "-0.0", "-0").otherwise("+0"))
        .when(value.isNotNull(), F.concat(sign, exponent.cast("long").cast("string"), F.lit("p"), digits))
    )


def row_line(df: DataFrame) -> Column:
    """Canonical typed text of a row of a schema of plain values and arrays of numbers."""
    cells = {}
    for field in df.schema:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            cells[field.name] = typed_text("real", real_text(column.cast("double")))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            each = F.transform(column.cast("array<double>"), lambda x: F.coalesce(real_text(x), F.lit("∅")))
            cells[field.name] = typed_text("reals", F.array_join(each, ";"))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            cells[field.name] = typed_text("time", F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        elif isinstance(kind, T.BooleanType):
            cells[field.name] = typed_text("bool", column)
        elif isinstance(kind, T.StringType):
            cells[field.name] = typed_text("text", column)
        else:
            cells[field.name] = typed_text("int", column)
    return row_text(cells)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, columns, row count and rowset digest of each table."""
    parts = [
        multiset_digest(df, [], row_line(df)).select(
            F.lit(name).alias("table_name"), F.lit(",".join(sorted(df.columns))).alias("columns"),
            "row_count", "digest",
        )
        for name, df in sorted(tables.items())
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def inventory_digest(inventory: DataFrame) -> DataFrame:
    """One digest for the whole inventory."""
    line = F.concat_ws("|", "table_name", "columns", "row_count", "digest")
    return multiset_digest(inventory, [], line, "tables", "digest")


def compare_inventories(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Fields in which two inventories differ, one row each."""
    fields = ("columns", "row_count", "digest")
    e = expected.select("table_name", *[F.col(f).cast("string").alias(f"e_{f}") for f in fields])
    o = observed.select("table_name", *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("e"), F.col(f"o_{f}").alias("o")) for f in fields]
        )
    )
    return (
        e.join(o, "table_name", "full")
        .select("table_name", pairs.alias("p"))
        .where(~F.col("p.e").eqNullSafe(F.col("p.o")))
        .select("table_name", "p.field", F.col("p.e").alias("expected"), F.col("p.o").alias("observed"))
    )


def reconcile_references(listed: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored objects against references: present, orphan, missing or substituted.

    Both have ``key, digest``; keys are unique on each side.  A digest may be
    absent: what is on a side is told by its key, and only two digests can differ.
    """
    ls = listed.select("key", F.col("digest").alias("l"), F.lit(True).alias("in_l"))
    rs = referenced.select("key", F.col("digest").alias("r"), F.lit(True).alias("in_r"))
    verdict = (
        F.when(F.col("in_r").isNull(), "orphan").when(F.col("in_l").isNull(), "missing")
        .when(F.col("l") != F.col("r"), "substituted").otherwise("present")
    )
    return ls.join(rs, "key", "full").select("key", verdict.alias("verdict"))


def orphan_count(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def id_divergence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side they are on."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_left = a.join(b, key, "left_anti").select(key, F.lit("left_only").alias("side"))
    return only_left.unionByName(b.join(a, key, "left_anti").select(key, F.lit("right_only").alias("side")))


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return id_divergence(left, right, key).agg((F.count(F.lit(1)) == 0).alias("equal"))


def mark_repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``conflicted`` true where their id occurs more than once."""
    counts = rows.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("conflicted"))
    return rows.join(counts, key)


def registry_classes(rows: DataFrame) -> DataFrame:
    """Registry rows as accounted or the first reason they are not."""
    issue = first_failure(
        [
            (F.col("stable_id").isNull() | (F.trim("stable_id") == ""), "REGISTRY_ID_INVALID"),
            (F.col("aliases").isNull(), "REGISTRY_ALIASES_INVALID"),
            (F.col("conflicted"), "DUPLICATE_REGISTRY_ID"),
        ]
    )
    return rows.withColumn("issue", issue).withColumn(
        "disposition",
        F.when(issue.isNull(), "accounted").when(F.col("conflicted") & (issue == "DUPLICATE_REGISTRY_ID"), "conflicted").otherwise("invalid"),
    )


def alias_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "stable_id", "disposition", F.posexplode("aliases").alias("alias_index", "alias_text")
    )


def reconcile_universe(
    benchmarks: DataFrame, sources: DataFrame, universe_benchmarks: DataFrame, universe_sources: DataFrame
) -> DataFrame:
    """Registry rows against the declared universe, and the universe's own gaps.

    ``benchmarks``: stable_id.  ``sources``: stable_id, benchmark_id, status.
    The universe adds coverage_status and reason_code (and, for sources, what
    it holds their benchmark and status to be).
    """
    def universe(df: DataFrame, *columns: str) -> DataFrame:
        # Ids listed more than once are one row with a count.
        return df.groupBy("stable_id").agg(
            F.count(F.lit(1)).alias("listed"),
            *[F.min(c).alias(f"u_{c}") for c in ("coverage_status", "reason_code", *columns)],
        )

    def counted(df: DataFrame) -> DataFrame:
        n = df.groupBy("stable_id").agg(F.count(F.lit(1)).alias("rows"))
        return df.join(n, "stable_id")

    repeated = F.col("rows") > 1
    b = counted(benchmarks).join(universe(universe_benchmarks), "stable_id", "left")
    b_reason = first_failure(
        [
            (repeated, "DUPLICATE_REGISTRY_ID"),
            (F.col("listed").isNull(), "REGISTRY_BENCHMARK_OUTSIDE_UNIVERSE"),
            (F.col("listed") > 1, "DUPLICATE_UNIVERSE_ID"),
        ]
    )
    b = b.withColumn("problem", b_reason)
    valid = b.where("problem is null").select(F.col("stable_id").alias("benchmark_id"), F.lit(True).alias("valid"))
    known = benchmarks.select(F.col("stable_id").alias("benchmark_id"), F.lit(True).alias("known")).distinct()
    s = (
        counted(sources)
        .join(universe(universe_sources, "benchmark_id", "status"), "stable_id", "left")
        .join(valid, "benchmark_id", "left")
        .join(known, "benchmark_id", "left")
    )
    s_reason = first_failure(
        [
            (repeated, "DUPLICATE_REGISTRY_ID"),
            (F.col("known").isNull(), "SOURCE_REFERENCES_UNKNOWN_BENCHMARK"),
            (F.col("valid").isNull(), "SOURCE_REFERENCES_BENCHMARK_OUTSIDE_UNIVERSE"),
            (F.col("listed").isNull(), "REGISTRY_SOURCE_OUTSIDE_UNIVERSE"),
            (F.col("listed") > 1, "DUPLICATE_UNIVERSE_ID"),
            (F.col("u_benchmark_id") != F.col("benchmark_id"), "SOURCE_BENCHMARK_REFERENCE_MISMATCH"),
            (F.col("u_status") != F.col("status"), "SOURCE_REGISTRY_STATUS_MISMATCH"),
        ]
    )
    s = s.withColumn("problem", s_reason)

    def rows(df: DataFrame, kind: str) -> DataFrame:
        outside = F.col("problem").isin("REGISTRY_BENCHMARK_OUTSIDE_UNIVERSE", "REGISTRY_SOURCE_OUTSIDE_UNIVERSE")
        disposition = (
            F.when(F.col("problem").isNull(), F.col("u_coverage_status"))
            .when(outside, "outside_universe").otherwise("conflicted")
        )
        return df.select(
            F.lit(kind).alias("kind"), "stable_id", disposition.alias("disposition"),
            F.coalesce("problem", "u_reason_code").alias("reason_code"),
        )

    def gaps(listed: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
        missing = listed.select("stable_id").distinct().join(registry.select("stable_id"), "stable_id", "left_anti")
        return missing.select(
            F.lit(kind).alias("kind"), "stable_id", F.lit("universe_gap").alias("disposition"),
            F.lit(f"UNIVERSE_{kind.upper()}_MISSING_REGISTRY_ROW").alias("reason_code"),
        )

    return (
        rows(b, "benchmark").unionByName(rows(s, "source"))
        .unionByName(gaps(universe_benchmarks, benchmarks, "benchmark"))
        .unionByName(gaps(universe_sources, sources, "source"))
    )


def pin_differences(observed: DataFrame, pins: DataFrame) -> DataFrame:
    """Counts and digests (``name, value``) that are not what they were pinned to."""
    o = observed.select("name", F.col("value").cast("string").alias("observed"))
    p = pins.select("name", F.col("value").cast("string").alias("pinned"))
    return p.join(o, "name", "full").where(~F.col("observed").eqNullSafe(F.col("pinned")))


def issue_list(issues: Sequence[DataFrame], fields: Sequence[str]) -> DataFrame:
    """All issues once each, keyed by a digest of their fields."""
    union = reduce(lambda a, b: a.unionByName(b), [i.select(*fields) for i in issues])
    return union.distinct().withColumn("issue_id", derived_id("issue", *[F.col(f) for f in fields]))


def census_summary(dispositions: DataFrame) -> DataFrame:
    """Counts per kind and disposition; ready only where nothing is off."""
    bad = F.col("disposition").isin("conflicted", "invalid", "outside_universe", "universe_gap")
    return dispositions.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("off"), (F.count_if(bad) == 0).alias("ready")
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in sorted(tables.items())
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dataset_issues(models: DataFrame, benchmarks: DataFrame, scores: DataFrame) -> DataFrame:
    """Broken rules of a score data set with the number of rows breaking each."""
    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    checks = {
        "MODEL_ID_REPEATED": repeated(models, "model_id"),
        "BENCHMARK_ID_REPEATED": repeated(benchmarks, "benchmark_id"),
        "SCORE_WITHOUT_MODEL": scores.join(models.select("model_id"), "model_id", "left_anti"),
        "SCORE_WITHOUT_BENCHMARK": scores.join(benchmarks.select("benchmark_id"), "benchmark_id", "left_anti"),
        "CELL_REPEATED": repeated(scores, "model_id", "benchmark_id"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n") for code, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def referenced_objects(references: DataFrame) -> DataFrame:
    """Objects some row points at, with the first rule their reference breaks."""
    counts = references.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("references"), F.min("digest").alias("low"), F.max("digest").alias("high")
    )
    issue = first_failure(
        [(F.col("low").isNull(), "DIGEST_MISSING"), (F.col("low") != F.col("high"), "DIGEST_AMBIGUOUS")]
    )
    return counts.select("object_id", "references", issue.alias("issue"))


def declared_count_differences(details: DataFrame, group: str, declared: DataFrame) -> DataFrame:
    """Summary rows (``group, n``) that the detail rows do not bear out."""
    actual = details.groupBy(group).agg(F.count(F.lit(1)).alias("actual"))
    d = declared.select(group, F.col("n").alias("declared"))
    return actual.join(d, group, "full").where(~F.col("actual").eqNullSafe(F.col("declared")))


def target_coverage(targets: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Targets naming unknown benchmarks, and benchmarks no target names."""
    named = targets.select("target_id", F.explode("benchmark_ids").alias("benchmark_id"))
    unknown = named.join(benchmarks.select("benchmark_id"), "benchmark_id", "left_anti").select(
        "benchmark_id", "target_id", F.lit("UNKNOWN_BENCHMARK").alias("issue")
    )
    bare = benchmarks.join(named.select("benchmark_id"), "benchmark_id", "left_anti").select(
        "benchmark_id", F.lit(None).cast(targets.schema["target_id"].dataType).alias("target_id"),
        F.lit("BENCHMARK_WITHOUT_TARGET").alias("issue"),
    )
    return unknown.unionByName(bare)


def comparison_cell_issues(cells: DataFrame, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """Cells naming a metric, split or other dimension value that is not defined."""
    parts = []
    for name, known in dimensions.items():
        values = known.select(F.col("definition_id"), F.col("value").alias(name))
        missing = cells.where(F.col(name).isNotNull()).join(values, ["definition_id", name], "left_anti")
        parts.append(
            missing.select("definition_id", F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value")).distinct()
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def membership_gaps(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs (``left_id, right_id``) that only one of two directions states."""
    f = forward.select("left_id", "right_id").distinct().withColumn("f", F.lit(True))
    b = backward.select("left_id", "right_id").distinct().withColumn("b", F.lit(True))
    return (
        f.join(b, ["left_id", "right_id"], "full")
        .where(F.col("f").isNull() | F.col("b").isNull())
        .select("left_id", "right_id", F.when(F.col("b").isNull(), "forward_only").otherwise("backward_only").alias("side"))
    )


def priority_gaps(routes: DataFrame) -> DataFrame:
    """Owners whose route priorities are not 1..n, each once."""
    per_rank = routes.groupBy("owner", "priority").agg(F.count(F.lit(1)).alias("n"))
    shape = per_rank.groupBy("owner").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("priority").alias("low"), F.max("priority").alias("high")
    )
    ok = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("d") == F.col("n"))
    return shape.where(~ok).select("owner", "n")


#: Rows, or digests, under one node of a digest tree.
FAN = 1024


def ordered_problems(document: DataFrame, place: str, key: Sequence[str]) -> DataFrame:
    """Rows (place, problem) that keep a document from being complete and in strict order.

    ``place`` numbers its rows 1, 2, ...; ``key`` must rise from row to row.  Rows
    are compared within blocks of ``FAN`` places, and the last row of a block
    with the first of the next one, so every row is shuffled once and no task
    holds more than a block.  Problems: ``PLACE_REPEATED``, ``PLACE_MISSING`` (the
    row before a gap is named), ``KEY_REPEATED``, ``KEY_REVERSED``; a missing first
    place is named at place 0.  Null keys come first.
    """
    at, own = F.col("place"), F.struct(*[F.col(k) for k in key])
    counted = document.select(F.col(place).cast("long").alias("place"), own.alias("key")).groupBy("place").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")
    )
    rows = counted.withColumn("block", F.floor((at - 1) / FAN))
    order = Window.partitionBy("block").orderBy("place")
    within = rows.select("*", F.lead("place").over(order).alias("next_place"), F.lead("low").over(order).alias("next_low"), F.row_number().over(order).alias("i"))
    inner = staged(within)
    # The first row of the next block that has rows follows the last one of a block.
    heads = inner.where("i = 1").select("block", F.col("place").alias("head"), F.col("low").alias("head_low"))
    numbered = staged(sequential_position(heads, [], [F.col("block")], "no"))
    onward = numbered.select((F.col("no") - 1).alias("no"), "head", "head_low")
    following = numbered.select("block", "no").join(onward, "no", "left").drop("no")
    last = F.col("next_place").isNull()
    joined = inner.join(following, "block").select(
        "place", "n", "high", F.when(last, F.col("head")).otherwise(F.col("next_place")).alias("then"),
        F.when(last, F.col("head_low")).otherwise(F.col("next_low")).alias("then_low"),
    )
    followed = F.col("then").isNotNull()
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, "PLACE_REPEATED"), F.when(followed & (F.col("then") > at + 1), "PLACE_MISSING"),
            F.when(followed & (F.col("high") == F.col("then_low")), "KEY_REPEATED"), F.when(followed & (F.col("high") > F.col("then_low")), "KEY_REVERSED"),
        )
    )
    start = inner.agg(F.min("place").alias("first")).where("first <> 1").select(F.lit(0).cast("long").alias("place"), F.lit("PLACE_MISSING").alias("problem"))
    return joined.select("place", F.explode(problems).alias("problem")).unionByName(start)


def digest_nodes(document: DataFrame, place: str, text: Column) -> tuple[int, int, DataFrame]:
    """Rows, levels and root (at, digest) of the digest tree over the rows' texts in their order.

    Each node is the digest of up to ``FAN`` digests below it, so no task joins
    more than that, and a document that was digested before can be compared node by
    node.  The tree grows until one node is left; without rows there is none.
    """
    level = staged(document.select((F.col(place).cast("long") - 1).alias("at"), F.sha2(text, 256).alias("digest")))
    rows, levels = level.count(), 0
    while True:
        nodes = level.groupBy(F.floor(F.col("at") / FAN).alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("parts"))
        level = staged(nodes.select(F.col("node").alias("at"), F.sha2(F.array_join("parts.digest", ""), 256).alias("digest")))
        levels += 1
        if level.count() <= 1:
            break
    return rows, levels, level


def ordered_digest(document: DataFrame, place: str, text: Column) -> DataFrame:
    """(rows, levels, digest): a digest of the rows' texts in their order, the root of their tree."""
    rows, levels, root = digest_nodes(document, place, text)
    return root.select(F.lit(rows).cast("long").alias("rows"), F.lit(levels).cast("long").alias("levels"), "digest")
