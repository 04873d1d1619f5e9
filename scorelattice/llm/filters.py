"""How filters overlap when they are applied one after another (operator 11).

Every filter has a relation of failing ids, stored once.  A filter that comes
after a set of others (its prefix) removes the ids of its own relation that no
relation of the prefix holds: a left-anti join.  A left-semi join with the same
relations gives what the prefix had removed already, and a left-semi join with
the ids of a label gives what is lost of it.  A prefix is a set, so all orders of
five filters need 16 prefixes of each filter, not 120 orders.  Rows are shuffled
by id once; the prefixes are made behind that shuffle and the joins compare sets
of filters as bits.

Copies of a text: the smallest id of each text is found with a shuffled minimum.
Texts that more than a thousandth of all rows share are at most a thousand and
are joined by broadcast, the rest by shuffle, so no text makes a hot task.  Rows
that repeat id, text and part are one row with a count.

Defined results: null text is the empty text; a null id fails no comparison of
ids, makes no other row fail and has no label; rows that repeat an id are judged
each by their own text; a null part is the empty part; ids with several label
rows have each label that one of them gives; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_dir, staged
from .common import NO_ID, whole_text

#: Texts with more copies than this share of all rows are joined by broadcast.
HOT_SHARE = 1000
COPIES = "E"


def conditions(text: str) -> dict[str, Column]:
    """The failure conditions on a text column without nulls, by letter."""
    t = F.col(text)
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 10 * F.char_length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, filters, part: str) -> DataFrame:
    """Rows (part, id, body, letters, m): filters that the rows fail, equal rows counted."""
    texts = docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("id"), whole_text().alias("text")
    )
    failed = F.array_compact(F.array(*[F.when(c, F.lit(letter)) for letter, c in filters("text").items()]))
    rows = texts.select("part", "id", F.unhex(F.sha2("text", 256)).alias("body"), F.array_join(failed, "").alias("letters"))
    return rows.groupBy("part", "id", "body", "letters").agg(F.count(F.lit(1)).alias("m"))


def later_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with the letter of copies added where a smaller id has the same text."""
    spread = rows.groupBy("body").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.sum("m").alias("n"))
    least = staged(spread.where("least < most"))
    total = rows.agg(F.sum("m")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    # At most HOT_SHARE rows can each hold more than that share of all rows.
    few = F.broadcast(least.where(hot).select(F.col("body").alias("b1"), F.col("least").alias("hot_least")))
    rest = least.where(~hot).select(F.col("body").alias("b2"), F.col("least").alias("cold_least"))
    named = rows.join(few, F.col("body") == F.col("b1"), "left")
    cold = named.where("b1 IS NULL").join(rest, F.col("body") == F.col("b2"), "left")
    found = named.where("b1 IS NOT NULL").withColumn("first", F.col("hot_least")).unionByName(
        cold.withColumn("first", F.col("cold_least")).drop("b2", "cold_least")
    )
    letters = F.concat("letters", F.when(F.col("id") > F.col("first"), F.lit(COPIES)).otherwise(F.lit("")))
    return found.select("part", "id", "body", letters.alias("letters"), "m")


def failing_ids(docs: DataFrame, filters=conditions, part: str = "lang", copies: bool = True) -> tuple[DataFrame, DataFrame]:
    """The stored relations (filter, id, own, part, m), a folder for each filter, and the rows of each part.

    ``own`` is a hash of text and part: it tells rows apart that repeat an id.
    """
    rows = staged(judged(docs, filters, part))
    totals = rows.groupBy("part").agg(F.sum("m").alias("total"))
    marked = later_copies(rows) if copies else rows
    named = marked.where("letters <> ''").select(
        F.explode(F.split("letters", "")).alias("filter"),
        F.coalesce("id", F.lit(NO_ID)).alias("id"), F.xxhash64("body", "part").alias("own"), "part", "m",
    ).where("filter <> ''")
    home = f"{shared_dir(docs.sparkSession)}/failing-{uuid.uuid4().hex}"
    named.write.partitionBy("filter").parquet(home)
    return docs.sparkSession.read.schema(named.schema).parquet(home), totals


def removals(fails: DataFrame, labels: DataFrame, letters: str, wanted: dict[str, Column]) -> DataFrame:
    """Rows (part, filter, prefix, kind, removed, redundant) for every set of other filters before a filter.

    ``kind`` is ``all`` or the name of a label; a prefix is a sum of bits.
    """
    bit = F.expr(f"shiftleft(1, instr('{letters}', filter) - 1)")
    rows = fails.withColumn("bit", bit)
    kinds = [rows.withColumn("kind", F.lit("all"))]
    for name, condition in wanted.items():
        ids = labels.where(condition & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id")).distinct()
        kinds.append(rows.join(ids, "id", "left_semi").withColumn("kind", F.lit(name)))
    asked = kinds[0]
    for more in kinds[1:]:
        asked = asked.unionByName(more)
    every = F.sequence(F.lit(0), F.lit(2 ** len(letters) - 1))
    asked = asked.repartition("id", "own").withColumn("prefix", F.explode(every)).where(F.col("prefix").bitwiseAND(F.col("bit")) == 0)
    gone = rows.select(F.col("id").alias("gone_id"), F.col("own").alias("gone_own"), F.col("bit").alias("gone_bit"))
    before = (
        (F.col("id") == F.col("gone_id")) & (F.col("own") == F.col("gone_own"))
        & (F.col("prefix").bitwiseAND(F.col("gone_bit")) != 0)
    )
    keys = ["part", "filter", "prefix", "kind"]
    removed = asked.join(gone.hint("merge"), before, "left_anti").groupBy(*keys).agg(F.sum("m").alias("removed"), F.lit(0).cast("long").alias("redundant"))
    redundant = asked.where("kind = 'all'").join(gone.hint("merge"), before, "left_semi").groupBy(*keys).agg(
        F.lit(0).cast("long").alias("removed"), F.sum("m").alias("redundant")
    )
    return removed.unionByName(redundant).groupBy(*keys).agg(F.sum("removed").alias("removed"), F.sum("redundant").alias("redundant"))


def interactions(docs: DataFrame, labels: DataFrame, filters=conditions, part: str = "lang") -> DataFrame:
    """One row per part, order of all filters and step, see the columns below.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    """
    letters = "".join(filters("text")) + COPIES
    fails, totals = failing_ids(docs, filters, part)
    counts = staged(removals(fails, labels, letters, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}))
    of = lambda kind, column: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0)).alias
    steps = counts.groupBy("part", "filter", "prefix").agg(
        of("all", "removed")("removed"), of("all", "redundant")("redundant"), of("good", "removed")("good_lost"), of("toxic", "removed")("toxic_lost")
    )
    alone = F.expr(f"{2 ** len(letters) - 1} - shiftleft(1, instr('{letters}', filter) - 1)")
    only = counts.where((F.col("kind") == "all") & (F.col("prefix") == alone)).select("part", "filter", F.col("removed").alias("unique_fails"))

    orders = ",".join("".join(p) for p in permutations(letters))
    grid = totals.select("part", "total", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    earlier = sum((F.when(F.instr("filter_order", x) < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(letters)), F.lit(0))
    grid = grid.withColumns({"filter": F.expr("substring(filter_order, step, 1)"), "prefix": earlier})
    full = grid.join(steps, ["part", "filter", "prefix"], "left").join(only, ["part", "filter"], "left")
    full = full.fillna(0, ["removed", "redundant", "good_lost", "toxic_lost", "unique_fails"])
    # Orders and steps are a fixed number for each part.
    worth = full.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    gone = full.groupBy("part", "filter_order").agg(F.array_sort(F.collect_list(F.struct("step", "removed"))).alias("way"))
    so_far = F.aggregate(F.filter("way", lambda w: w["step"] <= F.col("step")), F.lit(0).cast("long"), lambda s, w: s + w["removed"])
    return (
        full.join(worth, ["part", "filter"]).join(gone, ["part", "filter_order"])
        .select(
            "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - so_far).alias("kept"),
            "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
        )
    )
