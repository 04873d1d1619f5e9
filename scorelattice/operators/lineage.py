"""Append-only decision chains held as parent pointers.

Every check is a join on a unique id or a mergeable aggregate per entity, so a
chain with most of all rows is as cheap per row as a short one.  Only
``chain_depths`` and ``cyclic_edges`` iterate, by doubling.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import first_failure
from ..session import staged


def with_parent(rows: DataFrame, parent: str, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Rows with their parent's columns as ``p_*`` and ``has_parent``; as many rows as before.

    An id that several rows have gives one parent, its least row.
    """
    least = rows.groupBy(F.col(row_id).alias("_pid")).agg(F.min(F.struct(*columns)).alias("_p"))
    parents = least.select("_pid", F.lit(True).alias("has_parent"), *[F.col(f"_p.{c}").alias(f"p_{c}") for c in columns])
    return rows.join(parents, F.col(parent) == F.col("_pid"), "left").drop("_pid").withColumn(
        "has_parent", F.coalesce("has_parent", F.lit(False))
    )


def effective_leaves(decisions: DataFrame) -> DataFrame:
    """One row per entity: its effective decision, or why there is none.

    ``decisions`` has ``id, entity, parent``.  With a single leaf, the walk to
    the root can only fail to end when the entity has no root at all, so a
    cycle shows in the counts and needs no walk.
    """
    linked = with_parent(decisions, "parent", "id", ["entity"])
    bad = F.col("parent").isNotNull() & (~F.col("has_parent") | (F.col("p_entity") != F.col("entity")))
    superseded = decisions.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    flags = linked.join(superseded.withColumn("_sup", F.lit(True)), "id", "left")
    is_leaf = F.col("_sup").isNull()
    per_entity = flags.groupBy("entity").agg(
        F.count_if(bad).alias("bad"),
        F.count_if(is_leaf).alias("leaves"),
        F.count_if(F.col("parent").isNull()).alias("roots"),
        F.max(F.when(is_leaf, F.col("id"))).alias("leaf"),
    )
    error = first_failure(
        [
            (F.col("bad") > 0, "CHAIN_INVALID"),
            (F.col("leaves") != 1, "CHAIN_AMBIGUOUS"),
            (F.col("roots") == 0, "CHAIN_CYCLE"),
        ]
    )
    return per_entity.select(
        "entity", F.when(error.isNull(), F.col("leaf")).alias("leaf_id"), error.alias("chain_error")
    )


def chain_depths(rows: DataFrame) -> DataFrame:
    """``id, root, depth`` of every row that reaches a root (depth 0 = root).

    Pointer doubling: each round replaces a row's ancestor by that ancestor's
    own, doubling the distance looked at.  Rows in or below a cycle never
    finish and are left out; rounds end when no further row finishes.  Each
    round is stored, so a lost executor repeats one round at most.  Rows that
    repeat an id are one row, with the least parent they name.
    """
    state = rows.groupBy("id").agg(F.min("parent").alias("parent")).select(
        "id",
        F.coalesce("parent", "id").alias("anc"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("parent").isNull().alias("done"),
    )
    # The first round reads the grouping by id as it comes, so nothing is sent by id again.
    known, before = staged(_doubled(state, state).unionByName(state.where("done"))), None
    finished = known.where("done").select("id", "anc", "dist")
    left = known.where("not done").count()
    while left and left != before:
        # Only new rows are written: those that finished stay where they are.
        step = known.where("not done").select("id", "anc", "dist", "done").unionByName(finished.withColumn("done", F.lit(True)))
        known = staged(_doubled(known, step))
        finished = finished.unionByName(known.where("done").select("id", "anc", "dist"))
        before, left = left, known.where("not done").count()
    return finished.select("id", F.col("anc").alias("root"), F.col("dist").alias("depth"))


def _doubled(state: DataFrame, step: DataFrame) -> DataFrame:
    """Open rows of ``state`` with the ancestor of their ancestor in ``step``."""
    onward = step.select(
        F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2")
    )
    return state.where("not done").join(onward, "anc").select(
        "id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done")
    )


def project_sparse(decisions: DataFrame, depths: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Latest stated value of each field per entity: the deepest non-null one."""
    placed = decisions.join(depths.select("id", "depth"), "id")
    return placed.groupBy("entity").agg(
        *[
            F.max_by(f, F.when(F.col(f).isNotNull(), F.col("depth"))).alias(f)
            for f in fields
        ],
        F.max("depth").alias("depth"),
    )


def project_identity(
    claims: DataFrame, decisions: DataFrame, depths: DataFrame, leaves: DataFrame, fields: Sequence[str]
) -> DataFrame:
    """Claims with each field as reviewed, else as captured; none on a broken chain."""
    reviewed = project_sparse(decisions, depths, fields)
    joined = (
        claims.alias("c")
        .join(leaves.alias("l"), F.col("c.claim_id") == F.col("l.entity"), "left")
        .join(reviewed.alias("r"), F.col("c.claim_id") == F.col("r.entity"), "left")
    )
    usable = F.col("l.chain_error").isNull()
    return joined.select(
        "c.claim_id",
        *[F.when(usable, F.coalesce(f"r.{f}", f"c.{f}")).alias(f) for f in fields],
        F.col("l.leaf_id").alias("leaf_id"),
        F.col("l.chain_error").alias("chain_error"),
    )


def lineage_audit(
    rows: DataFrame,
    family: str,
    sequence: str | None = None,
    time: str | None = None,
    state: tuple[str, str] | None = None,
    strict_time: bool = False,
    depths: DataFrame | None = None,
) -> DataFrame:
    """Counts of rows, roots, leaves and each kind of violation of one family.

    ``rows`` has ``id, entity, parent``; ``state`` names the columns holding
    the state before and after.  Pass ``depths`` to count rows off any root.
    """
    extra = [c for c in {sequence, time, *(state or ())} if c]
    linked = with_parent(rows, "parent", "id", ["entity", *extra])
    child, orphan = F.col("parent").isNotNull(), F.col("parent").isNotNull() & ~F.col("has_parent")
    checks: dict[str, Column] = {
        "missing_parents": orphan | (F.col("parent") == F.col("id")),
        "crossed_entities": F.col("has_parent") & (F.col("p_entity") != F.col("entity")),
    }
    if sequence:
        expected = F.when(child, F.col(f"p_{sequence}") + 1).otherwise(1)
        checks["sequence_gaps"] = ~orphan & (F.col(sequence) != expected)
    if state:
        before = F.when(child, F.col(f"p_{state[1]}"))
        checks["state_breaks"] = ~orphan & ~F.col(state[0]).eqNullSafe(before)
    if time:
        late = F.col(time) <= F.col(f"p_{time}") if strict_time else F.col(time) < F.col(f"p_{time}")
        checks["time_reversals"] = F.col("has_parent") & late
    row_level = linked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("parent").isNull()).alias("roots"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()],
    )
    children = rows.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    branches = children.agg(F.count_if(F.col("n") > 1).alias("branches"))
    repeats = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("repeated_ids")
    )
    childless = rows.join(children.select(F.col("parent").alias("id")), "id", "left_anti")
    shape = (
        rows.groupBy("entity").agg(F.count_if(F.col("parent").isNull()).alias("r"))
        .join(childless.groupBy("entity").agg(F.count(F.lit(1)).alias("l")), "entity", "left")
        .agg(
            F.coalesce(F.sum("l"), F.lit(0)).alias("leaves"),
            F.count_if(F.col("r") != 1).alias("bad_roots"),
            F.count_if(F.coalesce("l", F.lit(0)) != 1).alias("bad_leaves"),
        )
    )
    out = row_level.select(F.lit(family).alias("family"), "*")
    for part in (branches, repeats, shape):
        for name in part.columns:
            out = out.withColumn(name, part.select(name).scalar())
    if depths is not None:
        off = rows.join(depths.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
        out = out.withColumn("off_root", off.scalar())
    return out


def revision_chain_issues(rows: DataFrame) -> DataFrame:
    """Definition revisions against the one they replace, first problem each.

    Columns: ``id, entity, parent, edition, stated_prior_edition, fingerprint,
    change_type, disposition``.
    """
    linked = with_parent(rows, "parent", "id", ["entity", "edition", "fingerprint"])
    same_edition = F.col("edition") == F.col("p_edition")
    same_print = F.col("fingerprint") == F.col("p_fingerprint")
    compatible = F.col("change_type").isin("display_rename", "definition_correction")
    child = F.col("has_parent")
    issue = first_failure(
        [
            (F.col("parent").isNotNull() & ~child, "PRIOR_REVISION_MISSING"),
            (child & (F.col("p_entity") != F.col("entity")), "PRIOR_FAMILY_MISMATCH"),
            (child & ~F.col("stated_prior_edition").eqNullSafe(F.col("p_edition")), "PRIOR_EDITION_MISMATCH"),
            (child & compatible & ~same_print, "COMPATIBLE_CHANGE_ALTERED_IDENTITY"),
            (
                child & (F.col("disposition") == "new_edition_identity") & (same_edition | same_print),
                "NEW_EDITION_REUSED_IDENTITY",
            ),
        ]
    )
    return linked.select("id", "entity", issue.alias("issue"))


def _ends_of_chains(single: DataFrame) -> DataFrame:
    """Rows (node, dst): where the chain of nodes with one edge each ends that ``node`` begins.

    Pointers double, so a chain of n nodes takes log2(n) rounds.  What has not reached an end after that runs in a circle and gets
    itself as its end.
    """
    open_ = staged(single)
    rounds = math.ceil(math.log2(max(open_.count(), 1))) + 1
    for _ in range(rounds):
        onward = open_.select(F.col("node").alias("dst"), F.col("dst").alias("next"))
        walked = staged(open_.join(onward, "dst", "left").select("node", F.coalesce("next", "dst").alias("dst"), F.col("next").isNull().alias("ended")))
        # A node at its end still tells others where that is.
        open_ = walked.select("node", "dst")
        if not walked.where("NOT ended").limit(1).count():
            break
    return walked.select("node", F.when(F.col("ended"), F.col("dst")).otherwise(F.col("node")).alias("dst"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` that lie on, or lead to, a cycle.

    A node with one edge stands or falls with where the edge leads, so chains of
    such nodes are cut out first, by doubling, and edges into them lead to their
    end.  Then edges to nodes without edges go.  This repeats until no edge leads
    to such a node: every node that is left then has a way on for ever.  Chains
    and trees take a logarithmic number of rounds; a graph that is neither takes
    one for each layer of branching nodes that only lead to an end.

    Null ends make no edge; repeated edges count once.
    """
    whole = staged(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    live, cut = whole, []
    while True:
        degree = live.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
        single = degree.where("n = 1 AND src <> dst").select(F.col("src").alias("node"), "dst")
        ends = staged(_ends_of_chains(single))
        cut.append(ends)
        to_end = ends.select(F.col("node").alias("dst"), F.col("dst").alias("end"))
        # Nodes of chains leave the graph; what runs in a circle stays as a loop.
        kept = live.join(ends.select(F.col("node").alias("src")), "src", "left_anti").join(to_end, "dst", "left")
        loops = ends.where("node = dst").select(F.col("node").alias("src"), "dst")
        core = staged(kept.select("src", F.coalesce("end", "dst").alias("dst")).unionByName(loops).distinct())
        going = staged(core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        left = going.count()
        if left == core.count():
            break
        live = going
        if not left:
            break
    alive = going.select(F.col("src").alias("node")).distinct()
    for ends in reversed(cut):
        back = ends.join(alive.select(F.col("node").alias("dst")), "dst", "left_semi").select("node")
        alive = staged(alive.unionByName(back).distinct())
    return whole.join(alive.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def component_issues(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """Resolved base-model components whose target is no base model."""
    kinds = subjects.select(F.col("subject").alias("dst"), F.col("kind").alias("dst_kind"))
    return edges.where(F.col("role") == "base_model").join(kinds, "dst").where(
        F.col("dst_kind") != "base_model"
    )


def cross_lineage_issues(publications: DataFrame, reviews: DataFrame) -> DataFrame:
    """Publications whose review is missing, of another claim, or later."""
    named = reviews.select(
        F.col("id").alias("review_id"), F.col("entity").alias("review_entity"),
        F.col("decided_at").alias("reviewed_at"),
    )
    issue = first_failure(
        [
            (F.col("review_entity").isNull(), "REVIEW_MISSING"),
            (F.col("review_entity") != F.col("entity"), "REVIEW_OF_ANOTHER_CLAIM"),
            (F.col("decided_at") < F.col("reviewed_at"), "PUBLISHED_BEFORE_REVIEW"),
        ]
    )
    return publications.join(named, "review_id", "left").withColumn("issue", issue)
