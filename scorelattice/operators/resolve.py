"""Free-text names to registered entities, first matching tier wins.

Both sides are reduced before they meet: mentions to distinct texts, aliases to
one row per (tier, key) holding the smallest and largest entity id.  Two
different ids there already mean the key is ambiguous, so a key shared by any
number of entities costs one row and no pair is ever spelled out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import first_failure
from ..functions.text import alias_key

# Tiers in order of strength.
DECLARED, EXACT, CASELESS, NORMAL, BY_ID, BY_NAME, BY_NORMAL_NAME = range(7)


def live_aliases(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """Aliases whose target exists."""
    return aliases.join(entities.select("entity_id"), "entity_id", "left_semi")


def _keys(tiers: Sequence[tuple[int, Column]]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in tiers])
    )


def _index(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("key").isNotNull())
        .groupBy("tier", "key")
        .agg(F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))
    )


def tier_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(tier, key) -> lowest and highest entity id`` over aliases and names."""
    text = F.col("alias_text")
    from_aliases = live_aliases(aliases, entities).select(
        "entity_id", _keys([(EXACT, text), (CASELESS, F.lower(text)), (NORMAL, alias_key(text))]).alias("k")
    )
    names = (F.col("canonical_name"), F.col("display_name"))
    from_names = entities.select(
        "entity_id",
        _keys(
            [(BY_ID, F.col("entity_id"))]
            + [(BY_NAME, F.lower(n)) for n in names]
            + [(BY_NORMAL_NAME, alias_key(n)) for n in names]
        ).alias("k"),
    )
    return _index(from_aliases.unionByName(from_names).select("entity_id", "k.*"))


def resolve(mentions: DataFrame, index: DataFrame, raw: str = "raw", declared: str | None = None) -> DataFrame:
    """Mentions with ``tier, status, entity_id``; never picks among several.

    ``declared`` names a column with an id the source itself states, which is
    tried before everything else.
    """
    identity = [raw] if declared is None else [raw, declared]
    distinct = mentions.select(*identity).distinct()
    text = F.coalesce(F.col(raw), F.lit(""))
    usable = text != ""

    def given(key: Column) -> Column:
        return F.when(usable, key)

    tiers = [
        (EXACT, given(text)), (CASELESS, given(F.lower(text))), (NORMAL, given(alias_key(text))),
        (BY_ID, given(text)), (BY_NAME, given(F.lower(text))), (BY_NORMAL_NAME, given(alias_key(text))),
    ]
    if declared is not None:
        tiers.insert(0, (DECLARED, F.col(declared)))
        own_ids = index.where(F.col("tier") == BY_ID).withColumn("tier", F.lit(DECLARED))
        index = index.unionByName(own_ids)
    hits = (
        distinct.select(*identity, _keys(tiers).alias("k"))
        .select(*identity, "k.*")
        .where(F.col("key").isNotNull())
        .join(index, ["tier", "key"])
    )
    best = hits.groupBy(*identity).agg(F.min_by(F.struct("tier", "low", "high"), "tier").alias("b"))
    unique = F.col("b.low") == F.col("b.high")
    keys = [F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")) for c in identity]
    joined = mentions.alias("m").join(best.alias("r"), keys, "left")
    return joined.select(
        "m.*",
        F.col("b.tier").alias("tier"),
        F.when(F.col("b").isNull(), "unmatched").when(unique, "matched").otherwise("ambiguous").alias("status"),
        F.when(unique, F.col("b.low")).alias("entity_id"),
    )


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Alias keys shared by two or more entities, exact and normalised.

    A key's entities are counted rather than listed; ``collision_members``
    lists them one row each.
    """
    return _collision_keys(aliases).groupBy("match_kind", "match_key").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.min("entity_id").alias("first_entity"),
        F.max("entity_id").alias("last_entity"),
    ).where("n_entities > 1")


def _collision_keys(aliases: DataFrame) -> DataFrame:
    kinds = F.explode(
        F.array(
            F.struct(F.lit("exact").alias("match_kind"), F.col("alias_text").alias("match_key")),
            F.struct(F.lit("normalized").alias("match_kind"), alias_key(F.col("alias_text")).alias("match_key")),
        )
    )
    return aliases.select("entity_id", kinds.alias("k")).select("k.*", "entity_id").distinct()


def collision_members(aliases: DataFrame) -> DataFrame:
    keys = _collision_keys(aliases)
    return keys.join(
        alias_collisions(aliases).select("match_kind", "match_key"), ["match_kind", "match_key"], "left_semi"
    )


def merge_catalogs(catalogs: DataFrame) -> DataFrame:
    """Entries of several catalogs by normalised name: kinds and id counts.

    ``catalogs`` is a union with ``kind, entry_id, name``; there are few kinds.
    """
    per_kind = (
        catalogs.withColumn("key", alias_key(F.col("name")))
        .where(F.col("key") != "")
        .groupBy("key", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first_id"))
    )
    return per_kind.groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"),
        F.sum("n").alias("n"),
        F.min("first_id").alias("first_id"),
    )


def known_candidates(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates already registered, with how many registry parts list them."""
    parts = registry.groupBy("entity_id").agg(F.count_distinct("part").alias("parts"))
    return candidates.join(parts, "entity_id")


def unblocked(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """All candidates if none is registered yet, otherwise none."""
    clashes = known_candidates(candidates, registry).agg(F.count(F.lit(1)).alias("n")).scalar()
    return candidates.where(clashes == 0)


def project_candidates(candidates: DataFrame) -> DataFrame:
    """Registry rows for ``owner/name`` ids: derived names and an alias list."""
    short = F.element_at(F.split("candidate_id", "/"), -1)
    canonical = F.coalesce("canonical_name", short)
    display = F.coalesce("display_name", canonical)
    aliases = F.array_sort(F.array_distinct(F.array(F.col("candidate_id"), short, canonical, display)))
    return candidates.select(
        F.regexp_replace(F.lower("candidate_id"), "[^a-z0-9]+", "-").alias("entity_id"),
        canonical.alias("canonical_name"),
        display.alias("display_name"),
        F.coalesce("provider", F.get(F.split("candidate_id", "/"), F.lit(0))).alias("provider"),
        aliases.alias("aliases"),
    )


def collision_fact_issues(decisions: DataFrame) -> DataFrame:
    """Identity decisions whose collision facts contradict their outcome."""
    status, priority = F.col("collision_status"), F.col("matching_priority")
    quiet = (priority == "none") & (F.col("n_conflicting") == 0) & F.col("collision_reason").isNull()
    named = F.concat(priority, F.lit("_collision")) == status
    closed = F.col("outcome").isin("unresolved", "rejected") & F.col("selected_id").isNull()
    action = F.col("action")
    issue = first_failure(
        [
            ((status == "none") & ~quiet, "COLLISION_FACTS_NOT_EMPTY"),
            ((status != "none") & ~named, "COLLISION_PRIORITY_MISMATCH"),
            ((status != "none") & (F.col("n_conflicting") < 2), "COLLISION_SUBJECTS_MISSING"),
            ((status != "none") & F.col("collision_reason").isNull(), "COLLISION_REASON_MISSING"),
            ((status != "none") & ~closed, "COLLISION_NOT_AMBIGUOUS"),
            ((status != "none") & ~action.isin("no_alias", "reject_alias"), "COLLISION_ALIAS_ADDED"),
            ((F.col("outcome") == "resolved") & (action != "add_scoped_alias"), "RESOLVED_WITHOUT_ALIAS"),
            ((F.col("outcome") == "unresolved") & (action != "no_alias"), "UNRESOLVED_WITH_ALIAS"),
            ((F.col("outcome") == "rejected") & (action != "reject_alias"), "REJECTED_WITHOUT_REJECTION"),
        ]
    )
    return decisions.withColumn("issue", issue)
