"""Column functions over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import digests as G, jsonpath as J, scores as S, text as X, timegrid as TG
from ..operators import summary as Y
from . import domain as D
from .registry import query

ANCHOR = 1704067200  # 2024-01-01T00:00:00Z
CADENCE = 12 * 3600


@query(
    """SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key_digest,
    length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key_chars FROM documents"""
)
def alias_key(spark, folder):
    key = X.alias_key(F.col("text"))
    return D.table(spark, folder, "documents").select(
        "doc_id", F.sha2(key, 256).alias("key_digest"), F.length(key).cast("long").alias("key_chars")
    )


@query(
    """SELECT doc_id, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS key_digest FROM documents"""
)
def alias_key_unicode(spark, folder):
    key = X.alias_key_unicode(F.col("text"))
    return D.table(spark, folder, "documents").select("doc_id", F.sha2(key, 256).alias("key_digest"))


_LEXEME = """CASE l_linenumber WHEN 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || '%' WHEN 2 THEN '+' || l_linenumber || '.'
  WHEN 3 THEN '1e400' WHEN 4 THEN '-0.000001e-400' WHEN 5 THEN 'n/a ' || l_partkey WHEN 6 THEN '.' || l_suppkey || 'e-2' ELSE '0.00e0' END"""


def _lexemes(spark, folder):
    n = F.col("l_linenumber")
    lexeme = (
        F.when(n == 1, F.concat(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("%")))
        .when(n == 2, F.concat(F.lit("+"), n, F.lit(".")))
        .when(n == 3, "1e400").when(n == 4, "-0.000001e-400")
        .when(n == 5, F.concat(F.lit("n/a "), "l_partkey"))
        .when(n == 6, F.concat(F.lit("."), "l_suppkey", F.lit("e-2"))).otherwise("0.00e0")
    )
    policy = F.when(F.col("l_returnflag") == "R", "decimal_percent").otherwise("decimal")
    return D.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", lexeme.alias("lexeme"), policy.alias("policy")
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, err AS error,
    CASE WHEN err IS NULL THEN CAST(rtrim(lexeme, '%') AS DOUBLE) END AS score_numeric FROM (
      SELECT *, CASE WHEN (lexeme LIKE '%\\%' ESCAPE '\\') <> (l_returnflag = 'R') THEN 'SCORE_UNIT_UNDECLARED'
        WHEN l_linenumber = 5 THEN 'SCORE_NOT_NUMERIC' WHEN l_linenumber = 3 THEN 'SCORE_NOT_FINITE'
        WHEN l_linenumber = 4 THEN 'SCORE_NOT_REPRESENTABLE' END AS err
      FROM (SELECT *, {_LEXEME} AS lexeme FROM lineitem))"""
)
def strict_numeric(spark, folder):
    return _lexemes(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        X.strict_number_error(F.col("lexeme"), F.col("policy")).alias("error"),
        X.strict_number(F.col("lexeme"), F.col("policy")).alias("score_numeric"),
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(nullif(regexp_extract(replace(replace(
      'about ' || CAST(l_suppkey AS VARCHAR) || ',' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '.5%', '%', ''), ',', ''),
      '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?'), '') AS DOUBLE) AS score_numeric FROM lineitem"""
)
def loose_number(spark, folder):
    text = F.concat(
        F.lit("about "), F.col("l_suppkey").cast("string"), F.lit(","),
        F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit(".5%"),
    )
    return D.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.loose_number(text).alias("score_numeric")
    )


@query(
    r"""SELECT doc_id, sha256('text:' || replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')) AS shown FROM documents"""
)
def visible_text(spark, folder):
    shown = X.visible_text(F.col("text"))
    return D.table(spark, folder, "documents").select("doc_id", F.sha2(shown, 256).alias("shown"))


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type = 'click' AS repeated,
    CASE event_type WHEN 'error' THEN 'EVIDENCE_LOCATOR_INVALID' WHEN 'view' THEN 'EVIDENCE_NOT_FOUND' END AS path_error,
    CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '/k/none' ELSE '/k' END AS pointer,
    event_type IN ('purchase', 'click') AS in_template FROM events"""
)
def json_paths(spark, folder):
    kind = F.col("event_type")
    path = F.when(kind == "error", "$.k..v").when(kind == "view", "$.k.none").otherwise("$.k")
    doc = F.when(
        kind == "click", F.regexp_replace("props", r"\}$", ',"k": 0}')
    ).otherwise(F.col("props"))
    row_path = F.concat(
        F.lit("$.rows["), F.when(kind == "signup", "0").otherwise(""), F.col("event_id") + 1,
        F.when(kind.isin("purchase", "click", "signup"), "].cell").otherwise("]"),
    )
    return D.table(spark, folder, "events").select(
        "event_id",
        J.resolve(F.col("props"), F.lit("$.k")).alias("k"),
        X.has_duplicate_keys(doc).alias("repeated"),
        J.resolve_error(F.col("props"), path).alias("path_error"),
        J.pointer(path).alias("pointer"),
        J.matches_template(row_path, F.lit("$.rows[{row_index}].cell")).alias("in_template"),
    )


@query(
    r"""SELECT page_id, url LIKE 'https://%' AND NOT contains(url, '#') AS as_is,
    NOT contains(url, '#') AS made_secure, false AS with_login, NOT contains(url, '#') AND NOT contains(url, '?page') AS renamed_query
    FROM pages"""
)
def public_urls(spark, folder):
    url = F.col("url")
    secure = F.regexp_replace(url, "^http://", "https://")
    return D.table(spark, folder, "pages").select(
        "page_id",
        X.is_public_https_url(url).alias("as_is"),
        X.is_public_https_url(secure).alias("made_secure"),
        X.is_public_https_url(F.replace(secure, F.lit("https://"), F.lit("https://me:pw@"))).alias("with_login"),
        X.is_public_https_url(F.replace(secure, F.lit("?page"), F.lit("?Api_Key"))).alias("renamed_query"),
    )


@query(
    """SELECT event_id, 'v1.' || rtrim(translate(base64(encode('{"created_at":"' || epoch_us(ts) || '","id":"' || event_id || '"}')), '+/', '-_'), '=') AS cursor,
    CAST(event_id AS VARCHAR) AS back_id, false AS bad_accepted FROM events"""
)
def cursor_round_trip(spark, folder):
    ev = D.spread_table(spark, folder, "events").select(
        "event_id",
        X.visible_cursor(TG.epoch_micros(F.col("ts")).cast("string"), F.col("event_id").cast("string")).alias("cursor"),
    )
    return ev.select(
        "event_id", "cursor",
        X.cursor_fields(F.col("cursor"))["id"].alias("back_id"),
        X.cursor_fields(F.concat("cursor", F.lit("A"))).isNotNull().alias("bad_accepted"),
    )


@query(
    f"""SELECT event_id, CASE WHEN event_type <> 'error' AND d * 86400 + h * 3600 > 0 THEN d * 86400 + h * 3600 END AS seconds,
    s AS slot, {ANCHOR} + s * {CADENCE} AS slot_start FROM (SELECT event_id, event_type, CAST(day(ts) - 1 AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h,
      CAST(epoch_us(ts) // 1000000 - {ANCHOR} AS BIGINT) // {CADENCE} AS s FROM events)"""
)
def slot_at(spark, folder):
    """Durations spelled from each event's day and hour, and its 12-hour slot."""
    ev = D.table(spark, folder, "events")
    spelled = F.concat(
        F.lit("P"), F.dayofmonth("ts") - 1, F.lit("DT"), F.hour("ts"), F.lit("H"),
        F.when(F.col("event_type") == "error", "H").otherwise(""),
    )
    slot = TG.slot_ordinal(TG.epoch_seconds(F.col("ts")), ANCHOR, CADENCE)
    return ev.select(
        "event_id", TG.duration_seconds(spelled).alias("seconds"), slot.alias("slot"),
        TG.slot_start(slot, ANCHOR, CADENCE).alias("slot_start"),
    )


_JSON = "CASE WHEN {0} IS NULL THEN 'null' ELSE CAST(to_json(CAST({0} AS VARCHAR)) AS VARCHAR) END"
_CLAIM = {
    "official_source_id": "s_nationkey", "source_snapshot_id": "CASE WHEN l_linestatus = 'O' THEN l_orderkey END",
    "source_revision_decision_id": "CASE WHEN l_returnflag <> 'A' THEN s_nationkey * 10 END", "model_raw": "s_name", "benchmark_raw": "p_brand",
    "score_raw": "CAST(l_extendedprice AS DECIMAL(18,2))", "metric_raw": "p_type", "split_raw": "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END",
    "setting_raw": "p_name", "evaluation_version_raw": "'v' || p_size", "rank_raw": "NULL", "date_raw": "CAST(l_shipdate AS DATE)",
    "score_unit": "CASE WHEN l_linenumber > 1 THEN '\"pts\"' END",
}
_PLACE = """'{"row": "' || l_linenumber || '", "type": "table"}'"""


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, sha256('{{' || {" || ', ' || ".join(
        f"""'"{name}": ' || {_PLACE if name == "evidence_location" else _JSON.format("(" + _CLAIM[name] + ")")}""" for name in sorted([*_CLAIM, "evidence_location"])
    )} || '}}') AS fingerprint FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""
)
def claim_fingerprints(spark, folder):
    """Every line item as a claim with all fourteen fields that identify it."""
    lines = (
        D.table(spark, folder, "lineitem")
        .join(D.table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(D.table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    fields = {
        "official_source_id": F.col("s_nationkey"),
        "source_snapshot_id": F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")),
        "source_revision_decision_id": F.when(F.col("l_returnflag") != "A", F.col("s_nationkey") * 10),
        "model_raw": F.col("s_name"), "benchmark_raw": F.col("p_brand"),
        "score_raw": F.col("l_extendedprice").cast("decimal(18,2)"), "metric_raw": F.col("p_type"),
        "split_raw": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), "setting_raw": F.col("p_name"),
        "evaluation_version_raw": F.concat(F.lit("v"), "p_size"), "date_raw": F.col("l_shipdate").cast("date"),
        "score_unit": F.when(F.col("l_linenumber") > 1, F.lit('"pts"')),
    }
    place = F.create_map(F.lit("type"), F.lit("table"), F.lit("row"), F.col("l_linenumber").cast("string"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", G.claim_fingerprint(place, fields).alias("fingerprint"))


@query(
    """SELECT sha_ok AND NOT upper_ok AS digest_rule, id_ok, code_ok, count(*) AS n FROM (
      SELECT regexp_matches(sha256(c_name), '^[0-9a-f]{64}$') AS sha_ok, regexp_matches(upper(sha256(c_name)), '^[0-9a-f]{64}$') AS upper_ok,
        regexp_matches(lower(c_name), '^[a-z0-9][a-z0-9._-]{0,127}$') AS id_ok, regexp_matches(c_mktsegment, '^[A-Z][A-Z0-9_]{2,127}$') AS code_ok FROM customer) GROUP BY ALL"""
)
def format_predicates(spark, folder):
    sha = F.sha2("c_name", 256)
    return D.table(spark, folder, "customer").select(
        (X.is_sha256(sha) & ~X.is_sha256(F.upper(sha))).alias("digest_rule"),
        X.is_stable_id(F.lower("c_name")).alias("id_ok"),
        X.is_reason_code(F.col("c_mktsegment")).alias("code_ok"),
    ).groupBy("digest_rule", "id_ok", "code_ok").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size || 'k' ELSE 'Not supplied' END AS window_text,
    'in ' || CASE WHEN p_size > 10 THEN '$' || p_size ELSE 'Not supplied' END || ' / out ' || CASE WHEN p_size > 40 THEN '$' || p_size ELSE 'Not supplied' END AS price_text,
    lower(trim(p_type)) || ' ' || p_name AS header FROM part"""
)
def metadata_text(spark, folder):
    size = F.col("p_size")
    messy = F.concat(F.lit(" ​"), F.lower("p_type"), F.lit("  \n\t"), "p_name", F.lit("﻿ "))
    return D.table(spark, folder, "part").select(
        "p_partkey",
        S.format_context_window(F.when(size > 25, size)).alias("window_text"),
        S.format_price_pair(F.when(size > 10, size), F.when(size > 40, size)).alias("price_text"),
        X.fold_header(messy).alias("header"),
    )


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 4 THEN NULL ELSE false END AS repeats FROM events"""
)
def duplicate_keys(spark, folder):
    """Event properties as they are, with a key repeated at the top or deep inside, or cut short."""
    ev = D.table(spark, folder, "events")
    own = F.col("props")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"a":'), own, F.lit(',"b":0,"a":1}')))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"a":[1,{"b":{"c":1,"d":2,"c":'), own, F.lit("}}]}")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"a":'), own, F.lit(',"b":{"a":'), own, F.lit("}}")))
        .when(F.col("event_id") % 5 == 3, own)
        .otherwise(F.concat(F.lit('{"a":'), own))
    )
    return ev.select("event_id", X.has_duplicate_keys(text).alias("repeats"))


_CAPPED = ("customer", "supplier", "orders", "events", "documents")


@query(
    "SELECT name, cap, n > cap AS refused FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _CAPPED)
    + "), (SELECT CAST(unnest([50, 900, 9000, 40000]) AS BIGINT) AS cap)"
)
def cap_verdicts(spark, folder):
    """Which tables a refusing limit turns away, at several limits."""
    parts = [Y.cap_verdicts(D.table(spark, folder, t), [50, 900, 9000, 40000]).withColumn("name", F.lit(t)) for t in _CAPPED]
    return reduce(DataFrame.unionByName, parts).select("name", "cap", "refused")


@query("SELECT c_custkey, c_name FROM customer")
def refusing_cap(spark, folder):
    """A table within its cap passes whole; a larger one is refused (see the tests)."""
    return Y.guarded(D.table(spark, folder, "customer"), 1_000_000_000).select("c_custkey", "c_name")


@query(
    """SELECT o_custkey, sha256('{"customer":' || o_custkey || ',"priorities":' || CAST(to_json(list_sort(list_distinct(list(o_orderpriority)))) AS VARCHAR) || ',"statuses":' ||
      CAST(to_json(list_sort(list_distinct(list(o_orderstatus)))) AS VARCHAR) || '}') AS fingerprint FROM orders GROUP BY o_custkey"""
)
def content_fingerprints(spark, folder):
    """Digest of each customer's sets of order priorities and states, whatever their order and number."""
    sets = D.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderpriority").alias("priorities"), F.collect_set("o_orderstatus").alias("statuses")
    )
    fields = {"customer": F.col("o_custkey"), "priorities": G.set_like(F.col("priorities")), "statuses": G.set_like(F.col("statuses"))}
    return sets.select("o_custkey", G.identity_digest(fields).alias("fingerprint"))
