"""Extraction over artifacts that Spark builds from the shipped tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lexemes import exact_records, score_field
from ..operators import extract as X
from ..session import configure, shared_dir
from ..sources import html as H, tables as T
from . import domain as D
from .registry import query


def _money(name, scale=2):
    return F.col(name).cast(f"decimal(18,{scale})").cast("string")


def _line_id():
    """A line's identity: every field its artifact is made from.

    Order and line number repeat in this data, and rows equal in all of these
    fields give one and the same artifact.
    """
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _money("l_extendedprice"),
        _money("l_discount"), _money("l_tax"), "l_returnflag", "l_linestatus",
    )


_LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)), "
    "CAST(l_discount AS DECIMAL(18,2)), CAST(l_tax AS DECIMAL(18,2)), l_returnflag, l_linestatus)"
)


def _json_snapshots(spark, folder):
    """One JSON artifact per line item: three records, one of them without a score."""
    li = D.spread_table(spark, folder, "lineitem")
    model = F.concat(F.lit('"supplier '), "l_suppkey", F.lit('"'))
    content = F.concat(
        F.lit('{"results":[{"model":'), model, F.lit(',"score":'), _money("l_discount", 4),
        F.lit(',"metric":"discount","rank":'), F.col("l_linenumber"),
        F.lit('},{"model":'), model, F.lit(',"score":"'), _money("l_extendedprice"),
        F.lit('","metric":"price"},{"model":'), model, F.lit(',"metric":"tax"}]'),
        # Returned items repeat a key, which makes the artifact ambiguous.
        F.when(F.col("l_returnflag") == "R", F.lit(',"results":[]')).otherwise(""),
        F.lit("}"),
    )
    return li.select(
        F.col("l_linestatus").alias("source_id"), _line_id().alias("snapshot_id"),
        content.alias("content"), "l_extendedprice",
    )


def _config(spark):
    rows = [(s, "$.results", "model", "score", "metric", "rank") for s in ("F", "O")]
    return spark.createDataFrame(
        rows,
        "source_id string, collection_path string, model_field string, score_field string, "
        "metric_field string, rank_field string",
    )


_JSON_CLAIMS_SQL = f"""claims AS (
  SELECT l_linestatus AS source_id, {_LINE_ID} AS snapshot_id, '$.results[0]' AS record_path,
    'supplier ' || l_suppkey AS model_raw, CAST(CAST(l_discount AS DECIMAL(18,4)) AS VARCHAR) AS score_raw,
    'discount' AS metric_raw, CAST(l_linenumber AS VARCHAR) AS rank_raw FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL SELECT l_linestatus, {_LINE_ID}, '$.results[1]', 'supplier ' || l_suppkey,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), 'price', NULL FROM lineitem WHERE l_returnflag <> 'R')"""


@query(f"WITH {_JSON_CLAIMS_SQL} SELECT * FROM claims")
def json_records(spark, folder):
    return X.json_claims(_json_snapshots(spark, folder), _config(spark))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'id ' || o_custkey WHEN 'O' THEN 'model ' || o_custkey
      WHEN 'P' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'unknown' ELSE 'full ' || o_custkey END END AS model_raw,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS score_raw FROM orders"""
)
def fallback_fields(spark, folder):
    orders = D.spread_table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    entry = F.to_json(
        F.struct(
            F.when(status == "F", F.concat(F.lit("id "), "o_custkey")).alias("model_id"),
            F.when(status == "O", F.concat(F.lit("model "), "o_custkey")).alias("model"),
            F.when((status == "P") & (F.col("o_orderpriority") != "1-URGENT"),
                   F.concat(F.lit("full "), "o_custkey")).alias("fullname"),
            F.when(status == "F", _money("o_totalprice")).alias("value"),
            F.when(status != "F", _money("o_totalprice")).alias("score"),
        )
    )
    parsed = orders.select(
        "o_orderkey",
        F.from_json(entry, "model_id string, model string, fullname string, value string, score string").alias("e"),
    ).select("o_orderkey", "e.*")
    return X.fallback_claims(parsed).select("o_orderkey", "model_raw", "score_raw")


@query(
    f"""SELECT {_LINE_ID} AS snapshot_id, 'supplier ' || l_suppkey AS model_raw,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS score_raw, '$.leaderboards[0].results[0]' AS record_path
    FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F'
    UNION ALL SELECT {_LINE_ID}, 'part ' || l_partkey, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), '$.leaderboards[1].results[0]'
    FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F'"""
)
def category_scoped_claims(spark, folder):
    """Returned items and finished lines both name a board ``R``; both at once is ambiguous."""
    li = D.spread_table(spark, folder, "lineitem")

    def board(name, entry, score):
        return F.struct(
            name.alias("name"),
            F.array(F.struct(entry.alias("name"), score.alias("resolved"))).alias("results"),
        )

    content = F.to_json(
        F.struct(
            F.array(
                board(F.col("l_returnflag"), F.concat(F.lit("supplier "), "l_suppkey"), _money("l_extendedprice")),
                board(F.when(F.col("l_linestatus") == "F", "R").otherwise("X"),
                      F.concat(F.lit("part "), "l_partkey"), _money("l_quantity")),
            ).alias("leaderboards")
        )
    )
    docs = li.select(_line_id().alias("snapshot_id"), content.alias("content"))
    return X.category_claims(docs, "R")


@query(
    f"""SELECT {_LINE_ID} AS snapshot_id, CASE WHEN l_linestatus = 'O' THEN 'run ' || l_suppkey ELSE 'model ' || l_suppkey END AS model_raw,
    m AS metric_raw, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS split_raw,
    CASE m WHEN 'exact_match' THEN CAST(l_discount AS VARCHAR) || '00' ELSE CAST(l_tax AS VARCHAR) || 'E+0' END AS score_raw
    FROM lineitem, (SELECT unnest(['exact_match', 'f1']) AS m)"""
)
def run_metrics(spark, folder):
    li = D.spread_table(spark, folder, "lineitem")
    flat = F.array(
        *[
            F.struct(F.lit(n).alias("name"), v.alias("value"))
            for n, v in (
                ("exact_match", F.concat(F.lit("#"), F.col("l_discount").cast("string"), F.lit("00#"))),
                ("f1", F.concat(F.lit("#"), F.col("l_tax").cast("string"), F.lit("E+0#"))),
                ("Num_instances", F.col("l_linenumber").cast("string")),
                ("calibration", F.lit("not measured")),
            )
        ]
    )
    grouped = F.to_json(
        F.struct(F.array(F.struct(F.array(F.struct(
            F.concat(F.lit("run "), "l_suppkey").alias("run_name"), flat.alias("metrics")
        )).alias("runs"))).alias("groups"))
    )
    stats = F.transform(
        flat,
        lambda m: F.struct(
            F.struct(m["name"].alias("name"), F.col("l_returnflag").alias("split")).alias("name"),
            m["value"].alias("mean"),
        ),
    )
    spec = F.struct(F.struct(F.concat(F.lit("model "), "l_suppkey").alias("model")).alias("adapter_spec"))
    listed = F.to_json(F.array(F.struct(spec.alias("run_spec"), stats.alias("stats"))))
    docs = li.select(
        _line_id().alias("snapshot_id"),
        # Marked values become numbers in a spelling of their own.
        F.regexp_replace(F.when(F.col("l_linestatus") == "O", grouped).otherwise(listed), '"#([^"#]*)#"', "$1").alias("content"),
    )
    return X.run_claims(docs)


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS source_row, c_name AS model_raw, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS score_raw,
    c_mktsegment AS metric_raw, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS score_numeric, true AS first_is_zero
    FROM customer WHERE c_acctbal >= 0"""
)
def csv_claims(spark, folder):
    """Customers written as CSV files, scanned back with row locators and claimed."""
    path = f"{shared_dir(spark)}/scorelattice-stage/csv-{uuid.uuid4().hex}"
    columns = ["row", "model", "score", "metric"]
    rows = D.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row"), F.col("c_name").alias("model"),
        F.when(F.col("c_acctbal") >= 0, _money("c_acctbal")).alias("score"),
        F.col("c_mktsegment").alias("metric"),
    )
    rows.write.option("header", True).csv(path)
    cells = T.csv_cells(spark, path, columns, ["model", "score"])
    firsts = cells.groupBy("file_path").agg(F.min("row_index").alias("first")).agg(
        (F.max("first") == 0).alias("z")).scalar()
    claims = X.csv_claims(cells, "model", "score", "metric").join(
        cells.select("file_path", "row_index", F.col("row").alias("source_row")), ["file_path", "row_index"]
    )
    return claims.select(
        "source_row", "model_raw", "score_raw", "metric_raw", "score_numeric", firsts.alias("first_is_zero")
    )


@query(
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS table_index, CAST(r AS INTEGER) AS row_index,
    'customer ' || o_custkey || CASE r WHEN 0 THEN '' ELSE ' b' END AS model_raw,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS score_raw, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS metric_raw
    FROM orders, (SELECT unnest([0, 2]) AS r) WHERE r = 0 OR o_orderstatus <> 'O'"""
)
def html_tables(spark, folder):
    """Order pages whose score table has an untidy header, short and blank rows."""
    orders = D.spread_table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")

    def row(model, score):
        return F.concat(F.lit("<tr><td>"), model, F.lit("</td><td> "), score, F.lit(" </td><td>"), status, F.lit("</td></tr>"))

    model = F.concat(F.lit("customer "), "o_custkey")
    score = _money("o_totalprice")
    board = F.concat(
        F.lit("<table><tr><th>\n  MODEL​ </th><th>Total&nbsp;Score</th><th>Setting</th></tr>"),
        row(F.concat(F.lit("<b>"), model, F.lit("</b>")), score),
        F.lit("<tr><td>short row</td></tr>"),
        row(F.concat(model, F.lit(" b")), F.when(F.col("o_orderstatus") != "O", score).otherwise("")),
        F.lit("</table>"),
    )
    other = F.lit("<table><tr><th>Date</th></tr><tr><td>1 &lt; 2</td></tr></table>")
    page = F.concat(
        F.lit("<html><body>"),
        F.when(F.col("o_orderpriority") == "1-URGENT", other).otherwise(""),
        board, F.lit("</body></html>"),
    )
    pages = orders.select(F.col("o_orderkey").alias("page_id"), page.alias("html"))
    tables = H.page_tables(pages, "page_id", "html")
    return H.table_claims(
        tables, "page_id", "Model", "total score", 0, None, {"metric_raw": "Setting"}
    )


@query(
    """SELECT page_id, CAST(count(*) AS BIGINT) AS scripts, sum(length(body)) AS script_chars FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages) GROUP BY page_id"""
)
def page_scripts(spark, folder):
    scripts = H.page_scripts(D.spread_table(spark, folder, "pages"), "page_id", "html")
    return scripts.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("scripts"), F.sum(F.length("content")).alias("script_chars")
    )


@query(
    """SELECT o_orderkey AS page_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'EVIDENCE_SCRIPT_AMBIGUOUS'
       WHEN '2-HIGH' THEN 'EVIDENCE_NOT_FOUND' WHEN '3-MEDIUM' THEN 'EVIDENCE_LOCATOR_INVALID' END AS reason,
    CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) END AS score_raw
    FROM orders"""
)
def inline_scripts(spark, folder):
    """Score records embedded in a named script, by order priority usable or not."""
    orders = D.spread_table(spark, folder, "orders")
    priority = F.col("o_orderpriority")
    body = F.concat(F.lit('{"rows":[{"score":'), _money("o_totalprice", 4), F.lit("}]}"))
    good = F.concat(F.lit('<script id="data" type="application/json">'), body, F.lit("</script>"))
    page = F.concat(
        F.lit("<html><script>track(0)</script>"),
        F.when(priority == "1-URGENT", F.concat(good, F.lit('<p id="data"></p>')))
        .when(priority == "2-HIGH", F.replace(good, F.lit('id="data"'), F.lit('id="other"')))
        .when(priority == "3-MEDIUM", F.replace(good, F.lit("<script "), F.lit('<script src="x.js" ')))
        .otherwise(good),
        F.lit("</html>"),
    )
    pages = orders.select(F.col("o_orderkey").alias("page_id"), page.alias("html"))
    chosen = H.choose_script(
        H.page_scripts(pages, "page_id", "html"), "page_id", "data", "application/json"
    )
    record = F.get(exact_records("content", F.array(F.lit("rows"))), F.lit(0))
    return chosen.select("page_id", "reason", score_field(record, "score").alias("score_raw"))


_METRICS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


@query(
    f"SELECT snapshot_id, l_suppkey AS model_raw, metric_raw, score_raw FROM (SELECT {_LINE_ID} AS snapshot_id, l_suppkey,"
    + "CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price,"
    + "CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS discount, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS tax FROM lineitem)"
    + " UNPIVOT (score_raw FOR metric_raw IN (quantity, price, discount, tax))"
)
def unpivot_claims(spark, folder):
    li = D.spread_table(spark, folder, "lineitem")
    wide = li.select(
        _line_id().alias("snapshot_id"), F.col("l_suppkey").alias("model_raw"),
        *[_money(c).alias(c) for c in _METRICS.values()],
    )
    return X.unpivot_claims(wide, ["snapshot_id", "model_raw"], _METRICS)


@query(
    """SELECT 'part.parquet' AS file_name, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index, p_name AS model_raw,
    CAST(p_size AS VARCHAR) AS score_raw, p_brand AS category_raw FROM part"""
)
def parquet_cells(spark, folder):
    """Part rows as text cells with their position in the file."""
    configure(spark)
    cells = T.parquet_cells(spark, f"{folder}/part.parquet", ["p_name", "p_size", "p_brand"])
    claims = X.renamed_claims(
        cells, {"model_raw": "p_name", "score_raw": "p_size", "category_raw": "p_brand"},
        ["file_path", "row_index"],
    )
    return claims.select(
        F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
        "row_index", "model_raw", "score_raw", "category_raw",
    )


@query(
    """SELECT 'orders.parquet' AS file_name, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, CAST(o_custkey AS VARCHAR) AS model_raw,
    CAST(o_orderkey AS VARCHAR) AS score_raw, o_orderstatus AS split_raw, o_orderpriority AS benchmark_raw FROM orders"""
)
def parquet_order_cells(spark, folder):
    """Order rows, stored in key order, as text cells with their position."""
    configure(spark)
    fields = {"model_raw": "o_custkey", "score_raw": "o_orderkey", "split_raw": "o_orderstatus", "benchmark_raw": "o_orderpriority"}
    cells = T.parquet_cells(spark, f"{folder}/orders.parquet", list(fields.values()))
    claims = X.renamed_claims(cells, fields, ["file_path", "row_index"])
    return claims.select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "row_index", *fields)


@query(
    """SELECT 'orders.parquet' AS file_name, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, CAST(o_totalprice AS VARCHAR) AS score_raw FROM orders
      UNION ALL SELECT 'part.parquet', row_number() OVER (ORDER BY p_partkey) - 1, CAST(p_retailprice AS VARCHAR) FROM part
      UNION ALL SELECT 'events.parquet', row_number() OVER (ORDER BY event_id) - 1, CAST(value AS VARCHAR) FROM events"""
)
def parquet_real_cells(spark, folder):
    """Prices and values, stored in key order, in their shortest spelling."""
    configure(spark)
    parts = [
        T.parquet_cells(spark, f"{folder}/{name}.parquet", [column]).select(
            F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "row_index", F.col(column).alias("score_raw")
        )
        for name, column in (("orders", "o_totalprice"), ("part", "p_retailprice"), ("events", "value"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CAST(CAST(o_totalprice * o_custkey * power(10.0, o_orderkey % 9) AS FLOAT) AS DOUBLE) AS VARCHAR) AS volume FROM orders"""
)
def parquet_single_cells(spark, folder):
    """32-bit floats of many sizes, stored and read back as cells."""
    volume = F.col("o_totalprice") * F.col("o_custkey") * F.pow(F.lit(10.0), F.col("o_orderkey") % 9)
    at = f"{shared_dir(configure(spark))}/scorelattice-stage/single-{uuid.uuid4().hex}"
    D.table(spark, folder, "orders").select("o_orderkey", volume.cast("float").alias("volume")).write.parquet(at)
    return T.parquet_cells(spark, at, ["o_orderkey", "volume"]).select("o_orderkey", "volume")


@query("SELECT 'lineitem.parquet' AS file_name, count(*) AS n_rows FROM lineitem")
def parquet_row_counts(spark, folder):
    configure(spark)
    counts = T.row_counts(spark, f"{folder}/lineitem.parquet")
    return counts.select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "n_rows")


def _order_claims(spark, folder):
    """Three facts per line; the order is the snapshot, (part, fact) the identity."""
    wide = D.spread_table(spark, folder, "lineitem").select(
        "l_orderkey", F.concat(F.lit("part "), "l_partkey").alias("model_raw"),
        _money("l_quantity").alias("quantity"),
        F.when(F.col("l_discount") < 0.1, _money("l_discount")).otherwise("n/a").alias("discount"),
        _money("l_tax").alias("tax"),
    )
    return X.unpivot_claims(
        wide, ["l_orderkey", "model_raw"], {m: m for m in ("quantity", "discount", "tax")}
    )


_ACCOUNTING = """SELECT {0} AS l_orderkey, count(*) AS records, 3 * count(*) AS claims,
    CASE WHEN count(*) FILTER (WHERE l_discount >= 0.1) > 0 THEN 'SCORE_VALUE_INVALID'
         WHEN count(*) > count(DISTINCT l_partkey) THEN 'DUPLICATE_MODEL_DIMENSION' END AS verdict FROM lineitem GROUP BY l_orderkey"""


@query(_ACCOUNTING.format("CAST(l_orderkey AS VARCHAR)"))
def csv_batches(spark, folder):
    """Facts written as CSV files, some cells over several lines, scanned back and judged as batches."""
    path = f"{shared_dir(configure(spark))}/scorelattice-stage/facts-{uuid.uuid4().hex}"
    facts = _order_claims(spark, folder)
    wide = facts.select("l_orderkey", F.concat("model_raw", F.lit("\n(as printed)")).alias("model"), "metric_raw", "score_raw")
    wide.write.option("header", True).option("escape", '"').csv(path)
    cells = T.csv_cells(spark, path, wide.columns, ["model", "metric_raw", "score_raw"])
    fields = {"l_orderkey": "l_orderkey", "model_raw": "model", "metric_raw": "metric_raw", "score_raw": "score_raw"}
    claims = X.renamed_claims(cells.where("well_formed"), fields, ["file_path", "row_index"])
    records = D.table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"))
    return X.batch_verdicts(claims, "l_orderkey", ["model_raw", "metric_raw"], 3, records)


@query(_ACCOUNTING.format("l_orderkey"))
def batch_accounting(spark, folder):
    claims = _order_claims(spark, folder)
    records = D.table(spark, folder, "lineitem").select("l_orderkey")
    return X.batch_verdicts(claims, "l_orderkey", ["model_raw", "metric_raw"], 3, records)


@query(
    """WITH bad AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey
      HAVING count(*) FILTER (WHERE l_discount >= 0.1) > 0 OR count(*) > count(DISTINCT l_partkey))
    SELECT l_orderkey, 3 * count(*) AS kept FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad) GROUP BY l_orderkey"""
)
def whole_batches(spark, folder):
    claims = _order_claims(spark, folder)
    records = D.table(spark, folder, "lineitem").select("l_orderkey")
    verdicts = X.batch_verdicts(claims, "l_orderkey", ["model_raw", "metric_raw"], 3, records)
    kept = X.whole_batches(claims, verdicts, "l_orderkey")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"))


@query(
    """WITH r AS (SELECT conv_id, turn + 1 AS rank, turn AS member FROM conversations WHERE role <> 'system'),
    g AS (SELECT c.conv_id AS board, count(r.member) AS n, count(*) - count(r.member) AS mismatched, min(rank) AS lo, max(rank) AS hi, count(DISTINCT rank) AS d
          FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.member = c.turn GROUP BY c.conv_id)
    SELECT board, n, mismatched, coalesce(lo = 1 AND hi = n AND d = n AND mismatched = 0, false) AS valid FROM g"""
)
def rank_permutation(spark, folder):
    """Turns as places of a conversation; system turns are left out of the ranking."""
    turns = D.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("board"), F.col("turn").alias("member"), "role"
    )
    ranks = turns.where(F.col("role") != "system").withColumn("rank", F.col("member") + 1)
    return X.rank_map_verdicts(ranks, turns)


@query(
    f"""WITH {_JSON_CLAIMS_SQL}
    SELECT outcome, count(*) AS n FROM (
      SELECT CASE WHEN l_returnflag = 'R' THEN 'uncertain' WHEN l_tax = 0.08 THEN 'fail' ELSE 'pass' END AS outcome FROM lineitem
      UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'uncertain' ELSE 'pass' END FROM lineitem) GROUP BY outcome"""
)
def reread_validation(spark, folder):
    """Claims taken from the line items, checked against the artifacts' records."""
    snapshots = _json_snapshots(spark, folder)
    records = X.json_claims(snapshots, _config(spark)).dropDuplicates(["snapshot_id", "record_path"])
    li = D.spread_table(spark, folder, "lineitem")
    discount = F.when(F.col("l_tax") == 0.08, F.col("l_discount").cast("string")).otherwise(_money("l_discount", 4))
    scores = {"$.results[0]": discount, "$.results[1]": _money("l_extendedprice")}
    claims = li.select(
        _line_id().alias("snapshot_id"), F.concat(F.lit("supplier "), "l_suppkey").alias("model_raw"),
        F.inline(F.array(*[F.struct(F.lit(path).alias("record_path"), score.alias("score_raw")) for path, score in scores.items()])),
    )
    checked = X.reread_outcomes(claims, records, ["snapshot_id", "record_path"])
    return checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT d.doc_id AS snapshot_id, item_id AS score_item, CASE WHEN contains(d.text, b.text) THEN 'pass' ELSE 'uncertain' END AS outcome
    FROM labels JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = doc_id"""
)
def contains_value(spark, folder):
    """Whether a labelled document holds the passage with the same number."""
    docs = D.table(spark, folder, "documents").select(
        F.col("doc_id").alias("snapshot_id"), F.col("text").alias("content")
    )
    claims = (
        D.table(spark, folder, "labels")
        .join(D.table(spark, folder, "benchmark"), F.col("doc_id") == F.col("item_id"))
        .select(F.col("doc_id").alias("snapshot_id"), F.col("text").alias("score_raw"), F.col("item_id").alias("score_item"))
    )
    return X.contains_outcomes(claims, docs).select("snapshot_id", "score_item", "outcome")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(1 + CASE WHEN l_discount > 0 OR l_tax > 0 THEN 1 ELSE 0 END AS INTEGER) AS categories_computed,
    printf('%.2f', CASE WHEN l_discount > 0 OR l_tax > 0 THEN (a + b) / 2 ELSE a END) AS score_raw FROM (
      SELECT *, (l_quantity + l_extendedprice) / 2 AS a,
        ((CASE WHEN l_discount > 0 THEN l_discount ELSE 0 END) + l_tax) / ((l_discount > 0)::INT + (l_tax > 0)::INT) AS b FROM lineitem)"""
)
def mean_of_means(spark, folder):
    li = D.spread_table(spark, folder, "lineitem")
    wide = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").cast("string").alias("quantity"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("-").alias("discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax").cast("string")).otherwise("").alias("tax"),
    )
    means = X.mean_of_means(wide, {"size": ["quantity", "price"], "rate": ["discount", "tax"]})
    return means.select("l_orderkey", "l_linenumber", "l_partkey", "categories_computed", "score_raw")


@query(
    """WITH p AS (SELECT user_id, event_type, CAST(value AS DECIMAL(28,6)) AS v, date_trunc('day', ts) AS mark FROM events),
    m AS (SELECT mark, row_number() OVER (ORDER BY mark) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT mark FROM p)),
    s AS (SELECT mark AS start FROM m WHERE i = CASE WHEN n > 12 THEN 16 WHEN n > 4 THEN 5 ELSE 1 END),
    g AS (SELECT user_id || ' ' || event_type AS model_raw, CAST(sum(v) FILTER (WHERE mark >= start) AS DOUBLE) / count(v) FILTER (WHERE mark >= start) AS a,
       count(*) FILTER (WHERE mark >= start) AS k, CAST(sum(v) AS DOUBLE) / count(v) AS b FROM p, s GROUP BY ALL)
    SELECT model_raw, printf('%.1f', CASE WHEN k > 0 THEN a ELSE b END) AS score_raw FROM g"""
)
def windowed_mean_fallback(spark, folder):
    perf = D.table(spark, folder, "events").select(
        F.concat_ws(" ", "user_id", "event_type").alias("model_raw"),
        F.col("value").alias("pass_rate"), F.date_trunc("day", "ts").alias("mark"),
    )
    return X.windowed_mean(perf, perf).select("model_raw", "score_raw")


@query(
    """WITH p AS (SELECT event_type AS snapshot, user_id, CAST(value AS DECIMAL(28,6)) AS v, date_trunc('day', ts) AS mark FROM events),
    d AS (SELECT DISTINCT snapshot, mark FROM p WHERE user_id % 2 = 0 AND day(mark) <= CASE WHEN snapshot IN ('click', 'error') THEN 14 ELSE 20 END), m AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY mark) AS i, count(*) OVER (PARTITION BY snapshot) AS n FROM d),
    s AS (SELECT snapshot, max(mark) FILTER (WHERE i = CASE WHEN n > 12 THEN 16 WHEN n > 4 THEN 5 ELSE 1 END) AS start, max(mark) AS last FROM m GROUP BY 1),
    g AS (SELECT snapshot, user_id, CAST(sum(v) FILTER (WHERE last IS NULL OR (coalesce(mark >= start, true) AND mark <= last)) AS DOUBLE) / count(v) FILTER (WHERE last IS NULL OR (coalesce(mark >= start, true) AND mark <= last)) AS a,
       count(*) FILTER (WHERE last IS NULL OR (coalesce(mark >= start, true) AND mark <= last)) AS k, CAST(sum(v) AS DOUBLE) / count(v) AS b FROM p LEFT JOIN s USING (snapshot) GROUP BY ALL)
    SELECT snapshot, user_id AS model_raw, printf('%.1f', CASE WHEN k > 0 THEN a ELSE b END) AS score_raw FROM g"""
)
def windowed_mean_by_snapshot(spark, folder):
    """One artifact per event type, with marks that end before its last rows; two have fewer than the default start needs."""
    perf = D.table(spark, folder, "events").select(
        F.col("event_type").alias("snapshot"), F.col("user_id").alias("model_raw"),
        F.col("value").alias("pass_rate"), F.date_trunc("day", "ts").alias("mark"),
    )
    last_day = F.when(F.col("snapshot").isin("click", "error"), 14).otherwise(20)
    marks = perf.where((F.col("model_raw") % 2 == 0) & (F.dayofmonth("mark") <= last_day))
    return X.windowed_mean(perf, marks, ["snapshot"]).select("snapshot", "model_raw", "score_raw")


@query(
    """WITH v AS (SELECT user_id, value AS x FROM events WHERE event_type <> 'error'
      UNION ALL SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) FROM events WHERE event_type <> 'error')
    SELECT 'user ' || user_id AS model_raw, count(*) AS n,
      printf('%.4f', CAST(sum(CAST(x AS DECIMAL(28,9))) AS DOUBLE) / count(*)) AS score_raw FROM v GROUP BY user_id"""
)
def prefix_map_mean(spark, folder):
    """JSON lines of results by domain; lines of error events are cut short."""
    ev = D.spread_table(spark, folder, "events")
    line = F.concat(
        F.lit('{"model":"user '), "user_id", F.lit('","results":{"'), "event_type", F.lit('":{"pass_1":'),
        F.col("value").cast("string"), F.lit(',"fail":1,"pass_note":"none"},"props":{"pass_k":'),
        F.get_json_object("props", "$.k"), F.lit("}}"),
        F.when(F.col("event_type") == "error", "").otherwise("}"),
    )
    lines = T.json_lines(
        ev.select(line.alias("line")), "line", "model string, results map<string, map<string, string>>"
    )
    return X.prefix_map_mean(
        lines.select(F.col("record.model").alias("model_raw"), F.col("record.results").alias("results"))
    ).select("model_raw", "n", "score_raw")


@query(
    """SELECT source AS model_raw, count(*) AS num_problems, printf('%.4f', CAST(sum(quality) AS DOUBLE) / count(*)) AS score_raw
    FROM labels JOIN documents USING (doc_id) GROUP BY source"""
)
def accuracy_per_model(spark, folder):
    problems = D.table(spark, folder, "labels").join(
        D.table(spark, folder, "documents").select("doc_id", "source"), "doc_id"
    )
    return X.accuracy_per_model(
        problems.select(F.col("source").alias("model_raw"), F.col("quality").alias("correct"))
    ).select("model_raw", "num_problems", "score_raw")
