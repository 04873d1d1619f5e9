"""Column functions on awkward spellings."""

import pytest
from pyspark.sql import functions as F

from scorelattice.functions import jsonpath as J, text as X, timegrid as T
from scorelattice.functions.lexemes import exact_records, fixed_text, score_field, text_field


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strict_numbers(spark):
    texts = ["1.2300", "1e-3", "12%", "nan", "1e400", "1e-400", "0e-9", "-.5", "1_0", " 1"]
    errors = column(spark, texts, lambda c: X.strict_number_error(c, F.lit("decimal")))
    assert errors == [
        None, None, "SCORE_UNIT_UNDECLARED", "SCORE_NOT_NUMERIC", "SCORE_NOT_FINITE", "SCORE_NOT_REPRESENTABLE",
        None, None, "SCORE_NOT_NUMERIC", "SCORE_NOT_NUMERIC",
    ]
    assert column(spark, ["12.5%", "12.5"], lambda c: X.strict_number(c, F.lit("decimal_percent"))) == [12.5, None]


def test_loose_numbers_and_keys(spark):
    assert column(spark, ["~1,234.5%", "none", "-2e3"], X.loose_number) == [1234.5, None, -2000.0]
    assert column(spark, ["GPT-4 (Turbo)", "Ünï-1"], X.alias_key) == ["gpt4turbo", "n1"]
    assert column(spark, ["Ünï-1"], X.alias_key_unicode) == ["ünï1"]


def test_visible_text(spark):
    got = column(spark, ["a\\b", "x\ty\n", "z​w", "\x07", "plain é", None, "\U000e0001"], X.visible_text)
    assert got == [
        "text:a\\\\b", "text:x\\ty\\n", "text:z\\u200bw", "text:\\x07", "text:plain é", None, "text:\\U000e0001",
    ]


def test_header_folding(spark):
    assert column(spark, [" Mo​del\n  Name﻿ "], X.fold_header) == ["Model Name"]


def test_urls(spark):
    urls = [
        "https://example.org/a?b=1", "http://example.org", "https://u:p@example.org", "https://example.org/#x",
        "https://example.org/?Token=1", "https:///x", None, "https://example.org/?x-amz-signature=",
    ]
    assert column(spark, urls, X.is_public_https_url) == [True, False, False, False, False, False, False, False]


def test_cursor_is_strict(spark):
    made = spark.range(1).select(X.visible_cursor(F.lit("2024-01-01 00:00:00"), F.lit("id-1")).alias("c")).first().c
    bad = [made + "=", made[:-1], "v2" + made[2:], None]
    assert column(spark, [made], lambda c: X.cursor_fields(c)["id"]) == ["id-1"]
    assert column(spark, bad, lambda c: X.cursor_fields(c)["id"]) == [None] * 4


def test_paths(spark):
    paths = ["$", "$.a[0].b-c", "$.a..b", "a", "$.a[x]"]
    assert column(spark, paths, J.is_path) == [True, True, False, False, False]
    assert column(spark, paths, J.pointer) == ["/", "/a/0/b-c", None, None, None]
    rows = ["$.r[0]", "$.r[10]", "$.r[01]", "$.r[]", "$.r[1].x", "$.q[1]"]
    assert column(spark, rows, lambda c: J.matches_template(c, F.lit("$.r[{row_index}]"))) == [True, True, False, False, False, False]


def test_durations(spark):
    texts = ["P1D", "PT12H", "P1DT12H30M5S", "PT0S", "P", "P1W", "1D"]
    assert column(spark, texts, T.duration_seconds) == [86400, 43200, 131405, None, None, None, None]
    assert column(spark, [99, 100, 159, 160], lambda c: T.slot_ordinal(c, 100, 60), "long") == [None, 0, 0, 1]


def test_exact_json(spark):
    docs = [
        '{"r":[{"m":"a","s":71.2500},{"m":"b","s":1e-3},{"m":7,"s":"9.10"},[1],{"m":"c","s":null}]}',
        '{"r":[{"m":"a","m":"b"}]}', '{"r":[{"m":NaN}]}', "not json", '{"q":[]}', None,
    ]
    df = spark.createDataFrame([(d,) for d in docs], "d string").select(
        exact_records("d", F.array(F.lit("r"))).alias("r")
    )
    sizes = [None if r.r is None else len(r.r) for r in df.collect()]
    assert sizes == [5, None, None, None, None, None]
    records = df.where("r is not null").select(F.explode("r").alias("x"))
    got = [tuple(r) for r in records.select(text_field(F.col("x"), "m"), score_field(F.col("x"), "s")).collect()]
    assert got == [("a", "71.2500"), ("b", "1e-3"), (None, "9.10"), (None, None), ("c", None)]


def test_fixed_text_rounds_the_binary_value(spark):
    got = column(spark, [0.125, 1.005, 2.675, None], lambda c: fixed_text(c, 2), "double")
    assert got == [f"{v:.2f}" for v in (0.125, 1.005, 2.675)] + [None]


def test_duplicate_keys(spark):
    texts = ['{"a":1,"a":2}', '{"a":1,"b":2}', '{"a":[{"b":1,"c":{"d":1,"d":2}}]}', '{"a":{"b":1},"c":{"b":1}}', "no json", None]
    assert column(spark, texts, X.has_duplicate_keys) == [True, False, True, False, None, None]


def test_encoded_keys_and_paths_are_read(spark):
    urls = ["https://x.org/a?access%5Ftoken=x", "https://x.org/a?b=1;access_token=2", "https://x.org/a?%zz=1", "https://x.org/a?b=%5F"]
    assert column(spark, urls, X.is_public_https_url) == [False, True, False, True]


def test_claim_fingerprint_is_the_digest_of_sorted_spaced_json(spark):
    import hashlib
    import json

    from scorelattice.functions.digests import CLAIM_FIELDS, claim_fingerprint

    rows = [
        ("m \"x\"", None, 7, {"type": "table", "row": "1"}), ("Gr\u00fcn\\\n\t", "a,b: c", None, None), ("", "", 0, {}),
    ]
    df = spark.createDataFrame(rows, "model_raw string, split_raw string, official_source_id long, place map<string,string>")
    got = df.select(claim_fingerprint(F.col("place"), {n: F.col(n) for n in ("model_raw", "split_raw", "official_source_id")})).collect()
    want = []
    for model, split, source, place in rows:
        fields = dict.fromkeys(CLAIM_FIELDS) | {"model_raw": model, "split_raw": split, "evidence_location": place}
        fields["official_source_id"] = None if source is None else str(source)
        want.append(hashlib.sha256(json.dumps(fields, sort_keys=True, ensure_ascii=False).encode()).hexdigest())
    assert [r[0] for r in got] == want
    with pytest.raises(ValueError):
        claim_fingerprint(F.col("place"), {"score": F.lit(1)})


def test_run_scores_keep_their_spelling(spark):
    from scorelattice.operators.extract import run_claims

    grouped = '{"groups":[{"runs":[{"run_name":"m","metrics":[{"name":"f1","value":1.2300},{"name":"em","value":1e16},{"name":"num_x","value":1},{"name":"t","value":"0.50"},{"name":"bad","value":"none"}]}]}]}'
    listed = '[{"run_spec":{"adapter_spec":{"model":"n"}},"stats":[{"name":{"name":"f1","split":"test"},"mean":-0.0}]}]'
    docs = spark.createDataFrame([(1, grouped), (2, listed), (3, "{broken"), (4, None)], "snapshot_id int, content string")
    got = sorted((r["snapshot_id"], r["model_raw"], r["metric_raw"], r["split_raw"], r["score_raw"]) for r in run_claims(docs).collect())
    assert got == [(1, "m", "em", None, "1e16"), (1, "m", "f1", None, "1.2300"), (1, "m", "t", None, "0.50"), (2, "n", "f1", "test", "-0.0")]


def test_window_with_fewer_marks_than_its_default_start(spark):
    """Fourteen marks and later rows: open at the start, closed at the last mark."""
    from scorelattice.operators.extract import windowed_mean

    perf = spark.createDataFrame([("a", 1, 1.0), ("a", 99, 100.0), ("b", 99, 7.0)], "model_raw string, mark int, pass_rate double")
    for n in (13, 14, 15):
        out = windowed_mean(perf, spark.range(1, n + 1).selectExpr("cast(id as int) mark"))
        assert {r["model_raw"]: r["score_raw"] for r in out.collect()} == {"a": "1.0", "b": "7.0"}
    none = windowed_mean(perf, spark.range(0).selectExpr("cast(id as int) mark"))
    assert {r["model_raw"]: r["score_raw"] for r in none.collect()} == {"a": "50.5", "b": "7.0"}


def test_cursor_fields_of_any_spelling(spark):
    import base64

    def token(raw):
        return "v1." + base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")

    made = [("a", "1"), ("", ""), ('q"\\', "é"), ("\t", "x/y")]
    df = spark.createDataFrame(made, "c string, i string")
    tokens = [r.t for r in df.select(X.visible_cursor(F.col("c"), F.col("i")).alias("t")).collect()]
    assert [tuple(v) for v in column(spark, tokens, lambda c: X.cursor_fields(c))] == made
    bad = [tokens[0] + "A", tokens[0] + "AA", tokens[0] + "AAA", tokens[0] + "=", "v1.A", "v1.", ""]
    bad += [token(t) for t in ('{"created_at":"a","id":"1"} ', '{"id":"1","created_at":"a"}', '{"created_at":"a"}', '{"created_at":"a","id":1}', '{"created_at":"\\u0061","id":"1"}')]
    assert column(spark, bad, lambda c: X.cursor_fields(c)["id"]) == [None] * len(bad)


def test_cursor_fields_do_not_decode_what_cannot_be_base64(spark):
    df = spark.createDataFrame([("v1.AAAAA",)], "c string")
    plan = df.select(X.cursor_fields(F.col("c")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "% 4" in plan and "RLIKE" in plan
