"""Scans with locators, HTML pages and sinks."""

import csv
import glob
import io

import pytest
from pyspark.sql import functions as F

from scorelattice.operators import extract as X
from scorelattice.sources import html as H, sinks as K, tables as T


def test_csv_rows_keep_their_number(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        lines = ["model,score"] + [f'"{name}, {i}",{i}.0' for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\nshort\n")
    cells = T.csv_cells(spark, str(tmp_path), ["model", "score"], ["score"])
    got = sorted((r.row_index, r.model, r.score, r.well_formed) for r in cells.collect())
    assert got == [
        (0, "a, 0", "0.0", True), (0, "b, 0", "0.0", True), (1, "a, 1", "1.0", True), (1, "b, 1", "1.0", True),
        (2, "a, 2", "2.0", True), (2, "short", None, False), (3, "short", None, False),
    ]


def test_csv_number_survives_split_files(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cells = T.csv_cells(spark, str(tmp_path), ["n"])
        assert cells.select(F.spark_partition_id()).distinct().count() >= 1
        assert cells.where(F.col("n").cast("long") != F.col("row_index")).count() == 0
        assert cells.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_quoted_line_ends_empty_cells_and_blank_lines(spark, tmp_path):
    text = 'model,score\n"a\nb",1\n\nc,\n,2\n"say ""x""",3\nd,4,5\n"",""\n'
    (tmp_path / "q.csv").write_text(text)
    cells = T.csv_cells(spark, str(tmp_path), ["model", "score"])
    got = [tuple(r) for r in cells.orderBy("row_index").select("row_index", "model", "score", "well_formed").collect()]
    assert got == [(0, "a\nb", "1", True), (1, "c", "", True), (2, "", "2", True), (3, 'say "x"', "3", True), (4, "d", "4", False), (5, "", "", True)]
    assert sorted(r.row_index for r in cells.select("row_index").collect()) == list(range(6))
    assert cells.where("not well_formed").count() == 1


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "x.csv").write_text("model,points\na,1\n")
    with pytest.raises(Exception, match="unexpected CSV header"):
        T.csv_cells(spark, str(tmp_path), ["model", "score"]).collect()
    with pytest.raises(ValueError):
        T.csv_cells(spark, str(tmp_path), ["model", "model"])


def test_parquet_locators(spark, tmp_path):
    spark.range(5).select("id", F.lit(True).alias("flag"), F.col("id").cast("double").alias("x")).coalesce(1).write.parquet(str(tmp_path / "p"))
    got = T.parquet_cells(spark, str(tmp_path / "p"), ["id", "flag", "x"]).orderBy("row_index").collect()
    assert [(r.row_index, r.id, r.flag, r.x) for r in got][:2] == [(0, "0", None, "0.0"), (1, "1", None, "1.0")]
    with pytest.raises(ValueError):
        T.parquet_cells(spark, str(tmp_path / "p"), ["nope"])


PAGES = [
    (1, "<table><tr><th>Date</th></tr></table><table><tr><th> MODEL\n</th><th>Score&nbsp;%</th></tr><tr><td>a&amp;b</td><td> 1 </td></tr><tr><td>x</td></tr><tr><td></td><td>2</td></tr></table>"),
    (2, "<table><tr><td>Leader board</td></tr><tr><td>q</td></tr></table>"),
    (3, "<p>none</p>"),
]


def test_text_after_a_nested_table_stays_in_its_cell(spark):
    page = "<table><tr><td>a <table><tr><td>in</td></tr></table> b</td><td>c</td></tr></table>"
    parser = H._Tables()
    parser.feed(page)
    assert parser.done == [[["a  b", "c"]], [["in"]]]


def test_html_tables(spark):
    pages = spark.createDataFrame(PAGES, "pid long, html string")
    tables = H.page_tables(pages, "pid", "html")
    got = [tuple(r) for r in H.table_claims(tables, "pid", "model", "score %").collect()]
    assert got == [(1, 1, 0, "a&b", "1")]
    hinted = H.table_claims(tables, "pid", "leader board", "leader board", 5, "LEADER  board")
    assert [tuple(r) for r in hinted.collect()] == [(2, 0, 0, "q", "q")]


def test_scripts(spark):
    ok = '<script id="d" type="application/json">{"a":"<b>"}</script>'
    pages = [
        (1, ok), (2, ok + '<i id="d"></i>'), (3, ok + ok), (4, "<script>x</script>"),
        (5, ok.replace("<script ", '<script src="u" ')), (6, ok.replace('type="application/json"', "")),
        (7, ok.replace("<script ", '<script id="d" ')),
    ]
    df = spark.createDataFrame(pages, "pid long, html string")
    got = {r.pid: (r.reason, r.content) for r in H.choose_script(H.page_scripts(df, "pid", "html"), "pid", "d", "application/json").collect()}
    assert got[1] == (None, '{"a":"<b>"}')
    assert [got[i][0] for i in range(2, 8)] == [
        "EVIDENCE_SCRIPT_AMBIGUOUS", "EVIDENCE_SCRIPT_AMBIGUOUS", "EVIDENCE_NOT_FOUND",
        "EVIDENCE_LOCATOR_INVALID", "EVIDENCE_LOCATOR_INVALID", "EVIDENCE_LOCATOR_INVALID",
    ]


def test_review_csv(spark, tmp_path):
    queue = spark.createDataFrame([("c1", '=1+"x"\n', "needs_review")], "claim_id string, model_raw string, capture_status string")
    page = spark.createDataFrame([(1, "true")], "scanned int, exhausted string")
    K.write_review_csv(page, queue, str(tmp_path / "out"))
    (name,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    raw = open(name, newline="", encoding="utf8").read()
    header, first, claim = list(csv.reader(io.StringIO(raw)))
    assert raw.count("\r\n") == 3 and raw.startswith('"record_type"')
    assert tuple(header) == K.REVIEW_COLUMNS
    assert (first[0], first[-2], claim[0], claim[1]) == ("page", "1", "claim", "c1")
    assert claim[header.index("model_raw_b64")] == "PTErIngiCg=="


def test_canonical_json_and_markdown_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "a|b\nc")], "z int, a string")
    K.write_canonical_json(df, str(tmp_path / "j"), ["z"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(lines) == ['{"a":"a|b\\nc","z":1}', '{"a":null,"z":2}']
    K.write_markdown(df.orderBy("z").coalesce(1), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| 1 | a\\|b c |", "| 2 |  |"]


def test_registry_is_all_or_nothing(spark):
    a = spark.createDataFrame([("m1", ["x"]), (" ", ["y"])], "id string, aliases array<string>")
    union = T.registry_union({"core": a, "seed": spark.createDataFrame([("m1", ["z"])], "id string, aliases array<string>")})
    assert [tuple(r) for r in T.repeated_registry_ids(union).collect()] == [("m1", 2, 2)]
    issues = T.registry_row_issues(union)
    assert [r.issue for r in issues.collect()] == ["ID_BLANK"]
    assert T.accepted_registry(union, issues).count() == 0
    good = union.where("trim(id) <> ''")
    assert T.accepted_registry(good, T.registry_row_issues(good)).count() == 2


def test_extractors_are_pluggable(spark):
    known = {}
    X.register_extractor("upper", lambda it: (b.assign(model_raw=b.content.str.upper())[["snapshot_id", "model_raw"]] for b in it), "snapshot_id long, model_raw string", known)
    with pytest.raises(ValueError):
        X.register_extractor("upper", None, "", known)
    snaps = spark.createDataFrame([(1, "upper", "ab"), (2, "other", "cd")], "snapshot_id long, parser_name string, content string")
    assert [tuple(r) for r in X.run_extractor(snaps, "upper", known).collect()] == [(1, "AB")]


def test_batches_are_whole_or_nothing(spark, rows):
    claims = spark.createDataFrame(
        [(1, "a", "m", "1"), (1, "b", "m", "2"), (2, "a", "m", "1"), (2, "a", "m", "1"), (3, "a", "m", "x"), (4, "a", "m", "1")],
        "s long, model_raw string, metric_raw string, score_raw string",
    )
    records = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,), (4,), (4,), (5,)], "s long")
    verdicts = X.batch_verdicts(claims, "s", ["model_raw", "metric_raw"], 1, records)
    assert {r.s: r.verdict for r in verdicts.collect()} == {
        1: None, 2: "DUPLICATE_MODEL_DIMENSION", 3: "SCORE_VALUE_INVALID", 4: "INCOMPLETE_ACCOUNTING", 5: "INCOMPLETE_ACCOUNTING",
    }
    assert {r.s for r in X.whole_batches(claims, verdicts, "s").collect()} == {1}


def test_windowed_mean_start_marks(spark):
    def score(n_marks):
        perf = spark.createDataFrame([("m", i, float(i)) for i in range(n_marks)] + [("old", 0, 4.0)], "model_raw string, mark long, pass_rate double")
        return {r.model_raw: r.score_raw for r in X.windowed_mean(perf, perf).collect()}

    assert score(20) == {"m": "17.0", "old": "4.0"}
    assert score(6)["m"] == "4.5"
    assert score(3)["m"] == "1.0"
    # More than twelve but fewer than sixteen marks: no start date at all.
    assert score(13)["m"] == "6.0"


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_csv_records_do_not_depend_on_blocks(spark, tmp_path, blocks):
    """Quoted line ends, doubled marks, blank lines and carriage returns, cut anywhere."""
    import os
    import random

    from scorelattice.sources.csvblocks import csv_records

    rng = random.Random(9)
    rows = [[rng.choice(["a", "", "x\ny", 'say "no"', "\n\n", "l,m", "é\n\"", "long " * 30]), str(i)] for i in range(600)]
    for name, ending in (("unix", "\n"), ("dos", "\r\n")):
        raw = io.StringIO()
        writer = csv.writer(raw, lineterminator=ending)
        for i, row in enumerate(rows):
            writer.writerow(row)
            if i % 50 == 7:
                raw.write(ending)
        (tmp_path / f"{name}.csv").write_bytes(raw.getvalue().encode())
    size = os.path.getsize(tmp_path / "dos.csv")
    settings = {"spark.sql.files.maxPartitionBytes": str(size // blocks + 1), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = T.numbered_records(spark, str(tmp_path), ["a", "b"]).collect()
        texts = csv_records(spark, str(tmp_path)).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert texts == len(out) == 1200
    for name in ("unix", "dos"):
        got = sorted((r["record_no"], r["a"], r["b"], r["bad"]) for r in out if r["file_path"].endswith(f"{name}.csv"))
        assert got == [(i, a, b, None) for i, (a, b) in enumerate(rows)]


def test_csv_records_of_several_lines_are_not_gathered(spark, tmp_path):
    from scorelattice.sources.csvblocks import csv_split

    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f'{i},"first\nsecond"\n' for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        few, others = csv_split(spark, str(tmp_path))
        assert "Exchange hashpartitioning" not in others._jdf.queryExecution().executedPlan().toString()
        assert 1 <= few.count() <= 8
        got = {r["record_no"]: r["record"] for r in others.unionByName(few).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {0: "a,b", **{i + 1: f'{i},"first\nsecond"' for i in range(5000)}}


def test_plain_pages_are_read_as_the_full_parser_reads_them(monkeypatch):
    import random

    from scorelattice.sources import html as H

    rng = random.Random(5)
    plain = [
        "<table>", "</table>", "<tr>", "</TR>", "<td>", "</td>", '<th class="a b" scope="row">', "</th>", "<b>", "</b>", "<Div hidden>", "a &lt; b",
        "&nbsp;", "&amp", "x&", "\n  y", "\u200b1", "<br>", "&#x41;", "> \"q\" '",
    ]
    odd = [
        "<!-- <td> -->", "<script>'<td>'</script>", "<td", "<", "</ td>", "<td/>", "<br/>", "<td a='>'>", "</td x>", "<title><td></title>",
        "<tab\u017fe>", "<tdx>", "<![CDATA[x]]>", "<td a=b>", "<?php <td> ?>", "<style><td></style>", "<textarea><tr>",
    ]
    full = lambda text: H._feed(H._Tables(), text).done
    for share in (0, 0.03, 0.3):
        for _ in range(3000):
            text = "".join(rng.choice(odd if rng.random() < share else plain) for _ in range(rng.randint(0, 30)))
            assert H._tables_of(text) == full(text), text
    assert H._tables_of(None) == H._tables_of("") == []
    # Plain markup needs no full parser.
    monkeypatch.setattr(H, "_feed", None)
    assert H._tables_of('<table><tr><td id="x">1 &lt; 2</td></tr></table> end') == [[["1 < 2"]]]
