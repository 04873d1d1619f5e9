"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chunks, decontam, filters, licenses, lines, neighbours, outliers, phrases, pii, quality, simhash, toxicity
from ..session import staged
from .common import remainder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as files: each source is a tree of directories of twenty files."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id")
    path = F.concat_ws("/", "source", F.floor(number / 400).cast("string"), F.floor(number / 20).cast("string"), F.concat(number.cast("string"), F.lit(".txt")))
    return licenses.inherited(staged(licenses.scan(docs, path)))


@query
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find_spans(docs, pii.fit(docs))


@query
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), stored=True)


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality.fit(docs, table(spark, folder, "labels"))
    return quality.scored(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        (remainder("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


@query
def op5_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, folder, "documents"))


@query
def op6_toxic_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lexicon = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, lexicon).select(
        "doc_id",
        (remainder("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"),
        "weight",
        "n_words",
    )


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op8_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, folder, "documents"))
    return linked.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


@query
def op9_posting_list_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    marked = lines.mark_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(lines.kept_text().cast("binary"), 256).alias("kept_sha256"),
        F.to_json("lines.keep_runs").alias("keep_runs"),
    )


@query
def op11_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filters.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents")).drop("cut")


@query
def op13_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    judged = outliers.judged(table(spark, folder, "documents"))
    return judged.select("doc_id", *outliers.MEASURES[:5], "base_failed", "kept", "distance")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op10_line_dedup"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d),
 k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
 r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
 m AS (SELECT k.*, r.last IS NOT NULL AND r.last <> doc_id AS gone FROM k LEFT JOIN r USING (key)),
 g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id),
 s AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run, pos FROM m WHERE NOT gone),
 q AS (SELECT doc_id, '[' || string_agg('{{"start":' || a || ',"length":' || n || '}}', ',' ORDER BY a) || ']' AS runs
   FROM (SELECT doc_id, run, min(pos) AS a, count(*) AS n FROM s GROUP BY ALL) GROUP BY doc_id)
 SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256, coalesce(runs, '[]') AS keep_runs FROM g LEFT JOIN q USING (doc_id)"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op7_decontamination"] = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 iw AS (SELECT DISTINCT item, w[s : s + least(len(w), 13) - 1] AS gram FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM i WHERE len(w) > 0)),
 lens AS (SELECT DISTINCT len(gram) AS n FROM iw), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 dw AS (SELECT doc_id, s, n, w[s : s + n - 1] AS gram FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, lens WHERE len(w) >= n)),
 hit AS (SELECT DISTINCT doc_id, s, n, item FROM dw JOIN iw USING (gram)),
 words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
   coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_FAILS = r"""SELECT doc_id, part, good, toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
   + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
   + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS bits
 FROM (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents)
 LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)"""

SQL["op11_filter_interactions"] = f"""WITH RECURSIVE x AS ({_FAILS}),
 s AS (SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM x GROUP BY ALL),
 o AS (SELECT '' AS filter_order, 0 AS step, 0 AS before, '' AS letter, 0 AS bit UNION ALL
   SELECT filter_order || c, step + 1, before | bit, c, ascii(c) - 64 FROM (SELECT filter_order, step, before, CASE WHEN bit = 0 THEN 0 ELSE 1 << (bit - 1) END AS bit FROM o), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE position(c IN filter_order) = 0),
 e AS (SELECT f.filter_order, p.step, p.before, 1 << (p.bit - 1) AS bit FROM o f JOIN o p ON f.step = 5 AND p.step > 0 AND starts_with(f.filter_order, p.filter_order)),
 g AS (SELECT part, filter_order, step, any_value(bit) AS bit, sum(n) FILTER (WHERE bits & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE bits & before = 0 AND bits & bit <> 0) AS removed,
   sum(n) FILTER (WHERE bits & before <> 0 AND bits & bit <> 0) AS redundant, sum(n) FILTER (WHERE bits = bit) AS alone,
   sum(good) FILTER (WHERE bits & before = 0 AND bits & bit <> 0) AS good, sum(toxic) FILTER (WHERE bits & before = 0 AND bits & bit <> 0) AS toxic
   FROM s, e GROUP BY part, filter_order, step)
 SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
   CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic, 0) AS BIGINT) AS toxic_lost,
   CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g"""

SQL["op12_phrase_collocations"] = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
 n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
 g AS (SELECT lang, array_to_string(w[s : s + k - 1], ' ') AS phrase, k, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w), range(1, 6) t(k)
   WHERE s + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
 s AS (SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
   FROM c JOIN g l ON c.lang = l.lang AND array_to_string(w[1 : cut], ' ') = l.phrase JOIN g r ON c.lang = r.lang AND array_to_string(w[cut + 1 : c.k], ' ') = r.phrase JOIN n ON c.lang = n.lang
   QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM s
 WHERE NOT EXISTS (SELECT 1 FROM g m WHERE m.lang = s.lang AND len(string_split(m.phrase, ' ')) > len(string_split(s.phrase, ' ')) AND contains(' ' || m.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * m.a >= 100 * s.a)
 QUALIFY rank <= 2000"""
