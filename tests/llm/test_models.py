"""Quality rules, toxic lexicon, personal data."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import as_multiset, texts_of
from scorelattice.llm import pii, quality, toxicity
from scorelattice.llm.common import remainder

LABELS = "doc_id long, quality int, toxic int"


def held_out_accuracy(scored, labels, target, folds, fold):
    joined = scored.join(labels, "doc_id").where(remainder("doc_id", folds) == fold)
    rows = joined.select(target, (F.col("score") >= 0.7).cast("int").alias("p")).collect()
    return sum(r[0] == r["p"] for r in rows) / len(rows), len(rows)


def test_remainder(spark):
    df = spark.createDataFrame([(0,), (7,), (123456789012,)], "doc_id long")
    assert [r[0] for r in df.select(remainder("doc_id", 4)).collect()] == [zlib.crc32(str(i).encode()) % 4 for i in (0, 7, 123456789012)]


def test_quality_on_held_out_rows(small):
    docs, labels = small("documents", "/root/testdata/sf0.1"), small("labels", "/root/testdata/sf0.1")
    rules = quality.fit(docs, labels)
    assert 0 < len(rules.weights) < 200
    accuracy, n = held_out_accuracy(quality.scored(docs, rules), labels, "quality", quality.FOLDS, quality.HELD_OUT)
    assert n > 500 and accuracy > 0.97


def test_quality_never_learns_from_held_out_rows(small):
    docs, labels = small("documents"), small("labels")
    turned = labels.withColumn("quality", F.when(remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_rules_compile_to_what_numpy_computes(spark, odd):
    rules = quality.Rules(-0.5, ((1.5, (("upper", True, 0.01), ("chars", False, 5.0))), (-2.0, (("digits", True, 0.0),))))
    rows = quality.scored(odd, rules).select("text", "score_1" if "score_1" in odd.columns else "score").collect()
    assert len(rows) == odd.count()
    for text, score in rows:
        t = text or ""
        upper = sum(c.isupper() for c in t) / max(len(t), 1)
        digits = sum(c in "0123456789" for c in t) / max(len(t), 1)
        z = -0.5 + 1.5 * (upper > 0.01 and np.log1p(len(t)) <= 5.0) - 2.0 * (digits > 0)
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_odd_rows(spark, odd, none, small):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (8, 1, 0), (8, 0, 0), (None, 1, 1), (4, None, 0), (2, 1, 0)], LABELS)
    assert quality.accepted(none, labels).collect() == []
    assert quality.accepted(odd, labels.where("false")).count() == odd.count()  # nothing learnt, nothing rejected
    assert quality.accepted(odd, labels.where("quality = 1")).columns == odd.columns
    rules = quality.fit(small("documents"), small("labels"))
    scores = [r[0] for r in quality.scored(odd.select("doc_id", "text"), rules).select("score").collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)


def test_lasso_prefers_few_rules():
    r = np.random.default_rng(0)
    x = r.random((600, 6))
    y = ((x[:, 2] > 0.6) & (x[:, 4] <= 0.5)).astype(float)
    rules = quality.learn(list("abcdef"), x, y)
    used = {name for _, conditions in rules.weights for name, _, _ in conditions}
    assert {"c", "e"} <= used and len(rules.weights) < 60


def test_toxicity_on_held_out_rows(small):
    docs, labels = small("documents", "/root/testdata/sf0.1"), small("labels", "/root/testdata/sf0.1")
    lexicon = toxicity.fit(docs, labels)
    accuracy, n = held_out_accuracy(toxicity.scored(docs, lexicon), labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT)
    assert n > 500 and accuracy > 0.97
    turned = labels.withColumn("toxic", F.when(remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == lexicon


def test_folding():
    assert toxicity.folded("Id1ot!") == " idiot " and toxicity.folded("ѕtuр​id") == " stupid "
    assert toxicity.folded("ＦＯＯ-b4r") == " foo bar " and toxicity.folded("") == "  "


def test_hits_normalised_by_length_with_exceptions():
    lexicon = toxicity.Lexicon({" idio": 4.0, " clown ": 2.0}, frozenset({" clown fish "}), (-3.0, 2.0, 0.5))
    automaton = lexicon.automaton()
    assert toxicity.measures("You 1DIOTS, you clown", automaton) == (6.0, 4)
    assert toxicity.measures("a clown fish", automaton) == (0.0, 3)
    assert toxicity.measures("clowns videotape", automaton) == (0.0, 2)


def test_learns_words_and_exceptions(spark):
    rows = [(i, f"you are a wretch number {i}" if i % 2 else f"the kind wretch tree of {i} leaves" if i % 4 == 0 else f"calm text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], LABELS)
    lexicon = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, lexicon).collect()}
    assert all((out[i] >= 0.7) == (i % 2 == 1) for i in out)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (8, 1, 1), (5, 1, 0), (7, 1, 0), (None, 1, 1), (3, 1, None)], LABELS)
    for known in (labels, labels.where("false"), labels.where("toxic = 0")):
        out = toxicity.scored(odd, toxicity.fit(odd, known)).collect()
        assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(none, toxicity.fit(none, labels)).collect() == []


# The contract's patterns, as they are.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            good = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_follow_the_patterns(small):
    import random

    r = random.Random(5)
    made = ["".join(r.choice("01.9@a-+ ()x%é\n") for _ in range(r.randrange(60))) for _ in range(20_000)]
    made += ["@a.b@c.d", "x@y.z@w.v", "@b.c@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1.1", "001.002.003.004", "4571475004921503", "4571-4750 0492-1503",
             "+1 (986) 555-4218", "++1 22 333 4444 5", "a@b", "é@x.y", "a.@-.-", "1" * 25 + ".1.1.1", "٣@x.y ١.١.١.١"]
    for text in made + [t for _, t in texts_of(small("documents"))]:
        assert pii.base_spans(text) == brute_spans(text), text


def test_gradients_are_right():
    r = np.random.default_rng(1)
    t = pii.Tagger(4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    codes, tags = r.integers(0, pii.CLASSES, (3, 7)), r.integers(0, len(pii.TAGS), (3, 7))
    _, g = t.gradients(codes, tags)
    for name in t.p:
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in t.p[name].shape)
            kept, step = t.p[name][at], 1e-2
            t.p[name][at] = kept + step
            up = t.gradients(codes, tags)[0]
            t.p[name][at] = kept - step
            down = t.gradients(codes, tags)[0]
            t.p[name][at] = kept
            assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


@pytest.fixture(scope="module")
def tagger(small):
    return pii.fit(small("documents", "/root/testdata/sf0.1"))


def test_query_form(small, tagger, odd, none):
    for docs in (small("documents"), odd):
        out = {}
        for r in pii.find_spans(docs, tagger).collect():
            out.setdefault(r["doc_id"], []).append(r)
        for i, text in texts_of(docs):
            base = brute_spans(text)
            shown = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
            mine = [r for r in out[i] if r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()]
            assert mine
            for k in pii.KINDS:
                assert any(r[f"n_{k}"] == sum(s[2] == k for s in base) for r in mine)
            assert all({x for x in shown.split(",") if x} <= set(r["spans"].split(",")) for r in mine)
        assert sum(map(len, out.values())) == docs.count()
    assert pii.find_spans(none, tagger).collect() == [] and pii.fit(none) is None
    assert pii.find_spans(odd, None).count() == odd.count()


def test_model_adds_other_spellings(tagger, spark):
    texts = ["and then the text said finsi.18 @ mail1.example.com in the middle of the words", "or perhaps at 66-87-218-26 for the thing with words",
             "they gave 4571/4750/0492/1503 to the other one of them", "and 986 555 4218 1 was given", "version 3 of the 2 things by 1999 words and 12 more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find_spans(df, tagger).collect()}
    assert sum(out[i]["n_added"] for i in range(4)) >= 2 and out[4]["n_added"] == 0


def test_windows_cover_triggers_and_reconcile():
    text = "x" * 500 + "1" + "y" * 10 + "@" + "z" * 700 + "2" * 300
    starts = pii.windows(text)
    for m in re.finditer("[0-9@]", text):
        assert any(s <= m.start() < s + pii.WINDOW for s in starts)
    assert pii.windows("no trigger at all " * 50) == []
    # A span that two windows see in parts is one span.
    value = "1234567890123"
    long = "a " * 30 + value + " b" * 30
    tags = []
    for start in (10, 10 + 55):
        row = np.zeros(pii.WINDOW, np.int8)
        for i in range(pii.WINDOW):
            at = start + i
            if 60 <= at < 73:
                row[i] = 7 if at == 60 else 8
        tags.append(row)
    assert pii.reconciled(long, [10, 65], np.array(tags), []) == [(60, 73, "phone")]


def brute_measures(text, lexicon):
    """Every place of every term, outside every place of every exception."""
    t = toxicity.folded(text)
    inside = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(t)) if t.startswith(p, i)]
    at = {}
    for term, weight in lexicon.terms.items():
        for i in range(len(t)):
            if t.startswith(term, i) and not any(a <= i and i + len(term) <= b for a, b in inside):
                at[i] = max(weight, at.get(i, 0.0))
    return sum(at.values()), max(len(t.split()), 1)


def test_measures_against_every_place():
    import random

    r = random.Random(8)
    lexicon = toxicity.Lexicon(
        {" ab": 2.0, " abc ": 3.0, " b ": 1.0, " cab": 0.5}, frozenset({" ab b ", " b abc ", " c cab ", " abc abc "}), (-1.0, 1.0, 1.0)
    )
    automaton = lexicon.automaton()
    for _ in range(2000):
        text = " ".join(r.choice(["ab", "abc", "b", "c", "cab", "ABCD", "4b"]) for _ in range(r.randrange(12)))
        assert toxicity.measures(text, automaton) == pytest.approx(brute_measures(text, lexicon)), text


def test_many_matches_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({" bad": 2.0, " odd ": 1.0}, frozenset({" not bad ", " odd one "}))
    automaton, took = lexicon.automaton(), []
    for n in (8_000, 64_000):
        start = time.perf_counter()
        total, _ = toxicity.measures("not bad odd one bad " * n, automaton)
        took.append(time.perf_counter() - start)
        assert total == 2.0 * n
    assert took[1] < 30 * took[0] + 0.5  # eight times the text; a walk over all pairs would take 64 times


def test_a_long_text_in_many_copies_hides_no_term(spark):
    """200 copies of one long toxic text, 90 other toxic texts with one of three words, 900 clean ones."""
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    calm = [word() for _ in range(400)]
    long_text = " ".join(word() for _ in range(6000))
    text = lambda *more: " ".join(r.sample([*r.sample(calm, 30), *more], 30 + len(more)))
    rows = [(long_text, 1)] * 200 + [(text(("wretch", "zounds", "quisling")[i % 3]), 1) for i in range(90)] + [(text(), 0) for _ in range(900)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], LABELS)
    lexicon = toxicity.fit(docs, labels)
    assert any(t.startswith(" wretch") or " wretch".startswith(t.rstrip()) for t in lexicon.terms)
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, lexicon).collect()}
    assert all(score[i] >= 0.7 for i in range(200, 290)) and not any(score[i] >= 0.7 for i in range(290, 1190))


def test_copied_passages_give_no_second_terms(spark):
    """Words that only occur in one passage of many near copies have one context."""
    rows = [(f"you scoundrel {i} said so and so in the year of {i * 7} with a rare flumbox in it", 1) for i in range(60)]
    rows += [(f"a scoundrel like number {i} of the {i * 3}", 1) for i in range(60)] + [(f"calm words of number {i} in it", 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], LABELS)
    lexicon = toxicity.fit(docs, labels)
    assert any(t.startswith(" sco") for t in lexicon.terms) and not any("flumbox".startswith(t.strip()) for t in lexicon.terms)


def test_many_spans_are_reconciled_in_linear_time():
    import time

    took = []
    for n in (2_000, 16_000):
        text = "some.one@example.org and 10.20.30.40 then " * n
        base = pii.base_spans(text)
        assert len(base) == 2 * n
        starts = pii.windows(text)
        tags = np.zeros((len(starts), pii.WINDOW), np.int8)
        for row, start in zip(tags, starts):
            row[:] = pii._tags(base, start, pii.WINDOW)
        begun = time.perf_counter()
        assert pii.reconciled(text, starts, tags, base) == base
        took.append(time.perf_counter() - begun)
    assert took[1] < 30 * took[0] + 1


def test_decoded_spans_give_way_to_base_spans():
    import random

    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("12.3@a b") for _ in range(60))
        base = sorted((a, a + r.randrange(1, 9), r.choice(pii.KINDS)) for a in (r.randrange(50) for _ in range(r.randrange(6))))
        tags = np.array([[r.randrange(len(pii.TAGS)) if r.random() < 0.6 else 0 for _ in range(60)]], np.int8)
        kept = [s for s in pii.reconciled(text, [0], tags, base) if s not in base]
        alone = [s for s in pii.reconciled(text, [0], tags, [])]
        assert kept == [s for s in alone if not any(s[0] < y and x < s[1] for x, y, _ in base) and s not in base]


def test_smallest_hashes_are_the_same_however_they_are_dealt(spark):
    from scorelattice.llm.common import smallest_hashes

    df = spark.range(50_000).repartition(17)
    want = [r[0] for r in df.orderBy(F.xxhash64("id"), "id").limit(3_000).collect()]
    assert [r[0] for r in smallest_hashes(df, ["id"], 3_000, 50_000).collect()] == want
    assert smallest_hashes(df, ["id"], 60_000, 50_000).count() == 50_000
