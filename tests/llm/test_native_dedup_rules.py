"""Host-level quality rules and exact dedup: edge cases on small tables."""

import hashlib

from pyspark.sql import functions as F

from mobilis.llm.exact_dedup import exact_dedup
from mobilis.llm.quality_rules import host_rates, measures, quality_rules

DOCS = "doc_id long, text string, source string"


def _measured(spark, text):
    return measures(spark.createDataFrame([(1, text, "s")], DOCS)).first()


def test_words_split_at_ascii_blanks_only(spark):
    r = _measured(spark, "\tein\x0bzwei  drei vier\r\n")
    assert (r.n_words, r.word_chars) == (3, 16)
    assert _measured(spark, None).n_words == 0 and _measured(spark, " \n ").n_words == 0


def test_symbols_and_duplicate_lines(spark):
    r = _measured(spark, "a#b\n\na#b\n \na#b \nc<|>*$%&")
    assert r.n_symbols == 10 and r.n_dup_lines == 1


def test_documents_of_repeated_lines_fail(spark):
    """A third of the lines, not of the words: ten words a line and 90 of 100 lines repeated in changing order."""
    import random

    rng, lines = random.Random(1), [" ".join(f"w{i}x{k}" for k in range(6)) for i in range(10)]
    bad = "\n".join(rng.choice(lines) for _ in range(40))
    good = "\n".join(f"line {i} of words that differ" for i in range(30)) + "\nend\nend"
    rows = {r.doc_id: r for r in measures(spark.createDataFrame([(1, bad, "s"), (2, good, "s")], DOCS)).collect()}
    assert rows[1].n_lines == 40 and rows[1].n_dup_lines >= 30 and rows[1].failed
    assert rows[2].n_lines == 32 and rows[2].n_dup_lines == 1 and not rows[2].failed


def test_repeated_windows_count_each_word_once(spark):
    words = [f"w{i}" for i in range(30)]
    assert _measured(spark, " ".join(words)).n_repeat_words == 0
    assert _measured(spark, " ".join(words[:8] + ["x"] + words[:8])).n_repeat_words == 16
    assert _measured(spark, " ".join(["a"] * 25)).n_repeat_words == 25
    assert _measured(spark, " ".join(["a"] * 8)).n_repeat_words == 0
    assert _measured(spark, " ".join(words[:10] + words[:10])).n_repeat_words == 20


def test_repeated_windows_by_brute_force(spark):
    import random

    rng, rows = random.Random(4), []
    for i in range(40):
        rows.append((i, " ".join(rng.choices("abc", k=rng.randint(0, 200))), "s"))
    got = {r.doc_id: r.n_repeat_words for r in measures(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, _ in rows:
        w = text.split()
        runs = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        covered = {k + d for k, x in enumerate(runs) if runs.count(x) > 1 for d in range(8)}
        assert got[i] == len(covered), i


def test_bad_host_is_rejected_and_small_hosts_shrink(spark):
    good, bad = " ".join(f"w{i}" for i in range(25)), "too short"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad if i < 190 else good, "poor") for i in range(200)]
    rows += [(5000, bad, "tiny"), (5001, good, None)] + [(6000 + i, good, f"h{i % 9}") for i in range(200)]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(out) == len(rows)
    assert out[0].kept and not out[1195].kept and not out[1195].base_failed and not out[1000].kept
    assert out[5001].kept
    rates = {r.host: r for r in host_rates(measures(spark.createDataFrame(rows, DOCS))).collect()}
    assert 0 < rates["tiny"].rate < 1 and rates["poor"].host_rejected and not rates["fine"].host_rejected


def test_rules_on_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], DOCS)
    assert quality_rules(df).collect() == []
    df = spark.createDataFrame([(None, None, None, 1, "x", True), (None, None, None, 1, "x", True)],
                               DOCS + ", n_words int, host string, kept boolean")
    assert [r.kept for r in quality_rules(df).collect()] == [False, False]


def test_exact_dedup_keeps_largest_and_counts(spark):
    rows = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (7, "b"), (8, "B"), (9, "b ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("clash")).withColumn("keep_id", F.lit(0))
    out = {r.doc_id: r for r in exact_dedup(df, runs=9, fan=2).collect()}
    assert (out[1].keep_id, out[1].group_size, out[1].kept) == (5, 3, False) and out[5].kept
    assert (out[2].keep_id, out[4].kept) == (4, True) and out[7].group_size == 1
    assert out[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    low = {r.doc_id: r.keep_id for r in exact_dedup(df, keep="min").collect()}
    assert low[5] == 1 and low[4] == 2


def test_exact_dedup_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    out = exact_dedup(spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y")], schema)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup(spark.createDataFrame([], schema)).collect() == []


def test_native_plans_have_no_python(spark):
    df = spark.createDataFrame([(1, "x", "s")], DOCS)
    for out in (quality_rules(df), exact_dedup(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
