"""Near-duplicate documents, repeated strings and repeated passages against brute force."""

import collections
import hashlib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from mobilis.llm.components import components
from mobilis.llm.minhash_dedup import minhash_dedup
from mobilis.llm.substring_dedup import aligned, compact_windows, cut_words, repeated_passages, substring_dedup
from mobilis.llm.suffix_dedup import suffix_dedup
from mobilis.llm.suffix_sort import deep_shallow_order, prefix_lengths

DOCS = "doc_id long, text string"


def _words(rng, n, alphabet="abcdefghij"):
    return ["".join(rng.choices(alphabet, k=5)) for _ in range(n)]


def _edited(rng, words, k):
    words = list(words)
    for i in rng.sample(range(len(words)), k):
        words[i] = "x" + str(rng.random())
    return words


def _groups(sets, percent):
    """Smallest id reachable over links of at least ``percent``, by comparing all pairs."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [4, 5])
def test_minhash_components_equal_brute_force(spark, size):
    rng, rows = random.Random(size), []
    for _ in range(6):  # groups around a base: copies with few edits, with many, and copies of copies
        base = _words(rng, 150)
        rows.append(base)
        for _ in range(14):
            rows.append(_edited(rng, rng.choice([base, base, rows[-1]]), rng.randint(0, 8)))
    rows += [_words(rng, 60) + rows[0][:50] for _ in range(20)] + [["a", "b"], ["A", "B"], ["a"], [], _words(rng, 3000)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("component_id", F.lit(1)).repartition(5)
    out = {r.doc_id: r for r in minhash_dedup(df, size=size).collect()}
    sets = {i: _set(t, size) for i, t in rows}
    want = _groups(sets, 80)
    assert {i: r.component_id for i, r in out.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in out.items())


def test_minhash_nulls_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    out = minhash_dedup(spark.createDataFrame([(3, text), (3, text), (None, text), (1, text.upper()), (4, " ")], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (3, 1, False), (3, 1, False), (4, 4, True)]
    assert minhash_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40, 60)] + [(100, i) for i in range(101, 140)] + [(200, 150), (150, 139), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 40 for i in range(40, 61)) and all(got[i] == 100 for i in (*range(100, 140), 150, 200)) and 7 not in got


def test_deep_shallow_order_and_prefixes():
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 40))) for _ in range(300)] + [b"x" * 30 + bytes([i]) for i in range(9)] + [b"x" * 30] * 3
    starts = [0, 100, 101, len(strings)]
    order = deep_shallow_order(strings, starts)
    for a, b in zip(starts, starts[1:], strict=False):
        assert sorted(order[a:b]) == list(range(a, b))
        got = [strings[i] for i in order[a:b]]
        # zero bytes pad short heads, so a string may stand next to itself with zeros added; neighbours still share most
        assert collections.Counter(got) == collections.Counter(strings[a:b])
    lcp = prefix_lengths(strings, order, set(starts))
    assert all(strings[order[k]][:n] == strings[order[k - 1]][:n] for k, n in enumerate(lcp) if n)


def _cut_bytes(rows, length):
    count, out = collections.Counter(), {}
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[s:s + length] for s in range(len(b) - length + 1))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest(), rest)
    return out


@pytest.mark.parametrize(("length", "gram", "block"), [(20, 8, 50_000), (20, 8, 5), (24, 24, 7)])
def test_suffix_dedup_equals_brute_force(spark, length, gram, block):
    rng, rows = random.Random(length + block), []
    base = "".join(rng.choices("abé\0", k=200))
    for i in range(120):
        kind, t = rng.random(), "".join(rng.choices("ab é", k=rng.randint(0, 120)))
        if kind < 0.4:
            a = rng.randint(0, 150)
            t = t[:rng.randint(0, len(t))] + base[a:a + rng.randint(10, 50)] + t
        elif kind > 0.9 and rows:
            t = rng.choice(rows)[1]
        elif kind > 0.85:
            t = "ab" * rng.randint(0, 60)
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, "z" * 300), (503, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("sha", F.lit("clash")).withColumn("gram", F.lit(0))
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffix_dedup(df, length, gram, block, keep_text=True).collect()}
    assert out == _cut_bytes(rows, length)


def test_suffix_dedup_long_texts_span_slices(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=450))
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in (700_000, 530_000)]
    at = (1 << 19) - 600
    rows = [(1, texts[0][:at] + passage + texts[0][at:]), (2, texts[1][:100] + passage + texts[1][100:]), (3, "short")]
    out = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert 450 <= out[1].n_removed <= 460 and out[1].n_removed == out[2].n_removed and out[1].n_spans == 1 and out[3].n_removed == 0


def test_suffix_dedup_nulls_repeats_and_empty(spark):
    out = suffix_dedup(spark.createDataFrame([(1, "abcdefgh" * 3), (1, "abcdefgh" * 3), (None, "q" * 5), (None, "rstuvwxy")], DOCS), 8, 4).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (0, 0), (1, 24), (1, 24)]
    assert suffix_dedup(spark.createDataFrame([], DOCS), 8, 4).collect() == []


def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    values, nodes, left, right = compact_windows(tokens, 12, 1)
    ranks = {}
    for v, i, a, b in zip(values, nodes, left, right, strict=True):
        ranks[int(i)] = (int(a), int(b))
        assert b - a + 1 >= 12 and a <= i <= b
    # Every window of the width has its smallest hash at one node, whose span holds the window.
    for s in range(300 - 11):
        assert sum(a <= s and s + 11 <= b for a, b in ranks.values()) >= 1
    assert len(set(values.tolist())) == len(values)


def test_aligned_takes_the_nearest_of_several_places_without_a_call_each():
    rng = np.random.default_rng(7)
    line = rng.integers(0, 1 << 60, 60, np.uint64)
    a, b = np.tile(line, 20), np.concatenate([rng.integers(0, 1 << 60, 30, np.uint64), np.tile(line, 12)])
    hits = [(60 * k + 5, 30 + 60 * m + 5) for k in (0, 3, 9) for m in (0, 4)]
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "c_call" and "argmin" in str(arg) else None)
    try:
        found = aligned(a, b, hits, 46, 80)
    finally:
        sys.setprofile(None)
    assert not calls  # one for each repeated shingle and hit before
    assert found
    for begin, end, left, right in found:
        assert end - begin >= 46 and (b[begin:end] == a[left:right]).all()


def test_aligned_finds_similar_stretches():
    rng = np.random.default_rng(2)
    a, passage = rng.integers(0, 2 ** 62, 200).astype(np.uint64), rng.integers(0, 2 ** 62, 80).astype(np.uint64)
    changed = passage.copy()
    changed[40:45] = 1
    left, right = np.r_[a[:50], passage, a[50:90]], np.r_[a[100:130], changed, a[130:170]]
    assert aligned(left, right, [(60, 40)], 46, 80) == [(30, 110, 50, 130)]
    assert aligned(left, right[:60], [(60, 40)], 46, 80) == []


def _longest_similar(a, b, width, percent):
    """The longest stretch of b, from a match to a match, that some stretch of a resembles enough."""
    best = 0
    for y0 in range(len(b)):
        for y1 in range(y0 + max(width, best + 1), len(b) + 1):
            right = set(b[y0:y1])
            if b[y0] not in a or b[y1 - 1] not in a:
                continue
            left = set(a[a.index(b[y0]):a.index(b[y1 - 1]) + 1])
            if 100 * len(left & right) >= percent * len(left | right):
                best = y1 - y0
    return best


@pytest.mark.parametrize("inserted", [9, 12, 14])
@pytest.mark.parametrize("known", [False, True])
def test_aligned_passes_over_long_insertions(inserted, known):
    rng = random.Random(inserted)
    words = _words(rng, 110)
    phrase = _words(rng, inserted)
    left = _words(rng, 30) + words + _words(rng, 20) + (phrase if known else [])
    for x, y in ((left, _words(rng, 25) + words[:55] + phrase + words[55:] + _words(rng, 25)),
                 (_words(rng, 25) + words[:55] + phrase + words[55:] + _words(rng, 25), left)):  # inserted, then deleted
        a, b = ([" ".join(w[k:k + 5]) for k in range(len(w) - 4)] for w in (x, y))
        code = {t: k + 1 for k, t in enumerate(dict.fromkeys(a + b))}
        hit = (a.index(" ".join(words[20:25])), b.index(" ".join(words[20:25])))
        spans = aligned(np.array([code[t] for t in a], np.uint64), np.array([code[t] for t in b], np.uint64), [hit], 46, 80)
        assert max(e - s for s, e, *_ in spans) == _longest_similar(a, b, 46, 80)


def test_repeated_passages_with_an_insertion(spark):
    rng = random.Random(21)
    p = _words(rng, 91)
    rows = [(1, " ".join(_words(rng, 40) + p + _words(rng, 40))), (2, " ".join(_words(rng, 30) + p[:45] + _words(rng, 9) + p[45:] + _words(rng, 30)))]
    assert [(r.doc_id, r.source_doc_id, r.begin, r.end) for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()] == [(2, 1, 30, 130)]


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(3)
    p, q = _words(rng, 60), _words(rng, 80)
    long = _words(rng, 25) + q + _words(rng, 5)
    texts = {1: _words(rng, 100) + p + _words(rng, 50), 2: _words(rng, 30) + p + _words(rng, 40), 3: p, 4: _words(rng, 200),
             5: _words(rng, 10) + q + _words(rng, 30) + p + _words(rng, 20), 6: _edited(rng, q, 1) + _words(rng, 100), 7: _words(rng, 300),
             8: _words(rng, 20) + p[:40] + _words(rng, 50), 9: long, 12: list(long), 11: []}
    return [(i, " ".join(w)) for i, w in texts.items()] + [(14, None), (None, " ".join(p))]


def test_repeated_passages(spark, passages):
    df = spark.createDataFrame(passages, DOCS).withColumn("value", F.lit("clash")).withColumn("hub", F.lit(0))
    spans = repeated_passages(df)
    found = {(r.doc_id, r.begin, r.end) for r in spans.collect()}
    assert {(2, 30, 90), (3, 0, 60), (5, 120, 180), (9, 25, 105), (12, 0, 110)} <= found
    assert {i for i, _, _ in found} == {2, 3, 5, 6, 9, 12} and all(b - a > 70 for i, a, b in found if i == 6)
    cut = {r.doc_id: r for r in substring_dedup(df, spans).collect()}
    assert cut[3].text == "" and cut[2].n_removed == 60 and cut[14].text is None and cut[1].n_removed == cut[4].n_removed == cut[8].n_removed == 0
    assert cut[5].text.split()[:10] == dict(passages)[5].split()[:10] and len(cut) == len(passages)


def test_repeated_passages_cover_every_shared_run(spark):
    rng, rows = random.Random(8), []
    shared = [_words(rng, rng.randint(50, 90)) for _ in range(12)]
    for i in range(80):
        w = _words(rng, rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared) + _words(rng, rng.randint(0, 60))
        rows.append((i, " ".join(w)))
    spans = collections.defaultdict(list)
    for r in repeated_passages(spark.createDataFrame(rows, DOCS).repartition(7)).collect():
        spans[r.doc_id].append((r.begin, r.end))
    held = collections.defaultdict(list)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            held[tuple(w[k:k + 50])].append((i, k))
    for places in held.values():
        first = min(i for i, _ in places)
        for i, k in places:
            if i != first:
                assert any(a <= k and k + 50 <= b for a, b in spans[i]), (i, k)
    # One copy of every shared passage is still there.
    cut = " \n ".join(cut_words(t, spans[i])[0] for i, t in rows)
    used = [p for p in shared if any(" ".join(p) in t for _, t in rows)]
    assert used and all(" ".join(p[10:-10]) in " ".join(cut.split()) for p in used)


def test_repeated_passages_edge_tables(spark):
    assert repeated_passages(spark.createDataFrame([], DOCS)).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = repeated_passages(spark.createDataFrame([(1, text), (1, text), (2, "w " * 500), (3, "w " * 500)], DOCS)).collect()
    assert [(r.doc_id, r.source_doc_id, r.begin, r.end) for r in rows] == [(3, 2, 0, 500)]


def test_similar_stretches_share_a_run():
    from mobilis.llm.substring_dedup import run_length

    assert run_length(5, 46, 80) == 12
    # The fewest breaks and matches that bound allows: 3 breaks of 4 unmatched shingles each take 48 matches, 12 a run.
    assert min(-(-max(37, 16 * e) // (e + 1)) for e in range(1, 50)) == 12


def test_repeated_passages_that_meet_no_hub(spark):
    """Groups of three: the first leads the buckets, the third has the second's version, and a passage that only these two have."""
    rng, rows = random.Random(31), []
    for g in range(0, 300, 10):
        p = _words(rng, 60)
        changed = list(p)
        changed[20], changed[40] = "x1", "x2"
        q = _words(rng, 55)
        rows += [(g + 1, " ".join(_words(rng, 40) + p)), (g + 2, " ".join(_words(rng, 30) + changed + _words(rng, 20) + q)),
                 (g + 3, " ".join(changed + _words(rng, 35) + q))]
    found = {(r.doc_id, r.source_doc_id, r.begin, r.end) for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {(g + 3, g + 2, *span) for g in range(0, 300, 10) for span in ((0, 60), (95, 150))}


def test_a_round_without_spans_is_not_the_end(spark):
    rng = random.Random(7)  # the second and third share one hash that the first lacks
    p = _words(rng, 60)
    changed = list(p)
    changed[20], changed[40] = "x1", "x2"
    rows = [(1, " ".join(_words(rng, 40) + p)), (2, " ".join(_words(rng, 30) + changed + _words(rng, 20))), (3, " ".join(changed + _words(rng, 35)))]
    rows += [(i, " ".join(_words(rng, 150))) for i in range(10, 400)]  # buckets seldom span partitions
    assert [tuple(r) for r in repeated_passages(spark.createDataFrame(rows, DOCS)).select("doc_id", "source_doc_id", "begin", "end").collect()] == [(3, 2, 0, 60)]


def test_listed_spans_stay_sources(spark):
    """The second is listed for the first; the third is similar to the second's passage, not enough to the first's."""
    rng, rows = random.Random(32), []
    for g in range(0, 300, 10):
        p = _words(rng, 100)
        second, third = list(p), list(p)
        second[30] = third[30] = "x1"
        third[60] = third[90] = "x2"  # 85 of 105 shared with the second, 86 of 114 or so with the first
        third[10] = second[10] = "x3"
        rows += [(g + 1, " ".join(_words(rng, 40) + p)), (g + 2, " ".join(_words(rng, 30) + second + _words(rng, 20))), (g + 3, " ".join(third + _words(rng, 35)))]
    spans = collections.defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect():
        spans[r.doc_id].update(range(r.begin, r.end))
    for g in range(0, 300, 10):
        assert set(range(30, 130)) <= spans[g + 2] and len(spans[g + 3] & set(range(100))) >= 90, g


def test_cut_words():
    assert cut_words("a b\n c  d e", [(1, 3)]) == ("a d e", 2)
    assert cut_words("a b c", [(0, 2), (1, 3)]) == ("", 3) and cut_words(" a b", []) == (" a b", 0) and cut_words("", [(0, 3)]) == ("", 0)


def test_buckets_do_not_depend_on_batches():
    import pyarrow as pa

    from mobilis.llm.substring_dedup import _buckets

    rng = random.Random(12)
    for _ in range(60):
        rows = sorted((rng.randint(0, 6) ** 2, rng.randint(0, 30), rng.randint(0, 5)) for _ in range(rng.randint(1, 40)))
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randint(0, 6)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        names = ["value", "doc_id", "node"]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in range(3)], names=names) for p in parts]
        out = [tuple(r.values()) for b in _buckets(names)(iter(batches)) for r in b.to_pylist()]
        first = {}
        for v, d, n in rows:
            first.setdefault(v, (d, n))
        count = collections.Counter(r[0] for r in rows)
        want = [(*r, *first[r[0]]) for r in rows if count[r[0]] > 1 or r[0] in (rows[0][0], rows[-1][0])]
        assert sorted(out) == sorted(want)


def test_a_short_common_line_makes_no_pairs_and_no_table_stays(spark, monkeypatch):
    import glob

    from mobilis.llm import substring_dedup as module
    from mobilis.session import checkpoint_root

    rng, met, counts = random.Random(5), module._met, []
    folder = checkpoint_root(spark).removeprefix("file:") + "/tables/passage-*"
    before = set(glob.glob(folder))
    monkeypatch.setattr(module, "_met", lambda pairs, agree: counts.append((out := met(pairs, agree)).count()) or out)
    line, p = _words(rng, 13), _words(rng, 60)  # the line is shorter than any run that a passage must share
    rows = [(i, " ".join(_words(rng, 70) + line + _words(rng, 70))) for i in range(80)] + [(100 + i, " ".join(_words(rng, 30) + p)) for i in range(2)]
    found = repeated_passages(spark.createDataFrame(rows, DOCS))
    left = set(glob.glob(folder)) - before
    assert [(r.doc_id, r.source_doc_id, r.begin, r.end) for r in found.collect()] == [(101, 100, 30, 90)]
    assert sum(counts) < 80  # 3,160 pairs of documents have the line
    assert {n.rsplit("/", 1)[1].split("-")[1] for n in left} <= {"classes", "spans"}


def test_nodes_of_many_texts_are_those_of_each():
    from mobilis.llm.substring_dedup import nodes_of, thinned

    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (0, 30, 11, 12, 200, 5)] + [np.full(300, 9, np.uint64), np.tile(rng.integers(0, 2 ** 63, 3).astype(np.uint64), 70)]
    value, text, node = nodes_of(np.concatenate(texts), np.cumsum([len(t) for t in texts]), 12, 2)
    for k, t in enumerate(texts):
        one, at, *_ = compact_windows(t, 12, 2)
        got = set(zip(value[text == k].tolist(), node[text == k].tolist(), strict=True))
        assert got <= set(zip(one.tolist(), at.tolist(), strict=True)) and {v for v, _ in got} == set(one.tolist())
        assert len(got) == len(one) if k < 6 else len(got) < 60  # a streak has its ends and every 16th
    assert thinned(np.array([1] * 40 + [2, 2, 3]), np.zeros(43, int)).sum() == 2 + 2 + 2 + 3


def test_windows_are_shared_by_the_words_around_a_node(spark):
    import pyarrow as pa

    from mobilis.llm.substring_dedup import _grams, shares_window

    rng = random.Random(6)
    line = _words(rng, 16)
    texts = [" ".join(_words(rng, 40) + line + _words(rng, 30)), " ".join(_words(rng, 9) + line), " ".join(line[:15] + _words(rng, 30)), " ".join(_words(rng, 20) + line[1:14])]
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2, 3], "text": texts})
    rows = [r for b in _grams(11, 6)(iter([batch])) for r in b.to_pylist()]
    nodes = spark.createDataFrame([(r["value"], r["doc_id"], r["node"]) for r in rows], "value long, doc_id long, node long")
    other = nodes.toDF("value", "hub", "hub_node")
    both = nodes.join(other, "value").where((F.col("doc_id") < F.col("hub")) & shares_window(F.col("node"), F.col("hub_node"), 5))
    assert {(r.doc_id, r.hub) for r in both.collect()} == {(0, 1)}


def test_documents_that_share_a_line_alone_are_not_aligned(spark, monkeypatch):
    """A line and a repeated word, each shorter than a passage, in many documents: every pair of them was aligned."""
    from mobilis.llm import substring_dedup as module

    rng, met, counts = random.Random(15), module._met, []
    monkeypatch.setattr(module, "_met", lambda pairs, agree: counts.append((out := met(pairs, agree)).count()) or out)
    line, p, q = _words(rng, 20), _words(rng, 35), _words(rng, 30)
    rows = [(i, " ".join(_words(rng, 40) + line + _words(rng, 40) + ["again"] * (20 + i % 7) + _words(rng, 30))) for i in range(80)]
    rows += [(100 + i, " ".join(_words(rng, 30) + line + p + _words(rng, 20))) for i in range(2)]  # the line is part of a passage
    rows += [(200 + i, " ".join(_words(rng, 9) + ["again"] * 22 + q + _words(rng, 9))) for i in range(2)]
    rows += [(300 + i, " ".join(_words(rng, 20) + ["again"] * (60 + 5 * i) + _words(rng, 20))) for i in range(2)]
    found = {(r.doc_id, r.source_doc_id, r.begin, r.end) for r in repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(counts) < 400  # 3,160 pairs of documents have the line, as many the word
    assert {(101, 100, 30, 85), (201, 200, 9, 61)} <= found
    assert any(f[0] == 301 and f[1] == 300 and f[3] - f[2] >= 60 for f in found) and {f[0] for f in found} <= {101, 201, 301}


def test_may_match_keeps_what_is_similar():
    from mobilis.llm.substring_dedup import may_match, near_shingles

    rng, kept = np.random.default_rng(5), 0
    for _ in range(150):
        a = rng.integers(0, 1 << 63, int(rng.integers(60, 700))).astype(np.uint64)
        b = a.copy()
        b[rng.random(len(b)) < rng.choice([0.02, 0.05, 0.12])] = rng.integers(0, 1 << 63)
        cut = int(rng.integers(0, 40))
        b = np.concatenate([rng.integers(0, 1 << 63, 20).astype(np.uint64), b[cut:]])
        same = [y for y in range(20, len(b) - 12) if (b[y:y + 12] == a[y - 20 + cut:y - 8 + cut]).all()]
        if not same:
            continue
        y = int(rng.choice(same))
        x = y - 20 + cut
        spans = aligned(a, b, [(x, y)], 46, 80)
        may = may_match(near_shingles(b, y, 12, 46)[None], near_shingles(a, x, 12, 46)[None], 12, 46, 80)
        assert may.shape == (1, 1)
        if any(s[0] <= y and y + 12 <= s[1] for s in spans):
            kept += 1
            assert may[0, 0]
    assert kept > 50
    alone = [np.concatenate([rng.integers(0, 1 << 63, 80).astype(np.uint64), np.arange(12, dtype=np.uint64) << np.uint64(50), rng.integers(0, 1 << 63, 80).astype(np.uint64)]) for _ in range(2)]
    assert not may_match(*(near_shingles(t, 80, 12, 46)[None] for t in alone), 12, 46, 80).any()
