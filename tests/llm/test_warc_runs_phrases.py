"""Web archives, periodic runs and phrase collocations against brute force, and their edge tables."""

import gzip
import hashlib
import random
import re
import zlib
from base64 import b32encode
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mobilis.llm import warc
from mobilis.llm.collocations import collocations
from mobilis.llm.lce import Extensions
from mobilis.llm.periodic_runs import find_runs, periodic_runs

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def _digest(text):
    return b32encode(hashlib.sha1(text.encode()).digest()).decode()


def _pages():
    rng = random.Random(3)
    texts = ["", "ä€😀" * 40, "<p>x</p>" * 5000, "one", "two", "a\r\n\r\nb"]
    rows = [(i, f"http://h/{i}", rng.choice([*texts, f"page {i} " * rng.randint(1, 300)])) for i in range(120)]
    return [*rows, (500, None, None), (501, "http://h/with blank\r\nX-Page-ID: 9", "one"), (None, "http://n", "one"), (None, "u", "only null")]


def _files(folder):
    return {f.name: f.read_bytes() for f in sorted(folder.iterdir()) if f.name.endswith(".warc.gz")}


def test_archive_round_trip_revisits_and_standard_readers(spark, tmp_path):
    rows = _pages()
    df = spark.createDataFrame(rows, PAGES).withColumn("sha", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(5)
    path = str(tmp_path / "w")
    warc.write_warc(df, path, shard_bytes=20_000, roll_bytes=1500)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    last = {}
    for page_id, _, html in rows:
        if page_id is not None:
            last[html or ""] = max(page_id, last.get(html or "", -1))
    found = {(r.page_id, r.payload_digest): r for r in got}
    for page_id, url, html in rows:
        html = html or ""
        r = found[page_id, _digest(html)]
        keep = last.get(html, page_id)
        assert r.payload_bytes == len(html.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == keep else ("revisit", keep))
        assert (bytes(r.payload) == html.encode()) if r.record_type == "response" else r.payload is None
        assert r.url == (url if page_id != 501 else "http://h/with%20blank%0D%0AX-Page-ID:%209")
    files, listed = _files(tmp_path / "w"), {r.name: r for r in warc.manifest(spark, path).collect()}
    assert set(files) == set(listed) and len(files) > 5 and max(r.number for r in listed.values()) > 0
    for name, data in files.items():
        assert hashlib.sha256(data).hexdigest() == listed[name].sha256 and len(data) == listed[name].bytes
        plain = gzip.decompress(data)  # any gzip reader takes the members one after the other
        assert plain.count(b"WARC/1.1\r\nWARC-Type: ") == listed[name].records + 1
    # the address of a record leads to it
    r = next(r for r in got if r.record_type == "response" and r.payload_bytes > 100)
    content = zlib.decompressobj(31).decompress(files[r.file][r.offset:])
    assert warc.parse(content)[0]["X-Page-ID"] == str(r.page_id)


def test_archive_is_the_same_however_spark_splits_the_pages(spark, tmp_path):
    df = spark.createDataFrame(_pages(), PAGES)
    made = []
    for k, parts in enumerate((1, 3, 11)):
        warc.write_warc(df.repartition(parts, F.rand(k)), str(tmp_path / str(k)), shard_bytes=30_000, roll_bytes=2000)
        made.append(_files(tmp_path / str(k)))
    assert len(made[0]) > 3 and made[0] == made[1] == made[2]


def test_archive_commit_and_damage(spark, tmp_path):
    df = spark.createDataFrame(_pages(), PAGES)
    path = str(tmp_path / "w")
    warc.write_warc(df, path)
    with pytest.raises(OSError):
        warc.write_warc(df, path)  # an archive is never overwritten
    (tmp_path / "w" / ".shard-000000-00000.warc.gz.dead.tmp").write_bytes(b"left over")
    assert warc.read_warc(spark, path).count() == len(_pages())
    name = next(iter(_files(tmp_path / "w")))
    data = bytearray((tmp_path / "w" / name).read_bytes())
    data[-30] ^= 1
    (tmp_path / "w" / name).write_bytes(bytes(data))
    with pytest.raises(Exception):
        warc.read_warc(spark, path).collect()


def test_archive_smaller_payloads_never_revisit_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd")]
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "m"), min_bytes=3)
    got = warc.read_warc(spark, str(tmp_path / "m"), payloads=False).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]
    warc.write_warc(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).collect() == [] and _files(tmp_path / "e") == {}


def test_shard_bounds_are_few_and_in_order(spark):
    rows = [(i % 900, f"{i:064d}", 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, sha string, n_bytes long")
    bounds = warc.shard_bounds(df, shard_bytes=1, max_shards=7)
    assert bounds == sorted(bounds) and len(bounds) <= 8 and bounds[-1] == (True, 899, max(s for p, s, _ in rows if p == 899))


# ---------------------------------------------------------------- periodic runs
def _runs(w, min_length=6, exponent=4):
    """(start, period, length), by comparing each word with the one a period later."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, q, n) for (s, n), q in out.items())


def _periodic(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_common_extensions_by_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        w = _periodic(rng, rng.randint(2, 150), rng.choice([1, 2, 4])) + [99]
        ext = Extensions(np.array(w) + 1)
        pairs = [(x, y) for x in range(len(w)) for y in range(len(w)) if x != y]
        got = ext(*(np.array(z) for z in zip(*pairs, strict=True)))
        for (x, y), n in zip(pairs, got.tolist(), strict=True):
            k = 0
            while max(x, y) + k < len(w) and w[x + k] == w[y + k]:
                k += 1
            assert n == k


def test_runs_by_brute_force(monkeypatch):
    from mobilis.llm import periodic_runs as module

    rng = random.Random(1)
    for trial in range(150):
        monkeypatch.setattr(module, "POINTS", rng.choice([1, 50, 1 << 21]))
        docs = [_periodic(rng, rng.choice([0, 1, 3, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 6))]
        exponent, least = rng.choice([2, 3, 4, 4]), rng.choice([1, 6, 6, 10])
        ends = np.cumsum([0, *map(len, docs)])
        text, start, length, period = find_runs(np.array([x for d in docs for x in d], np.int64), ends, least, exponent)
        for k, d in enumerate(docs):
            at = text == k
            assert list(zip(start[at].tolist(), period[at].tolist(), length[at].tolist(), strict=True)) == _runs(d, least, exponent), trial


def test_runs_edge_tables(spark):
    schema = "doc_id long, text string, runs int, collapsed string"
    long = " ".join(["la"] * 30_000)
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (3, " \n", 1, "x"), (None, "\x0ba a\ta a  a a\n", 1, "x"), (5, long, 1, "x"), (5, long, 1, "x"),
            (6, "x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y", 1, "x")]
    got = sorted(periodic_runs(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert found == [(None, 6, [(0, 6, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (5, 30_000, [(0, 30_000, 1)], "la"),
                     (5, 30_000, [(0, 30_000, 1)], "la"), (6, 6, [(0, 6, 1)], "x\xa0y")]
    assert periodic_runs(spark.createDataFrame([], schema)).collect() == []


def test_op12_query_by_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 5000:
            continue
        runs = _runs(w)
        planted += bool(runs)
        drop = {i for s, q, m in runs for i in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        best = min(((-m, s, q) for s, q, m in runs), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert got[doc_id] == (len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), doc_id
    assert planted > 5


# ---------------------------------------------------------------- collocations
def _phrases(rows, least, longest, top, covered):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,longest,top,covered,small", [(3, 4, 2000, 80, 0), (2, 5, 4, 80, 10**6), (4, 2, 10, 50, 9), (30, 4, 2000, 80, 10**6)])
def test_phrases_by_brute_force(spark, least, longest, top, covered, small):
    rng = random.Random(least)
    words = ["a", "B", "b", "c", "ä", "Ä", "d\xa0e", "f"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for _ in range(rng.randint(0, 60))),
             rng.choice(["x", "y", None, "und"])) for _ in range(80)]
    rows += [(None, "x"), ("", None), ("... ,", "z"), ("hot Copy " * 40, "x")] + [("the same text twice", "y")] * 40
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS b", "2 AS place", "'w' AS word", "3 AS n")
    got = sorted(tuple(r) for r in collocations(df, least, longest, top, covered, small).collect())
    assert got == _phrases(rows, least, longest, top, covered)


def test_ids_that_do_not_fit_into_one_number(spark, monkeypatch):
    from mobilis.llm import collocations as module

    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcd") for _ in range(30)), "x") for _ in range(30)]
    plain = module._extended
    monkeypatch.setattr(module, "_extended", lambda here, largest: plain(here, 1 << 40))
    got = sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, "text string, lang string"), 5).collect())
    assert got == _phrases(rows, 5, 4, 2000, 80) and got


def test_phrases_of_empty_tables_and_no_candidates(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([("a b", "x"), (None, None)], "text string, lang string")).collect() == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("phrases", "frequent"))]


def test_phrase_counts_pass_64_bits_in_products(spark):
    from mobilis.llm.collocations import _scored

    big = 4_000_000_000_000_000_000
    df = spark.createDataFrame([(big, [big], [big])], "a long, heads array<long>, tails array<long>")
    r = _scored(df, 2).first()
    assert (r.score, r.l, r.r) == (1_000_000, big, big)


def test_occurrences_are_joined_where_they_lie(spark):
    """Neither the merge join nor the semi-join shuffles occurrences, with a broadcast dictionary or one in buckets."""
    from mobilis.llm import collocations as module
    from mobilis.llm.buckets import Buckets, bucket_joins, labels

    tables, n = Buckets(spark), 8
    df = spark.createDataFrame([("a b c. d e", "x")] * 50, "text string, lang string")
    try:
        with bucket_joins(spark):
            relation = tables.store_here(module.occurrences(df, labels(spark, n)), "test-relation", n)
            _, dictionary = module._words(relation, 1, n)
            for small in (0, 100):
                here = module._semi_joined(relation, dictionary, ["lang", "word"], tables, f"test-{small}", n, small)
                plan = module._extended(here, 1)._jdf.queryExecution().executedPlan().toString()
                assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
                assert ("BroadcastHashJoin" if small else "ShuffledHashJoin") in plan
    finally:
        tables.drop_all()
