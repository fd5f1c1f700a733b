"""Codec, token files and packing against the public libraries and brute force."""

import base64
import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mobilis.llm import bpe_codec, packing, token_cache, token_output
from mobilis.llm.token_cache import BYTE_LEVEL, LOWER_CASE, PieceEncoder, encoder

MULTI, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", "\n", "  ", " x", "x ", "a\tb  c\n\n d", "don't we'll 'tis ''s it's!! …", "naïve ½ x² a1b2", "日本語 テスト", "İstanbul ΣΑΣ ς",
       "é test ́ x", "a\x1cb", "a,,b ,c", "a\x00b c", "<|endoftext|> <|startoftext|>hi", "\x85x y", "ªº µ ﬁ", "a \n b\r\nc"]


def _odd(count, seed):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices("aé \n'.,!1\t ²İ́日_sS<|>-\xad", k=rng.randint(0, 40))) for _ in range(count)]


@pytest.mark.parametrize(("name", "cutter"), [("byte_bpe_50k.json", BYTE_LEVEL), ("word_bpe_49k.json", LOWER_CASE)])
def test_cached_ids_equal_the_library(name, cutter):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = _odd(3000, 1)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, "<u4").tolist() for b in PieceEncoder(path, cutter).encode(texts)]
    assert got == want


@pytest.fixture(scope="module")
def encoding():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (16, 8), (7, 3)])
def test_codec_equals_tiktoken_and_round_trips(spark, encoding, chunk, overlap):
    texts = _odd(150, 2) + ["x" * 60, "word " * 30, "a" * 20 + " " * 30 + "b", "long text. " * 20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (len(texts), None), (None, "tail of text without id " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("k", F.lit(1))
    out = bpe_codec.decode(bpe_codec.encode(df, MULTI, PATTERN, chunk, overlap), MULTI, PATTERN).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(out) == len(rows)
    for got, (i, t) in zip(sorted(out, key=key), sorted(rows, key=key), strict=True):
        assert (got.doc_id, got.ids, bytes(got.decoded)) == (i, encoding.encode_ordinary(t or ""), (t or "").encode())


def test_codec_on_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.encode(df, MULTI, PATTERN).collect() == []


def test_token_files_round_trip(spark, tmp_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = [(i * 3 % 101, t) for i, t in enumerate(_odd(80, 3)[:101])] + [(500, None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("start", F.lit(0))
    token_output.write_tokens(df, tmp_dir + "/t", path, parts=5)
    out = sorted(token_output.token_index(token_output.read_tokens(spark, tmp_dir + "/t")).collect(), key=lambda r: r.start)
    assert len(out) == len(rows)
    at = 0
    for r, (i, t) in zip(out, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = token_output.read_tokens(spark, tmp_dir + "/t", [500])
    assert [r.ids for r in found.collect()] == [[2]]
    assert "PushedFilters: [In(doc_id, [500])" in found._jdf.queryExecution().executedPlan().toString() or "EqualTo(doc_id,500)" in \
        found._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_an_empty_table_and_repeats(spark, tmp_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), tmp_dir + "/e", path)
    assert token_output.token_index(token_output.read_tokens(spark, tmp_dir + "/e")).collect() == []
    token_output.write_tokens(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string"), tmp_dir + "/r", path)
    out = token_output.token_index(token_output.read_tokens(spark, tmp_dir + "/r")).collect()
    assert sorted(r.start for r in out) == [0, 3]


def _check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = [(i, t) for i, t in enumerate(_odd(60, 5))] + [(900, "word " * 100), (901, None), (901, None), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("rank", F.lit(0))
    out = packing.pack(packing.pieces(df, path, capacity=32), capacity=32).collect()
    _check_packing(out, 32)
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        cut = [ids[k:k + 32] for k in range(0, len(ids), 32)]
        copies = rows.count((i, t))
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert got == sorted(copies * [(k, 32 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)])
    assert packing.pack(packing.pieces(df.limit(0), path)).collect() == []
    ids = packing.pieces(df.where("doc_id = 900"), path, capacity=32, with_ids=True).orderBy("piece").collect()
    assert [i for r in ids for i in r.ids] == plain.encode("word " * 100, add_special_tokens=False).ids + [0]


def test_equal_lengths_keep_their_order_and_spread(spark):
    rows = [(i, 0, 700) for i in range(500)] + [(1000 + i, 0, 600) for i in range(7)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long")).collect()
    assert 250 <= _check_packing(out, 2048) <= 254


@pytest.mark.parametrize("seed", range(4))
def test_rounds_are_close_to_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = [np.clip(rng.lognormal(6.2, 1, 8000).astype(int), 1, 2048), rng.integers(1, 2049, 8000), rng.integers(300, 1200, 8000),
               np.r_[rng.integers(1, 30, 8000), np.full(50, 2000)]][seed]
    sizes, counts = np.unique(lengths, return_counts=True)
    runs = packing.best_fit_rounds(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), 2048)
    used = max(first + n for _, _, n, first, _ in runs)
    gaps, best = [], 0
    for size in sorted(lengths.tolist(), reverse=True):
        k = bisect.bisect_left(gaps, size)
        if k < len(gaps):
            room = gaps.pop(k) - size
        else:
            best, room = best + 1, 2048 - size
        if room:
            bisect.insort(gaps, room)
    assert sum(n for _, _, n, _, _ in runs) == len(lengths)
    assert -(-lengths.sum() // 2048) <= used <= best * 1.01 + 1


@pytest.mark.parametrize(("name", "cutter"), [("word_bpe_49k.json", LOWER_CASE), ("byte_bpe_50k.json", BYTE_LEVEL)])
def test_words_with_marks_are_not_scanned(name, cutter):
    def scanned(text):
        raise AssertionError(text)

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    words = ["Été", "naïve,", "Straße###", "über&&&", "don", "stop.", "éclair'", "ß", "_", "|", "...", "µm%%%"]
    texts = [" ".join(words), *words]
    got = PieceEncoder(public_tokenizers.path(name), cutter).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    letters = PieceEncoder(public_tokenizers.path(name), cutter._replace(pre_tokens=scanned))
    words = ["Été", "naïve", "Straße", "ß", "don"]
    got = letters.encode(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in words]


def test_decoding_reads_lists_by_their_offsets(spark):
    path, rows = MULTI, [(1, [300, 5]), (2, None), (3, []), (4, [7])]
    tokens = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    raw = bpe_codec.codec(path, PATTERN).raw
    got = {r.doc_id: r.decoded for r in bpe_codec.decode(tokens, path, PATTERN).collect()}
    assert {k: v if v is None else bytes(v) for k, v in got.items()} == {k: v if v is None else b"".join(raw[i] for i in v) for k, v in rows}


def test_written_ids_are_read_once_and_without_pandas(spark, tmp_dir):
    token_output.write_tokens(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), tmp_dir + "/t",
                              public_tokenizers.path("byte_bpe_50k.json"))
    out = token_output.token_index(token_output.read_tokens(spark, tmp_dir + "/t"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "orc" not in plan.lower() and "PythonUDF" not in plan
    assert sorted(r.n_tokens for r in out.collect()) == [1, 3]


def test_tasks_of_a_worker_share_one_encoder():
    """A task unpickles a cutter of its own; its worker must not load the vocabulary and fill the cache again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    for cutter in (BYTE_LEVEL, LOWER_CASE):
        mine, other = (cloudpickle.loads(cloudpickle.dumps(cutter)) for _ in range(2))
        assert encoder(path, mine) is encoder(path, other)
    assert encoder(path, BYTE_LEVEL) is not encoder(path, LOWER_CASE)


def test_cache_is_bounded_and_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr(token_cache, "LIMIT", 40)
    monkeypatch.setattr(token_cache, "KEPT", 30)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), PieceEncoder(path, BYTE_LEVEL)
    texts = [f"often again w{k} x{k}y z{k % 37}" for k in range(400)]
    for text in texts:
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(enc.known.kept) <= 30 + 40 + 20 and len(enc.known) <= 2 * (30 + 40 + 20)
    assert " again" in enc.known
