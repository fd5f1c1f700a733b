"""Registered queries of the corpus operators: each applies one operator to a whole given table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilis.llm import bpe_codec, html_extract, lang_id, oracle, packing, token_output, warc
from mobilis.llm.collocations import collocations
from mobilis.llm.common import let, table, words
from mobilis.llm.exact_dedup import exact_dedup
from mobilis.llm.minhash_dedup import minhash_dedup
from mobilis.llm.periodic_runs import periodic_runs
from mobilis.llm.quality_rules import quality_rules
from mobilis.llm.substring_dedup import repeated_passages
from mobilis.llm.suffix_dedup import suffix_dedup
from mobilis.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op2_minhash_dedup(spark, sf_dir):
    return minhash_dedup(table(spark, sf_dir, "documents"), size=4)


@register
def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumn("has_repeat", F.col("n_removed") > 0)


@register
def op5_bpe_codec(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op6_best_fit_packing(spark, sf_dir):
    rows = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(rows)


@register
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@register
def op10_token_output(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.token_index(token_output.read_tokens(spark, path))


@register
def op8_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents")).withColumn("n_words", F.col("end") - F.col("begin"))


@register
def op4_lang_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = lang_id.lang_id(docs.withColumn("doc_id", F.struct("doc_id", held_out.alias("held_out"))), lang_id.fit(docs, held_out))
    return found.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")


@register
def op9_html_extract(spark, sf_dir):
    return html_extract.html_extract(table(spark, sf_dir, "pages"), html_extract.train())


@register
def op11_warc(spark, sf_dir):
    path = scratch_path(spark, "warc-files")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, planted_periods(F.col("doc_id"), F.col("text")))
    longest = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    length = -longest["l"]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest["start"].alias("start"), length.alias("length"),
                        longest["period"].alias("period"), F.floor(1000 * length / longest["period"]).alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted_periods(doc_id, text):
    """The text, for one id in ten with its words from one on repeated with a period, both by the id's checksum."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        return F.array_join(F.transform(place, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when((h % 10 == 0) & (F.size(words(text)) > 0), let(words(text), planted)).otherwise(text)


@register
def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
