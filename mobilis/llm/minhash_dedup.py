"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``side`` hashes are computed per document, each hash made of
``width`` minima. Every pair (i-th of the first, j-th of the second) is the key of
one of ``side`` x ``side`` tables, so the minima needed are about the square root
of what as many separate tables would take. A key can only be shared where both
its halves are, so halves that no other document has are dropped before pairs
are formed.

Candidates are verified on full shingle sets. Inside a table's bucket documents
are compared with one hub first, the one with the smallest share of shingles
that nobody else has; what the hub links needs no further comparison with each
other. Counts alone rule out many: a document shares at most the shingles that
are not its own alone. Where buckets join documents that are still in different
components, those outside the largest are looked up among all the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.llm.common import shuffle_partitions, stored
from mobilis.llm.components import components
from mobilis.llm.shingles import mixed, shingle_hashes, shingle_set, word_hashes, word_list

SHINGLE = 5
#: Link when PERCENT * |union| <= 100 * |intersection|.
PERCENT = 80
#: Hashes of each of the two collections, and minima in each hash. At a similarity of 0.8 a pair is
#: missed with probability 2 * (1 - 0.8 ** 3) ** 16 = 0.00002, less above.
SIDE, WIDTH = 16, 3
_SEED = 20
#: Documents that are indexed together when the rest of a group is looked up.
BLOCK = 4096


def _signatures(size: int, side: int, width: int):
    def run(batches: Iterator):
        import hashlib

        import pyarrow as pa

        rng = np.random.default_rng(_SEED)
        factors = rng.integers(0, 2 ** 63, 2 * side * width, np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 2 ** 63, 2 * side * width, np.uint64)[:, None]
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                keys, counts, halves = [], [], np.zeros((part.num_rows, 2 * side), np.uint64)
                for row, text in enumerate(part.column("text").to_pylist()):
                    words = word_list(text)
                    found = np.unique(shingle_hashes(word_hashes(words), size))
                    keys.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                    counts.append(len(found))
                    if words:
                        low = np.full(len(factors), np.iinfo(np.uint64).max)
                        for at in range(0, len(found), 4096):  # bounded memory, however long the text
                            low = np.minimum(low, (factors[:, None] * found[at:at + 4096] + shifts).min(axis=1))
                        joint = low.reshape(2 * side, width)
                        for c in range(width):
                            halves[row] = mixed(halves[row] * np.uint64(0x9E3779B97F4A7C15) + joint[:, c])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                     pa.FixedSizeListArray.from_arrays(pa.array(halves.reshape(-1).view(np.int64)), 2 * side).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "key", "n_shingles", "halves"])
    return run


def _sets(size: int):
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = [shingle_set(t, size) for t in part.column("text").to_pylist()]
                sizes = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))],
                                                 names=["doc_id", "shingles"])
    return run


def _linked(percent: int):
    """Keeps the pairs whose full sets pass the threshold."""
    def run(batches: Iterator):
        import pyarrow as pa

        def values(column, k):
            return column.values.to_numpy()[column.offsets[k].as_py():column.offsets[k + 1].as_py()]

        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for k in range(batch.num_rows):
                x, y = values(left, k), values(right, k)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    kind = sets.schema["doc_id"].dataType.simpleString()
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_linked(percent), f"a {kind}, b {kind}")


def _possible(nx: Column, ux: Column, ny: Column, uy: Column, percent: int) -> Column:
    """Whether sets of nx and ny elements, of which ux and uy are nobody else's, can pass the threshold."""
    most = F.least(nx - ux, ny - uy)
    return 100 * most >= percent * (nx + ny - most)


def buckets(nodes: DataFrame, side: int) -> DataFrame:
    """(key, doc_id) of the tensored tables, keys that two documents share at least."""
    halves = nodes.select("doc_id", F.posexplode("halves").alias("i", "h"))
    shared = halves.groupBy("i", "h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("i", "h")
    own = halves.join(shared, ["i", "h"]).groupBy("doc_id").agg(F.collect_list(F.struct("i", "h")).alias("s"))  # at most 2 * side
    first, second = F.filter("s", lambda x: x["i"] < side), F.filter("s", lambda x: x["i"] >= side)
    rows = (own.select("doc_id", F.explode(first).alias("x"), second.alias("s")).select("doc_id", "x", F.explode("s").alias("y"))
            .select("doc_id", F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("key")))
    rows = stored(rows, "minhash-keys")
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("key"), "key")


def minhash_links(nodes: DataFrame, texts: DataFrame, size: int, percent: int, side: int) -> DataFrame:
    """(a, b): verified links that connect every component of ``nodes`` (doc_id, n_shingles, halves; one row per text)."""
    table = stored(buckets(nodes, side), "minhash-buckets")
    chosen = table.select("doc_id").distinct().join(nodes.select("doc_id", "n_shingles"), "doc_id")
    sets = stored(texts.join(chosen.select("doc_id"), "doc_id", "left_semi").mapInArrow(
        _sets(size), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, shingles array<bigint>"), "minhash-sets")
    alone = (sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("_c"), F.min("doc_id").alias("doc_id"))
             .where("_c = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("u")))
    facts = stored(chosen.join(alone, "doc_id", "left").select("doc_id", F.col("n_shingles").alias("n"), F.coalesce("u", F.lit(0)).alias("u")), "minhash-facts")
    # A document whose own shingles rule out any partner of at least PERCENT of its size is done.
    smallest = F.ceil(F.col("n") * percent / 100)
    open_facts = facts.where(_possible(F.col("n"), F.col("u"), smallest, F.lit(0), percent))
    rows = stored(table.join(open_facts, "doc_id"), "minhash-open")

    hubs = rows.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("r"), "doc_id", "n", "u")).alias("hub"))
    star = (rows.join(hubs, "key").where(F.col("doc_id") != F.col("hub.doc_id"))
            .where(_possible(F.col("n"), F.col("u"), F.col("hub.n"), F.col("hub.u"), percent))
            .select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct())
    star = stored(star, "minhash-star")
    links = stored(_verified(star, sets, percent), "minhash-links")

    return links.union(stored(_rest(rows, hubs, links, sets, percent), "minhash-links"))


def _rest(rows: DataFrame, hubs: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): verified links between documents that share buckets and are not connected by ``links`` yet.

    Documents that are connected by buckets form a group. In a group of several
    components, every document outside the largest one is compared with all of
    the group. Members are dealt to blocks of bounded size and indexed there by
    shingle, the others are looked up in each block; only links come out.
    """
    touching = rows.join(hubs, "key").select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b")).distinct()
    group = components(touching).select(F.col("node").alias("doc_id"), F.col("component").alias("g"))
    part = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    member = stored(group.join(part, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "minhash-groups")
    parts = member.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed_groups = (parts.groupBy("g").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
                    .select("g", F.col("top.c").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    member = member.join(mixed_groups, "g").join(sets, "doc_id")
    dealt = member.select("g", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("query"), "doc_id", "c", "shingles")
    asked = member.where("c != top").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("query"),
                                            "doc_id", "c", "shingles")
    kind = sets.schema["doc_id"].dataType.simpleString()
    both = dealt.union(asked).repartition(shuffle_partitions(rows.sparkSession), "g", "block").sortWithinPartitions("g", "block", "query")
    return both.mapInArrow(_lookup(percent), f"a {kind}, b {kind}")


def _lookup(percent: int):
    """Reads blocks of members, then the documents to look up in them; writes one link for each component that such a document links to."""
    def run(batches: Iterator):
        import pyarrow as pa

        key, ids, parts, held, index, rows = None, [], [], [], None, []
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("g", "block", "query", "doc_id", "c")]
            lists = batch.column("shingles")
            values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for k, (g, block, query, doc, c) in enumerate(zip(*columns, strict=True)):
                found = values[ends[k]:ends[k + 1]]
                if (g, block) != key:
                    key, ids, parts, held, index = (g, block), [], [], [], None
                if not query:
                    ids.append(doc)
                    parts.append(c)
                    held.append(found.copy())
                    continue
                if not ids:
                    continue
                if index is None:
                    sizes = np.array([len(h) for h in held])
                    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], owner[order], sizes
                flat, owner, sizes = index
                low, high = np.searchsorted(flat, found, "left"), np.searchsorted(flat, found, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(ids))
                linked = {parts[m]: ids[m] for m in np.flatnonzero(100 * common >= percent * (sizes + len(found) - common)) if parts[m] != c}
                rows += [(min(doc, other), max(doc, other)) for other in linked.values()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], kind) for x in (0, 1)], names=["a", "b"])
                rows = []
    return run


def minhash_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, side: int = SIDE, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are ignored whatever their
    names. A document's set has its distinct shingles of ``size`` lower-cased
    words, or all its words as one shingle if there are fewer. Documents are
    linked at 100 * |intersection| >= ``percent`` * |union|; component_id is the
    smallest doc_id reachable, and that document is kept. Null text and text
    without words is linked with nothing. A row with a null id takes part in
    no link and is kept, its component_id null. Repeated rows get the same
    answer each; rows that share an id are one document. An empty table gives
    an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(docs.select("doc_id", "text").mapInArrow(
        _signatures(size, side, width), f"doc_id {kind}, key binary, n_shingles bigint, halves array<bigint>"), "minhash-signatures")
    # Equal word sequences have equal sets: one node stands for all of them.
    classes = (signed.where("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("key")
               .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves")))
    classes = stored(classes, "minhash-classes")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    links = minhash_links(classes.dropDuplicates(["doc_id"]), texts, size, percent, side)
    found = components(links)
    answer = classes.join(found, classes["doc_id"] == found["node"], "left").select("key", F.coalesce("component", "doc_id").alias("component_id"))
    # The answer reaches each run of rows once per class, then the rows of that run: a large class is spread over all runs.
    runs = shuffle_partitions(docs.sparkSession)
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"),
                         F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"))
    per_run = rows.where("key IS NOT NULL").select("run", "key").distinct().join(answer, "key")
    return (rows.join(per_run, ["run", "key"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
