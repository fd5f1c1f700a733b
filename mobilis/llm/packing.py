"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces of documents are range-sorted by length, so that each has a rank among
the pieces of its length; gaps (free room of open sequences) are kept sorted by
size. A round is one successor sweep: from the largest size down, pieces take
the smallest gap that holds them, each gap at most one piece; where more pieces
than gaps meet, lower ranks win and the rest waits. Then gaps are updated and
the next sweep follows. When nothing fits any more, new sequences are opened
for the largest pieces left: a share (one of ``OPEN_SHARES``) of those that the tokens
left need at least, so that never more are open than a packing needs.

Pieces of one length differ only by rank and gaps of one size only by number, so
a sweep needs runs (size, first, count): at most ``capacity`` sizes on each
side, whatever the size of the corpus. What a round decides is a list of runs,
too. Rows are ranked before and matched to those runs after the rounds, in
parallel.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilis.llm.common import shuffle_partitions, stored, text_batches
from mobilis.llm.token_cache import LOWER_CASE, encoder

CAPACITY = 2048
END_ID = 0
#: Rounds are cheap, so they are run with each of these shares, and the packing with the fewest sequences is taken.
OPEN_SHARES = (0.4, 0.25, 0.1, 0.04)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and its end id, cut at ``capacity``.

    ``docs`` needs doc_id and text; other columns are ignored whatever their
    names. Null text counts as empty: the end id alone. Repeated rows are
    separate documents with the same id. An empty table gives no pieces.
    """
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        enc, end, width = encoder(tokenizer, LOWER_CASE), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounded output, however long the texts
                part = batch.slice(k, 256)
                rows, cut = [], []
                for row, blob in enumerate(enc.encode(part.column("_t").to_pylist())):
                    blob += end
                    rows += [(row, n, at // 4) for n, at in enumerate(range(0, len(blob), width))]
                    cut += [blob[at:at + width] for at in range(0, len(blob), width)]
                row, piece, start = np.array(rows, np.int64).reshape(-1, 3).T
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                if with_ids:
                    sizes = np.cumsum([0, *(len(x) // 4 for x in cut)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(cut), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).mapInArrow(run, T.StructType(fields))


def best_fit_rounds(sizes: dict[int, int], capacity: int, shares: tuple[float, ...] = OPEN_SHARES) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece.

    ``sizes`` has the number of pieces of each length, 1 to ``capacity``.
    """
    return min((_rounds(sizes, capacity, share) for share in shares), key=lambda runs: max((r[3] + r[2] for r in runs), default=0))


def _rounds(sizes: dict[int, int], capacity: int, share: float) -> list[tuple[int, int, int, int, int]]:
    left = dict(sizes)
    taken: dict[int, int] = defaultdict(int)  # lower ranks are placed first
    gaps: dict[int, deque] = defaultdict(deque)  # free room: runs (first sequence, count)
    placed, opened = [], 0

    def place(length: int, count: int, first: int, room: int) -> None:
        placed.append((length, taken[length], count, first, capacity - room))
        taken[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    while left:
        matched, stack = [], []
        for size in sorted(left.keys() | {g for g, runs in gaps.items() if runs}, reverse=True):
            if gaps.get(size):
                stack.append(size)
            # The top of the stack is the successor: the smallest gap that still holds this size.
            while size in left and stack:
                first, count = gaps[stack[-1]].popleft()
                n = min(count, left[size])
                if n < count:
                    gaps[stack[-1]].appendleft((first + n, count - n))
                matched.append((stack[-1] - size, first, n))
                place(size, n, first, stack[-1])
                if not gaps[stack[-1]]:
                    stack.pop()
        if not matched:
            need = math.ceil(share * sum(k * n for k, n in left.items()) / capacity)
            for size in sorted(left, reverse=True):
                n = min(need, left[size])
                matched.append((capacity - size, opened, n))
                place(size, n, opened, capacity)
                opened, need = opened + n, need - n
                if not need:
                    break
        for room, first, n in matched:  # gaps change only between sweeps
            if room:
                gaps[room].append((first, n))
    return placed


def ranked(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Adds ``rank``, from 0, among the rows of equal length.

    Rows are range-sorted by length and ``order``, so a frequent length spans
    many partitions; ranks are counted inside a partition and continued from
    the totals of the partitions before it.
    """
    keys = [F.col("length").desc(), *(F.col(c).asc_nulls_first() for c in order)]
    with text_batches(rows.sparkSession):  # rows come from texts, usually
        rows = stored(rows, "packing-rows")
    dealt = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()),
                   "packing-ranks")
    inside = Window.partitionBy("_part", "length").orderBy(*keys[1:])
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (dealt.withColumn("_in", F.row_number().over(inside) - 1).join(starts, ["_part", "length"])
            .withColumn("rank", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start"))


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``rows`` (with a length from 1 to ``capacity``) plus sequence_id and offset.

    Every row gets a place in one sequence of at most ``capacity`` tokens; the
    places of a sequence have no gaps between them. Ties are broken by
    ``order``, nulls first. An empty table gives an empty result.
    """
    with_rank = stored(ranked(rows, list(order), shuffle_partitions(rows.sparkSession)), "packing-pieces")
    sizes = {r["length"]: r["n"] for r in with_rank.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(best_fit_rounds(sizes, capacity))
    schema = T.StructType([*with_rank.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def find(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        length, first, _, sequence, offset = np.array(runs, np.int64).reshape(-1, 5).T
        # A run is found by its length and last first-rank that is not above the row's.
        span = np.int64(1) << 44
        keys = length * span + first
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                                             names=schema.names)

    return with_rank.mapInArrow(find, schema).drop("rank")
