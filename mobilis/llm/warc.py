"""Web archives: deterministic sharded writing and reading of WARC files.

The records are dealt to shards by ranges of (page_id, digest of the payload)
whose bounds follow from the data alone, so the same pages give the same files
however Spark splits them. A task sorts a shard, writes every record as a gzip
member of its own with new headers and digests, and opens the next file when
the compressed size is reached. A file is written under a temporary name and
renamed when it is complete; the archive exists once the manifest, which lists
files, sizes and digests, has been renamed. A repeated attempt writes the same
bytes, and what an unfinished one leaves is in no manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilis.llm.common import shuffle_partitions, stored

#: Bytes of payload in a shard at least, files' compressed size from which the next one is opened, shards at most.
SHARD_BYTES, ROLL_BYTES, MAX_SHARDS = 16 << 20, 4 << 20, 100_000
#: What a record counts besides its payload when shards are cut.
RECORD_BYTES = 512
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:page")
_MANIFEST = "name string, shard int, number int, records long, bytes long, sha256 string"
_RECORD = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
           "refers_to_url string, file string, offset long")


def _order() -> list[Column]:
    return [F.col("page_id").asc_nulls_first(), F.col("sha").asc()]


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC digests are written."""
    return b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{payload_digest}')}>"


def _lines(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]).encode()


def _uri(url: str | None) -> str | None:
    """The address with blanks and control characters escaped, which a header line cannot hold."""
    return None if url is None else "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)


def _member(kind: str, block: bytes, fields: list[tuple[str, object]]) -> bytes:
    head = _lines("WARC/1.1", [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + digest(block)), ("Content-Length", len(block))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def response_member(page_id: int | None, url: str | None, payload: bytes, date: str = DATE,
                    refers_to: tuple[int, str | None] | None = None) -> bytes:
    """The gzip member of a page: a response, or with ``refers_to`` a revisit without the payload."""
    sha1 = digest(payload)
    http = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    fields = [("WARC-Record-ID", record_id(page_id, sha1)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
              ("WARC-Payload-Digest", "sha1:" + sha1), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id)]
    if refers_to is None:
        return _member("response", http + payload, fields)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], sha1)), ("WARC-Refers-To-Target-URI", _uri(refers_to[1])),
               ("WARC-Refers-To-Date", date), ("WARC-Truncated", "length"), ("X-Refers-To-Page-ID", refers_to[0])]
    return _member("revisit", http, fields)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Files:
    """The files of one shard, one open at a time."""

    def __init__(self, path: str, shard: int, roll_bytes: int, date: str):
        self.fs, self.root = _opened(path)
        self.shard, self.roll_bytes, self.date, self.number, self.out, self.done = shard, roll_bytes, date, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.bytes, self.records, self.sha256 = 0, 0, hashlib.sha256()
            about = f"software: mobilis\r\nformat: WARC File Format 1.1\r\nisPartOf: shard-{self.shard:06d}\r\n".encode()
            self._write(_member("warcinfo", about, [
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, self.name)}>"), ("WARC-Date", self.date),
                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]))
        self._write(member)
        self.records += 1
        if self.bytes >= self.roll_bytes:
            self.close()

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.sha256.update(member)
        self.bytes += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.number, self.records, self.bytes, self.sha256.hexdigest()))
            self.number, self.out = self.number + 1, None


def _batch(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _write_shards(path: str, roll_bytes: int, date: str):
    """Writes sorted rows; a verdict (no payload) stands before the rows of its page and payload."""
    def run(batches: Iterator):
        import pyarrow as pa

        names, kinds = [x.split()[0] for x in _MANIFEST.split(", ")], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        files, verdict, target = None, None, None
        for batch in batches:
            columns = (batch.column(x) for x in ("shard", "page_id", "sha", "url", "payload", "refers_to"))
            for cells in zip(*columns, strict=True):
                shard, page_id, sha, url, payload, refers_to = (x.as_py() for x in cells)
                if payload is None:
                    verdict, target = (page_id, sha), (refers_to, url)
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield _batch(files.done, names, kinds)
                    files = _Files(path, shard, roll_bytes, date)
                files.add(response_member(page_id, url, payload, date, target if verdict == (page_id, sha) else None))
        if files is not None:
            files.close()
            yield _batch(files.done, names, kinds)
    return run


def revisits(records: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha, refers_to, url) of the records that revisit another: of equal payloads all but the largest page_id.

    ``url`` is the address of the record referred to. The answer reaches the
    copies of a payload by (run, payload), so those of a hot one are spread.
    """
    runs = 4 * shuffle_partitions(records.sparkSession)
    rows = (records.where(F.col("n_bytes") >= min_bytes)
            .select("page_id", "sha", "n_bytes", "url", F.pmod(F.xxhash64("page_id"), F.lit(runs)).cast("int").alias("run")))
    best = (rows.groupBy("sha", "n_bytes").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > 1) & F.col("best.page_id").isNotNull()))
    per_run = rows.select("run", "sha", "n_bytes").distinct().join(best, ["sha", "n_bytes"])
    return (rows.drop("url").join(per_run, ["run", "sha", "n_bytes"])
            .where(~F.col("page_id").eqNullSafe(F.col("best.page_id")))
            .select("page_id", "sha", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("url")).distinct())


def shard_bounds(records: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> list[tuple]:
    """Largest (page_id, sha) of each shard, in order: at most ``max_shards`` + 1 of them, whatever the size of the table.

    Sizes are summed up in the order of (page_id, sha), so the bounds depend on
    the data only, not on how Spark splits them.
    """
    weights = records.groupBy("page_id", "sha").agg(F.sum(F.col("n_bytes") + RECORD_BYTES).alias("w"))
    parts = shuffle_partitions(records.sparkSession)
    weights = stored(weights.repartitionByRange(parts, *_order()).withColumn("part", F.spark_partition_id()), "warc-weights")
    sums = weights.groupBy("part").agg(F.sum("w").alias("w"))
    total = sums.agg(F.sum("w")).first()[0] or 0
    size = max(shard_bytes, -(-total // max_shards))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    begins = sums.select("part", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("begin") + F.coalesce(F.sum("w").over(inside), F.lit(0))
    shards = weights.join(begins, "part").select("page_id", "sha", F.floor(start / size).alias("shard"))
    ends = shards.groupBy("shard").agg(F.max(F.struct("page_id", "sha")).alias("last")).orderBy("shard").select("last.*").collect()
    return [_rank(r.page_id, r.sha) for r in ends]


def _rank(page_id: int | None, sha: str) -> tuple:
    return (page_id is not None, page_id or 0, sha)


def _shard(bounds: list[tuple]) -> Column:
    @F.pandas_udf("int")
    def shard(known: pd.Series, page_id: pd.Series, sha: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(bounds, x) for x in zip(known, page_id, sha, strict=True)], dtype="int32")

    return shard(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), F.col("sha"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
               max_shards: int = MAX_SHARDS, date: str = DATE) -> None:
    """Writes one record per row of ``pages`` to gzip-compressed WARC files and a manifest under ``path``.

    ``pages`` needs page_id (an integer), url and html; further columns are
    ignored whatever their names. The payload is the html in UTF-8, null: empty.
    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest page_id is a response and the others are revisits of it;
    records below are all responses. Rows that repeat the largest id are
    responses too; a null id is smaller than any other, and payloads that only
    null ids have are all responses. A null url has no target address; blanks
    and control characters in one are escaped. An empty table gives a manifest
    without files. ``path`` must be reachable by pyarrow from every executor
    (a shared folder, HDFS or an object store) and hold no archive yet.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    records = stored(rows.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("n_bytes")), "warc-records")
    bounds = shard_bounds(records, shard_bytes, max_shards)
    verdicts = revisits(records, min_bytes).withColumn("payload", F.lit(None).cast("binary"))
    both = (rows.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(verdicts).withColumn("shard", _shard(bounds))
            .repartitionById(max(1, len(bounds)), F.col("shard"))  # a shard is a task
            .sortWithinPartitions("shard", *_order(), F.col("payload").isNotNull(), F.col("url").asc_nulls_first()))
    fs, root = _opened(path)
    fs.create_dir(root, recursive=True)
    temporary = f"{path}/.manifest-{uuid.uuid4().hex}.tmp"
    both.mapInArrow(_write_shards(path, roll_bytes, date), _MANIFEST).write.parquet(temporary)
    _rename(spark, temporary, f"{path}/manifest")


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder through Spark's file system; the target must not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(source).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.exists(hadoop.Path(target)) or not store.rename(hadoop.Path(source), hadoop.Path(target)):
        raise OSError(f"cannot commit {target}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a committed archive: name, shard, number, records, bytes, sha256."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def members(stream, size: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a stream, one at a time."""
    offset, data = 0, stream.read(size)
    while data:
        unpacker, content, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not data:
                raise ValueError("the last gzip member is incomplete")
            content.append(unpacker.decompress(data))
            used += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data if unpacker.eof else stream.read(size)
        yield offset, b"".join(content)
        offset += used
        data = data or stream.read(size)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; a wrong length or block digest is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _fields(head)
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + digest(block):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


class _Hashed:
    """A stream that sums up what is read."""

    def __init__(self, stream):
        self.stream, self.sha256 = stream, hashlib.sha256()

    def read(self, size: int) -> bytes:
        data = self.stream.read(size)
        self.sha256.update(data)
        return data


def _read_files(path: str, payloads: bool):
    def run(batches: Iterator):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [x.split() for x in (_RECORD + (", payload binary" if payloads else "")).split(", ")]
        names, types = [x for x, _ in fields], [kinds[k] for _, k in fields]
        fs, root = _opened(path)
        rows, size = [], 0
        for batch in batches:
            for name, sha256 in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    stream = _Hashed(raw)
                    for offset, content in members(stream):
                        head, block = parse(content)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n, sha1 = int(_fields(http)["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and (len(payload) != n or digest(payload) != sha1):
                            raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                        page_id, refers_to = (None if x is None else int(x) for x in (head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")))
                        row = (page_id, head.get("WARC-Target-URI"), head["WARC-Type"], n, sha1, refers_to,
                               head.get("WARC-Refers-To-Target-URI"), name, offset)
                        rows.append((*row, payload if head["WARC-Type"] == "response" else None) if payloads else row)
                        size += len(payload)
                        if size > 4 << 20 or len(rows) >= 5000:
                            yield _batch(rows, names, types)
                            rows, size = [], 0
                    if stream.sha256.hexdigest() != sha256:
                        raise ValueError(f"{name} is not the file of the manifest")
        if rows:
            yield _batch(rows, names, types)
    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive, files in parallel, every digest verified.

    page_id, url, record_type, payload_bytes and payload_digest (of the full
    payload, for revisits too), refers_to, refers_to_url, file and offset (of
    the gzip member), and with ``payloads`` the payload of responses.
    """
    files = manifest(spark, path).select("name", "sha256").repartition(shuffle_partitions(spark), "name")
    return files.mapInArrow(_read_files(path, payloads), _RECORD + (", payload binary" if payloads else ""))
