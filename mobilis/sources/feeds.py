"""Feed files (GTFS-style ``.txt`` CSV) in, checked and typed.

Layout: ``{base}/{city}/{table}.txt``, a file or a folder of part files with a
header each, as ``write_feed`` leaves it. File listings come from the
``binaryFile`` source with only ``path`` and ``length`` selected, so file
contents are never read for a listing. Reading a table is one distributed CSV
scan: every byte of it is kept as one character, and the cells are stored as
Parquet. Encoding, row count and types are decided by one aggregate over the
stored cells (a by-name ``try_cast`` to the known schema, as column order may
differ between cities); the file is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilis import constants as K
from mobilis.schemas import FEED_SCHEMAS, NA_TEXTS
from mobilis.session import scratch_path


def feed_inventory(spark: SparkSession, base_dir: str) -> DataFrame:
    """(city, file_name, size_bytes, size_mb) for every ``.txt`` under ``base/{city}/``; the parts of a folder are added up."""
    pattern = f"{base_dir.rstrip('/')}/*/*.txt"
    if not exists(spark, pattern):
        return spark.createDataFrame([], "city string, file_name string, size_bytes bigint, size_mb double")
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    # A scan leaves out files without a byte; the listing behind it has them.
    listed = spark.createDataFrame([(unquote(f), 0) for f in files.inputFiles()], "path string, length bigint")
    place = r"/([^/]+)/([^/]+\.txt)(?:/[^/]+)?$"
    sizes = (files.unionByName(listed).groupBy(F.regexp_extract("path", place, 1).alias("city"), F.regexp_extract("path", place, 2).alias("file_name"))
             .agg(F.sum("length").alias("size_bytes")))
    return sizes.withColumn("size_mb", F.round(F.col("size_bytes") / F.lit(1048576.0), 2))


def write_feed(df: DataFrame, path: str, encoding: str = "UTF-8", header: bool = True) -> None:
    """``df`` as feed text: a folder of comma-separated parts with a header each; quotes are doubled, null is empty, blanks stay."""
    (df.write.mode("overwrite").option("header", header).option("encoding", encoding).option("escape", '"').option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def feed_completeness(spark: SparkSession, base_dir: str, cities: list[str],
                      required: list[str] | None = None) -> DataFrame:
    """Per (city, required file): status 'missing', 'empty' or 'present' with its size.

    A city passes only if no required file is missing or empty
    (``feed_gate`` gives one row per city).
    """
    req = spark.createDataFrame([(c, f) for c in cities for f in (required or K.REQUIRED_FEED_FILES)],
                                "city string, file_name string")
    inv = feed_inventory(spark, base_dir)
    j = req.join(inv, ["city", "file_name"], "left")
    status = (F.when(F.col("size_bytes").isNull(), "missing").when(F.col("size_bytes") == 0, "empty")
               .otherwise("present"))
    return j.select("city", "file_name", status.alias("status"), "size_bytes")


def feed_gate(completeness: DataFrame) -> DataFrame:
    return completeness.groupBy("city").agg(F.bool_and(F.col("status") == "present").alias("passed"))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """'UTF-8' if every line is valid UTF-8, else 'ISO-8859-1' (which cannot fail).

    A distributed scan of the whole file: raw line bytes are tested, nothing
    is decoded on the driver.
    """
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8(F.col("value"))).limit(1).count()
    return "UTF-8" if bad == 0 else "ISO-8859-1"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names; spaces and hyphens become underscores."""
    return df.toDF(*[c.replace(" ", "_").replace("-", "_").lower() for c in df.columns])


def _present(c: str) -> Column:
    """A cell, null if its text is one that a CSV reader conventionally treats as missing."""
    return F.when(F.col(c).isin(*NA_TEXTS), F.lit(None)).otherwise(F.col(c))


def _na_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[_present(c).alias(c) for c in df.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path or path pattern, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


@dataclass(frozen=True)
class StoredFeed:
    """A feed table after its one read: what was decided, and its rows."""

    df: DataFrame
    encoding: str
    rows: int
    rejects: dict[str, int]


def _bytes(c: str) -> Column:
    """The bytes of a cell that was read with one character a byte."""
    return F.encode(F.col(c), "ISO-8859-1")


def _utf8(text: str) -> str:
    """A name read with one character a byte, as UTF-8 if it is that, without a byte-order mark."""
    try:
        return text.encode("iso-8859-1").decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError:
        return text


def store_feed(spark: SparkSession, path: str, table: str | None = None, encoding: str = "auto", typed: bool = True,
               multi_line: bool = False) -> StoredFeed:
    """Reads a feed file once and stores its cells; see ``read_feed`` for the rules.

    In every encoding at hand commas, quotes and line ends are single bytes
    below 128, so rows and cells can be cut before the encoding is known. It
    is UTF-8 if every cell and column name is valid UTF-8, else ISO-8859-1
    (which cannot fail).
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("encoding", "ISO-8859-1")
           .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    names = raw.columns
    cells = raw.toDF(*[f"c{i}" for i in range(len(names))])
    at = scratch_path(spark, "feed")
    cells.write.parquet(at)
    cells = spark.read.schema(cells.schema).parquet(at)
    plain = normalize_columns(cells.toDF(*[_utf8(n) for n in names]))
    types = {f.name: f.dataType for f in FEED_SCHEMAS[table].fields} if typed and table in FEED_SCHEMAS else {}
    known = [c for c in plain.columns if c in types and not isinstance(types[c], T.StringType)]
    flags = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(plain.columns):
        flags.append(F.count_if(~F.is_valid_utf8(_bytes(f"c{i}").cast("string"))).alias(f"_bad{i}"))
        if c in known:  # numbers are ASCII, in whatever encoding
            text = _present(f"c{i}")
            flags.append(F.count_if(text.isNotNull() & cast_text(text, types[c]).isNull()).alias(f"_rejects{i}"))
    facts = cells.agg(*flags).first()
    if encoding == "auto":
        valid = all(facts[f"_bad{i}"] == 0 for i in range(len(names))) and all(_is_utf8(n) for n in names)
        encoding = "UTF-8" if valid else "ISO-8859-1"
    if encoding.upper() not in ("UTF-8", "ISO-8859-1"):
        raise ValueError("encoding must be auto, UTF-8 or ISO-8859-1")
    decode = encoding.upper() == "UTF-8"
    out = cells.select(*[(F.make_valid_utf8(_bytes(f"c{i}").cast("string")) if decode else F.col(f"c{i}")).alias(_utf8(n) if decode else n)
                         for i, n in enumerate(names)])
    out = _na_to_null(normalize_columns(out))
    rejects = {c: facts[f"_rejects{i}"] for i, c in enumerate(plain.columns) if c in known}
    out = out.select(*[cast_text(F.col(c), types[c]).alias(c) if rejects.get(c) == 0 else F.col(c) for c in out.columns])
    return StoredFeed(out, encoding, facts["_rows"], rejects)


def _is_utf8(name: str) -> bool:
    try:
        name.encode("iso-8859-1").decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def read_feed(spark: SparkSession, path: str, table: str | None = None, encoding: str = "auto",
              typed: bool = True, multi_line: bool = False) -> DataFrame:
    """Read one feed table with a header row; a missing file gives an empty table.

    A quote inside a quoted field is doubled, as in GTFS. Fields with line ends
    inside quotes need ``multi_line``; a file is then read by one task, so it
    is off unless asked for. Columns are normalised; with ``typed`` and a known
    table they are cast by name to the table's schema, but for columns with a
    value that does not cast (unknown extra columns stay text, too). The file
    is read once, see ``store_feed``.
    """
    if not exists(spark, path):
        schema = FEED_SCHEMAS.get(table)
        return spark.createDataFrame([], schema) if schema is not None else spark.createDataFrame([], "x string")
    return store_feed(spark, path, table, encoding, typed, multi_line).df


def read_feed_large(spark: SparkSession, path: str, table: str | None = None,
                    threshold: int = K.LARGE_TABLE_ROWS) -> tuple[DataFrame, bool]:
    """The same read plus a flag telling whether the table has more than ``threshold`` rows.

    Splitting into chunks is the scan's own job (file splits), so there is no
    chunk size; the rows were counted when the types were decided.
    """
    if not exists(spark, path):
        return read_feed(spark, path, table), False
    feed = store_feed(spark, path, table)
    return feed.df, feed.rows > threshold


def cast_text(text: Column, kind: T.DataType) -> Column:
    """A text column cast to ``kind``; null where it does not cast. Whole numbers may be written as 1.0."""
    plain = text.try_cast(kind)
    if not isinstance(kind, T.IntegralType):
        return plain
    number = text.try_cast("double")
    return F.coalesce(plain, F.when(number == F.floor(number), number.try_cast(kind)))


def typed_or_string(df: DataFrame, schema) -> DataFrame:
    """Cast known columns by name; a column with a value that does not cast stays text, as do unknown ones.

    One aggregate over the text decides for all columns.
    """
    types = {f.name: f.dataType for f in schema.fields if f.name in df.columns and f.dataType != T.StringType()}
    rejected = {r.column_name for r in cast_rejects(df, schema).where("rejects > 0").collect()} if types else set()
    return df.select(*[cast_text(F.col(c), types[c]).alias(c) if c in types and c not in rejected else F.col(c) for c in df.columns])


def cast_rejects(raw: DataFrame, schema) -> DataFrame:
    """Per known column: values present as text that did not cast (one pass)."""
    types = {f.name: f.dataType for f in schema.fields}
    cols = [c for c in raw.columns if c in types]
    if not cols:
        return raw.sparkSession.createDataFrame([], "column_name string, rejects bigint")
    counts = raw.agg(*[F.count_if(F.col(c).isNotNull() & cast_text(F.col(c), types[c]).isNull()).alias(c)
                       for c in cols])
    return counts.unpivot([], cols, "column_name", "rejects")


def has_required(df: DataFrame, table: str) -> bool:
    """Whether a table has the columns that a feed needs of it; unknown tables need none."""
    return all(c in df.columns for c in K.REQUIRED_COLUMNS.get(table, []))


def check_structure(df: DataFrame, table: str) -> bool:
    """False for an empty table or one missing a required column; unknown tables pass."""
    return not df.isEmpty() and has_required(df, table)


def city_files(spark: SparkSession, base_dir: str, city: str) -> list[str]:
    """Table names of the city's ``.txt`` files (a listing; no file content)."""
    inv = feed_inventory(spark, base_dir).where(F.col("city") == city)
    return sorted(r.file_name[:-4] for r in inv.select("file_name").collect())
