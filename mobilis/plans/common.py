"""Shared pieces of the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from mobilis.session import scratch_path

# Registered queries round doubles to this many decimals, in Spark and in the
# oracle SQL alike, so sums taken in different orders hash the same. A value
# that is exactly half-way (an average of grid values, say) comes out of two
# summation orders a few ulps either side of the tie; the NUDGE, far below
# the printed precision, puts both on the same side.
DIGITS = 4
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[F.round(F.col(f.name) + F.lit(NUDGE), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def stored(df: DataFrame, name: str = "shared") -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    For tables that several branches of a plan read: each would otherwise
    compute them anew. Cuts the lineage, so a lost executor re-reads files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
