"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words are runs of anything but space and the five ASCII controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def before(totals: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Sum of ``value`` over the rows in front of each row; meant for small tables of block totals."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


SENT_ROWS = 1 << 19  # narrow rows that may be sent to every executor


def sent_if_small(table: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A written table of a few numbers per row, marked for broadcast if it has at most ``rows`` rows; else left to Spark."""
    return F.broadcast(table) if table.count() <= rows else table
