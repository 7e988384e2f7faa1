"""Stored candidate documents: keys, hashes and versions as columns, nested parts as VARIANT.

Parts such as the raw upload and what was parsed from it change their shape over the years. As VARIANT each document
keeps its own shape, files of all times are read together, and a query names the paths it wants; where the scan takes
them, the rest of a part is not decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType


def pack(rows: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """The columns named in ``parts`` ({part: columns}) go into one VARIANT column per part; the others stay."""
    packed = {c for columns in parts.values() for c in columns}
    return rows.select(*[c for c in rows.columns if c not in packed], *[
        F.to_variant_object(F.struct(*columns)).alias(part) for part, columns in parts.items()])


def write_documents(rows: DataFrame, path: str, parts: dict[str, list[str]], by: str | None = None, mode: str = "append") -> None:
    """Writes documents as Parquet, in a folder per value of ``by``; repeated calls add to them, whatever shape their parts have."""
    writer = pack(rows, parts).write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def field(part: str, path: str, kind: str) -> Column:
    """A value inside a part, null where a document doesn't have it or has another kind of value there."""
    return F.try_variant_get(F.col(part), f"$.{path}", kind)


def read_documents(spark: SparkSession, path: str, plain: list[tuple[str, str]], fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Plain columns [(name, type)] and ``fields`` {name: (part, path, type)} of stored documents.

    The schema is given, so no file is opened to find it, and parts that no field names are not read at all.
    """
    schema = StructType()
    for name, kind in plain:
        schema = schema.add(name, kind)
    for part in dict.fromkeys(p for p, _, _ in fields.values()):
        schema = schema.add(part, VariantType())
    return spark.read.schema(schema).parquet(path).select(*[n for n, _ in plain], *[field(*f).alias(n) for n, f in fields.items()])
