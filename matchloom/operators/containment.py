"""Which patterns of a dictionary table stand anywhere in which texts.

Every pattern is met at one of its character grams, the one that the fewest texts have, so a common gram is never the
meeting point of a pattern that also has a rare one. What meets is then compared as a whole. Patterns may be of any
length and any number; the plan does not grow with them, and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialize

GRAM = 5  # characters of a gram; shorter patterns are their own gram


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, key: str, text: Column, patterns: DataFrame, pattern: str, longest: int = GRAM) -> DataFrame:
    """(key, pattern): every distinct pattern that is a part of the key's text, as it stands (lower both for any case).

    Null texts and empty or null patterns give nothing. ``key`` must be unique in ``texts``."""
    words = materialize(patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct(), "containment-patterns")
    body = texts.select(key, text.alias("_text")).where("_text IS NOT NULL")
    lengths = [r["n"] for r in words.select(F.least(F.length("pattern"), F.lit(longest)).alias("n")).distinct().collect()]  # 1 to ``longest``
    if not lengths:
        return body.select(key, F.lit(None).cast("string").alias(pattern)).limit(0)
    own = words.select("pattern", F.explode(F.when(F.length("pattern") < longest, F.array("pattern")).otherwise(_grams(F.col("pattern"), longest))).alias("gram"))
    seen = body.select(key, F.explode(F.array_distinct(F.concat(*[_grams(F.col("_text"), n) for n in sorted(lengths)]))).alias("gram"))
    seen = materialize(seen.join(own.select("gram").distinct(), "gram", "left_semi"), "containment-grams")  # only grams of the dictionary
    often = seen.groupBy("gram").agg(F.count("*").alias("texts"))
    # a pattern with a gram that no text has is in no text
    met = own.join(often, "gram", "left").groupBy("pattern").agg(
        F.min(F.coalesce("texts", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "gram")).alias("best"))
    anchors = met.where("least > 0").select("pattern", F.col("best.gram").alias("gram"))
    pairs = anchors.join(seen, "gram").select(key, "pattern")
    return pairs.join(body, key).where(F.col("_text").contains(F.col("pattern"))).select(key, F.col("pattern").alias(pattern))


def listed(hits: DataFrame, texts: DataFrame, key: str, pattern: str, name: str) -> DataFrame:
    """The rows of ``texts`` with their hits as the array ``name``, longest pattern first, equal ones by name."""
    per = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length(pattern)).alias("l"), F.col(pattern).alias("p")))), lambda e: e["p"]).alias(name))
    return texts.join(per, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
