"""Category keywords are found in one pass over the text, and counted as if each was looked for by itself."""

import random

from pyspark.sql import functions as F

from matchloom.functions import resume as rs

OTHER = ["engineer", "react native", "sub", "c", "++", ".", "developer", "1", "é", "admins"]


def plain(text):
    scored = F.array(*[F.struct(sum((text.rlike(rx).cast("int") for rx in rs._boundary(ws)), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
                       for i, (c, ws) in enumerate(rs.CATEGORY_WORDS.items())])
    return F.when(F.array_max(scored)["n"] > 0, F.array_max(scored)["c"]).otherwise("SOFTWARE-ENGINEERING")


def test_one_pass_counts_the_same(spark):
    rng = random.Random(4)
    pieces = [w for ws in rs.CATEGORY_WORDS.values() for w in ws] + OTHER * 4
    rows = [(k, "".join(rng.choice(pieces) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randint(0, 9)))) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = rs.impute_category(F.array("t"), F.array().cast("array<string>"))
    assert [r.k for r in df.where(~got.eqNullSafe(plain(F.lower("t")))).collect()] == []
    assert df.select(got.alias("c")).distinct().count() > 8
    assert str(got).lower().count("rlike") == 0  # before: one pattern per keyword over every text
