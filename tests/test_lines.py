"""Lines of a text, and ability labels, are found with less work and as before."""

import random

from pyspark.sql import functions as F

from matchloom.functions import resume as rs
from matchloom.functions import text as tx

PIECES = ["a", "B c", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\f", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "é", "x-y", "\x00"]
WORDS = [w for stems in rs.ABILITY_STEMS.values() for w in stems] + [
    "team", "with", "report", "issue", "client", "process", "workflow", "the", "analyst", "presents", "supervised", "recruiter", "building relationships", "\n", "ed", "ion", "control"]


def test_lines_are_the_same(spark):
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))) for k in range(4000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    each = F.filter(F.transform(F.split("t", r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"), tx.squash), lambda s: s != "")
    assert df.where(~rs.lines(F.col("t")).eqNullSafe(each)).count() == 0
    assert str(rs.lines(F.col("t"))).count("regexp_replace") == 2 and "regexp_replace(namedlambda" not in str(rs.lines(F.col("t"))).lower()  # before: once per line


def test_labels_are_the_same(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice(WORDS) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 7)))) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, t string")
    c = F.lower(tx.squash(F.col("t")))
    labels = F.filter(F.array(*[F.when(c.rlike(rx), F.lit(lb)) for lb, rx in rs.ABILITIES]), lambda x: x.isNotNull())
    found = rs.abilities(F.lit(None).cast("string"), F.array().cast("array<string>"), F.col("t"))
    assert df.where((F.size(labels) > 0) & ~found.eqNullSafe(labels)).count() == 0
    assert df.where(F.size(labels) > 1).count() > 300
