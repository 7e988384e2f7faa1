"""Résumé structuring makes each value once, and its faster patterns find what the plain ones find."""

import random
import time

from pyspark.sql import functions as F

from matchloom.functions import resume as rs
from matchloom.functions import text as tx

PIECES = ["05/2024", "2024/5", "Jan 2020", "january  1999", "Summer 2001", "Present", "to", "-", "–", "/", ",", "Engineer", "Beta", "ab", "1234", "99", "Education",
          "S.k.i.l.l.s", "résumé", "ma", "oct", "\n", "\x85", "\x1c", " ", "ſep 2000", "😀", "ability to", "team lead", "quality control", "multi-task", "resolved the issue"]


def texts(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 50)))) for k in range(800)]
    return spark.createDataFrame(rows, "k long, text string")


def test_values_are_made_once(spark):
    """Before, the header's cleaning stood in the expression once for every use of the title."""
    assert str(rs.experience_blocks(F.col("tagged"))).count("professional experience") == 1
    assert str(rs.skill_list_raw(F.col("a"))).count("regexp_replace") == 1


def test_patterns_find_the_same(spark):
    t = F.col("text")
    labels = F.filter(F.array(*[F.when(F.lower(tx.squash(t)).rlike(rx), F.lit(lb)) for lb, rx in rs.ABILITIES]), lambda x: x.isNotNull())
    found = rs.abilities(F.lit(None).cast("string"), F.array().cast("array<string>"), t)
    plain_title = rs.TITLE_THEN_DATE.replace(r"(?=.{3,100}?\d{4})", "")
    flat = tx.squash(t)
    pairs = {
        "range": (F.regexp_extract_all(t, F.lit(f"({rs.FIND_RANGE})"), F.lit(1)), F.regexp_extract_all(t, F.lit(f"({rs.DATE_RANGE})"), F.lit(1))),
        "space": (F.regexp_replace(t, tx.FIND_WS + "+", "_"), F.regexp_replace(t, tx.WS + "+", "_")),
        "letters": (F.regexp_replace(t, rs.NO_LETTER, ""), F.regexp_replace(t, "[^a-zA-Z ]+", "")),
        "title": (F.regexp_extract_all(flat, F.lit(rs.TITLE_THEN_DATE), F.lit(0)), F.regexp_extract_all(flat, F.lit(plain_title), F.lit(0))),
        "labels": (F.when(F.size(labels) > 0, found), F.when(F.size(labels) > 0, labels)),
    }
    df = texts(spark).select(*[c.alias(f"{n}_{s}") for n, p in pairs.items() for s, c in zip("ab", p)])
    for n in pairs:
        assert df.where(~F.col(f"{n}_a").eqNullSafe(F.col(f"{n}_b"))).count() == 0, n
    assert df.where("size(title_a) > 0 AND size(range_a) > 0 AND size(labels_a) > 0").count() > 50


def test_text_without_years_is_given_up_early(spark):
    """Before, every letter tried eighty lengths of a title."""
    df = spark.range(400).select(F.repeat(F.lit("planned the work of a team, "), 100).alias("t")).repartition(1).cache()
    df.count()

    def spent(pattern):
        at = time.time()
        df.select(F.size(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).alias("n")).agg(F.sum("n")).collect()
        return time.time() - at

    plain = rs.TITLE_THEN_DATE.replace(r"(?=.{3,100}?\d{4})", "")
    spent(rs.TITLE_THEN_DATE)
    assert spent(rs.TITLE_THEN_DATE) < spent(plain) / 2
