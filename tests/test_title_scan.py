"""Titles with a single date: read by dates and the gaps before them, the same as the plain pattern finds place by place."""

import random
import time

from pyspark.sql import functions as F

from matchloom.functions import resume as rs
from matchloom.functions import text as tx

PIECES = ["05/2024", "2024/5", "Jan 2020", "january  1999", "May 2020/5", "Present", "to", "-", "–", "/", ",", "Engineer", "Beta", "ab", "1234", "99", "Education", "\n", "\x85",
          " ", "a", "(", "12345", "4/2/2000", "May", "M", ";", "." * 90, "x" * 100, "12 " * 40, "Skills", "City", "2000", "&", "\x01"]


def plain(flat):
    found = F.zip_with(*[F.regexp_extract_all(flat, F.lit(rs.TITLE_THEN_DATE), F.lit(g)) for g in (1, 2)], lambda t, d: F.struct(F.trim(t).alias("t"), d.alias("d")))
    return F.array_distinct(F.filter(found, lambda e: (e["t"] != "") & ~F.lower(e["t"]).rlike("(education|skills|summary|highlights)$")))


def test_same_titles(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40)))) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, t string").where(~tx.squash(F.col("t")).rlike(rs.DATE_RANGE))
    scan = F.transform(rs.experience_scan(F.col("t")), lambda e: F.struct(e["title"].alias("t"), e["start_date"].alias("d")))
    lost = df.select("t", scan.alias("a"), plain(tx.squash(F.col("t"))).alias("b"))
    # the scan keeps the first of titles that differ by case, and has titles after a date too
    key = lambda a: F.transform(a, lambda e: F.lower(F.concat_ws("|", e["t"], e["d"])))
    assert lost.where(F.size(F.array_except(key("b"), key("a"))) > 0).count() == 0
    assert lost.where(F.size("b") > 1).count() > 1000


def test_far_dates_cost_little(spark):
    """Before, every letter tried eighty lengths of a title."""
    df = spark.range(300).select(F.repeat(F.lit("planned the work of a team and of its many partners, in a plant that is far from here, over 8 weeks. 1999; "), 30).alias("t")).repartition(1).cache()
    df.count()

    def spent(c):
        at = time.time()
        df.select(F.size(c).alias("n")).agg(F.sum("n")).collect()
        return time.time() - at

    t = F.col("t")
    spent(rs.experience_scan(t))
    assert spent(rs.experience_scan(t)) < spent(F.regexp_extract_all(t, F.lit(rs.TITLE_THEN_DATE), F.lit(0)))
