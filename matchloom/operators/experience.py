"""Employment history: interval union, trajectory, dedupe, whole-résumé parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import resume as rs
from matchloom.functions.text import blank_to_null, first_chars, squash


def experience_years(items: DataFrame, as_of_idx: int, key: str = "candidate_id") -> DataFrame:
    """Months covered by the union of a candidate's month intervals (ends inclusive).

    Only the farthest end per start month can matter, so a map-side combined
    max leaves at most one row per candidate and start month (2,400 in two
    centuries). A candidate with a third of all rows costs no more than that.
    """
    spans = items.select(key, "start_idx", F.coalesce("end_idx", F.lit(as_of_idx)).alias("end_idx"))
    best = spans.where("start_idx is not null and end_idx >= start_idx").groupBy(key, "start_idx").agg(F.max("end_idx").alias("end_idx"))
    w = Window.partitionBy(key).orderBy("start_idx")
    before = F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # months this interval adds beyond everything that started earlier
    fresh = F.greatest(F.col("end_idx") - F.greatest(F.col("start_idx") - 1, F.coalesce(before, F.col("start_idx") - 1)), F.lit(0))
    return best.withColumn("_m", fresh).groupBy(key).agg(F.sum("_m").cast("long").alias("months")).select(
        key, "months", F.round(F.col("months") / 12, 1).alias("years"))


def dedupe_items(items: DataFrame, fields: list[str], seq: str, key: str = "candidate_id") -> DataFrame:
    """First record per lower-cased fields, as a combinable min (no window)."""
    return items.groupBy(key, *[F.lower(squash(F.col(f))).alias(f) for f in fields]).agg(F.min(seq).alias(seq))


def career_trajectory(items: DataFrame, key: str = "candidate_id", shown: int = 6) -> DataFrame:
    """Progression, first and latest role and the first ``shown`` moves per candidate; all moves are counted.

    A move is a change of title or company between neighbours in start order.
    Neighbours are found inside (candidate, start month) slices and the
    slice edges are then joined up, so a candidate with very many items is spread
    over many tasks instead of sorted in one.
    """
    role = F.struct("start_idx", "seq", "title", "company")
    # items without a start come first, by seq: their slices are ranges of it
    sliced = items.withColumn("_b", F.coalesce(F.col("start_idx").cast("long"), F.floor(F.col("seq") / 1024) - F.lit(1 << 40)))
    w = Window.partitionBy(key, "_b").orderBy(F.asc_nulls_first("start_idx"), "seq")
    inner = sliced.select(key, "_b", role.alias("cur"), F.lag(role).over(w).alias("prev"))
    edges = sliced.groupBy(key, "_b").agg(F.min(role).alias("head"), F.max(role).alias("tail"))
    we = Window.partitionBy(key).orderBy("_b")  # one row per month of the career
    seams = edges.select(key, F.col("head").alias("cur"), F.lag("tail").over(we).alias("prev"))
    steps = inner.where("prev is not null").select(key, "cur", "prev").unionByName(seams.where("prev is not null"))
    changed_company = ~F.col("cur.company").eqNullSafe(F.col("prev.company"))
    moves = steps.where(changed_company | ~F.col("cur.title").eqNullSafe(F.col("prev.title")))
    from matchloom.operators.ranking import top_k

    def label(c):
        return F.concat(F.col(f"{c}.title"), F.lit(" at "), F.col(f"{c}.company"))

    totals = moves.groupBy(key).agg(F.count("*").alias("n_moves"), F.max(changed_company).alias("changed"))
    first6 = top_k(moves.select(key, "cur", F.concat(label("prev"), F.lit(" > "), label("cur")).alias("m"),
                                F.col("cur.start_idx").alias("_s"), F.col("cur.seq").alias("_q")), [key],
                   [F.asc_nulls_first("_s"), F.asc("_q")], shown)
    lists = first6.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "m"))), lambda e: e["m"]), "|").alias("moves"))
    ends = edges.groupBy(key).agg(F.min("head").alias("a"), F.max("tail").alias("z"))
    return ends.join(totals, key, "left").join(lists, key, "left").select(
        key,
        F.when(F.col("changed"), "transition").when(F.col("n_moves") >= 2, "growth").otherwise("stable").alias("progression"),
        F.coalesce("n_moves", F.lit(0)).cast("long").alias("n_moves"), label("a").alias("first_role"), label("z").alias("latest_role"),
        F.coalesce("moves", F.lit("")).alias("moves"))


def parse_resumes(resumes: DataFrame, summary_chars: int | None = None, name_lines: int | None = None) -> DataFrame:
    """Everything a résumé text yields, in one projection over the text column.

    Whole-text scans run only where the section scans found nothing. Without a summary section the text stands in for it:
    all of it, or its first ``summary_chars`` characters. ``name_lines``: how many lines may hold the name (None: all).
    """
    x, t = F.col("text"), F.col("tagged")
    staged = resumes.withColumn("tagged", rs.tagged_lines(x)).select(
        "*", rs.skills(t, x).alias("skills"), rs.education_lines(t).alias("edu"), rs.experience_blocks(t).alias("exp"),
        rs.person_name(rs.section_lines(t, "root"), name_lines).alias("name"), rs.email(x).alias("email"), rs.phone(x).alias("phone"),
        F.coalesce(rs.section_text(t, "summary"), blank_to_null(squash(first_chars(x, summary_chars)))).alias("summary"))
    full = staged.select(
        "*", F.when(F.size("edu") > 0, F.col("edu")).otherwise(rs.education_scan(x)).alias("education"),
        F.when(F.size("exp") > 0, F.col("exp")).otherwise(rs.experience_scan(x)).alias("experience")).drop("edu", "exp", "tagged")
    return full.withColumn("weak", rs.is_weak(F.col("skills"), F.col("experience"), F.col("education"), F.col("name"), F.col("email"), F.col("phone")))
