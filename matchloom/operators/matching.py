"""Pair-grain matching: records, evaluation scope, rerank gate, final order."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from matchloom.functions import scoring as sc
from matchloom.operators.ranking import places, top_k


def prepared_candidates(docs: DataFrame) -> DataFrame:
    """Candidate documents with ``candidate_terms``, which match_scores takes instead of making them for every pair."""
    return docs.withColumn("candidate_terms", sc.candidate_terms(F.col("core_skills"), F.col("expanded_skills"), F.col("skills")))


def prepared_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with ``job_terms``, likewise."""
    return jobs.withColumn("job_terms", sc.job_terms(F.col("required_skills"), F.col("related_skills")))


def overlap(pairs: DataFrame) -> Column:
    """The skill overlap of each pair, from prepared terms where both sides have them."""
    c = F.col
    if {"candidate_terms", "job_terms"} <= set(pairs.columns):
        return sc.prepared_overlap(c("candidate_terms"), c("job_terms"))
    return sc.skill_overlap(c("core_skills"), c("expanded_skills"), c("skills"), c("required_skills"), c("related_skills"))


OVERLAPS = ["skill_overlap", "core_overlap", "expanded_overlap", "normalized_overlap"]
_WORDS = re.compile(r"[a-z0-9+.#-]+")
_CELLS = 1 << 22  # largest table of term matches that a task holds


@functools.lru_cache(1 << 16)
def _words(term: str) -> frozenset[str]:
    return frozenset(_WORDS.findall(term.lower())) - frozenset(sc.TERM_STOPWORDS)


def _match_table(targets: list[str], members: list[str]) -> np.ndarray:
    """``scoring.term_match`` of each target and single member; only those that share a word are compared."""
    having: dict[str, list[int]] = {}
    for j, m in enumerate(members):
        for w in _words(m):
            having.setdefault(w, []).append(j)
    place, table = {m: j for j, m in enumerate(members)}, np.zeros((len(targets), len(members)))
    for row, t in zip(table, targets):
        words, shared = _words(t), {}
        for w in words:
            for j in having.get(w, ()):
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            row[j] = min(1.0, n / len(words) + 0.2) if t in members[j] or members[j] in t else n / len(words)
        if t in place:
            row[place[t]] = 1.0
    return table


def _soft(table: np.ndarray, targets: tuple[np.ndarray, np.ndarray], pools: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """scoring.soft_overlap of each row's targets and pool, given as places in the table and as sizes per row."""
    (asked, n_asked), (held, n_held) = targets, pools
    out, met = np.zeros(len(n_asked)), np.cumsum(n_asked * n_held)
    begin_asked, begin_held = np.cumsum(n_asked) - n_asked, np.cumsum(n_held) - n_held
    lo = 0
    while lo < len(out):  # rows whose targets and pools meet in no more than _CELLS places, or one row
        hi = max(lo + 1, int(np.searchsorted(met, (met[lo - 1] if lo else 0) + _CELLS, "right")))
        rows = np.flatnonzero((n_asked[lo:hi] > 0) & (n_held[lo:hi] > 0)) + lo
        if len(rows):
            of = np.repeat(rows, n_asked[rows])  # a target's row
            mine = np.arange(len(of)) - np.repeat(np.cumsum(n_asked[rows]) - n_asked[rows], n_asked[rows]) + begin_asked[of]
            first = np.cumsum(n_held[of]) - n_held[of]
            at = np.arange(int(n_held[of].sum())) - np.repeat(first - begin_held[of], n_held[of])
            best = np.maximum.reduceat(table[np.repeat(asked[mine], n_held[of]), held[at]], first)
            out[lo:hi] = np.bincount(of - lo, best, hi - lo)  # adds in the order of the targets
        lo = hi
    return out / np.maximum(n_asked, 1)


def _coded(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different terms, each entry's place among them, and the sizes per row."""
    flat = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), sizes.astype(np.int64)


def _overlaps(batch: pa.RecordBatch, kept: tuple[str, ...] = ("job_id", "candidate_id")) -> Iterator[pa.RecordBatch]:
    job, own = batch.column("job_skills"), batch.column("candidate_skills")
    sides = {n: _coded(own.field(n)) for n in "cen"}
    asked, codes, sizes = _coded(job.field("x"))
    if batch.num_rows > 1 and len(asked) * max(len(t) for t, *_ in sides.values()) > _CELLS:
        half = batch.num_rows // 2
        yield from _overlaps(batch.slice(0, half), kept)
        yield from _overlaps(batch.slice(half), kept)
        return
    leading = np.minimum(job.field("n").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(leading, sizes)
    required = codes[inside], leading
    c, e, n = (_soft(_match_table(asked, sides[s][0]), (codes, sizes) if s == "e" else required, sides[s][1:]) for s in "cen")
    some = sides["c"][2] > 0
    scores = np.where(some, 0.45 * c + 0.35 * e + 0.2 * n, 0.5 * n + 0.5 * e)
    yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, (scores, c, e, n))], [*kept, *OVERLAPS])


def overlaps(pairs: DataFrame, kept: tuple[str, ...] = ("job_id", "candidate_id")) -> DataFrame:
    """The columns ``kept`` and the skill overlaps of each pair, from ``scoring.job_skills`` and ``scoring.candidate_skills``.

    A batch's different terms are compared once, and its pairs look their matches up; words are made from terms in the
    task, so pairs travel with plain skills. A batch of very many terms is halved until its table is small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _overlaps(batch, kept)

    schema = StructType([pairs.schema[n] for n in kept] + [StructField(n, DoubleType()) for n in OVERLAPS])
    return pairs.select(*kept, "job_skills", "candidate_skills").mapInArrow(run, schema)


def match_scores(pairs: DataFrame) -> DataFrame:
    """Deterministic scores of (job, candidate) rows.

    Needs: raw_score, the candidate's skills / core_skills / expanded_skills /
    experience_years / seniority_level / category and the job's required_skills,
    related_skills, min_years, preferred_seniority, job_category, adjacent_score.
    Rows with ``job_skills`` and ``candidate_skills`` have their overlaps found by the batch.
    """
    c = F.col
    kept = tuple(n for n in pairs.columns if n not in ("candidate_terms", "job_terms", "candidate_skills", "job_skills"))
    pool = sc.lower_set(c("skills"), c("core_skills"), c("expanded_skills"))
    if {"candidate_skills", "job_skills"} <= set(pairs.columns):
        staged = overlaps(pairs, kept).withColumn("_o", F.struct(c("skill_overlap").alias("score"), *OVERLAPS[1:])).drop(*OVERLAPS)
    else:
        staged = pairs.withColumn("_o", overlap(pairs))
    staged = staged.withColumn("_d", sc.deterministic_score(
        c("raw_score"), c("_o.score"), c("experience_years"), c("min_years"), c("seniority_level"), c("preferred_seniority"), c("job_category") == c("category")))
    return staged.withColumn("_m", sc.must_have(c("required_skills"), pool, c("adjacent_score"))).select(
        *kept, c("_o.score").alias("skill_overlap"), c("_o.core_overlap").alias("core_overlap"), c("_o.expanded_overlap").alias("expanded_overlap"),
        c("_o.normalized_overlap").alias("normalized_overlap"), c("_d.score").alias("deterministic_score"), c("_d.semantic_similarity").alias("semantic_similarity"),
        c("_d.experience_fit").alias("experience_fit"), c("_d.seniority_fit").alias("seniority_fit"), c("_d.category_fit").alias("category_fit"),
        c("_m.rate").alias("must_have_rate"), c("_m.penalty").alias("must_have_penalty"))


def penalised(rank_score: Column, penalty: Column) -> Column:
    return sc.clip01(rank_score * (1.0 - penalty))


def agent_scores(pairs: DataFrame) -> DataFrame:
    """Heuristic dimension scores, negotiated weights and the weighted score."""
    c = F.col
    s = sc.heuristic_scores(
        c("required_skills"), c("skills"), c("required_skills"), c("skills"), c("experience_years"), c("min_years"),
        c("seniority_level"), c("preferred_seniority"), c("raw_score"), c("job_category") == c("category"))
    w = sc.negotiate_weights(c("min_years"), F.size("required_skills"))["final"]
    out = pairs.select("*", *[s[k].alias(f"agent_{k}") for k in sc.DIMENSIONS], *[w[k].alias(f"weight_{k}") for k in sc.DIMENSIONS])
    return out.withColumn("agent_weighted", sc.weighted_score({k: c(f"agent_{k}") for k in sc.DIMENSIONS}, {k: c(f"weight_{k}") for k in sc.DIMENSIONS}))


def select_for_evaluation(scored: DataFrame, n: int, score: str = "score") -> DataFrame:
    return top_k(scored, ["job_id"], [F.desc(score), F.asc("candidate_id")], n, "eval_rank")


def scoped_evaluation(scored: DataFrame, evaluated: DataFrame, n: int, score: str = "score") -> DataFrame:
    """In scope and evaluated: the evaluated score; failed or out of scope: the deterministic one plus a reason.

    ``evaluated``: job_id, candidate_id, agent_score (null when it failed), error.
    """
    scope = select_for_evaluation(scored, n, score).select("job_id", "candidate_id", F.lit(True).alias("_in"))
    j = scored.join(scope, ["job_id", "candidate_id"], "left").join(evaluated, ["job_id", "candidate_id"], "left")
    use = F.col("_in").isNotNull() & F.col("agent_score").isNotNull()
    return j.select(
        "job_id", "candidate_id", F.when(use, F.col("agent_score")).otherwise(F.col(score)).alias("score"), use.alias("evaluated"),
        F.when(F.col("_in").isNull(), "outside_agent_eval_scope").when(~use, F.concat(F.lit("agent_evaluation_failed("), F.coalesce("error", F.lit("Missing")), F.lit(")")))
        .alias("reason"))


def final_order(results: DataFrame, k: int | None = None) -> DataFrame:
    """Every row with its place: evaluated rows first, then score, then id. ``k``: a report's own length, if it has one."""
    order = [F.desc("evaluated"), F.desc("score"), F.asc("candidate_id")]
    if k is not None:
        return top_k(results, ["job_id"], order, k, "position")
    return places(results, "job_id", order)


def shortlist(hits: DataFrame, gate: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Each job's ``k`` hits to be scored: re-ranked where the gate says so, else in their own order.

    hits: job_id, candidate_id, rank, fusion_score; gate: job_id, apply_rerank; relevance: job_id, candidate_id, relevance.
    """
    j = hits.join(gate.select("job_id", "apply_rerank"), "job_id", "left").join(relevance, ["job_id", "candidate_id"], "left")
    blended = sc.rnd(0.75 * F.coalesce("relevance", "fusion_score") + 0.25 * F.col("fusion_score"), 6)
    order = F.when(F.coalesce("apply_rerank", F.lit(False)), blended).otherwise(-F.col("rank").cast("double"))
    return top_k(j.withColumn("_order", order), ["job_id"], [F.desc("_order"), F.asc("rank")], k, "new_rank").drop("_order")


def judged(scored: DataFrame, n: int) -> DataFrame:
    """Adds score and evaluated: of a job's shortlist the best ``n`` by rank_score take their agent-blended score.

    scored: job_id, candidate_id, rank_score, blend_score; one shortlist is a few rows, so its window is too."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("rank_score"), "candidate_id"))
    use = (F.col("_place") <= n) & F.col("blend_score").isNotNull()
    return scored.withColumn("_place", place).withColumn("evaluated", use).withColumn(
        "score", F.when(use, F.col("blend_score")).otherwise(F.col("rank_score"))).drop("_place")


def rerank_gate(hits: DataFrame, queries: DataFrame, coverage: DataFrame) -> DataFrame:
    """Whether each job's shortlist should be re-ranked, and the first reason that decides.

    hits: job_id, candidate_id, rank, fusion_score; queries: job_id,
    confidence, unknown_ratio; coverage: job_id, candidate_id, coverage.
    """
    g = sc.RERANK_GATE
    pool = hits.where(F.col("rank") <= g["pool"])
    per = pool.groupBy("job_id").agg(
        F.count("*").alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list("fusion_score"))), 1, 2).alias("best"),  # at most 8 scores
        F.max(F.when(F.col("rank") == 1, F.struct("candidate_id", "fusion_score"))).alias("top"))
    j = per.select("*", F.col("top.candidate_id").alias("candidate_id")).join(queries, "job_id").join(coverage, ["job_id", "candidate_id"], "left")
    tie = (F.get("best", F.lit(0)) - F.get("best", F.lit(1))) <= g["gap"]
    ambiguous = (F.col("confidence") < g["confidence"]) | (F.col("unknown_ratio") > g["unknown"])
    strong = (F.coalesce("coverage", F.lit(0.0)) >= g["coverage"]) & (F.col("top.fusion_score") >= g["fusion"])
    reason = (
        F.when(F.col("n") < 2, "insufficient_candidates").when(strong & ~ambiguous, "strong_top_hit_without_query_ambiguity")
        .when(~tie, "top_gap_too_wide_for_safe_rerank").when(~ambiguous, "tight_top_scores_but_query_is_confident")
        .when(strong, "ambiguous_query_but_top_hit_skill_overlap_is_strong").otherwise("tight_top_scores_and_ambiguous_query"))
    return j.select("job_id", reason.alias("reason")).withColumn("apply_rerank", F.col("reason") == "tight_top_scores_and_ambiguous_query")


def rerank_blend(hits: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """.75 re-rank + .25 fusion, missing re-rank score falls back to fusion; top-k per job.

    A job with no re-rank score at all keeps its order.
    """
    j = hits.join(relevance, ["job_id", "candidate_id"], "left")
    any_score = relevance.select("job_id").distinct().withColumn("_any", F.lit(True))
    s = F.coalesce("relevance", "fusion_score")
    blended = F.when(F.col("_any"), 0.75 * s + 0.25 * F.col("fusion_score")).otherwise(-F.col("rank").cast("double"))
    r = j.join(any_score, "job_id", "left").select("job_id", "candidate_id", "rank", sc.r4(s).alias("rerank_score"), sc.rnd(blended, 6).alias("blended"))
    return top_k(r, ["job_id"], [F.desc("blended"), F.asc("rank")], k, "new_rank")
