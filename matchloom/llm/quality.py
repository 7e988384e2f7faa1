"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest is grown on statistics of the labelled texts; every path from a root to a node is a rule, a conjunction
of comparisons. A logistic regression with an L1 penalty over the rules keeps few of them with a weight each. What is
left is compiled into one Column, so scoring is a projection without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import WORD, held_out, text_of
from matchloom.session import materialize

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which hold

# regular expressions whose matches are counted; per word or per letter below
PATTERNS = {
    "letters": r"\p{L}+", "capitals": r"\p{Lu}", "numbers": r"[0-9]+", "marks": r"[^\p{L}\p{N}\s.,;:'\"-]",
    "mark_runs": r"[^\p{L}\p{N}\s]{2,}", "ends": r"[.!?](?=\s|$)", "short": r"(?<!\S)\S{1,3}(?!\S)",
}


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns ``more``, and the statistics of each whole text; null counts as empty and every ratio of nothing is 0."""
    text = text_of()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    first = docs.select(
        "doc_id", *more, F.length(text).alias("chars"), words.alias("words"), F.split(text, "\n").alias("lines"),
        *[F.regexp_count(text, F.lit(p)).alias(k) for k, p in PATTERNS.items()])
    n = F.size("words")
    again = F.size(F.filter(F.zip_with("words", F.slice("words", 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda same: same))
    counted = first.select(
        "doc_id", *more, "chars", *PATTERNS, n.alias("n"), F.size(F.array_distinct("words")).alias("kinds"), again.alias("again"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("line_kinds"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counted.select(
        "doc_id", *more, F.log1p("chars").alias("log_chars"), F.log1p("n").alias("log_words"), ratio("chars", "n").alias("word_length"),
        ratio("kinds", "n").alias("distinct_words"), ratio("again", "n").alias("repeated_words"), ratio("line_kinds", "n_lines").alias("distinct_lines"),
        ratio("n", "n_lines").alias("line_words"), ratio("capitals", "chars").alias("capital_share"),
        *[ratio(k, "n").alias(f"{k}_per_word") for k in PATTERNS])


def _paths(node, names: list[str], so_far: Rule, out: set[Rule]) -> None:
    if so_far:
        out.add(tuple(sorted(so_far)))
    if node.subtreeDepth() == 0:
        return
    name, threshold = names[node.split().featureIndex()], float(node.split().threshold())
    _paths(node.leftChild(), names, (*so_far, (name, "<=", threshold)), out)
    _paths(node.rightChild(), names, (*so_far, (name, ">", threshold)), out)


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, threshold in rule:
        out = out & (F.col(name) <= threshold if op == "<=" else F.col(name) > threshold)
    return out


@dataclass
class RuleEnsemble:
    intercept: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        """Probability of quality 1 over the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(_holds(rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(stats: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """Fit to all rows of ``stats`` (the statistics and ``label`` 0 or 1). Forest and regression run as Spark jobs on whole data.

    Without rows of both labels there is nothing to tell apart: the score is the (smoothed) share of label 1 everywhere."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    names = [c for c in stats.columns if c not in ("doc_id", "label")]
    n, ones = stats.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(stats)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.5, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    found: set[Rule] = set()
    for tree in forest.trees:
        _paths(tree._java_obj.rootNode(), names, (), found)
    rules = sorted(found)
    if not rules:
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
    fired = stats.select("label", array_to_vector(F.array(*[F.when(_holds(r), 1.0).otherwise(0.0) for r in rules])).alias("features"))
    fit = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=50, tol=1e-5).fit(materialize(fired, "quality-rules"))
    kept = [(r, round(w, 6)) for r, w in zip(rules, fit.coefficients.toArray().tolist()) if abs(w) >= 1e-4]
    return RuleEnsemble(round(fit.intercept, 6), kept)


def labelled(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics of the documents that may be learned from, with their label.

    Rows of ``labels`` without id or label are ignored; several for one id vote, a tie counts as 1."""
    vote = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    return stats.where(~held_out()).join(vote, "doc_id")


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    * Null and empty texts have all statistics 0 and get the score of that.
    * Repeated rows are each scored (and each learned from); a null doc_id is not held out and has no label.
    * Empty tables: no documents give no rows; without labels of both kinds every score is the share of label 1, smoothed.
    * Other columns are ignored whatever their names.
    """
    stats = materialize(statistics(docs), "quality-statistics")
    model = train(materialize(labelled(stats, labels), "quality-labelled"), **options)
    return stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents scored 0.5 or more, with exactly their own columns; texts are read again rather than shuffled."""
    stats = materialize(statistics(docs), "quality-statistics")
    model = train(materialize(labelled(stats, labels), "quality-labelled"), **options)
    scored = statistics(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), "row")
    return scored.where(model.score() >= 0.5).select(*[F.col("row")[c].alias(c) for c in docs.columns])
