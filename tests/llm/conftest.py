import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators use inside: documents may have them too
CLASHES = ["size", "n", "h", "a", "b", "key", "row", "rep", "label", "shard", "words", "component", "position", "kind", "held_out", "score"]


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang, source]) tuples, with clashing columns if asked."""
    def make(rows, clash=False, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        for c in CLASHES if clash else []:
            df = df.selectExpr("*", f"'x' AS `{c}`")
        return df
    return make


@pytest.fixture(scope="session")
def words():
    """A list of n pseudo-random words."""
    def make(n, seed, vocabulary=4000):
        r = random.Random(seed)
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    return make


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))
