"""Tokens are cleaned once, and the ontology reads an entity's canonical names from files."""

from pyspark.sql import functions as F

from matchloom.operators import ontology as on


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, [" MS  Office", "ms office", "a&b", ";", None, "SQL"]), (2, []), (3, None), (4, ["Mongo DB"])], "id int, s array<string>")
    rows = on.explode_tokens(df, "id", F.col("s"))
    assert sorted(map(tuple, rows.collect())) == [(1, "a and b", 2), (1, "microsoft office", 0), (1, "sql", 5), (4, "mongodb", 0)]
    assert plan(rows).lower().count("lower(") == 1


def test_canonical_names_are_read_from_files(spark):
    def table(cols, *rows):
        return spark.createDataFrame(rows, cols)

    ont = on.Ontology(table("alias string, canonical string", ("js", "javascript")),
                      table("skill string, ord int, domain string, family string, parents array<string>", ("javascript", 1, "web", "code", ["coding"])),
                      table("token string"), table("token string"), table("token string"), table("token string, canonical string, version string"))
    n = on.normalize(table("id int, s array<string>", (1, ["JS", "x"]), (2, [])), "id", F.col("s"), ont, "ord")
    assert {r.id: (r.canonical_skills, r.core_skills, r.expanded_skills) for r in n.collect()} == {
        1: (["javascript", "x"], ["javascript"], ["javascript", "coding"]), 2: ([], [], [])}
    assert "posexplode" not in plan(n).lower()
