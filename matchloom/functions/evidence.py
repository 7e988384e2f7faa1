"""Evidence lines for a query inside one candidate's parsed record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import first_items, let


def _sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?\n])\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def search_within(query: Column, phrases: Column, summary: Column, items: Column, shown: tuple[int | None, int | None, int | None] = (None, None, None)) -> Column:
    """Matching phrases, summary sentences and, per job held, sentences as one text; ``shown`` limits each list (None: all)."""
    terms = F.filter(F.transform(F.regexp_extract_all(query, F.lit(r"\w+"), F.lit(0)), lambda t: F.lower(t)), lambda t: F.length(t) > 2)

    def build(ts):
        def hit(s):
            return F.exists(ts, lambda t: F.lower(s).contains(t))

        def bullets(a, n):
            return F.transform(first_items(a, n), lambda s: F.concat(F.lit("- "), s))

        def block(title, a, n, force=F.lit(False)):
            return let(a, lambda v: F.when(force | (F.size(v) > 0), F.concat(F.array(title), bullets(v, n))).otherwise(F.array().cast("array<string>")))

        def held(e):
            title, company = F.coalesce(e["title"], F.lit("Unknown Role")), F.coalesce(e["company"], F.lit("Unknown Company"))
            return block(F.concat(F.lit("\n[Experience] "), title, F.lit(" at "), company), F.filter(_sentences(e["description"]), hit), shown[2], hit(title) | hit(company))

        lines = F.concat(
            block(F.lit("[Capabilities] Related capabilities / skills"), F.filter(phrases, hit), shown[0]),
            block(F.lit("\n[Summary]"), F.filter(_sentences(summary), hit), shown[1]), F.flatten(F.transform(items, held)))
        none = F.concat(F.lit("No evidence found in candidate's resume for query: '"), query, F.lit("'."))
        return F.when(F.size(ts) == 0, "Query is empty or contains only short stop words.").otherwise(
            let(lines, lambda v: F.when(F.size(v) > 0, F.array_join(v, "\n")).otherwise(none)))

    return let(terms, build)
