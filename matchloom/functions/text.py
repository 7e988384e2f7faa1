"""Text cleaning expressions (Column -> Column, no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------
# Characters that count as white space (ASCII controls, NEL, NBSP, Unicode Z*).
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PRINTABLE = "".join(rf"\x{k:02x}" for k in range(0x21, 0x7F))
FIND_WS = rf"[[^{_PRINTABLE}]&&{WS}]"  # the same; the first part turns printable ASCII away at once (a list is looked up faster than ranges)
WIDE_WS = rf"{FIND_WS}(?:{FIND_WS}+|(?<! ))"  # a run that is not one plain space
NULL_WORDS = ["nan", "none", "null", "na", "n/a"]
EDGE_CHARS = " ,;:/|"
LEXICAL_FIXES = {"mongo db": "mongodb", "mongo db-3.2": "mongodb", "ms office": "microsoft office"}
SKILL_ALLOWED = [
    "project management", "people management", "time management", "stakeholder management",
    "quality assurance", "machine learning", "data analysis", "cloud architecture",
    "distributed systems", "technical leadership",
]
SKILL_NOISE = (
    r"\b(\d{1,2}/\d{2,4}|19\d{2}|20\d{2})\b|\bcompany name\b|\bcity\b|\bstate\b|\bsummary\b"
    r"|\bexperience\b|\beducation\b|\bresponsible for\b|\bprofessional experience\b"
)
SKILL_DUTY = r"managed|managing|responsible|worked with"
YEARS_PATTERNS = [
    r"(over|more than|around|about|approximately)\s*(\d{1,2}(\.\d+)?)\s*\+?\s*(years|yrs)",
    r"()(\d{1,2}(\.\d+)?)\s*\+\s*(years|yrs)",
    r"()(\d{1,2}(\.\d+)?)\s*(years|yrs)",
]
REGION_ALIASES = [  # applied longest alias first
    ("united states of america", "united states"), ("great britain", "united kingdom"),
    ("england", "united kingdom"), ("remote", "remote"), ("india", "india"),
    ("u.s.", "united states"), ("u.k.", "united kingdom"),
    ("usa", "united states"), ("uae", "united arab emirates"), ("wfh", "remote"),
    ("us", "united states"), ("uk", "united kingdom"),
]
INJECTION = (
    r"(?i)\bignore\s+previous\s+instructions\b|\bdisregard\s+(all\s+)?(previous\s+)?instructions\b"
    r"|\bsystem\s+prompt\b|\byou\s+are\s+(now\s+)?an?\s+(ai|assistant)\b"
    r"|\bforget\s+(all\s+)?(previous\s+)?instructions\b|\bbypass\s+(all\s+)?filters\b"
)
SENSITIVE = [
    "young", "old", "male", "female", "man", "woman", "boy", "girl", "pregnant", "maternity",
    "married", "single", "christian", "muslim", "hindu", "buddhist", "jewish", "white", "black",
    "asian", "latino", "native", "disability", "disabled",
]
# ------------------------------------------------------------------------


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squash(c: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.trim(single_spaced(c))


def single_spaced(c: Column) -> Column:
    """White-space runs become one space; plain single spaces, most of them, stay untouched."""
    return F.regexp_replace(c, WIDE_WS, " ")


def clean_text(c: Column) -> Column:
    return _unless_null_word(squash(c))


def clean_item(c: Column) -> Column:
    """clean_text inside a lambda, where the squashed value is made once."""
    return let(squash(c), _unless_null_word)


def _unless_null_word(t: Column) -> Column:
    return F.when((t != "") & ~F.lower(t).isin(NULL_WORDS), t)


def normalize_identifier(c: Column, prefix: str, floating: bool = False) -> Column:
    raw = c.cast("string")
    if floating:
        raw = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(raw)
        raw = F.when(~F.isnan(c), raw)
    return F.concat(F.lit(prefix + "-"), F.coalesce(blank_to_null(squash(raw)), F.lit("unknown")))


def dedupe(a: Column) -> Column:
    """Distinct, first occurrence wins, empties dropped."""
    return F.filter(F.array_distinct(a), lambda x: x != "")


def dedupe_keep_empty(a: Column) -> Column:
    return F.array_distinct(a)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once, for bodies that use it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_by_key(keyed: Column) -> Column:
    """Values of an array<struct<k,i,v>>, the first position per key, in position order."""
    def firsts(s):
        return F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"]))

    kept = let(F.array_sort(keyed), firsts)  # equal keys become neighbours, earliest first
    by_pos = F.array_sort(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
    return F.transform(by_pos, lambda e: e["v"])


def dedupe_ignore_case(a: Column) -> Column:
    """Distinct by lower case, first spelling wins; items are squashed first."""
    items = F.filter(F.transform(a, squash), lambda x: x != "")
    return first_by_key(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v"))))


def sorted_unique(a: Column) -> Column:
    return F.array_sort(dedupe(a))


def normalize_skill(c: Column) -> Column:
    t = F.regexp_replace(squash(F.lower(c)), "&", " and ")
    return F.btrim(single_spaced(t), F.lit(EDGE_CHARS))


def clean_token(c: Column) -> Column:
    def fixed(t):
        out = F.when(t != "", t)
        for old, new in LEXICAL_FIXES.items():
            out = F.when(t == old, F.lit(new)).otherwise(out)
        return out

    return let(normalize_skill(c), fixed)


def skill_list_raw(a: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(a, clean_item), lambda x: x.isNotNull()))


def skill_list_normalized(a: Column) -> Column:
    return dedupe(F.transform(skill_list_raw(a), normalize_skill))


def sanitize_skills(a: Column, max_words: int = 6, max_chars: int = 48) -> Column:
    def keep(t: Column) -> Column:
        words = F.size(F.split(t, " "))
        return (t != "") & (
            t.isin(SKILL_ALLOWED)
            | (
                (F.length(t) <= max_chars)
                & (words <= max_words)
                & ~t.rlike(SKILL_NOISE)
                & ~((words >= 4) & t.rlike(SKILL_DUTY))
            )
        )

    return F.array_distinct(F.filter(F.transform(skill_list_raw(a), normalize_skill), keep))


def years_from_text(c: Column) -> Column:
    """First plausible 'N years' figure; the three wordings are tried in order."""
    t = single_spaced(F.lower(c))

    def first(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), lambda s: s.cast("double"))
        return F.get(F.filter(found, lambda y: (y > 0) & (y <= 60)), F.lit(0))

    return F.round(F.coalesce(*[first(p) for p in YEARS_PATTERNS]), 1)


def seniority_bucket(y: Column) -> Column:
    return (
        F.when(y.isNull(), F.lit(None).cast("string"))
        .when(y < 2, "junior").when(y < 5, "mid").when(y < 8, "senior").otherwise("lead")
    )


def first_chars(c: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all of them."""
    return c if n is None else F.substring(c, 1, n)


def first_items(a: Column, n: int | None) -> Column:
    """The first ``n`` elements, or all of them."""
    return a if n is None else F.slice(a, 1, n)


def embedding_text(c: Column, limit: int = 4000) -> Column:
    return F.substring(F.coalesce(blank_to_null(squash(c)), F.lit("empty resume")), 1, limit)


def normalize_token(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.regexp_replace(c, f"^{FIND_WS}+|{FIND_WS}+$", "")), "[-_]+", " ")
    return F.coalesce(single_spaced(t), F.lit(""))


def normalize_region(c: Column) -> Column:
    """Alias look-up, else every contained alias is replaced, longest first.

    'us' inside a longer word is replaced too; callers rely on that.
    """
    t = normalize_token(c)
    exact = F.lit(None).cast("string")
    chain = t
    for alias, canonical in REGION_ALIASES:
        exact = F.when(t == alias, F.lit(canonical)).otherwise(exact)
        chain = F.replace(chain, F.lit(alias), F.lit(canonical))
    return F.coalesce(exact, chain)


def display_label(c: Column) -> Column:
    t = normalize_token(c)
    return F.when(t == "e commerce", "E-commerce").otherwise(F.initcap(t))


def trim_description(c: Column, max_chars: int = 8000) -> Column:
    return F.coalesce(F.substring(squash(c), 1, max_chars), F.lit(""))


def estimate_tokens(c: Column) -> Column:
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
    ).cast("long")


def seniority_group(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return (
        F.when(t.isNull() | (t == ""), "unknown")
        .when(t.contains("principal") | t.contains("staff"), "principal")
        .when(t.contains("lead"), "lead")
        .when(t.contains("senior"), "senior")
        .when(t.contains("junior") | t.contains("entry") | t.contains("intern"), "junior")
        .when(t.contains("mid"), "mid")
        .otherwise(t)
    )


def request_key(**parts: Column) -> Column:
    """16 hex digits over the sorted ``name=value`` pairs."""
    pairs = [F.concat(F.lit(k + "="), F.coalesce(parts[k].cast("string"), F.lit("None"))) for k in sorted(parts)]
    return F.substring(F.sha2(F.concat_ws("|", *pairs), 256), 1, 16)


def has_injection(c: Column) -> Column:
    return F.coalesce(c.rlike(INJECTION), F.lit(False))


SENSITIVE_RE = r"\b(" + "|".join(SENSITIVE) + r")\b"


def sensitive_terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(SENSITIVE_RE), F.lit(1)))
