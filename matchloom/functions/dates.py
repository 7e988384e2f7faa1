"""Month tokens ('03/1999', 'summer 1999', 'present') as YYYY-MM text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import clean_text, let

# Fixed values -----------------------------------------------------------
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9,
    "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
SEASONS = {"spring": 3, "summer": 6, "fall": 9, "autumn": 9, "winter": 12}
PRESENT = ["present", "current", "now"]
NO_DATE = ["00/00", "00/0000", "00/yy", "yy", "unknown", "n/a", "na"]
LEAD_WORDS = r"^(from|since|starting|started|start|beginning|began|as of|effective)\s+"
# ------------------------------------------------------------------------
WORD_MONTH = r"^(" + "|".join([*MONTHS, *SEASONS]) + r")\s+(\d{4})$"


def strip_lead(c: Column) -> Column:
    t = F.btrim(F.lower(clean_text(c)), F.lit(" ,.;:()[]{}"))
    return F.trim(F.regexp_replace(t, LEAD_WORDS, ""))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _year_month(year: Column, month: Column, bounded: bool = True) -> Column:
    ok = (month >= 1) & (month <= 12)
    if bounded:
        ok = ok & (year >= 1900) & (year <= 2100)
    return F.when(ok, F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def month_of_token(t: Column) -> Column:
    """YYYY-MM of an already stripped lower-case token; unknown shapes use any year inside."""
    def num(pattern: str, group: int) -> Column:
        return _part(t, pattern, group).cast("int")

    my, ym, iso = r"^(\d{1,2})/(\d{4})$", r"^(\d{4})/(\d{1,2})$", r"^(\d{4})-(\d{1,2})$"
    names = F.create_map(*[F.lit(x) for kv in {**MONTHS, **SEASONS}.items() for x in kv])
    any_year = r"\b(19\d{2}|20\d{2}|21\d{2})\b"
    dated = F.coalesce(
        _year_month(num(my, 2), F.greatest(num(my, 1), F.lit(1))),
        _year_month(num(ym, 1), F.greatest(num(ym, 2), F.lit(1))),
        _year_month(num(WORD_MONTH, 2), F.element_at(names, _part(t, WORD_MONTH, 1))),
        _year_month(num(iso, 1), num(iso, 2), bounded=False),
        _year_month(num(r"^(\d{4})$", 1), F.lit(1)),
        F.when(~t.rlike(r"^\d{1,2}/yy$"), _year_month(num(any_year, 1), F.lit(1))),
    )
    return F.when(t.isin(PRESENT), "present").when(~t.isin(NO_DATE), dated)


def normalize_month(c: Column) -> Column:
    return let(strip_lead(c), month_of_token)


def month_to_date(c: Column, as_of: Column | None = None) -> Column:
    """First day of the month; 'present' becomes ``as_of`` when given (never the clock)."""
    dated = F.coalesce(
        F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{1,2}$"), F.concat(c, F.lit("-1"))), "yyyy-M-d"),
        F.try_to_date(F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))), "yyyy-MM-dd"),
    )
    return F.when(c == "present", as_of).otherwise(dated) if as_of is not None else dated


def month_index(d: Column) -> Column:
    return (F.year(d) * 12 + F.month(d) - 1).cast("long")
