"""Résumé structuring inside one row: every step is a Column over the text.

A résumé is one cell, so lines and sections are arrays of that row; nothing
is shuffled and a document's cost stays with its own task.
"""

from __future__ import annotations

import functools
import operator
import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.dates import normalize_month
from matchloom.functions.text import blank_to_null, clean_item, dedupe, dedupe_ignore_case, embedding_text, first_by_key, first_chars, first_items, let, single_spaced, skill_list_normalized, skill_list_raw, squash, FIND_WS

# Fixed values -----------------------------------------------------------
SECTIONS = {  # first match wins: 'qualifications' belongs to skills
    "summary": ["summary", "professional summary", "profile", "objective"],
    "skills": ["skills", "technical skills", "core skills", "expertise", "core qualifications", "qualifications"],
    "education": ["education", "academic background", "qualifications", "education and training", "academic credentials"],
    "experience": ["experience", "work experience", "employment history", "professional experience"],
}
HEADER_MAX = 45
NO_LETTER = r"[\x00-\x1f!-@\[-`{-\x{10ffff}]+"  # neither a-z, A-Z nor a space; much faster than the negated class
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
PHONE = r"(\+?\d[\d\-\s()]{7,}\d)"
MONTH_WORD = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    r"|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
DATE = rf"(?:\d{{1,2}}/\d{{4}}|\d{{4}}/\d{{1,2}}|{MONTH_WORD}\s+\d{{4}}|(?:Spring|Summer|Fall|Autumn|Winter)\s+\d{{4}}|\d{{4}})"
DATE_WORD = rf"(?i)\b({DATE})\b"
# turns most places away where no date begins; listed characters are looked up faster than ranges
DATE_AT = r"(?=[0123456789JFMASONDWjfmasondw](?:(?<=\d)|[AEPUOICaepuoic][NBRYLGPTVCMnbrylgptvcm]))"
DATE_RANGE = rf"(?i)({DATE})\s*(?:to|-|–|—|－)\s*(Present|Current|Now|{DATE})"
FIND_RANGE = DATE_AT + DATE_RANGE  # finds the same as DATE_RANGE
MAYBE_RANGE = r"\d{4}(?:/\d{1,2})?\s*(?:[tT][oO]|[-–—－])"  # a text without it has no range
DEGREE_WORDS = r"bachelor|master|phd|doctor|mba|b\.sc|bsc|m\.sc|msc|diploma|degree"
DEGREE_CHUNK = r"(?i)((?:Bachelor|Master|PhD|Doctor|MBA|B\.Sc|M\.Sc|Diploma|Degree)[^.;]{0,180})"
SCHOOL_CHUNK = r"((?:[A-Z][A-Za-z&.\-'\s]{1,50}\s)?(?:University|College|Institute|School|Academy)[^.;]{0,140})"
NOT_A_NAME_WORDS = [
    "resume", "curriculum", "profile", "@", "training", "summary", "objective", "skills", "experience", "education", "professional", "career",
    "highlights", "overview", "served", "developed", "managed", "focused", "driven", "dedicated", "specialist", "manager", "director", "coordinator",
]
NAME_SYMBOLS = r"[\d@:()/\\<>|]"
SKILL_SPLIT = r"[,;\n|•·]+"
SKILL_HEADING = r"(?is)\b(?:skills?|technical skills?|core qualifications?|qualifications?|highlights?)\b[:\s\-]*(.*)"
SKILL_PREFIX_NOISE = r"^(and|or|with|the|a|an|to|in|of|for|type|provide) "
SKILL_NOISE_PHRASES = [
    "bilingual", "languages:", "language:", "proficient in", "including", "such as", "etc.", "experience in", "knowledge of", " and ", " or ",
    "background in", "10-key", "wpm", "consisting of", "evolved", ".com", "as well as", "understanding of", "ability to", "familiarity with",
]
_LETTER = string.ascii_letters
_IN_TITLE = rf"[{_LETTER}0123456789/&().,'\- ]"
_LETTER = string.ascii_letters
_IN_TITLE = rf"[{_LETTER}0123456789/&().,'\- ]"
# in single-spaced text
DATE_THEN_TITLE = rf"{DATE_AT}((?i:{DATE})) ([{_LETTER}]{_IN_TITLE}{{2,80}}?)(?= (?i:Company Name|City|State|Education|Skills|Highlights|$))"
MAYBE_DATE_THEN_TITLE = r"\d " + DATE_THEN_TITLE[len(rf"{DATE_AT}((?i:{DATE})) "):]  # a text without it has none
# a place with no year within the longest title and date is given up before a title is tried
TITLE_THEN_DATE = rf"(?i)(?=.{{3,100}}?\d{{4}})([A-Za-z][A-Za-z0-9/&().,'\- ]{{2,80}}?)\s*,?\s*({DATE})(?!\s*(?:to|-|–|—|－))"
# A match in single-spaced text is part of a run of characters that a title may have, and its date is one that this finds.
TITLE_RUN = rf"{_IN_TITLE}++[–—－]?"
TITLE_MOST = 81
ALONE_DATE = rf"{DATE_AT}((?i:{DATE}))(?!\s*(?:(?i:to)|-|–|—|－))"
TITLE_PREFIX = r"(?i)^(experience|employment|work experience|professional experience|work history)\s*"
MARK = "\x01"  # split() makes a longer pattern anew for every text
RECORDS = "array<struct<title:string,company:string,start_date:string,end_date:string,location:string,description:string>>"
ABILITIES = [
    ("team leadership", r"\b(team lead|led (?:a |the )?team|managed (?:a |the )?team|supervis(?:e|ed|ion)|people management)\b"),
    ("stakeholder communication", r"\bstakeholder\b|\b(client|customer|executive)\b.*\bcommunication\b|\bpresent(?:ation|ed)\b"),
    ("cross-functional collaboration", r"\bcross[- ]functional\b|\bcollaborat(?:e|ed|ion)\b|\bworked with\b.*\bteam\b"),
    ("project coordination", r"\bproject (?:coordination|management|planning|execution)\b|\bcoordinat(?:e|ed|ion)\b.*\b(project|schedule|workflow)\b"),
    ("process improvement", r"\bprocess (?:improvement|optimization|redesign)\b|\bimprov(?:e|ed|ement)\b.*\b(process|workflow|efficiency)\b|\bstreamlin(?:e|ed)\b"),
    ("training and mentoring", r"\btrain(?:ed|ing)\b|\bmentor(?:ed|ing)\b|\bonboard(?:ed|ing)\b"),
    ("recruitment", r"\brecruit(?:er|ing|ment|ed)\b|\bhiring\b|\binterview(?:ed|ing)?\b"),
    ("customer service", r"\bcustomer service\b|\bclient service\b|\bcandidate experience\b"),
    ("problem solving", r"\bproblem[- ]solv(?:e|ing)\b|\bresolved?\b.*\b(issue|problem|incident)\b"),
    ("time management", r"\btime management\b|\bprioriti[sz](?:e|ed|ation)\b|\bmulti[- ]task(?:ing)?\b"),
    ("quality assurance", r"\bquality (?:assurance|control|improvement)\b|\btesting\b|\bquality gates?\b"),
    ("documentation", r"\bdocument(?:ation|ed)\b|\bprepared?\b.*\b(report|records?)\b|\breporting\b"),
    ("analytical thinking", r"\banaly[sz](?:e|ed|ing|is)\b|\bdata[- ]driven\b|\broot cause\b"),
    ("relationship management", r"\brelationship management\b|\bbuild(?:ing)? relationships?\b|\bpartner(?:ing)? with\b"),
    ("strategic planning", r"\bstrategic planning\b|\broadmap\b|\bplanning and organizing\b"),
]
ABILITY_STEMS = {  # a text without any of a label's stems cannot match its pattern
    "team leadership": ["team lead", "led team", "led a team", "led the team", "managed team", "managed a team", "managed the team", "supervis", "people management"],
    "stakeholder communication": ["stakeholder", "communication", "presentation", "presented"],
    "cross-functional collaboration": ["functional", "collaborat", "worked with"],
    "project coordination": ["project ", "coordinat"],
    "process improvement": ["process improvement", "process optimization", "process redesign", "improve", "streamlin"],
    "training and mentoring": ["train", "mentor", "onboard"],
    "recruitment": ["recruit", "hiring", "interview"],
    "customer service": ["customer service", "client service", "candidate experience"],
    "problem solving": ["problem solv", "problem-solv", "resolve"],
    "time management": ["time management", "prioriti", "multi task", "multi-task"],
    "quality assurance": ["quality ", "testing"],
    "documentation": ["documentation", "documented", "prepare", "reporting"],
    "analytical thinking": ["analyse", "analyze", "analysi", "analyzi", "data-driven", "data driven", "root cause"],
    "relationship management": ["relationship", "partner with", "partnering with"],
    "strategic planning": ["strategic planning", "roadmap", "planning and organizing"],
}
ABILITY_PHRASE = r"\b(?:ability to|proven ability to|experienced in|experience in|responsible for)\s+([a-z][a-z0-9 /-]{8,90})"
CATEGORY_WORDS = {
    "DATABASE": ["dba", "database administrator", "oracle dba", "sql server", "database developer", "database admin", "mysql dba", "postgresql dba"],
    "BACKEND": ["backend", "java developer", "python developer", "c# developer", "c++ developer", "nodejs", "spring boot", "django",
                "ruby on rails", ".net developer", "golang", "php developer"],
    "FRONTEND": ["frontend", "react", "angular", "vue", "ui developer", "html", "css", "javascript developer", "web developer"],
    "DATA-ENGINEERING": ["data engineer", "hadoop", "spark", "etl", "data pipeline", "kafka", "snowflake", "big data"],
    "DATA-ANALYSIS": ["data analyst", "data scientist", "business analyst", "machine learning", "deep learning", "nlp", "computer vision", "statistics"],
    "DEVOPS": ["devops", "sre", "site reliability", "aws", "azure", "gcp", "docker", "kubernetes", "jenkins", "cicd", "terraform"],
    "QA": ["qa", "quality assurance", "tester", "test engineer", "automation testing", "manual testing", "selenium", "cypress"],
    "PROJECT-MANAGEMENT": ["scrum master", "product manager", "project manager", "agile", "pmp", "product owner"],
    "SYSTEM-ADMINISTRATION": ["system admin", "sysadmin", "linux admin", "windows admin", "network admin", "infrastructure"],
    "MOBILE": ["ios developer", "android developer", "mobile developer", "flutter", "react native", "swift", "kotlin"],
    "SECURITY": ["security", "cybersecurity", "penetration testing", "infosec", "soc analyst", "ethical hacker"],
}
CATEGORY_SKILL = {
    "INFORMATION-TECHNOLOGY": "information technology", "ACCOUNTANT": "accounting", "ENGINEERING": "engineering",
    "HR": "human resources", "BANKING": "banking", "FINANCE": "finance", "CONSULTANT": "consulting",
    "DIGITAL-MEDIA": "digital media", "DESIGNER": "design", "HEALTHCARE": "healthcare",
    "BUSINESS-DEVELOPMENT": "business development", "SALES": "sales", "PUBLIC-RELATIONS": "public relations",
    "TEACHER": "teaching", "ADVOCATE": "legal", "AVIATION": "aviation", "FITNESS": "fitness", "CHEF": "culinary",
    "CONSTRUCTION": "construction", "ARTS": "arts", "APPAREL": "apparel", "BPO": "bpo", "AGRICULTURE": "agriculture",
    "AUTOMOBILE": "automotive",
}
# ------------------------------------------------------------------------
NOT_A_NAME = "|".join(NOT_A_NAME_WORDS)
SKILL_INNER_NOISE = "|".join(w.replace(".", r"\.") for w in SKILL_NOISE_PHRASES)


def _null():
    return F.lit(None).cast("string")


def _empty():
    return F.array().cast("array<string>")


LINE_END = r"[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_GAP = rf"[{FIND_WS}&&[^\n]]"


def lines(text: Column) -> Column:
    """Squashed, non-empty lines. White space is made plain in the whole text, as empty lines and the edges of lines do not count."""
    plain = F.regexp_replace(F.regexp_replace(text, f"{LINE_END}{FIND_WS}*", "\n"), rf"{_GAP}(?:{_GAP}+|(?<! ))", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def header_of(line: Column) -> Column:
    """Section name a header line announces, else null."""
    names: dict[str, str] = {}
    for section, words in SECTIONS.items():
        for w in words:
            names.setdefault(w, section)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(F.length(line) <= HEADER_MAX, F.try_element_at(table, F.lower(F.trim(F.regexp_replace(line, NO_LETTER, "")))))


def tagged_lines(text: Column) -> Column:
    """array<struct<line, sec>>: each line takes the last header at or before it.

    Header positions are found once and each line looks up the newest one.
    """
    def place_all(ls):
        heads = F.filter(ls, lambda e: e["h"].isNotNull())
        body = F.filter(ls, lambda e: e["h"].isNull())

        def place(hs, e):
            before = F.filter(hs, lambda h: h["i"] < e["i"])
            return F.struct(e["line"].alias("line"), F.coalesce(F.try_element_at(before, F.lit(-1))["h"], F.lit("root")).alias("sec"))

        return let(heads, lambda hs: F.transform(body, lambda e: place(hs, e)))

    return let(F.transform(lines(text), lambda s, i: F.struct(s.alias("line"), header_of(s).alias("h"), i.alias("i"))), place_all)


def section_lines(tagged: Column, name: str) -> Column:
    return F.transform(F.filter(tagged, lambda e: e["sec"] == name), lambda e: e["line"])


def section_text(tagged: Column, name: str) -> Column:
    return blank_to_null(F.array_join(section_lines(tagged, name), "\n"))


def email(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, EMAIL, 1))


def phone(text: Column) -> Column:
    return blank_to_null(squash(F.regexp_extract(text, PHONE, 1)))


def person_name(root_lines: Column, lines_read: int | None = None) -> Column:
    """The first line that looks like a name, of the first ``lines_read`` lines if given."""
    def plausible(s):
        words = F.split(s, " ")
        shouting = F.exists(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 5))
        return ~F.lower(s).rlike(NOT_A_NAME) & F.size(words).between(2, 4) & ~s.rlike(NAME_SYMBOLS) & ~shouting

    return F.initcap(F.get(F.filter(first_items(root_lines, lines_read), plausible), F.lit(0)))


def valid_skill(token: Column) -> Column:
    def ok(t):
        return (
            F.length(t).between(2, 50) & ~t.rlike("(?i)" + SKILL_PREFIX_NOISE) & ~t.rlike("(?i)" + SKILL_INNER_NOISE)
            & (F.length(F.regexp_replace(t, r"\P{L}", "")) >= 2))

    return let(F.regexp_replace(token, f"^{FIND_WS}+|{FIND_WS}+$", ""), ok)


def skills(tagged: Column, text: Column, chars: int | None = None, most: int | None = None) -> Column:
    """Skill tokens of the skill section, else of what follows a skill heading (its first ``chars`` characters, if given);
    ``most``: parts looked at."""
    after_heading = first_chars(F.regexp_extract(text, SKILL_HEADING, 1), chars)
    src = F.coalesce(section_text(tagged, "skills"), blank_to_null(after_heading))
    parts = first_items(F.split(src, SKILL_SPLIT), most)
    return F.coalesce(dedupe_ignore_case(F.filter(parts, valid_skill)), _empty())


def fallback_skill_tokens(text: Column, chars: int | None = None, most: int | None = None) -> Column:
    """Parts of the text after the word 'skills': of its first ``chars`` characters and the first ``most`` parts, if given."""
    tail = first_chars(F.regexp_extract(text, r"(?is)\bskills\b(.*)", 1), chars)
    return F.when(text.rlike(r"(?i)\bskills\b"), first_items(F.split(tail, r"[,\n;|]"), most)).otherwise(_empty())


def fallback_skills(text: Column) -> Column:
    return skill_list_raw(fallback_skill_tokens(text))


def fallback_skills_normalized(text: Column) -> Column:
    return skill_list_normalized(fallback_skill_tokens(text))


def first_date(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, DATE_WORD, 1))


def _education(degree: Column, institution: Column, start: Column) -> Column:
    return F.struct(degree.alias("degree"), institution.alias("institution"), start.alias("start_date"))


def education_lines(tagged: Column) -> Column:
    rows = F.filter(section_lines(tagged, "education"), lambda s: F.lower(s).rlike(DEGREE_WORDS))
    return F.transform(rows, lambda s: _education(s, _null(), first_date(s)))


def education_scan(text: Column) -> Column:
    """Degree and school chunks anywhere in the whole text, first of equals kept."""
    flat = single_spaced(text)
    deg = F.transform(F.regexp_extract_all(flat, F.lit(DEGREE_CHUNK), F.lit(1)), lambda s: _education(squash(s), _null(), first_date(squash(s))))
    school = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(SCHOOL_CHUNK), F.lit(1)), squash), lambda s: F.length(s) >= 8)
    sch = F.transform(school, lambda s: _education(_null(), s, first_date(s)))
    return distinct_by(F.concat(deg, sch), ["degree", "institution"])


def distinct_by(records: Column, fields: list[str]) -> Column:
    """First record per lower-cased field tuple, order kept (sort by key, keep firsts, sort back)."""
    def key(r):
        return F.concat_ws("\x01", *[F.coalesce(F.lower(squash(r[f])), F.lit("")) for f in fields])

    return first_by_key(F.transform(records, lambda r, i: F.struct(key(r).alias("k"), i.alias("i"), r.alias("v"))))


def split_title(header: Column) -> tuple[Column, Column]:
    parts = titled(header)
    return parts["title"], parts["company"]


def titled(header: Column) -> Column:
    """struct<title, company> of a header, whose text is cleaned once."""
    def parts(t):
        at, dash, comma = F.lower(t).contains(" at "), t.contains(" - "), t.contains(",")
        by_at = F.split(t, r"(?i)\s+at\s+", 2)
        cut = F.when(at, F.get(by_at, F.lit(0))).when(dash, F.substring_index(t, " - ", 1)).when(comma, F.substring_index(t, ",", 1)).otherwise(t)
        rest = (
            F.when(at, F.get(by_at, F.lit(1)))
            .when(dash, F.get(F.split(t, " - ", 2), F.lit(1)))
            .when(comma, F.get(F.split(t, ",", 2), F.lit(1)))
        )
        return F.struct(cut.alias("title"), rest.alias("company"))

    return let(squash(header), parts)


def experience_blocks(tagged: Column) -> Column:
    """One record per line with a date range; the lines up to the next one describe it."""
    def record(ls, starts, e, j):
        nxt = F.coalesce(F.get(starts, j + 1)["i"], F.size(ls))
        prev = F.get(ls, e["i"] - 1)
        may_prev = (e["i"] > 0) & ~prev["d"] & (F.length(prev["s"]) < 80)
        head = let(F.trim(F.regexp_extract(e["s"], rf"^(.*?){FIND_RANGE}", 1)), lambda h: F.when((h == "") & may_prev, prev["s"]).otherwise(h))
        header = let(F.trim(F.regexp_replace(head, TITLE_PREFIX, "")), blank_to_null)
        desc = let(F.array_join(F.transform(F.slice(ls, e["i"] + 2, nxt - e["i"] - 1), lambda x: x["s"]), " "), blank_to_null)
        return let(titled(header), lambda p: F.struct(
            p["title"].alias("title"), p["company"].alias("company"), F.regexp_extract(e["s"], FIND_RANGE, 1).alias("start_date"),
            F.regexp_extract(e["s"], FIND_RANGE, 2).alias("end_date"), _null().alias("location"), desc.alias("description")))

    def all_records(ls):
        return let(F.filter(ls, lambda e: e["d"]), lambda starts: F.transform(starts, lambda e, j: record(ls, starts, e, j)))

    numbered = F.transform(section_lines(tagged, "experience"), lambda s, i: F.struct(s.alias("s"), s.rlike(FIND_RANGE).alias("d"), i.alias("i")))
    return let(numbered, all_records)


def experience_scan(text: Column) -> Column:
    """Date ranges anywhere in the whole text: 140 characters before name the job, 220 after describe it.

    Splitting on the range itself gives the running offsets the contexts are cut at.
    """
    def ranged(flat):
        return let(F.regexp_extract_all(flat, F.lit(f"({FIND_RANGE})"), F.lit(1)), lambda whole: cut(flat, whole))

    def cut(flat, whole):
        def record(m, s, i):
            after = F.get(m["ends"], i)
            first = after - F.get(m["spans"], i)
            left = F.trim(F.substring(flat, F.greatest(first - 139, F.lit(1)), F.least(first, F.lit(140))))
            desc = let(F.substring(F.trim(F.substring(flat, after + 1, F.lit(220))), 1, 200), blank_to_null)
            return let(titled(F.trim(F.element_at(F.split(left, r"\."), -1))), lambda p: F.struct(
                p["title"].alias("title"), p["company"].alias("company"), s.alias("start_date"), F.get(m["end"], i).alias("end_date"),
                _null().alias("location"), desc.alias("description")))

        apart = F.when(flat.contains(MARK), F.split(flat, FIND_RANGE)).otherwise(F.split(F.regexp_replace(flat, FIND_RANGE, MARK), MARK))
        gaps = F.transform(apart, lambda s: F.length(s))
        spans = F.transform(whole, lambda s: F.length(s))
        # running end offset of each range: lengths of the text before it and of itself, summed once
        ends = F.aggregate(
            F.arrays_zip(gaps.alias("g"), spans.alias("s")), F.array().cast("array<int>"),
            lambda acc, x: F.when(x["s"].isNull(), acc).otherwise(
                F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["g"] + x["s"]))))
        found = F.struct(
            F.transform(whole, lambda s: F.regexp_extract(s, DATE_RANGE, 1)).alias("start"),
            F.transform(whole, lambda s: F.regexp_extract(s, DATE_RANGE, 2)).alias("end"), spans.alias("spans"), ends.alias("ends"))
        return let(found, lambda m: F.transform(m["start"], lambda s, i: record(m, s, i)))

    def single(title, date):
        return F.struct(F.trim(title).alias("title"), _null().alias("company"), date.alias("start_date"), _null().alias("end_date"),
                        _null().alias("location"), _null().alias("description"))

    def dated_titles(flat):
        """A date, then a title."""
        parts = rf"^((?i:{DATE})) ([{_LETTER}].*)$"
        found = F.transform(F.regexp_extract_all(flat, F.lit(DATE_THEN_TITLE), F.lit(0)), lambda m: single(F.regexp_extract(m, parts, 2), F.regexp_extract(m, parts, 1)))
        return F.when(flat.rlike(MAYBE_DATE_THEN_TITLE), found).otherwise(F.array().cast(RECORDS))

    def titled_dates(flat):
        """A title, then a date: what TITLE_THEN_DATE finds. A title begins at the first letter after the last date, or at the first
        one of as many characters before the date as it may have; a comma and spaces before the date are not part of it."""
        def cut(gap):
            t = F.rtrim(F.regexp_extract(gap, rf"[{_LETTER}].*", 0))
            t = let(t, lambda u: F.when(F.endswith(u, F.lit(",")), F.rtrim(F.substring(u, F.lit(1), F.length(u) - 1))).otherwise(u))
            return let(t, lambda u: F.when(F.length(u) <= TITLE_MOST, u).otherwise(F.regexp_extract(F.substring(u, -TITLE_MOST, TITLE_MOST), rf"[{_LETTER}].*", 0)))

        def ahead(e):  # without a letter before it, only the month of the date itself can be a title
            named = F.regexp_extract(e["d"], rf"^[{_LETTER}]+", 0)
            return F.when(e["gap"].rlike(rf"[{_LETTER}]"), F.struct(cut(e["gap"]).alias("t"), e["d"].alias("d"))).otherwise(
                F.struct(F.when(named != "", F.when(F.startswith(e["after"], F.lit("/")), "").otherwise(named)).alias("t"), F.when(named == "", e["d"]).otherwise(F.substring(e["d"], -4, 4)).alias("d")))

        def read(run):
            def paired(parts):  # gap, date, gap, date, ..., rest
                pairs = F.transform(parts, lambda gap, i: F.struct(gap.alias("gap"), F.get(parts, i + 1).alias("d"), F.get(parts, i + 2).alias("after"), i.alias("i")))
                return F.filter(pairs, lambda e: (e["i"] % 2 == 0) & e["d"].isNotNull())

            marked = F.regexp_replace(run, ALONE_DATE, MARK + "$1" + MARK)  # a run has no such character
            found = F.filter(F.transform(let(F.split(marked, MARK), paired), ahead), lambda e: e["t"].isNotNull())
            # a title of one or two characters would end within what looks like a date: read place by place
            return let(found, lambda f: F.when(F.forall(f, lambda e: F.length(e["t"]) >= 3), F.transform(f, lambda e: single(e["t"], e["d"])))
                       .otherwise(F.zip_with(*[F.regexp_extract_all(run, F.lit(TITLE_THEN_DATE), F.lit(g)) for g in (1, 2)], single)))

        runs = F.filter(F.regexp_extract_all(flat, F.lit(TITLE_RUN), F.lit(0)), lambda run: run.rlike(r"\d{4}"))
        ends = ("education", "skills", "summary", "highlights")
        return F.filter(F.flatten(F.transform(runs, read)), lambda r: ~functools.reduce(operator.or_, [F.endswith(F.lower(r["title"]), F.lit(w)) for w in ends]))

    def scan(flat):
        alone = F.filter(F.concat(dated_titles(flat), titled_dates(flat)), lambda r: r["title"] != "")
        return F.when(flat.rlike(MAYBE_RANGE) & flat.rlike(FIND_RANGE), ranged(flat)).otherwise(alone)

    records = let(single_spaced(text), scan)
    return distinct_by(records, ["title", "company", "start_date", "end_date"])


def is_weak(skills_: Column, experience: Column, education: Column, name: Column, email_: Column, phone_: Column) -> Column:
    no_exp_edu = (F.size(experience) == 0) & (F.size(education) == 0)
    return (F.size(skills_) == 0) | no_exp_edu | (name.isNull() & email_.isNull() & phone_.isNull())


def typed_experience(records: Column) -> Column:
    return F.transform(records, lambda r: F.struct(
        clean_item(r["title"]).alias("title"), clean_item(r["company"]).alias("company"),
        normalize_month(r["start_date"]).alias("start_date"), normalize_month(r["end_date"]).alias("end_date"),
        clean_item(r["location"]).alias("location"), clean_item(r["description"]).alias("description")))


def typed_education(records: Column) -> Column:
    return F.transform(records, lambda r: F.struct(
        clean_item(r["degree"]).alias("degree"), clean_item(r["institution"]).alias("institution"),
        normalize_month(r["start_date"]).alias("start_date")))


def abilities(summary: Column, descriptions: Column, text: Column, limit: int | None = None, chars: int | None = None) -> Column:
    """Ability labels, else ability phrases. ``limit``: at most so many; ``chars``: how much of the text is read (None: all)."""
    def from_corpus(corpus):
        def may(label):
            return functools.reduce(operator.or_, [corpus.contains(s) for s in ABILITY_STEMS[label]])

        # whether a pattern is there does not depend on how it repeats: the shortest way is found soonest
        labels = F.filter(F.array(*[F.when(may(lb) & corpus.rlike(rx.replace(".*", ".*?")), F.lit(lb)) for lb, rx in ABILITIES]), lambda x: x.isNotNull())
        phrases = F.transform(
            F.regexp_extract_all(corpus, F.lit(ABILITY_PHRASE), F.lit(1)),
            lambda p: F.btrim(F.regexp_replace(p, r"\b(?:the|a|an)\b\s+", ""), F.lit(" -")))
        phrases = F.filter(phrases, lambda p: F.size(F.filter(F.split(p, " +"), lambda w: w != "")).between(3, 8))
        fallback = first_items(dedupe(first_items(phrases, limit)), limit)
        return let(first_items(labels, limit), lambda found: F.when(F.size(found) > 0, found).otherwise(fallback))

    return let(F.lower(squash(F.concat_ws(" ", summary, F.array_join(descriptions, " "), first_chars(text, chars)))), from_corpus)


def _boundary(words: list[str]) -> list[str]:
    return [rf"\b{re.escape(w)}\b" for w in words]


def _any_word(words: list[str]) -> str:
    """Pattern that finds, at every place where some of the words begin, the longest of them; words share their first letters."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by_first.setdefault(w[0], []).append(re.escape(w[1:]))
    return rf"\b(?=((?:{'|'.join(f'{re.escape(c)}(?:{'|'.join(rest)})' for c, rest in by_first.items())})\b))"


def impute_category(titles: Column, core: Column) -> Column:
    """Category with most keyword hits; the earlier one wins a tie. All keywords are looked for in one pass."""
    words = [w for ws in CATEGORY_WORDS.values() for w in ws]
    # a word that begins a longer one, as a word of its own, is there with it
    within = [(w, v) for w in words for v in words if w != v and re.match(_boundary([w])[0], v)]

    def best_of(found):
        all_found = F.array_distinct(F.concat(found, *[F.when(F.array_contains(found, v), F.array(F.lit(w))).otherwise(_empty()) for w, v in within]))
        scored = F.array(*[
            F.struct(F.size(F.array_intersect(all_found, F.array(*[F.lit(w) for w in ws]))).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c"))
            for i, (c, ws) in enumerate(CATEGORY_WORDS.items())])
        return F.when(F.size(found) > 0, F.array_max(scored)["c"]).otherwise("SOFTWARE-ENGINEERING")

    return let(F.regexp_extract_all(F.lower(F.concat_ws(" ", titles, core)), F.lit(_any_word(words)), F.lit(1)), best_of)


def category_skill(category: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CATEGORY_SKILL.items() for x in kv])
    return F.try_element_at(m, F.upper(category))


def prepend_missing(a: Column, value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.array_contains(a, value), F.concat(F.array(value), a)).otherwise(a)


def inject_category(core: Column, canonical: Column, expanded: Column, category: Column, parents: Column) -> Column:
    s = category_skill(category)
    return F.struct(
        prepend_missing(core, s).alias("core_skills"), prepend_missing(canonical, s).alias("canonical_skills"),
        F.when(s.isNotNull() & ~F.array_contains(expanded, s),
               dedupe(F.concat(F.array(s), F.coalesce(parents, _empty()), expanded))).otherwise(expanded).alias("expanded_skills"))


def completeness(summary: Column, skills_: Column, years: Column, n_experience: Column, n_education: Column) -> Column:
    def part(cond, w):
        return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))

    return F.round(
        part(F.coalesce(summary, F.lit("")) != "", 0.25) + part(F.size(skills_) >= 3, 0.25) + part(years.isNotNull(), 0.2)
        + part(n_experience > 0, 0.15) + part(n_education > 0, 0.15), 4)


def build_embedding_text(*, name, category, summary, core, canonical, expanded, capabilities, titles, fallback, limit: int = 4000) -> Column:
    special = F.filter(F.array_except(F.array_except(canonical, core), capabilities), lambda t: F.size(F.split(t, " ")) <= 3)

    def listed(label, a, n):
        return F.when(F.size(a) > 0, F.concat(F.lit(label + ": "), F.array_join(F.slice(a, 1, n), "; ")))

    def named(label, c):
        return F.concat(F.lit(label + ": "), blank_to_null(c))

    body = F.concat_ws(
        "\n", named("Name", name), named("Category", category), named("Summary", summary), listed("Core skills", core, 30),
        listed("Specialized skills", special, 20), listed("Expanded skills", expanded, 30), listed("Capabilities", capabilities, 5),
        listed("Experience titles", titles, 20))
    return embedding_text(F.coalesce(blank_to_null(body), fallback), limit)


def synthetic_text(*, name, category, skills, abilities, experience, education) -> Column:
    def or_none(c):
        return F.coalesce(c, F.lit("None"))

    def exp(e):
        when = F.when(F.coalesce(e["start_date"], F.lit("")) != "", F.concat(F.lit(" ("), e["start_date"], F.lit(" to "), or_none(e["end_date"]), F.lit(")"))).otherwise("")
        return F.concat_ws("\n", F.concat(F.lit(" - "), or_none(e["title"]), F.lit(" at "), or_none(e["company"]), when),
                           F.concat(F.lit("   "), blank_to_null(e["description"])))

    def edu(e):
        when = F.when(F.coalesce(e["start_date"], F.lit("")) != "", F.concat(F.lit(" ("), e["start_date"], F.lit(")"))).otherwise("")
        return F.concat(F.lit(" - "), or_none(e["degree"]), F.lit(" at "), or_none(e["institution"]), when)

    def block(title, a, fn):
        return F.when(F.size(a) > 0, F.concat(F.lit(title + ":\n"), F.array_join(F.transform(a, fn), "\n")))

    return F.concat_ws(
        "\n", F.concat(F.lit("Name: "), blank_to_null(name)), F.concat(F.lit("Category: "), blank_to_null(category)),
        F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "))),
        block("Abilities", abilities, lambda a: F.concat(F.lit(" - "), a)), block("Experience", experience, exp), block("Education", education, edu))
