"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and words that announce an
identifier. Each anchor is expanded by a local parser to the boundaries of an address, number or account and checked
there; nothing else of the text is parsed. The parsers return exactly the leftmost non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                       12 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 9 to 15 digits

and, besides, ``account`` (a number after an announcing word, checked by the rules of its kind), ``handle`` (an at-sign
with a name), ``url``, and ``secret`` (a token, key or password after its name, checked by length and alphabet).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.wordhash import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "handle", "url", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
RUN = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HANDLE = re.compile(r"[A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@])")
URL = re.compile(r"[^\x00-\x20\"<>\\^`{|}]+")
ACCOUNT = re.compile(r"(?:[\x20\t]*(?:no|number|nr|id|is|name)\b)?[\x20\t.:#=]*([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){5,33})")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "customer", "member", "login", "username")
SECRETS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api key", "api_key", "api-key", "access key", "access_key", "private key", "private_key", "bearer")
LOOSE = ("password", "passwd", "pwd")  # may hold anything, so they need a sign between name and value
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){11,30}")
SSN = re.compile(r"([0-9]{3})([\x20-]?)([0-9]{2})\2([0-9]{4})(?![0-9])")
PASSPORT = re.compile(r"[A-Za-z]{0,2}[0-9]{6,9}(?![A-Za-z0-9])")
LEAD = re.compile(r"(?:[\x20\t]*(?:no|number|nr|id|is|name)\b)?[\x20\t.:#=]*")
SIGNED = re.compile(r"[\"'\x20\t]*([:=]+)[>\x20\t]*([\"']?)|[\x20\t]+()([\"']?)")
VALUE = re.compile(r"[^\s\"',;<>]+")
TOKEN = re.compile(r"[A-Za-z0-9_+/.=~-]+")


@functools.cache
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("url", SCHEMES), ("account", CUES), ("secret", SECRETS)):
        for w in words:
            automaton.add_word(w, (kind, len(w)))
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    """Length and check digits of an IBAN without blanks."""
    value = value.upper()
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _iban(text: str, at: int) -> int:
    """End of the longest IBAN that begins here, 0 if there is none."""
    m = IBAN.match(text, at)
    for end in range(m.end(), at + 14, -1) if m else ():
        if end == len(text) or not text[end].isalnum():
            if iban(re.sub("[ -]", "", text[at:end])):
                return end
    return 0


def _account(text: str, at: int, cue: str, found: list, done: int) -> int:
    """The number that an announcing word leads to, if it is one of that kind; words in between end the search.

    IBAN by check digits, social security numbers by their forbidden parts, passports by form, others by four digits."""
    lead = LEAD.match(text, at).end()
    if lead < done or lead == at:  # the word goes on
        return done
    end = _iban(text, lead)
    if not end and cue in ("ssn", "social security"):
        while m := re.compile(r"(?:security|number|no|nr|is)\b[\x20\t.:#=]*").match(text, lead):
            lead = m.end()
        m = SSN.match(text, lead)
        if not m or m[1] in ("000", "666") or m[1][0] == "9" or m[3] == "00" or m[4] == "0000":
            return done
        end = m.end()
    elif not end and cue == "passport":
        m = PASSPORT.match(text, lead)
        end = m.end() if m else 0
    elif not end and cue != "iban":
        m = ACCOUNT.match(text, at)
        cut = re.match(r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*(?: [A-Z0-9]*[0-9][A-Z0-9]*)*", m[1]) if m and m.start(1) == lead else None
        if cut and sum(c.isdigit() for c in cut[0]) >= 4:
            end = lead + cut.end()
    if not end:
        return done
    found.append((lead, "account", end))
    return end


def _secret(text: str, at: int, cue: str, found: list, done: int) -> int:
    """The value that a secret's name leads to. Tokens and keys: 16 characters or more of their alphabet, digits among
    them; passwords: six characters or more after a colon or an equals sign."""
    m = SIGNED.match(text, at)
    if not m or m.end() < done:
        return done
    loose = cue in LOOSE
    v = (VALUE if loose else TOKEN).match(text, m.end())
    if not v or (loose and not m[1]):
        return done
    value = v[0].rstrip(".")
    if len(value) < (6 if loose else 16) or (not loose and not any(c.isdigit() for c in value)):
        return done
    found.append((m.end(), "secret", m.end() + len(value)))
    return m.end() + len(value)


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start, then kind as listed."""
    found: list[tuple[int, str, int]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (anchor, width) in _anchors().iter(_lower(text)):
        at = last - width + 1
        if anchor == "0":
            if at >= done["ip"]:
                m = IP.match(text, at)
                done["ip"] = m.end() if m else RUN.match(text, at).end()
                if m and all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                    found.append((at, "ip", m.end()))
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, "card", m.end()))
        elif anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                done["email"] = m.end()
                found.append((start, "email", m.end()))
            elif start == at and (m := HANDLE.match(text, at + 1)):
                found.append((at, "handle", m.end()))
        elif anchor == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((at, "phone", m.end()))
        elif anchor == "url":
            if at >= done["url"] and (m := URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)'"))
                if end > last + 1:
                    found.append((at, "url", end))
                    done["url"] = end
        elif at == 0 or not text[at - 1].isalnum():
            take = _account if anchor == "account" else _secret
            done[anchor] = take(text, last + 1, text[at : last + 1].lower(), found, done[anchor])
    found.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return found


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more,
    n_private.

    Spans are kind:start:end in code points, end exclusive, by start, then kind as listed, joined by commas. The counts
    and ``base_sha256`` (SHA-256 of their joined spans) are of the four base kinds, ``spans`` of all, ``n_more`` counts
    the others; ``n_private`` counts base kinds, accounts and secrets, but no handles and URLs.

    * Null text counts as empty: no spans, the digest of the empty text. Long texts are parsed whole, in one pass.
    * Matches that fail their check are dropped, and the search goes on behind them. Kinds may overlap each other.
    * Repeated rows and rows without id are each answered. An empty table gives no rows. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [find(t or "") for t in part.column("text").to_pylist()]
                base = [[s for s in r if s[1] in BASE] for r in rows]
                counts = [pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k in BASE]
                digest = [hashlib.sha256(_told(r).encode()).hexdigest() for r in base]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([_told(r) for r in rows], pa.string()),
                     pa.array([len(r) - len(b) for r, b in zip(rows, base)], pa.int64()),
                     pa.array([sum(s[1] not in ("handle", "url") for s in r) for r in rows], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_more", "n_private"])

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, n_more long, n_private long")
