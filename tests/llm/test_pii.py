import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm.pii import BASE, find, find_personal_data, luhn

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The four kinds by their patterns."""
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(a, k, b) for a, _, k, b in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "+", "-", " ", "(", ")", "a", "Z", "é", "İ", "1", "0", "255", "256", "4111 1111 1111 1111", "10.0.0.1", "me@x.org",
                                 "+1 202 555 0100", "\n", "%", "_", ":", "//", "http://", "account ", "79927398713"]), max_size=14).map("".join))
def test_base_kinds_equal_their_patterns(text):
    assert [s for s in find(text) if s[1] in BASE] == plain(text)


def test_more_kinds():
    text = "İ see https://a.org/x?y=1, ask @some_one; IBAN: DE89 3704 0044 0532 0130 00. Account no. 12-3456-7 accounting 99999"
    more = {k: text[a:b] for a, k, b in find(text) if k not in BASE}
    assert more == {"url": "https://a.org/x?y=1", "handle": "@some_one", "account": "12-3456-7"}
    assert [text[a:b] for a, k, b in find(text) if k == "account"] == ["DE89 3704 0044 0532 0130 00", "12-3456-7"]


def kinds(text, kind):
    return [text[a:b] for a, k, b in find(text) if k == kind]


def test_accounts_follow_the_rules_of_their_kind():
    assert kinds("iban GB82 WEST 1234 5698 7654 32 and more", "account") == ["GB82 WEST 1234 5698 7654 32"]
    assert kinds("IBAN GB82WEST12345698765432.", "account") == ["GB82WEST12345698765432"]
    assert kinds("iban GB82 WEST 1234 5698 7654 33", "account") == []  # check digits
    assert kinds("account DE89370400440532013000", "account") == ["DE89370400440532013000"]
    assert kinds("ssn 123-45-6789; SSN: 123456789", "account") == ["123-45-6789", "123456789"]
    for bad in ("000-00-0000", "666-12-3456", "912-12-3456", "123-00-6789", "123-45-0000", "123-45-67890", "12-345-6789"):
        assert kinds(f"ssn {bad}", "account") == [], bad
    assert kinds("social security number 123-45-6789", "account") == ["123-45-6789"]
    assert kinds("passport no. C01234567, passport X1", "account") == ["C01234567"]
    assert kinds("member id 123456, members 999999, customer of 5 years", "account") == ["123456"]


def test_secrets_by_length_and_alphabet():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'x token = "{key}" y', "secret") == [key]
    assert kinds(f"ACCESS_TOKEN={key}; api-key: {key[:20]}", "secret") == [key, key[:20]]
    assert kinds(f"Authorization: Bearer {key}.", "secret") == [key]
    assert kinds("password: hunter-2! passwd='s3cr#t'", "secret") == ["hunter-2!", "s3cr#t"]
    for clean in ("the token of my love for you", "token = short1", "password is required", "a secret representationalism", "tokens everywhere", "pwd: x"):
        assert kinds(clean, "secret") == [], clean


def test_every_secret_of_the_given_documents_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in find_personal_data(docs).collect()}
    told = {r.doc_id: r.text for r in docs.collect()}
    wanted = [i for i, t in told.items() if re.search(r'token = "[0-9a-f]{40}"', t or "")]
    assert wanted and all("secret:" in got[i].spans and got[i].n_private for i in wanted)


def test_table(table):
    long = "9" * 300_000 + " @" * 1000 + "a" * 100_000 + "@b.c"
    docs = table([(1, "me@x.org 10.0.0.1"), (2, None), (3, ""), (4, long), (None, "+1 202 555 0100"), (1, "me@x.org 10.0.0.1")], clash=True)
    got = find_personal_data(docs).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].spans == "email:0:8,ip:9:17" and (by[1].n_email, by[1].n_ip, by[1].n_card, by[1].n_phone) == (1, 1, 0, 0)
    assert by[2].base_sha256 == by[3].base_sha256 == hashlib.sha256(b"").hexdigest() and by[2].spans == ""
    assert by[4].n_email == 1 and by[None].n_phone == 1
    assert find_personal_data(table([])).collect() == []
