import hashlib
import random
import re

import pytest

from barelake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def base(text):
    return sorted(s for s in pii.find(text) if s[0] in pii.BASE)


CASES = ["", None, "a@b", "a@b.c@d.e x.y@z.com.", "@a.b", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.002.003.004", "4111 1111-1111 1111", "4111111111111111 4111111111111112", "+1 (234) 555-0000", "+12", "++1 22 333 4444 5", "+1.2.3.4 5.6.7.8.9", "é+49 30 1234567é", "9" * 5000, "1." * 3000 + "1"]


@pytest.mark.parametrize("text", CASES)
def test_base_cases(text):
    assert base(text) == brute(text)


def test_base_random():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("01259+-. @a.b()é@%1") for _ in range(rng.randint(0, 60)))
        assert base(text) == brute(text), text


def added(text):
    return sorted((k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE)


def test_added_kinds():
    assert added("see https://a.example/x?y=1, then") == [("url", "https://a.example/x?y=1")]
    assert added("IBAN: DE89 3704 0044 0532 0130 00 ok") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN: DE89 3704 0044 0532 0130 01 no") == []
    assert added("account no. 12345678 and Konto: 99887766") == [("account", "12345678"), ("account", "99887766")]
    assert added("SSN 123-45-6789, not SSN 000-45-6789") == [("ssn", "123-45-6789")]
    assert added("lives at 12 Old Mill Road in") == [("address", "12 Old Mill Road")]
    assert added("The road was long. An accountant took account of it in 2020.") == []


def test_redaction():
    assert pii.redact("mail me.x@y.org or +1 (234) 555-0000.") == "mail [EMAIL] or [PHONE]."
    assert pii.redact("nothing here") == "nothing here" and pii.redact(None) is None and pii.redact("") == ""
    assert not brute(pii.redact("a@b.c 1.2.3.4 4111111111111111 +1 234 555 0000"))


def test_hard_rows(hard, none):
    rows = hard.withColumnRenamed("text", "t0").selectExpr("doc_id", "concat(coalesce(t0, ''), ' é me@x.org 10.0.0.1') AS text", "fp AS spans")
    got = pii.scan(rows.unionByName(hard.selectExpr("doc_id", "text", "fp AS spans"))).collect()
    assert len(got) == 2 * hard.count() and sum(r["n_email"] for r in got) == hard.count()
    for r in got:
        if r["n_email"]:
            assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest() and r["spans"].startswith("email:")
        else:
            assert r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == ""
    assert pii.scan(none).collect() == []
    clean = pii.redact_documents(hard)
    assert clean.columns == hard.columns and clean.count() == hard.count()
    assert pii.redact_documents(none).collect() == []
