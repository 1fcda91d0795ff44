import base64
import gzip
import re
import zlib
from urllib.parse import quote

import pytest

from barelake.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def base(text):
    return sorted(s for s in secrets.find(text) if s[0] in secrets.BASE)


PLAIN = "token = abcdef123456"
CASES = [None, "", PLAIN, "PassWord':  'abc", "apikey=abcdef api_KEY:'abcdefg", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "é", "xAKIA" + "B2" * 20, "a" * 23, "é" + "0f" * 12, "g" + "f" * 30 + "G", "token=token=abcdef", "secret" * 50 + "=abcdef", "\U0001f600 passwd:\"x.y/z+==\""]


@pytest.mark.parametrize("text", CASES)
def test_base(text):
    assert base(text) == brute(text)


def decoded(text):
    return sorted((k, text[a:b]) for k, a, b in secrets.find(text) if k not in secrets.BASE)


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


WRAPPED = {
    "percent": quote(PLAIN, safe=""),
    "percent twice": quote(quote(PLAIN, safe=""), safe=""),
    "base64": b64(PLAIN),
    "base64 twice": b64(b64(PLAIN)),
    "gzip": b64(gzip.compress(PLAIN.encode())),
    "zlib in zlib": b64(zlib.compress(zlib.compress(PLAIN.encode() * 3))),
    "percent over base64": quote(b64("x" + PLAIN), safe="").replace("=", "%3D"),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_layers(name):
    run = WRAPPED[name]
    text = f"é before {run} after"
    found = [s for s in secrets.find(text) if s[0] == "decoded_assign"]
    assert found, text
    assert all(text.index(run[0], 9) <= a < b <= text.index(" after") for _, a, b in found)


def test_exact_places():
    text = "x=%41; token%20%3D%20abcdef123456;"
    assert decoded(text) == [("decoded_assign", "token%20%3D%20abcdef123456")]
    text = "say \\u0074oken = \\u0061bcdef12 now"
    assert decoded(text) == [("decoded_assign", "\\u0074oken = \\u0061bcdef12")]
    assert decoded("token &#61; abcdef123456") == [("decoded_assign", "token &#61; abcdef123456")]


def test_nothing_found_twice_or_in_prose():
    assert decoded("token = abcdef123456 and 100%25 sure") == []
    assert decoded("Therhowandereandthing Ofthanonedingereshandon abcdefghijklmnopqrstuvwxyzabcdef 100% \\uZZZZ %zz") == []
    assert decoded("%25" * 500) == []


def test_oversize(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", 1000)
    text = b64(gzip.compress(PLAIN.encode() + b" " * 100_000))
    assert {k for k, _ in decoded(text)} == {"decoded_assign", "oversize"}


def test_hard_rows(hard, none):
    got = secrets.scan(hard).collect()
    assert len(got) == hard.count() and all(r["spans"] == "" and r["n_hex"] == 0 for r in got)
    assert secrets.scan(none).collect() == []
