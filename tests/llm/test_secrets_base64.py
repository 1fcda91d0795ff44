"""Base64 that is short, wrapped, has odd characters, or inflates to more than a layer."""

import base64
import bz2
import gzip
import lzma
import random
import textwrap

import pytest

from barelake.llm import secrets


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def kinds(text):
    return {k for k, _, _ in secrets.find(text)}


@pytest.mark.parametrize("plain", ["token=abc123", "secret=abc123", "token=abcdef"])
def test_short(plain):
    assert kinds(f"x {b64(plain)} y") == {"decoded_assign"}


LONG = "the config of the service, line one and more words until the secret = abcdef123456 stands here and goes on for long"


@pytest.mark.parametrize("width,end", [(64, "\n"), (76, "\r\n"), (20, "\n")])
@pytest.mark.parametrize("after", ["", "\n", "\nRegards, x"])
def test_wrapped(width, end, after):
    text = "key:\n" + end.join(textwrap.wrap(b64(LONG), width)) + after
    assert "decoded_assign" in kinds(text)
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefgh ") for _ in range(300))
    packed = "key:\n" + end.join(textwrap.wrap(b64(gzip.compress((noise + LONG).encode())), width)) + after
    assert "decoded_assign" in kinds(packed)


@pytest.mark.parametrize("odd", [" ", "​", "\x00"])
def test_odd_characters(odd):
    assert kinds(b64(f"user{odd}name token = abcdef123456 and so on")) == {"decoded_assign"}


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, lambda d: gzip.compress(bz2.compress(d))])
def test_beyond_the_first_stretch(monkeypatch, pack):
    monkeypatch.setattr(secrets, "MAX_LAYER", 1 << 16)
    for before in (200_000, (1 << 16) - 5):
        plain = b" " * before + b"token = abcdef123456" + b" " * 100_000
        assert kinds(b64(pack(plain))) == {"decoded_assign", "oversize"}
    assert kinds(b64(pack(b"token = abcdef123456"))) == {"decoded_assign"}
