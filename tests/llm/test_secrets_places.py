"""Each place of a blob is reported."""

import base64
import gzip

import pytest

from barelake.llm import secrets

PLAIN = "token = abcdef123456"


@pytest.mark.parametrize("blob", [base64.b64encode(PLAIN.encode()).decode(), base64.b64encode(gzip.compress(PLAIN.encode())).decode(), base64.b64encode(base64.b64encode(PLAIN.encode())).decode()])
def test_equal_blobs_at_two_places(blob):
    text = f"[a]\nx: {blob}\n[b]\ny: {blob}"
    starts = sorted(a for k, a, _ in secrets.find(text) if k == "decoded_assign")
    first = text.index(blob)
    assert starts == [first, text.index(blob, first + 1)]


def test_private_keys_at_two_places():
    blob = base64.b64encode(b"-----BEGIN RSA PRIVATE KEY-----").decode()
    assert sum(k == "private_key" for k, _, _ in secrets.find(f"{blob} and {blob} and {blob}")) == 3
