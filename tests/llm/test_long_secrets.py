"""Weak secrets of any length count, and the scope alone bounds what is linked."""

import base64
import hashlib

from tabulith.llm import secrets

KEY = base64.b64encode(hashlib.sha512(b"a").digest()).decode()


def kinds(text, **kw):
    return [s.split(":")[0] for s in secrets.scan_text(text, **kw)[4].split(",") if s]


def test_long_key():
    assert len(KEY) == 88
    text = f"account_id: store01 endpoint=https://store01.example.net key {KEY} end"
    assert "weak_secret" in kinds(text) and f"weak_secret:{text.index(KEY)}:{text.index(KEY) + 88}" in secrets.scan_text(text)[4]
    assert kinds(f"nothing else {KEY} here") == []


def test_scope_bounds_the_join():
    far = "user: admin01 " + "plain words of a text " * 40 + "Zx81kQpLm2Nv7RtYw3Bc9Df4 end"
    assert kinds(far) == ["weak_identity", "weak_secret"]
    assert kinds(far, reach=200) == []
    assert kinds(far.replace(" plain", "\n\nplain", 1)) == []
    assert kinds(far + "\n\nnext part") == ["weak_identity", "weak_secret"]
