"""Secret scan against a brute-force version that compares all parts of all scopes."""

import hashlib
import random
import re
import time

from tabulith.llm import secrets
from tests.conftest import SMALL
from tests.llm.test_operators import ODD, docs

PATTERNS = {
    "assign": r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
    "weak_identity": r"""(?ai:\b(?:user|username|login|clientid|client_id|account|accountid|account_id|accesskey|access_key|accesskeyid|accesskey_id|access_keyid|access_key_id|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,})""",
    "weak_endpoint": r"""(?ai:\b(?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|ssh)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})""",
    "weak_secret": r"[A-Za-z0-9+/=_-]+",
}
LEAST = {"access": 16, "hex": 32}


def base(text):
    out = []
    for kind in ("assign", "access", "hex"):
        for m in re.finditer(PATTERNS[kind], text):
            if len(m[1] if kind == "assign" else m[0]) >= LEAST.get(kind, 8):
                out.append((m.start(), m.end(), kind))
    return out


def meets(a, b):
    return a[0] < b[1] and b[0] < a[1]


def brute(text, reach=None):
    found = base(text)
    weak = [(m.start(), m.end(), k) for k in ("weak_identity", "weak_endpoint") for m in re.finditer(PATTERNS[k], text)]
    weak = [w for w in weak if not any(meets(w, b) for b in found)]
    for m in re.finditer(PATTERNS["weak_secret"], text):
        body = m[0].rstrip("=")
        if len(body) >= 20 and "=" not in body and len(m[0]) - len(body) <= 2 and secrets.opaque(m[0]):
            if not any(meets((m.start(), m.end()), b) for b in [*found, *weak]):
                weak.append((m.start(), m.end(), "weak_secret"))
    cuts = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    scope = lambda p: sum(c <= p[0] for c in cuts)
    side = lambda p: p[2] in ("assign", "hex", "weak_secret")
    gap = lambda a, b: max(a[0] - b[1], b[0] - a[1])
    keep = [w for w in weak if any(scope(w) == scope(p) and side(w) != side(p) and not meets(w, p) and (reach is None or gap(w, p) <= reach) for p in [*found, *weak])]
    order = ("assign", "access", "hex", "weak_identity", "weak_endpoint", "weak_secret")
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted({*found, *keep}, key=lambda x: (x[0], order.index(x[2]))))


def made(seed):
    r = random.Random(seed)
    bits = ["user: admin", "host=db.example.org", "https://a.example.org/x", "Zx81kQpLm2Nv7RtYw3Bc", "AKIA" + "ABCDEFGH23456789", "0f" * 16, "password=abc12345", "\n\n", "\n \t\n", "plain words", "account_id: A1b2C3d4E5f6G7h8I9j0K1", "https://cdn.example.org/Ab3dEf9h1J2k3L4m5N6pQ", "ſecret=abcdefgh", "é ", "x" * 150]
    return " ".join(r.choice(bits) for _ in range(r.randint(1, 25)))


def test_brute(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(10_000 + k, made(k)) for k in range(300)]
    rows += [(20_000, " ".join(made(k) for k in range(300, 420)))]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == brute(t or ""), i
    for reach in (0, 5, 200):
        assert all(secrets.scan_text(t, reach)[4] == brute(t, reach) for _, t in rows[-301:-1])


def test_parts_do_not_complement_themselves():
    for text in ("see https://cdn.example.org/Ab3dEf9h1J2k3L4m5N6pQ for the picture", "account_id: A1b2C3d4E5f6G7h8I9j0K1"):
        assert secrets.scan_text(text)[4] == ""


def test_no_chains():
    text = (" " * 250).join(f"user: admin{k} x" for k in range(7)) + " Zx81kQpLm2Nv7RtYw3Bc9Df4"
    got = secrets.scan_text(text, reach=200)[4].split(",")
    assert [g.split(":")[0] for g in got] == ["weak_identity", "weak_secret"] and len(secrets.scan_text(text)[4].split(",")) == 8


def test_time_grows_with_the_text():
    text = "".join(f"user: admin{k} host=h{k}.example.org key Zx81kQpLm2Nv7RtYw{k:04d}\n" for k in range(20_000))
    at = time.perf_counter()
    assert secrets.scan_text(text)[4].count("weak_secret") == 20_000
    assert time.perf_counter() - at < 10


def test_odd(spark):
    long = ("word " * 200_000) + "token: abcdefgh12 " + ("word " * 1000)
    rows = [*ODD, (70, long), (70, long)]
    got = secrets.find_secrets(docs(spark, rows)).collect()
    assert len(got) == len(rows) and [r.n_assign for r in got if r.doc_id == 70] == [1, 1]
    none = [r for r in got if r.doc_id in (1, 2)]
    assert all((r.n_assign, r.n_access, r.n_hex, r.spans, r.base_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in none)
    assert secrets.find_secrets(docs(spark, rows).limit(0)).count() == 0
