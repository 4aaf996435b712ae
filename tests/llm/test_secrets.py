import hashlib
import random
import re

import pytest

from cases import SF, documents, needs_tables
from laneflow.llm import automaton, queries, secrets

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PLAIN = [("assign", re.compile(ASSIGN, re.I | re.A), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def brute(text):
    found = [(m.start(), n, kind, m.end()) for n, (kind, p, g, least) in enumerate(PLAIN) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


@pytest.fixture(scope="module")
def scanner():
    return automaton.compile_rules()


def test_against_the_regex_engine(scanner):
    draw = random.Random(1)
    parts = ["token", "Token", "=", ":", " ", '"', "'", "secret", "passwd", "password", "api_key", "APIKEY", "AKIA", "A", "Z9", "0123456789ab", "abcdef",
             "f", "x", "\n", "_", ".", "é", "KIA", "toke", "AKIAAKIA0123456789", "ſecret", "日", "ghp_", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        found = [(scanner.rules[r].kind, s, e) for s, e, r in secrets._spans(scanner, text) if r < 3]
        assert found == brute(text), text


def test_more_kinds(scanner):
    text = f"x ghp_{'a1' * 20} xoxb-{'12' * 10} -----BEGIN EC PRIVATE KEY-----"
    assert {scanner.rules[r].kind for _, _, r in scanner.scan(text.encode())} >= {"github", "slack", "private_key"}


def test_minimised_automaton_is_small(scanner):
    assert len(scanner.moves) // scanner.width < 1500 and scanner.width < 64


@pytest.mark.parametrize("pattern", ["a*", "ab(cd)?", "[ab", "(a", "a)", "a\\d", "?"])
def test_rules_that_are_refused(pattern):
    with pytest.raises((ValueError, IndexError)):
        automaton.compile_rules((automaton.Rule("r", pattern),))


def test_operators_of_the_rule_language():
    for pattern in ("ab{2,3}", "(a|bc)+d", "[^a-c\\x0a]x", "a{2}", "\\x41b?", "[a-]+", "[]a]+"):
        machine = automaton.compile_rules((automaton.Rule("r", pattern),))
        draw = random.Random(2)
        for _ in range(300):
            text = "".join(draw.choice("abcdx-]A") for _ in range(12))
            assert [(s, e) for s, e, _ in machine.scan(text.encode())] == [m.span() for m in re.finditer(pattern, text)], (pattern, text)


def test_awkward_documents(spark):
    rows = secrets.find_secrets(documents(spark, clashes=True)).collect()
    assert len(rows) == 15 and all(r["secrets"] == [] for r in rows)
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_redaction(spark):
    rows = [(1, "é token = abcdefgh end"), (2, None), (3, "clean"), (4, "key 0123456789abcdef01234567!")]
    out = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(documents(spark, rows)).collect()}
    assert out == {1: "é [assign] end", 2: None, 3: "clean", 4: "key [hex]!"}


@needs_tables
def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_combined_secret_automaton"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        for kind in ("assign", "access", "hex"):
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in base)
