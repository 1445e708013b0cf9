"""Personal data: base spans against the plain patterns, votes, and what the method adds."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = pii.digits_of
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text("ab.@-c1%", max_size=40) | st.text("0123.9 25", max_size=40) | st.text("+() .-012345", max_size=50) | st.text("0 -1234", min_size=16, max_size=40))
def test_base_spans(text):
    assert pii.base_spans(pii.candidates(text)) == plain(text)


def test_long_runs_end():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + " " * 100_000, "a@" * 50_000):
        pii.candidates(text)


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < 0.9, np.where(truth, 1, 2), np.where(truth, 2, 1)) for _ in pii.LABELERS], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    pattern, n = np.unique((votes * 3 ** np.arange(votes.shape[1])).sum(axis=1), return_counts=True)
    post, share, table = pii.em(pattern, n.astype(float))
    assert abs(share - 0.3) < 0.02 and abs(table[0, 0, 1] - 0.72) < 0.03
    assert (post[pattern == sum(3**i for i in range(6))] > 0.99).all()


def test_query(spark):
    secret = 'token = "ed85aea7af91af30d358df8319c45ee8ae9f5135"'
    rows = [(i, f"words {i} a{i}@mail.example.com at 10.2.3.{i % 200} and {secret} end") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "Clean prose, 12 pages, version 1.2.3 of 1999."), (103, "card 4111 1111 1111 1111, call +1 (555) 010-9999"), (103, "card 4111 1111 1111 1111, call +1 (555) 010-9999"), (None, "999.1.1.1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = pii.pii_spans(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        base = plain(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for k, _, _ in base) for j in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert set(pii.shown(base).split(",")) <= set(r.spans.split(","))
        assert ("secret" in r.spans) == (secret in text)
    assert next(r.spans for r in got if r.doc_id == 102) == ""
    assert pii.pii_spans(df.limit(0)).count() == 0


def test_redact():
    text = "mail a@b.cd now"
    assert pii.redact(text, pii.base_spans(pii.candidates(text))) == "mail <email> now"


def luhn_number(rng, prefix, length):
    while True:
        digits = prefix + "".join(rng.choice("0123456789") for _ in range(length - len(prefix)))
        if pii.luhn(digits):
            return digits


def planted(rng):
    """Texts with spans that no strict pattern has, and look-alikes: (text, whether the look-alike is a true span)."""
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    out = []
    for i in range(400):
        out.append((f"my card {luhn_number(rng, '37', 15)} is lost", True))
        digits = rng.choice("0129") + "".join(rng.choice("0123456789") for _ in range(14))
        out.append((f"order {digits} is on its way", False))
        out.append((f"write to {word()} at {word()} dot {rng.choice(['com', 'org', 'de'])} today", True))
        out.append((f"look {word()} at {word()} dot {rng.choice(['1', '2'])} please", False))
        out.append((f"a card {luhn_number(rng, '4', 16)} and mail {word()}@{word()}.com", None))
    return out


def test_method_decides_beyond_the_strict_patterns(spark):
    rows = planted(random.Random(5))
    got = {r.doc_id: r for r in pii.pii_spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    added = {i: got[i].n_spans - sum(got[i][c] for c in ("n_email", "n_ip", "n_card", "n_phone")) for i in got}
    true, false = [added[i] for i, (_, t) in enumerate(rows) if t], [added[i] for i, (_, t) in enumerate(rows) if t is False]
    assert np.mean(true) > 0.9 and np.mean(false) < 0.05
    assert all(got[i].n_spans == len(got[i].spans.split(",")) for i in got if got[i].spans)


def test_many_spans_take_linear_time():
    import time

    text = "key=ABCDEFGHIJKLMNOPQRSTUV012345 a@b.org " * 20_000
    taken = frozenset((4, *pii.votes(text, k, s, e, x)) for k, s, e, x in pii.candidates(text[:400]) if k == 4)
    began = time.time()
    base, spans = pii.all_spans(text, taken)
    assert len(base) == 20_000 and len(spans) >= 39_000 and time.time() - began < 20
