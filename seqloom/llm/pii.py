"""Personal data by weak supervision.

Candidates of each kind are found by wide patterns. Labelers vote on every candidate (for, against, or abstain): the
strict pattern, a check (Luhn sum, number range, length), a gazetteer (top-level domains, calling codes, issuers), words
in the context before it, its edges, and the variety of its characters. Expectation-maximisation over the counts of
vote patterns estimates, by kind, how common true spans are and how reliable each labeler is; the posteriors train a
logistic span classifier on votes and shape, and candidates above `THRESHOLD` become spans. Spans of the strict
patterns ("base") stay whatever the classifier says; no added span overlaps one.

Votes, kinds and shapes have few values, so the counts of all documents are a table of bounded size; it is summed by
Spark, and only that table reaches the driver. Nothing is sampled.

Defined results: a null text is the empty text without spans; offsets are code points, ends exclusive; repeated rows
give repeated rows and count as often; null ids pass through; other columns are left out; an empty table fits no model
and gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_slices, texts

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
LABELERS = ("strict", "check", "gazetteer", "context", "edges", "variety")
#: Shapes: six characters of length each, the last open; by number of separators (0, 1 or 2, more); by letters (none,
#: of one case, of both).
LENGTHS, SEPARATORS, CASES = 8, 3, 3
SHAPES = LENGTHS * SEPARATORS * CASES
THRESHOLD, ROUNDS, PRIOR = 0.95, 60, 2.0

# Top-level domains, calling codes, and words that speak for or against a kind.
DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai me tv co us uk de fr es it nl be ch at pt pl se no dk fi ie gr cz ru ua jp cn kr in br mx ar au nz ca za eu".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write to|reply|correo|courriel|schreib\w*)\W{0,12}$"),
    "ip": re.compile(r"\b(?:ip|ipv4|host|server|address|from|login|adresse|dirección)\W{0,12}$"),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\W{0,12}(?:no|number|nr)?\W{0,6}$"),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|téléphone|whatsapp)\W{0,12}$"),
    "secret": re.compile(r"\b(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|key|pwd|passwort|contraseña)\W{0,6}$"),
}
AGAINST = re.compile(r"\b(?:version|ver|v|isbn|issn|doi|order|invoice|page|chapter|section|fig|figure|table|no|commit|sha\d*|md5|hash|checksum|uuid|example)\W{0,4}$")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
STRICT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
# Every strict ip, card and phone lies in one such run, as all their characters are of its set.
RUN = re.compile(r"[+0-9][0-9 .()+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WIDE_PHONE = re.compile(r"(?<![0-9+])[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
# An address in words; looked for only where the text has a spelled-out dot.
DOT = re.compile(r" dot |[\[(]dot[\])]")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: at | ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}+(?:(?: dot | ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}+){1,4}+")
SECRET = re.compile(r"[=:] ?[\"']?([A-Za-z0-9_/+-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def in_range(ip: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in ip.split("."))


def emails(text: str):
    """Strict and wide matches, leftmost and without overlap: start, end, whether it is strict."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            if m := STRICT_DOMAIN.match(text, at + 1):
                yield start, m.end(), True
                free = m.end()
            elif m := WIDE_DOMAIN.match(text, at + 1):
                yield start, m.end(), False
        at = text.find("@", at + 1)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """kind, start, end, and whether the strict pattern holds, in the order of kind and start."""
    out = [(0, s, e, strict) for s, e, strict in emails(text)] if "@" in text else []
    if DOT.search(text):
        out += [(0, *m.span(), False) for m in SPELLED.finditer(text)]
    for run in RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            out.append((1, *m.span(), in_range(m[0])))
        for m in CARD.finditer(text, a, b):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19:
                out.append((2, *m.span(), len(d) >= 16 and luhn(d)))
        for m in PHONE.finditer(text, a, b):
            out.append((3, *m.span(), 8 <= len(digits_of(m[0])) <= 15))
        for m in WIDE_PHONE.finditer(text, a, b):  # numbers without a plus sign are candidates only after a word for them
            if FOR["phone"].search(text[max(0, m.start() - 40) : m.start()].lower()):
                out.append((3, *m.span(), False))
    for m in SECRET.finditer(text):
        out.append((4, *m.span(1), False))
    out.sort(key=lambda c: c[:3])
    return out


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, int]:
    """The vote pattern in base 3 (0 abstains, 1 for, 2 against; the first labeler is the lowest digit) and the shape."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = digits_of(span)
    check = gazetteer = 0
    if kind == 0:
        written = DOT.sub(".", span)
        last = re.split(r"[^A-Za-z0-9-]", written)[-1].lower()
        check = 1 if "." in written and ".." not in span and not span.startswith(".") else 2
        gazetteer = 1 if last in DOMAINS else 0 if last.isalpha() and len(last) >= 2 and strict else 2  # the list is not complete
    elif kind == 1:
        parts = span.split(".")
        check = 1 if in_range(span) else 2
        gazetteer = 2 if all(len(p) == 1 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    elif kind == 2:
        check = 1 if luhn(digits) else 2
        gazetteer = 1 if digits[0] in "3456" else 2
    elif kind == 3:
        check = 1 if 8 <= len(digits) <= 15 else 2
        gazetteer = 1 if span[0] == "+" and any(digits[:n] in CALLING for n in (1, 2, 3)) else 0
    else:
        mixed = bool(digits) and len(digits) < len(span)
        check = 1 if mixed and len(span) >= 20 else 2
        gazetteer = 2 if "/" in span or span.replace("-", "").replace("_", "").isalpha() else 0
    context = 1 if FOR[KINDS[kind]].search(before) else 2 if AGAINST.search(before) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = 2 if left.isalnum() or right.isalnum() else 1
    different = len(set(digits if kind in (1, 2, 3) else span))
    variety = 1 if different >= (3 if kind == 1 else 5) else 2
    pattern = 0
    for vote in reversed((1 if strict else 0 if kind == 4 else 2, check, gazetteer, context, edges, variety)):
        pattern = pattern * 3 + vote
    length, apart = min(LENGTHS - 1, (end - start) // 6), min(SEPARATORS - 1, sum(c in " .-()" for c in span) // 2)
    case = 0 if not any(map(str.isalpha, span)) else 2 if span != span.lower() and span != span.upper() else 1
    return pattern, (length * SEPARATORS + apart) * CASES + case


def base_spans(found: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    return [c[:3] for c in found if c[3] and c[0] < BASE]


def pattern_counts(docs: DataFrame) -> DataFrame:
    """kind, pattern, shape and n over all candidates of all texts: at most 5 x 729 x 72 rows."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[int, int, int], int] = {}
        for text in part.column("text").to_pylist():
            for kind, start, end, strict in candidates(text):
                key = (kind, *votes(text, kind, start, end, strict))
                counts[key] = counts.get(key, 0) + 1
        columns = zip(*[(*k, n) for k, n in counts.items()]) if counts else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "pattern", "shape", "n"])

    return map_slices(docs, lambda: run, "kind long, pattern long, shape long, n long").groupBy("kind", "pattern", "shape").agg(F.sum("n").alias("n"))


def digits3(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def em(pattern: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each pattern, share of true spans, and P(vote | truth) as truth by labeler by vote.

    Labelers are independent given the truth; the start is the majority of votes, and the counts of a prior keep every
    vote possible and each labeler better than chance to begin with."""
    v = digits3(pattern)
    balance = (v == 1).sum(axis=1) - (v == 2).sum(axis=1)
    post = 1 / (1 + np.exp(-1.5 * balance.astype(np.float64)))
    prior = np.array([[1.0, 2.0, 0.5], [1.0, 0.5, 2.0]]) * PRIOR  # true, false: abstain, for, against
    for _ in range(rounds):
        weights = np.stack([post * n, (1 - post) * n])
        share = (weights[0].sum() + PRIOR) / (n.sum() + 2 * PRIOR)
        table = np.empty((2, len(LABELERS), 3))
        for truth in (0, 1):
            for j in range(len(LABELERS)):
                own = np.bincount(v[:, j], weights[truth], 3) + prior[truth]
                table[truth, j] = own / own.sum()
        log = np.log(table)
        score = np.array([np.log(share), np.log(1 - share)])[:, None] + np.stack([log[t, np.arange(len(LABELERS))[None, :], v].sum(axis=1) for t in (0, 1)])
        post = 1 / (1 + np.exp(np.clip(score[1] - score[0], -50, 50)))
    return post, float(share), table


def design(pattern: np.ndarray, shape: np.ndarray) -> np.ndarray:
    v = digits3(pattern)
    length, apart, case = shape // (SEPARATORS * CASES), shape // CASES % SEPARATORS, shape % CASES
    marks = [x[:, None] == np.arange(n) for x, n in ((length, LENGTHS), (apart, SEPARATORS), (case, CASES))]
    return np.concatenate([np.ones((len(v), 1)), v == 1, v == 2, *marks], axis=1).astype(np.float64)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted ridge regression of soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(counts: list[tuple[int, int, int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind: the labelers' table and the weights of the span classifier."""
    out = {}
    for kind in sorted({c[0] for c in counts}):
        own = np.array(sorted(c[1:] for c in counts if c[0] == kind), np.int64)
        post, _, table = em(own[:, 0], own[:, 2].astype(np.float64))
        out[kind] = (table, logistic(design(own[:, 0], own[:, 1]), post, own[:, 2].astype(np.float64)))
    return out


def accepted(model: dict[int, tuple[np.ndarray, np.ndarray]], counts: list[tuple[int, int, int, int]], threshold: float = THRESHOLD) -> frozenset[tuple[int, int, int]]:
    """The kinds, patterns and shapes, of those that occur, that the classifier takes for spans."""
    out = set()
    for kind, (_, w) in model.items():
        own = np.array([c[1:3] for c in counts if c[0] == kind], np.int64)
        p = 1 / (1 + np.exp(-np.clip(design(own[:, 0], own[:, 1]) @ w, -30, 30)))
        out |= {(kind, int(a), int(b)) for (a, b), x in zip(own, p) if x >= threshold}
    return frozenset(out)


def all_spans(text: str, taken: frozenset[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and accepted candidates that overlap none before them."""
    found = candidates(text)
    base = base_spans(found)
    starts, ends, out = [], [], list(base)  # what is taken, as disjoint intervals in order
    for start, end in sorted((s, e) for _, s, e in base):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for kind, start, end, strict in found:
        at = bisect_left(starts, end)
        if (strict and kind < BASE) or (at and ends[at - 1] > start):
            continue
        if (kind, *votes(text, kind, start, end, strict)) in taken:
            out.append((kind, start, end))
            starts.insert(at, start)
            ends.insert(at, end)
    out.sort()
    return base, out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


OUT = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, spans and n_spans (of all kinds) of every whole text."""
    source = texts(docs, id_col, text_col)
    counts = [(r.kind, r.pattern, r.shape, r.n) for r in pattern_counts(source).collect()]  # bounded: see there
    taken = accepted(fit(counts), counts, threshold)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            base, spans = all_spans(text, taken)
            rows.append((doc_id, *[sum(k == kind for k, _, _ in base) for kind in range(BASE)], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), len(spans)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT.types)], schema=OUT)

    return map_slices(source, lambda: run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
            at = end
    return "".join([*out, text[at:]])
