"""Damage assessment of whole reads: batches of sequences through arrays, where fits iterate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import damage as fn

_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
A, C, G, T = range(4)
#: Reads below this many bases have no change points, and no assessment.
SHORT = 15
_ERFC = np.frompyfunc(math.erfc, 1, 1)


def with_segments(reads: DataFrame, window: int = 5) -> DataFrame:
    """The reads with n5 (bases of a segment), five and three, as columns of their own so that they are computed once."""
    sized = reads.withColumn("n5", fn.segment_length(F.col("seq"), window))
    return sized.withColumn("five", fn.five(F.col("seq"), F.col("n5"))).withColumn("three", fn.three(F.col("seq"), F.col("n5")))


def fast_damage(reads: DataFrame, window: int = 5) -> DataFrame:
    """The reads with damage5, damage3 and combined of the fast path."""
    d5, d3 = fn.fast_ends(F.col("five"), F.col("three"))
    ends = with_segments(reads, window).withColumn("damage5", d5).withColumn("damage3", d3)
    return ends.withColumn("combined", fn.combined(F.col("damage5"), F.col("damage3"), F.length("seq")))


def change_points(reads: DataFrame, window: int = 5) -> DataFrame:
    """The reads with position (null: none), stat, p-value and score of the change point of both ends (columns end in 5 or
    3). Below 15 bases there is none, and the score is 0."""

    def compute(frame):
        seqs = frame["seq"].tolist()
        length = np.array([len(s) for s in seqs], np.int64)
        n = segment_sizes(length, window)
        out = {}
        for end, letter in ((5, T), (3, A)):
            place, stat, pvalue, score = change_arrays(segments(seqs, n, end)[0], n, letter)
            out |= {f"position{end}": pd.array(np.where(place < 0, 0, place), "Int32"), f"stat{end}": stat, f"pvalue{end}": pvalue, f"score{end}": np.where(length < SHORT, 0.0, score)}
            out[f"position{end}"][place < 0] = pd.NA
        return out

    columns = {f"{c}{end}": t for end in (5, 3) for c, t in (("position", "int"), ("stat", "double"), ("pvalue", "double"), ("score", "double"))}
    return _mapped(reads, reads.columns, compute, columns)


def segment_sizes(length: np.ndarray, window: int) -> np.ndarray:
    return np.minimum(np.minimum(3 * window, length // 4), length // 2)


def segments(seqs: list[str], n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Base codes of the 5' or 3' segments of n bases, reads by places, and which places are within."""
    width = max(int(n.max(initial=0)), 1)
    out = np.full((len(seqs), width), 4, np.int8)
    for i, (s, k) in enumerate(zip(seqs, n.tolist())):
        if k:
            part = s[:k] if end == 5 else s[len(s) - k :]
            out[i, :k] = _CODE[np.frombuffer(part.encode("ascii", "replace"), np.uint8)]
    return out, np.arange(width)[None, :] < n[:, None]


def site_probabilities(code: np.ndarray, inside: np.ndarray, end: int) -> np.ndarray:
    """Probability by place, 0 where there is no site."""
    place = np.arange(code.shape[1])[None, :]
    if end == 5:
        after = np.concatenate([code[:, 1:], np.full((len(code), 1), 4, np.int8)], axis=1)
        thymine = np.select([after == G, place < 3, place < 6], [0.85, 0.75, 0.65], 0.5)
        out = np.select([code == T, code == C], [thymine, 0.1], 0.0)
    else:
        before = np.concatenate([np.full((len(code), 1), 4, np.int8), code[:, :-1]], axis=1)
        away = inside.sum(axis=1)[:, None] - place - 1
        adenine = np.select([before == C, away == 0, away < 3, away < 6], [0.8, 0.75, 0.65, 0.55], 0.45)
        guanine = np.select([before == C, away < 3], [0.18, 0.14], 0.07)
        out = np.select([code == A, code == G], [adenine, guanine], 0.0)
    return np.where(inside, out, 0.0)


def fit_quality(prob: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Amplitude and quality of exp(-rate place) by read; zeros without sites."""
    site = prob > 0
    n = site.sum(axis=1)
    pred = np.where(site, np.exp(-rate[:, None] * np.arange(prob.shape[1])), 0.0)
    total = prob.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        amplitude = total / pred.sum(axis=1)
        quality = np.maximum(0.0, 1 - np.sqrt(((pred - prob) ** 2).sum(axis=1) / n) / (total / n))
    good = (n > 0) & (rate > 0)
    return np.where(good, amplitude, 0.0), np.where(good, quality, 0.0)


def ternary_fit(prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rate in [0.01, 2] by eight steps of ternary search: rate, amplitude, quality; zeros below three sites."""
    rows = len(prob)
    low, high = np.full(rows, 0.01), np.full(rows, 2.0)
    best = [np.zeros(rows) for _ in range(3)]  # rate, amplitude, quality
    for _ in range(8):
        m1, m2 = low + (high - low) / 3, high - (high - low) / 3
        (a1, f1), (a2, f2) = fit_quality(prob, m1), fit_quality(prob, m2)
        left = f1 > f2
        rate, amplitude, quality = np.where(left, m1, m2), np.where(left, a1, a2), np.where(left, f1, f2)
        better = quality > best[2]
        best = [np.where(better, new, old) for new, old in zip((rate, amplitude, quality), best)]
        high, low = np.where(left, m2, high), np.where(left, low, m1)
    few = (prob > 0).sum(axis=1) < 3
    return tuple(np.where(few, 0.0, b) for b in best)


def hill_fit(prob: np.ndarray) -> np.ndarray:
    """Rate in [0.05, 2.5] by halving towards the better neighbour, until 0.01 wide or at a local maximum."""
    rows = len(prob)
    low, high, out, done = np.full(rows, 0.05), np.full(rows, 2.5), np.zeros(rows), np.zeros(rows, bool)
    quality = lambda rate: fit_quality(prob, rate)[1]
    while not (done | (high - low <= 0.01)).all():
        go = ~done & (high - low > 0.01)
        mid = (low + high) / 2
        at, left, right = quality(mid), quality(mid - 0.05), quality(mid + 0.05)
        down, up = go & (left > at), go & (left <= at) & (right > at)
        stop = go & ~down & ~up
        high, low = np.where(down, mid, high), np.where(up, mid, low)
        out, done = np.where(stop, mid, out), done | stop
    return np.where(done, out, (low + high) / 2)


def log_likelihood_ratio(prob5, rate5, amp5, prob3, rate3, amp3) -> np.ndarray:
    """Model against a flat 0.25, over the sites of both ends; -5 where a model probability leaves (0, 1)."""
    out, wrong, sites = np.zeros(len(prob5)), np.zeros(len(prob5), bool), np.zeros(len(prob5))
    for prob, rate, amp in ((prob5, rate5, amp5), (prob3, rate3, amp3)):
        site = prob > 0
        model = amp[:, None] * np.exp(-rate[:, None] * np.arange(prob.shape[1]))
        wrong |= (site & ((model <= 0) | (model >= 1))).any(axis=1)
        safe = np.clip(model, 1e-300, 1 - 1e-16)
        term = prob * np.log(safe) + (1 - prob) * np.log1p(-safe) - prob * np.log(0.25) - (1 - prob) * np.log(0.75)
        out += np.where(site, term, 0.0).sum(axis=1)
        sites += site.sum(axis=1)
    return np.where(sites == 0, 0.0, np.where(wrong, -5.0, out))


def cuts(low: int, high: int) -> list[int]:
    """The places low to high - 1 in the order in which a better cut replaces another: ranges of more than 16 places begin with
    their middle, then come the places before it and those from it on."""
    if high <= low + 1:
        return []
    if high - low <= 16:
        return list(range(low, high))
    mid = (low + high) // 2
    return [mid, *cuts(low, mid), *cuts(mid, high)]


def change_arrays(code: np.ndarray, n: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position (-1: none), statistic, p-value and score of each segment's change point."""
    width = code.shape[1]
    hits = np.concatenate([np.zeros((len(code), 1)), np.cumsum(code == base, axis=1)], axis=1)
    total = np.take_along_axis(hits, n[:, None], axis=1)
    best, place = np.zeros(len(code)), np.full(len(code), -1)
    # Up to 20 bases every place is tried in order; beyond that the order depends on the length.
    for size in [None, *np.unique(n[n > 20]).tolist()]:
        rows = np.flatnonzero(n <= 20 if size is None else n == size)
        for k in range(3, 18) if size is None else cuts(2, size - 2):
            rest = n[rows] - k
            ok = (rest >= 3) & (k >= 3)
            if not ok.any():
                continue
            safe = np.where(ok, rest, 1)
            stat = np.abs(hits[rows, k] / k - (total[rows, 0] - hits[rows, k]) / safe) * np.sqrt(k * safe / (k + safe))
            better = ok & (stat > best[rows])
            best[rows[better]], place[rows[better]] = stat[better], k
    start = np.minimum(6, n // 2)
    beyond = n - start
    rate = np.where(beyond > 0, (total[:, 0] - np.take_along_axis(hits, start[:, None], axis=1)[:, 0]) / np.maximum(beyond, 1), 0.25)
    with np.errstate(divide="ignore"):
        z = np.where(rate > 0, best / np.sqrt(np.where(rate > 0, rate, 1)) / math.sqrt(2), np.inf)
    pvalue = np.where(place < 0, 1.0, 0.5 * _ERFC(z).astype(float))
    score = np.full(len(code), 0.1)
    k = np.maximum(place, 1)
    ratios = []
    for letter in (T, A):
        own = np.concatenate([np.zeros((len(code), 1)), np.cumsum(code == letter, axis=1)], axis=1)
        before = np.take_along_axis(own, np.minimum(k, width)[:, None], axis=1)[:, 0]
        after = (np.take_along_axis(own, n[:, None], axis=1)[:, 0] - before) / np.maximum(n - k, 1)
        ratios.append(np.where(after > 0, before / k / np.where(after > 0, after, 1), 1.0))
    s = ((ratios[0] - 1) + (ratios[1] - 1)) / 2
    return place, best, pvalue, np.where(place < 0, score, 0.2 + 0.6 * np.minimum(s, 2.0) / 2)


def length_factors(length: np.ndarray) -> np.ndarray:
    return np.select([length < 50, length < 100, length < 150, length < 200], [0.9, 0.7, 0.5, 0.3], 0.1)


def fragment_factors(length: np.ndarray) -> np.ndarray:
    return np.select([length <= 50, length <= 100, length <= 150, length <= 200], [0.9, 0.7, 0.5, 0.3], 0.1)


def balance(d5: np.ndarray, d3: np.ndarray) -> np.ndarray:
    return np.where((d5 > 0.2) & (d3 > 0.2), 1 - np.abs(d5 - d3) / np.maximum(d5 + d3, 0.1), 0.5)


def assess(seqs: list[str], window: int = 5) -> dict[str, np.ndarray]:
    """Damage of each read: below 15 bases 0.1; from 100 bases, or with few T and C or A and G at an end, the fast path;
    otherwise change points and decay fits. `path` names it; the details are NaN where they are not computed."""
    length = np.array([len(s) for s in seqs], np.int64)
    n = segment_sizes(length, window)
    (c5, in5), (c3, in3) = segments(seqs, n, 5), segments(seqs, n, 3)
    t5, c5n, a3, g3 = (c5 == T).sum(axis=1), (c5 == C).sum(axis=1), (c3 == A).sum(axis=1), (c3 == G).sum(axis=1)
    short, fast = length < SHORT, (length >= 100) | (t5 + c5n < 5) | (a3 + g3 < 5)
    share = lambda x, y: np.where(y > 0, np.minimum(x / np.maximum(x + y, 1), 0.8), 0.2)
    weight = lambda x: np.where((n >= 3) & (x > 0), 1.0, 0.2)
    f5, f3 = 0.7 * share(t5, c5n) + 0.3 * weight(t5), 0.7 * share(a3, g3) + 0.3 * weight(a3)
    p5, p3 = site_probabilities(c5, in5, 5), site_probabilities(c3, in3, 3)
    _, _, v5, s5 = change_arrays(c5, n, T)
    _, _, v3, s3 = change_arrays(c3, n, A)
    (l5, _, q5), (l3, _, q3) = ternary_fit(p5), ternary_fit(p3)
    d5, d3 = np.where(fast, f5, 0.6 * s5 + 0.4 * q5), np.where(fast, f3, 0.6 * s3 + 0.4 * q3)
    whole = 0.4 * (d5 + d3) / 2 + 0.35 * length_factors(length) + 0.25 * balance(d5, d3)
    detail = lambda x: np.where(short | fast, np.nan, x)
    tenth = lambda x: np.where(short, 0.1, x)
    return {
        "damage5": tenth(d5), "damage3": tenth(d3), "combined": tenth(whole), "path": np.where(short, "short", np.where(fast, "fast", "accurate")),
        "pvalue5": detail(v5), "pvalue3": detail(v3), "score5": detail(s5), "score3": detail(s3), "lambda5": detail(l5), "lambda3": detail(l3),
        "fit5": detail(q5), "fit3": detail(q3), "fit_excess": detail(np.maximum(q5 - 0.5, 0) + np.maximum(q3 - 0.5, 0)),
    }


def decay_model(seqs: list[str], n: np.ndarray) -> dict[str, np.ndarray]:
    """The model of both ends by hill climbing: rates, fits and the log-likelihood ratio; zeros below ten bases."""
    length = np.array([len(s) for s in seqs], np.int64)
    (c5, in5), (c3, in3) = segments(seqs, n, 5), segments(seqs, n, 3)
    p5, p3 = site_probabilities(c5, in5, 5), site_probabilities(c3, in3, 3)
    l5, l3 = hill_fit(p5), hill_fit(p3)
    (a5, q5), (a3, q3) = fit_quality(p5, l5), fit_quality(p3, l3)
    llr = log_likelihood_ratio(p5, l5, a5, p3, l3, a3)
    zero = lambda x: np.where(length < 10, 0.0, x)
    return {"lambda5": zero(l5), "lambda3": zero(l3), "fit5": zero(q5), "fit3": zero(q3), "llr": zero(llr)}


def ensemble(seqs: list[str], support: np.ndarray, ratio: np.ndarray, mismatches: np.ndarray, overlap: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Change points, decay model and mate evidence combined with weights that add up to 1."""
    length = np.array([len(s) for s in seqs], np.int64)
    n = segment_sizes(length, window)
    (c5, _), (c3, _) = segments(seqs, n, 5), segments(seqs, n, 3)
    _, _, v5, s5 = change_arrays(c5, n, T)
    _, _, v3, s3 = change_arrays(c3, n, A)
    s5, s3 = (np.where(length < SHORT, 0.0, s) for s in (s5, s3))  # the p-values are 1 there
    model = decay_model(seqs, n)
    w_cp = np.select([length < 50, length < 100], [0.5, 0.4], 0.3) * np.where((v5 < 0.05) | (v3 < 0.05), 1.0, 0.5)
    w_model = np.select([(model["llr"] > 2) & (model["fit5"] > 0.6) & (model["fit3"] > 0.4), model["llr"] > 0.5], [0.5, 0.4], 0.3)
    w_pair = np.where(overlap > 20, np.select([(ratio > 0.7) & (mismatches > 3), ratio > 0.5], [0.5, 0.4], 0.2), 0.0)
    total = w_cp + w_model + w_pair
    w_cp, w_model, w_pair = w_cp / total, w_model / total, w_pair / total
    p5 = w_cp * s5 + w_model * (0.1 + 0.8 * model["fit5"]) + w_pair * support
    p3 = w_cp * s3 + w_model * (0.1 + 0.8 * model["fit3"]) + w_pair * support
    least = np.minimum(v5, v3)
    model_support = np.where(model["llr"] > 0, model["llr"] / 10, 0.0)
    cp_support = np.where(least < 0.1, 1 - np.minimum(10 * least, 1.0), 0.0)
    authenticity = 0.35 * (p5 + p3) / 2 + 0.25 * (model_support + cp_support) / 2 + 0.25 * fragment_factors(length) + 0.15 * balance(p5, p3)
    return {"prob5": p5, "prob3": p3, "authenticity": authenticity, "w_change": w_cp, "w_model": w_model, "w_pair": w_pair}


def _mapped(reads: DataFrame, kept: list[str], compute, columns: dict[str, str]) -> DataFrame:
    """mapInPandas with the kept columns beside computed ones."""
    types = {f.name: f.dataType.simpleString() for f in reads.schema}
    schema = ", ".join([f"{c} {types[c]}" for c in kept] + [f"{c} {t}" for c, t in columns.items()])

    def run(frames):
        for frame in frames:
            if len(frame):
                yield pd.concat([frame[kept].reset_index(drop=True), pd.DataFrame({k: v for k, v in compute(frame).items() if k in columns})], axis=1)

    return reads.mapInPandas(run, schema)


ASSESSED = {c: "double" for c in ("damage5", "damage3", "combined", "pvalue5", "pvalue3", "score5", "score3", "lambda5", "lambda3", "fit5", "fit3", "fit_excess")} | {"path": "string"}


def assess_damage(reads: DataFrame, window: int = 5) -> DataFrame:
    """read_idx, the three damage scores, the path taken and its details (NaN on the other paths)."""
    return _mapped(reads.select("read_idx", "seq"), ["read_idx"], lambda f: assess(f["seq"].tolist(), window), ASSESSED)


def measured(reads: DataFrame, window: int = 5, columns: tuple[str, ...] = ("damage5", "damage3", "combined")) -> DataFrame:
    """The reads, all columns kept, with damage scores beside them; nothing is joined."""
    return _mapped(reads, reads.columns, lambda f: assess(f["seq"].tolist(), window), {c: ASSESSED[c] for c in columns})


def fit_decay(reads: DataFrame, window: int = 5) -> DataFrame:
    """read_idx with the ternary fits (rate, fit) of both ends' segments and the hill-climbed model with its ratio."""
    columns = {c: "double" for c in ("ternary5", "ternary3", "ternary_fit5", "ternary_fit3", "lambda5", "lambda3", "fit5", "fit3", "llr")}

    def compute(frame):
        seqs = frame["seq"].tolist()
        length = np.array([len(s) for s in seqs], np.int64)
        n = segment_sizes(length, window)
        out = decay_model(seqs, n)
        for end in (5, 3):
            rate, _, quality = ternary_fit(site_probabilities(*segments(seqs, n, end), end))
            out |= {f"ternary{end}": rate, f"ternary_fit{end}": quality}
        return out

    return _mapped(reads.select("read_idx", "seq"), ["read_idx"], compute, columns)


def ensemble_damage(reads: DataFrame, window: int = 5) -> DataFrame:
    """read_idx (id for reads without it) and the ensemble's probabilities and weights; mate evidence (support, ratio,
    mismatches, overlap_size) is taken from columns of those names (see pairs.with_evidence) where the reads have them."""
    key = "read_idx" if "read_idx" in reads.columns else "id"
    default = {"support": 0.5, "ratio": 0.0, "mismatches": 0.0, "overlap_size": 0.0}
    cols: list[Column] = [F.coalesce(F.col(c).cast("double"), F.lit(d)).alias(c) if c in reads.columns else F.lit(d).alias(c) for c, d in default.items()]
    columns = {c: "double" for c in ("prob5", "prob3", "authenticity", "w_change", "w_model", "w_pair")}
    return _mapped(reads.select(key, "seq", *cols), [key], lambda f: ensemble(f["seq"].tolist(), *(f[c].to_numpy() for c in default), window), columns)
