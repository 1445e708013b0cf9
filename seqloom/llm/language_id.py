"""Language identification by Bayesian fusion of evidence.

Text: character trigrams, hashed, with one multinomial model for each language, counted over all labelled documents; a
labelled document that is identified itself is scored without its own counts.
Declared language of the markup: its probability given the true language, from soft counts over all pages. Address:
each host has a prior that is smoothed towards that of its address suffix, and that towards the prior of all rows; the
counts are sums of text-only posteriors by host, by suffix and over all rows, without the row's own share. The fused
log score is text (tempered, as trigrams overlap) + declaration + host prior.

All counts are grouped sums with partial aggregation. Host priors are broadcast up to `MAX_BROADCAST_VALUES` numbers; beyond
that they are joined by host and salt, so that one host with many rows spreads over tasks.

Defined results: null or empty text leaves the other evidence; a page without host or declaration has none of it;
declarations are cut to their first subtag and lower-cased; without labelled documents `lang` is null; ties go to the
first language by name; repeated rows give repeated rows and count as often; other columns are left out.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpoint, map_slices

BINS, SMOOTH, TEMPER = 1 << 13, 0.5, 0.3
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 5.0
MAX_BROADCAST_VALUES, SALTS = 400_000, 16
SKIPPED = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "template"))
# Possessive, so that a search takes time in proportion to the page: no part of it can begin where the one before ends.
TAG = re.compile(r"<!--|<![^<>]*+>|<(/?)([A-Za-z][A-Za-z0-9]*+)([^<>]*+)>")
LANG = re.compile(r"""(?:xml:)?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)
META = re.compile(r"""content-language["']?\s+content\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)


def page_parts(html: str) -> tuple[str, str | None]:
    """The visible text, without scripts, styles and navigation, and the declared language; one pass over the page."""
    out, at, skip, declared = [], 0, None, None
    pos = 0
    while m := TAG.search(html, pos):
        pos = m.end()
        if m[0] == "<!--":
            if skip is None:
                out.append(html[at : m.start()])
            end = html.find("-->", pos)
            pos = len(html) if end < 0 else end + 3
            at = pos
            continue
        if m[2] is None:  # a declaration
            if skip is None:
                out.append(html[at : m.start()])
                at = pos
            continue
        name = m[2].lower()
        if skip is not None:
            if m[1] and name == skip:
                skip, at = None, pos
            continue
        out.append(html[at : m.start()])
        at = pos
        if declared is None and not m[1] and name in ("html", "body", "meta") and (d := (META if name == "meta" else LANG).search(m[3])):
            declared = d[1].lower()
        if not m[1] and name in SKIPPED:
            skip = name
    if skip is None:
        out.append(html[at:])
    return unescape(" ".join(x for x in out if x.strip())), declared


def host_of(url: str | None) -> tuple[str | None, str | None]:
    """Host (lower case, without www., user and port) and suffix (its last label) of an address."""
    rest = (url or "").partition("://")[2] or (url or "").removeprefix("//")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].strip().lower().removeprefix("www.")
    return (host, host.rpartition(".")[2]) if host else (None, None)


def trigrams(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams of the lower-cased texts, one space around each, and how many each text has."""
    padded = [f" {t.lower()} " for t in values]
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    mixed = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bins = (mixed >> np.uint32(19)).astype(np.int64)
    sizes = np.array([len(p) for p in padded], np.int64)
    ends = np.cumsum(sizes)
    keep = np.ones(len(bins), bool)
    for back in (1, 2):
        cut = ends[:-1] - back
        keep[cut[cut < len(bins)]] = False
    return bins[keep], np.maximum(sizes - 2, 0)


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Language -> counts by bin, over all labelled rows: a table of as many rows as languages times BINS."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from seqloom.llm.common import slices

        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs, values = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in set(langs):
                    own = np.bincount(trigrams([t for t, x in zip(values, langs) if x == lang])[0], minlength=BINS)
                    held[lang] = held.get(lang, 0) + own
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], names=["lang", "bin", "n"])

    out: dict[str, np.ndarray] = {}
    for r in labelled.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.lang, np.zeros(BINS))[r.bin] = r.n
    return dict(sorted(out.items()))


class TextModel:
    """Counts by language and bin, and their logarithms."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = list(counts)
        self.counts = np.stack([c + SMOOTH for c in counts.values()])
        self.totals = self.counts.sum(axis=1)
        self.log = np.log(self.counts / self.totals[:, None])

    def log_likelihoods(self, values: list[str], own: list[str | None] | None = None) -> np.ndarray:
        """Tempered log likelihood by text and language, relative to each text's best. A text whose own language is
        given is among those counted, and is left out of that language's counts."""
        bins, sizes = trigrams(values)
        owner = np.repeat(np.arange(len(values)), sizes)
        out = np.stack([np.bincount(owner, row[bins], len(values)) for row in self.log], axis=1).astype(np.float64)
        ends = np.cumsum(sizes)
        for i, lang in enumerate(own or ()):
            if lang in self.languages:
                at, n = np.unique(bins[ends[i] - sizes[i] : ends[i]], return_counts=True)
                row = self.languages.index(lang)
                out[i, row] = n @ np.log(self.counts[row, at] - n) - sizes[i] * np.log(self.totals[row] - sizes[i])
        out *= TEMPER
        return out - out.max(axis=1, keepdims=True)


def evidence(df: DataFrame, model: TextModel, text_col: str, url_col: str | None, host_col: str | None, key: str, own_col: str | None = None) -> DataFrame:
    """The key, host, suffix, declared and ll of each row; html pages if there is an address column. `own_col` has the
    language under which the row was counted."""
    columns = [F.col(key).cast("long").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    columns.append(F.col(url_col or host_col).cast("string").alias("address"))
    columns.append((F.col(own_col) if own_col else F.lit(None)).cast("string").alias("own"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        values, declared = part.column("text").to_pylist(), [None] * part.num_rows
        hosts = [(a, None) for a in part.column("address").to_pylist()]
        if url_col:
            parts = [page_parts(h) for h in values]
            values, declared = [p[0] for p in parts], [p[1] for p in parts]
            hosts = [host_of(a) for a, _ in hosts]
        ll = model.log_likelihoods(values, part.column("own").to_pylist())
        arrays = [part.column("key"), *[pa.array([h[i] for h in hosts], pa.string()) for i in (0, 1)], pa.array(declared, pa.string()), pa.array(list(ll), pa.list_(pa.float64())), pa.array(list(softmax(ll)), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "host", "suffix", "declared", "ll", "t"])

    return map_slices(df.select(*columns), lambda: run, "key long, host string, suffix string, declared string, ll array<double>, t array<double>")


def softmax(scores: np.ndarray) -> np.ndarray:
    parts = np.exp(scores - scores.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """The rows of `evidence` as key, host, declared, lang, p (of it) and text_lang (from the text alone).

    Sums of posteriors by key are grouped aggregations, one sum a language; the fusion of a row is vector arithmetic."""
    n = len(languages)
    rows = checkpoint(rows)
    sums = F.array(*[F.coalesce(F.sum(F.col("t")[i]), F.lit(0.0)) for i in range(n)])
    total = np.array(rows.agg(sums.alias("t")).first().t)
    said = rows.where("declared is not null").agg(F.count_distinct("declared").alias("words"), sums.alias("t")).first()
    words, declaring = max(said.words, 1), np.array(said.t)
    joined = rows
    for key in ("host", "suffix", "declared"):
        joined = _by_key(joined, rows.where(f"{key} is not null").groupBy(F.col(key).alias(f"{key}_key")).agg(sums.alias(f"{key}_sum")), key, f"{key}_key", n)

    def rest(sums: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and their total without the row's own share."""
        return np.maximum(sums - own, 0), np.maximum(sums.sum(axis=1, keepdims=True) - 1, 0)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: np.array([x if x is not None else [0.0] * n for x in batch.column(c).to_pylist()])  # noqa: E731, B023
            ll, own = column("ll"), column("t")
            counts, others = rest(np.tile(total, (len(ll), 1)), own)
            prior = (counts + 1.0) / (others + n)
            for key, weight in (("suffix", SUFFIX_WEIGHT), ("host", HOST_WEIGHT)):
                counts, others = rest(column(f"{key}_sum"), own)
                prior = (counts + weight * prior) / (others + weight)
            counts, _ = rest(column("declared_sum"), own)
            declared = (counts + DECLARED_WEIGHT / words) / (np.maximum(declaring - own, 0) + DECLARED_WEIGHT)
            has = batch.column("declared").is_valid().to_numpy(zero_copy_only=False)
            post = softmax(ll + np.log(prior) + np.where(has[:, None], np.log(declared), 0.0))
            names = lambda at: pa.array([languages[i] for i in at], pa.string())
            # The first language wins ties: argmax.
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), batch.column("declared"), names(post.argmax(axis=1)), pa.array(post.max(axis=1)), names(own.argmax(axis=1))], names=["key", "host", "declared", "lang", "p", "text_lang"])

    return joined.select("key", "host", "declared", "ll", "t", "host_sum", "suffix_sum", "declared_sum").mapInArrow(run, "key long, host string, declared string, lang string, p double, text_lang string")


def _by_key(rows: DataFrame, side: DataFrame, key: str, side_key: str, width: int) -> DataFrame:
    """Left join with a table of one row a key: broadcast while small, else by key and salt."""
    side = checkpoint(side)
    if side.count() * width <= MAX_BROADCAST_VALUES:
        return rows.join(F.broadcast(side), F.col(key) == F.col(side_key), "left")
    salted = side.withColumn("side_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key", "ll"), F.lit(SALTS)).cast("int")).join(salted, (F.col(key) == F.col(side_key)) & (F.col("salt") == F.col("side_salt")), "left").drop("salt", "side_salt")


def identify(pages: DataFrame, docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id or doc_id, host, declared, lang, p and text_lang of every page and document.

    Pages give all kinds of evidence; documents their text, and their source as the host. Without a table `labelled` the
    documents are those counted, and each is scored without its own counts."""
    counts = trigram_counts(docs if labelled is None else labelled)
    if not counts:
        empty = pages.selectExpr("cast(page_id as bigint) as page_id", "cast(null as bigint) as doc_id").unionByName(docs.selectExpr("cast(null as bigint) as page_id", "cast(doc_id as bigint) as doc_id"))
        return empty.selectExpr("*", "cast(null as string) as host", "cast(null as string) as declared", "cast(null as string) as lang", "cast(null as double) as p", "cast(null as string) as text_lang")
    model = TextModel(counts)
    of_pages = fuse(evidence(pages, model, "html", "url", None, "page_id"), model.languages)
    of_docs = fuse(evidence(docs, model, "text", None, "source", "doc_id", "lang" if labelled is None else None), model.languages)
    shown = ("host", "declared", "lang", "p", "text_lang")
    return of_pages.select(F.col("key").alias("page_id"), F.lit(None).cast("long").alias("doc_id"), *shown).unionByName(of_docs.select(F.lit(None).cast("long").alias("page_id"), F.col("key").alias("doc_id"), *shown))
