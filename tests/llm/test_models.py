"""Quality classifier and language identification: held-out accuracy and defined results."""

import random
import time
import zlib

import numpy as np
import pytest

from seqloom.llm import language_id, quality_mil

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_mil.quality_scores(docs, quality_mil.fit(docs, labels)).withColumn("held_out", quality_mil.held_out())
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [(r.score >= quality_mil.THRESHOLD) == bool(r.quality) for r in rows if r.held_out]
    assert len(own) > 30 and np.mean(own) > 0.95
    good = [r.score for r in rows if r.held_out and r.quality]
    assert np.mean(np.array(good) < quality_mil.THRESHOLD) < 0.03


def test_gradients():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 6, 400)
    y = (rng.random(400) < 0.5).astype(np.float32)
    x = rng.standard_normal((counts.sum(), quality_mil.FEATURES)).astype(np.float32)
    begin = np.cumsum(counts) - counts
    x[begin + rng.integers(0, counts), 3] += np.where(y > 0, 6, -6)  # one passage of each document tells
    model = quality_mil.Model.train(x, counts, y)
    assert ((model.logits(x, counts) > 0) == (y > 0)).mean() > 0.95


def plain_passages(text):
    """The features of a text's passages, one character after the other."""
    out = []
    for at in range(0, max(len(text), 1), quality_mil.PASSAGE):
        part = text[at : at + quality_mil.PASSAGE]
        kinds = [quality_mil.CLASS[ord(c)] for c in part]
        share = [kinds.count(k) / max(len(part), 1) for k in range(quality_mil.CLASSES)]
        bins = [((ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77) % 2**32) >> 24 for a, b in zip(part, part[1:])]
        profile = [bins.count(i) for i in range(quality_mil.BINS)]
        pairs = max(len(bins), 1)
        width = quality_mil.BINS // quality_mil.FOLDED
        folded = [(sum(profile[i : i + width]) / pairs) ** 0.5 for i in range(0, quality_mil.BINS, width)]
        spaces = sum(kinds.count(k) for k in (3, 4))
        out.append([*share, np.log1p(len(part)), sum(p > 0 for p in profile) / min(pairs, quality_mil.BINS), max(profile) / pairs, len(part) / (spaces + 1), *folded])
    return np.array(out)


def test_passages_and_scores_equal_plain_ones(spark):
    rng = random.Random(4)
    values = ["", "a", "Ab 1.\n", "漢字 かな 글자 " * 70, "x" * 400, "y" * 401, "#*$ " * 301] + ["".join(rng.choice("abC9 .,\n!|#é漢") for _ in range(rng.randint(0, 1700))) for _ in range(20)]
    x, counts = quality_mil.passages(values)
    plain = [plain_passages(v) for v in values]
    assert counts.tolist() == [len(p) for p in plain]
    np.testing.assert_allclose(x, np.concatenate(plain), rtol=2e-5, atol=1e-6)
    assert x[counts[:3].sum(), 0] > 0.5  # letters of every script are letters
    model = quality_mil.Model.train(*_toy())
    w = {k: np.asarray(v, np.float64) for k, v in model.w.items()}
    for text, own in zip(values, plain):
        h = [np.tanh(np.clip((p - w["mean"]) / w["std"], -8, 8) @ w["E"] + w["e"]) for p in own]
        score = np.array([(np.tanh(p @ w["V"]) / (1 + np.exp(-(p @ w["U"])))) @ w["a"] for p in h])
        share = np.exp(score - score.max())
        out = sum(a * p for a, p in zip(share / share.sum(), h)) @ w["c"] + w["d"]
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-out)), abs=2e-4)
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_mil.quality_scores(docs, model).collect()}
    assert got == {i: pytest.approx(model.scores([t])[0], abs=1e-5) for i, t in enumerate(values)}


def test_training_reads_whole_texts_within_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(quality_mil, "SAMPLE_DOCS", 30)
    monkeypatch.setattr(quality_mil, "SAMPLE_PASSAGES", 400)
    rows = [(i, "w " * (200 * (i % 7)) + str(i)) for i in range(60)] + [(i, "another text") for i in range(5)] * 3 + [(61, "long " * 100_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(62)], "doc_id long, quality int")
    x, counts, y = quality_mil.sample(docs, labels)
    assert 0 < len(counts) <= 30 and counts.sum() == len(x) <= 400 and len(y) == len(counts)
    whole = {len(plain_passages(t)) for _, t in rows if len(t) < 10_000}
    assert set(counts.tolist()) <= whole and counts.max() > 1


def test_scores_at_the_threshold_stay(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    model = quality_mil.Model.train(*_toy())
    score = float(model.scores(["a"])[0])
    assert quality_mil.keep_good(docs, model, threshold=score).count() == 2
    assert quality_mil.keep_good(docs, model, threshold=np.nextafter(score, 2)).count() == 0


def test_whole_texts_count():
    model = quality_mil.Model.train(*_toy())
    good, bad = "The cat sat on the mat and slept. " * 300, "THE!! CAT!! SAT!! ON!! MAT!! " * 400
    assert model.scores([good])[0] > 0.5 > model.scores([bad])[0]
    assert model.scores([good + bad * 5])[0] < model.scores([good])[0]


def _toy():
    rng = random.Random(3)
    words = "the cat sat on mat and dog ran home".split()
    texts = [" ".join(rng.choice(words) for _ in range(80)).capitalize() + "." if i % 2 else " ".join(rng.choice(words).upper() + "!!" for _ in range(80)) for i in range(200)]
    x, counts = quality_mil.passages(texts)
    return x, counts, np.array([i % 2 for i in range(200)], np.float32)


def test_quality_edges(spark):
    rows = [(1, None, 7.0), (2, "", 7.0), (None, "x", 7.0), (3, "A fine text. " * 9000, 7.0), (2, "", 7.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_mil.fit(df, labels)
    got = quality_mil.quality_scores(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    nothing = quality_mil.fit(df, labels.limit(0))
    assert nothing is None and {r.score for r in quality_mil.quality_scores(df, nothing).collect()} == {0.5}
    assert quality_mil.keep_good(df, nothing).columns == df.columns and quality_mil.keep_good(df, nothing).count() == 5
    assert quality_mil.quality_scores(df.limit(0), model).count() == 0


def test_page_parts():
    html = '<!DOCTYPE html><HTML lang="de-AT"><head><script>if (a<b) "</p>";</script><style>p{}</style></head><!-- x --><nav>menu</nav><p>Gr&uuml;n <b>und</b></p><script>open'
    text, declared = language_id.page_parts(html)
    assert declared == "de" and text.split() == ["Grün", "und"]
    assert language_id.page_parts("") == ("", None) and language_id.page_parts("<<<<" * 5000)[1] is None
    assert language_id.page_parts("<meta http-equiv='Content-Language' content='fr'>a")[1] == "fr"
    assert language_id.host_of("https://u:p@WWW.Example.ORG:80/a?b=http://x") == ("example.org", "org") and language_id.host_of(None) == (None, None)


def brute(rows, languages):
    """rows: (host, suffix, declared, ll); the fused posterior, one row after the other."""
    post = [np.exp(r[3] - np.max(r[3])) for r in rows]
    post = [p / p.sum() for p in post]
    words = {r[2] for r in rows if r[2] is not None}
    out = []
    for i, (host, suffix, declared, ll) in enumerate(rows):
        others = lambda keep: [p for j, p in enumerate(post) if j != i and keep(rows[j])]  # noqa: B023, E731
        total = lambda ps: np.sum(ps, axis=0) if ps else np.zeros(len(languages))
        every, same_s, same_h = others(lambda r: True), others(lambda r: suffix is not None and r[1] == suffix), others(lambda r: host is not None and r[0] == host)  # noqa: B023
        prior = (total(every) + 1) / (len(every) + len(languages))
        prior = (total(same_s) + language_id.SUFFIX_WEIGHT * prior) / (len(same_s) + language_id.SUFFIX_WEIGHT)
        prior = (total(same_h) + language_id.HOST_WEIGHT * prior) / (len(same_h) + language_id.HOST_WEIGHT)
        score = np.array(ll) + np.log(prior)
        if declared is not None:
            said, any_ = others(lambda r: r[2] == declared), others(lambda r: r[2] is not None)  # noqa: B023
            score += np.log((total(said) + language_id.DECLARED_WEIGHT / len(words)) / (total(any_) + language_id.DECLARED_WEIGHT))
        p = np.exp(score - score.max())
        out.append((languages[int(p.argmax())], p.max() / p.sum()))
    return out


@pytest.mark.parametrize("limit", [400_000, 0])
def test_fusion(spark, monkeypatch, limit):
    monkeypatch.setattr(language_id, "MAX_BROADCAST_VALUES", limit)
    rng = random.Random(4)
    rows = []
    for i in range(60):
        host = rng.choice(["a.de", "b.de", "c.com", None])
        rows.append((host, host and host[-2:], rng.choice(["de", "en", None]), [rng.uniform(-3, 0), 0.0 if i % 3 else -1.0]))
    post = [[float(x) for x in language_id.softmax(np.array([r[3]]))[0]] for r in rows]
    df = spark.createDataFrame([(i, *r, t) for i, (r, t) in enumerate(zip(rows, post))], "key long, host string, suffix string, declared string, ll array<double>, t array<double>")
    got = {r.key: (r.lang, r.p) for r in language_id.fuse(df, ["de", "en"]).collect()}
    for i, (lang, p) in enumerate(brute(rows, ["de", "en"])):
        assert got[i][0] == lang and got[i][1] == pytest.approx(p)


def test_languages(spark):
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    got = language_id.identify(pages, docs)
    rows = got.where("doc_id is not null").join(docs.select("doc_id", docs.lang.alias("truth")), "doc_id").collect()
    assert np.mean([r.lang == r.truth for r in rows]) > 0.98
    assert got.where("page_id is not null").count() == pages.count()
    odd = spark.createDataFrame([(1, None, None, 3), (2, "http://x.de/", "", 3), (2, "http://x.de/", "", 3)], "page_id long, url string, html string, lang int")
    few = language_id.identify(odd, docs.limit(0), docs).collect()
    assert len(few) == 3 and all(r.lang for r in few)
    none = language_id.identify(odd, docs.limit(0), docs.limit(0)).collect()
    assert len(none) == 3 and all(r.lang is None for r in none)


def plain_trigrams(text):
    out = []
    padded = f" {text.lower()} "
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        x = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**32
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) % 2**32
        out.append(x >> 19)
    return out


def test_text_model_equals_plain_one(spark):
    rng = random.Random(6)
    words = {"de": "der die das und ist nicht Straße".split(), "en": "the a and is not street".split(), "zh": ["漢字", "文本"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(0, 40))), lang) for i, lang in enumerate(rng.choices(sorted(words), k=40))] + [(90, None, "en"), (91, "x", None), (92, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {lang: np.zeros(language_id.BINS) for lang in words}
    for _, text, lang in rows:
        if lang:
            np.add.at(counts[lang], plain_trigrams(text or ""), 1)
    got = language_id.trigram_counts(df)
    assert list(got) == sorted(words) and all((got[x] == counts[x]).all() for x in words)
    model = language_id.TextModel(got)
    found = {r.key: r.ll for r in language_id.evidence(df, model, "text", None, "lang", "doc_id", "lang").collect()}
    for i, text, own in rows:
        bins, scores = plain_trigrams(text or ""), []
        for lang in sorted(words):
            c = counts[lang].copy()
            if lang == own:  # without the text itself
                np.subtract.at(c, bins, 1)
            scores.append(language_id.TEMPER * sum(np.log((c[b] + 0.5) / (c.sum() + 0.5 * language_id.BINS)) for b in bins))
        np.testing.assert_allclose(found[i], np.array(scores) - max(scores), atol=1e-6)


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "zz", "b", None), (2, "zz", "a", "s"), (3, None, "a", "s")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(7, None, "")], "page_id long, url string, html string")
    assert {r.text_lang for r in language_id.identify(pages, docs, docs).collect()} == {"a"}


def test_many_languages_are_planned_quickly(spark):
    rng = np.random.default_rng(1)
    languages = [f"l{i:03d}" for i in range(200)]
    ll = -rng.random((30, 200)) * 5
    rows = [(i, f"h{i % 3}.org", "org", languages[i % 7], [float(x) for x in ll[i]], [float(x) for x in language_id.softmax(ll[i : i + 1])[0]]) for i in range(30)]
    began = time.time()
    out = language_id.fuse(spark.createDataFrame(rows, "key long, host string, suffix string, declared string, ll array<double>, t array<double>"), languages)
    assert {r.key: r.lang for r in out.collect()}[0] in languages
    assert time.time() - began < 60


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<" + "a" * 1_000_000, "<a" * 500_000, "<!" * 500_000, "<a " + "lang " * 200_000, "<html " + "lang" + " " * 1_000_000):
        language_id.page_parts(page)
    assert time.time() - began < 5
