"""The pipeline's stages, each on its own input, and the whole run."""

import hashlib
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

import __spark_entry__ as entry
from seqloom.llm import line_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.subtract(docs).count() == 0
        if name == "quality_classifier":
            ids = {r.doc_id for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in ids for i in good) >= 0.97 * len(good)
            assert sum(i in ids for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())
        if name == "line_dedup":
            digest = {r.doc_id: r.kept_sha256 for r in line_dedup.line_dedup_digest(before).collect()}
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()} == digest
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert sorted(map(repr, docs.collect())) == sorted(map(repr, before.collect()))
        if name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            ids = {r.doc_id: library.encode(r.text) for r in before.collect()}
            got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in docs.collect()}
            assert got == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
    assert kept["line_dedup"] == kept["quality_classifier"] >= kept["ngram_join"] == kept["mixing"] == kept["sentencepiece"]
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(docs.collect())


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


COLUMNS = {
    "op1_media_tiff": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op2_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op3_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5_quality_mil": {"doc_id", "held_out", "score", "predicted"},
    "op6_ngram_join": {"doc_id", "class_id", "n_links"},
    "op7_language_id": {"page_id", "doc_id", "lang"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_queries_cover_their_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = entry.queries()[name](spark, SF).collect()
    assert COLUMNS[name] <= set(got[0].asDict())
    own = [r for r in got if r.doc_id is not None]
    assert sorted(r.doc_id for r in own) == sorted(r.doc_id for r in docs)
    sizes = {r.doc_id: len((r.text or "").encode()) for r in docs}
    if name in ("op1_media_tiff", "op2_token_counts"):
        assert all(r.n_bytes == sizes[r.doc_id] for r in own)
    if name == "op2_token_counts":
        library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        library.no_truncation()
        counts = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
        assert all(r.n_tokens == counts[r.doc_id] and r.over_limit == (r.n_tokens > 512) for r in own) and any(r.over_limit for r in own)
    if name == "op5_quality_mil":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in own)
    if name == "op7_language_id":
        assert len(got) - len(own) == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, names of helper columns, and an empty table: no stage fails or loses a row."""
    long = "A fine line of more than forty characters, the same in all.\n"
    rows = [(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, long + "two and some more words", None, "a"), (2, long + "other words that are not those", "en", None), (3, long * 50, "en", "b")]
    rows += [(10 + i, long + f"text number {i} with words of its own {i * 7} {i * 13}", "en", "a") for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, body long, keep int, mix_slot int, near_key int, none int"
    odd = spark.createDataFrame([(*r, len(r[1] or ""), "d", 1, 2, 3, 4, 5) for r in rows], schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if i < 4:
                assert out.columns == odd.columns, name
            if name in ("line_dedup", "mixing"):
                assert len(got) == n
                assert sorted(map(repr, out.select("doc_id", "doc", "body", "keep", "mix_slot", "none").collect())) == sorted(map(repr, docs.select("doc_id", "doc", "body", "keep", "mix_slot", "none").collect()))
            if name == "ngram_join" and n:  # one of each text: two rows are repeated, and null and empty texts are one class
                assert len(got) == len({r[1] or "" for r in rows})
            if name == "sentencepiece":
                assert len(got) == n
