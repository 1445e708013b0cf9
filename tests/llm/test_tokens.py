"""Token counts and piece encoding against the public libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import byte_pairs, pieces, token_counts

BPE, MODEL = public_tokenizers.path(token_counts.MODEL), public_tokenizers.path(pieces.MODEL)
LIBRARY = Tokenizer.from_file(BPE)
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab '\n\tsreé1_▁.", max_size=60) | st.text(" a", max_size=40)


def library_counts(values):
    return [len(e.ids) for e in LIBRARY.encode_batch(values, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_counts_equal_the_library(values):
    assert token_counts.count_tokens(values, BPE).tolist() == library_counts(values)


def test_counts_of_special_cases():
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh'") for _ in range(rng.randint(1, 12))) for _ in range(20_000))
    values = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "'s 'll 'x", "  \n a", "x" * 5000, long]
    assert token_counts.count_tokens(values, BPE).tolist() == library_counts(values)
    assert token_counts.count_tokens([], BPE).tolist() == []


def test_chunks_compose():
    table, _ = token_counts.loaded(BPE)
    rng = random.Random(2)
    text = "".join(rng.choice("ab' \n1.,srel") for _ in range(3000)) + "'" * 700 + " " * 600
    classes = np.append(table[np.frombuffer(text.encode("utf-32-le"), np.uint32)], token_counts.STOP).astype(np.uint8)
    whole = token_counts.marks(classes, len(classes)).tolist()
    for chunk in (7, 50, 64, 1024):
        assert token_counts.marks(classes, chunk).tolist() == whole


def test_states_start_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    counter = token_counts.Counter(token_counts.Merges(BPE))
    words = [" pseudonym", "zzqx", " unbelievable", "aaaa", "ßtraße"] * 3
    assert [counter.count(w) for w in words] == library_counts(words)


def test_long_pretokens_by_chunk_maps(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice(kind) for _ in range(n)) for kind in ("abcdefgh", "aA", "=", "=-", "東京日本", "é") for n in (65, 700, 9000)]
    expected = library_counts(words)
    for chunk, section in ((128, 65_536), (3, 100), (64, 64), (1, 50)):
        monkeypatch.setattr(token_counts, "BYTES", chunk)
        monkeypatch.setattr(token_counts, "SECTION", section)
        monkeypatch.setattr(token_counts, "MAX_STATES", 250_000 if chunk == 128 else 2_000)
        counter = token_counts.Counter(token_counts.Merges(BPE))
        assert [counter.count_long(w) for w in words] == expected


def test_scan_of_counting_maps():
    rng = np.random.default_rng(5)
    for rows in (1, 2, 7, 64):
        ends, counts = rng.integers(0, 5, (rows, 5)), rng.integers(-3, 9, (rows, 5))
        got_ends, got_counts = token_counts.scan_counts(ends, counts)
        for start in range(5):
            at, total = start, 0
            for i in range(rows):
                total += counts[i, at]
                at = ends[i, at]
                assert (got_ends[i, start], got_counts[i, start]) == (at, total)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library(text):
    model, ids = pieces.loaded(MODEL), PIECES.encode(text)
    n, joined, decoded = pieces.encode_text(model, text)
    assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), PIECES.decode(ids))
    assert model.decode(ids) == PIECES.decode(ids) and model.encode(text) == ids


def test_pieces_of_long_words():
    model = pieces.loaded(MODEL)
    for text in ("ab" * 4000, "=" * 3000, " " * 999, "​" * 50, "日本" * 300):
        assert model.encode(text) == PIECES.encode(text)


ROWS = [(1, None), (2, ""), (3, "Hello  world\n"), (None, "naïve"), (3, "Hello  world\n"), (4, "x y " * 30_000)]


def test_queries_on_edge_rows(spark):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "doc_id long, text string, n_tokens int")
    counts = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, BPE).collect())
    assert counts == sorted((i or 0, len((t or "").encode()), n) for (i, t), n in zip(ROWS, library_counts([t or "" for _, t in ROWS])))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, t in ROWS:
        ids = PIECES.encode(t or "")
        expected.append((i or 0, len(ids), sha(",".join(map(str, ids))), sha(PIECES.decode(ids))))
    assert sorted((r.doc_id or 0, *r[1:]) for r in pieces.piece_digests(df, MODEL).collect()) == sorted(expected)
    back = pieces.decode_pieces(pieces.encode_pieces(df, MODEL), MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in ROWS)
    assert token_counts.token_counts(df.limit(0), BPE).count() == 0 and pieces.piece_digests(df.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "x.model").write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "x.model"))


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_byte_pairs_equal_the_library(values):
    model = byte_pairs.loaded(BPE)
    for text, got in zip(values, model.encode(values)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == library_ids(text)
        assert model.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_byte_pairs_of_special_cases(monkeypatch):
    rng = random.Random(3)
    values = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 5000, "=-" * 700, "東京日本" * 300, "".join(rng.choice("aA'é \n") for _ in range(4000))]
    model = byte_pairs.loaded(BPE)
    assert [np.frombuffer(i, "<u4").tolist() for i in model.encode(values)] == [library_ids(t) for t in values]
    assert model.encode([]) == []
    monkeypatch.setattr(byte_pairs, "PIECE", 3)  # characters of several bytes are cut between pieces of ids
    assert all(model.decode(library_ids(t)) == t for t in values)
    lone = [model.merges.ids[b] for b in (0xE6, 0x41, 0x9D, 0xC3)]
    assert model.decode(lone) == LIBRARY.decode(lone, skip_special_tokens=False)
    for bad in ([-1], [50_257]):
        with pytest.raises(IndexError):
            model.decode(bad)


def test_byte_pairs_backtrack():
    """Tables kept within small bounds, and places where the longest token has to be given up."""
    model = byte_pairs.BytePairs(BPE)
    model.pairs.size = model.words.size = 20
    rng = random.Random(6)
    tokens = [t for t in (bytes(t) for t in model.merges.tokens) if t.isascii() and t.isalpha()]
    words = ["".join(rng.choice(tokens).decode() for _ in range(rng.randint(1, 6))) for _ in range(500)]
    greedy = 0
    for w, got in zip(words, model.encode(words)):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == library_ids(w)
        data, place, longest = w.encode(), 0, []
        while place < len(data):
            t = max((t for n in range(1, 20) if (t := data[place : place + n]) in set_of(model)), key=len)
            longest.append(t)
            place += len(t)
        greedy += len(longest) != len(ids) or [model.bytes[model.offsets[i] : model.offsets[i + 1]].tobytes() for i in ids] != longest
    assert greedy > 50


def set_of(model):
    if not hasattr(model, "every"):
        model.every = set(model.merges.tokens)
    return model.every


def test_byte_digests_on_edge_rows(spark):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "doc_id long, text string, n_tokens int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t in ROWS:
        ids = library_ids(t or "")
        expected.append((i or 0, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((r.doc_id or 0, *r[1:]) for r in byte_pairs.byte_digests(df, BPE).collect()) == sorted(expected)
    encoded = byte_pairs.encode_bytes(df, BPE)
    assert sorted((r.doc_id or 0, r.ids) for r in encoded.collect()) == sorted((i or 0, library_ids(t or "")) for i, t in ROWS)
    assert sorted((r.doc_id or 0, r.text) for r in byte_pairs.decode_bytes(encoded, BPE).collect()) == sorted((i or 0, t or "") for i, t in ROWS)
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert byte_pairs.decode_bytes(none, BPE).collect() == [(1, "")]
    assert byte_pairs.byte_digests(df.limit(0), BPE).count() == 0 and byte_pairs.encode_bytes(df.limit(0), BPE).count() == 0


def test_registered_byte_pairs(spark):
    from seqloom.llm.queries import op11_byte_pairs

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in op11_byte_pairs(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = library_ids(text)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
