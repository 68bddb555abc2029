from __future__ import annotations

import hashlib
import random
import tracemalloc
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from stratalist.llm import bpe

WORDS = ["the", "Tionoud", " ", "\n\n", "  ", "\t", "it's", "I'LL", "ÀÉî", "é", "ΣΑΣ", "İ", "123", "²½", "中文", "🙂!", "\x1c", "\x85", " ", "_", "<|endoftext|>", "<|endof", "<|startoftext|>", "\x00", "ﬁ", "a" * 70, "'s", " ", "٣"]


def texts() -> list[str | None]:
    rng = random.Random(7)
    made = ["".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    # Letters that every Unicode version in use agrees on: those of version 3.2.
    known = [chr(c) for c in range(1, 0x1F6FF) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs", "Co")]
    made += ["".join(rng.choice(known) for _ in range(60)) for _ in range(300)]
    return [None, "", " ", "x" * 20_000, "ab " * 5_000, *made]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, n_tokens string").repartition(3)


def test_merge_is_lowest_leftmost():
    tok = bpe.load_tokenizer(bpe.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(300):
        symbols = tok.symbols("".join(rng.choice("abetnhio") for _ in range(rng.randint(1, 40))))
        plain = [*symbols]
        while ranked := [(tok.merges[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in tok.merges]:  # noqa: B905
            i = min(ranked)[1]
            plain[i : i + 2] = [tok.merges[plain[i], plain[i + 1]][1]]
        assert bpe.merge_symbols(symbols, tok.merges) == plain


def test_counts_equal_the_library(docs):
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    lib = Library.from_file(path)
    got = {r.doc_id: r for r in bpe.token_counts(docs, path).collect()}
    for i, t in enumerate(texts()):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)


def test_encode_equals_the_library(docs):
    path = bpe.tokenizer_path("word_bpe_49k.json")
    lib = Library.from_file(path)
    got = {r.doc_id: r for r in bpe.bpe_encode(docs, path).collect()}
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].decoded == decoded, repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table_and_repeated_rows(docs):
    assert bpe.bpe_encode(docs.limit(0), bpe.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert bpe.token_counts(docs, bpe.tokenizer_path("byte_bpe_50k.json")).count() == len(texts()) + 1


def test_every_whole_token_is_proven():
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    lib, whole = Library.from_file(path), bpe.prove_whole_tokens(bpe.load_tokenizer(path))
    assert len(whole) > 40_000
    sample = random.Random(3).sample(sorted(whole.items()), 2_000)
    assert all(lib.encode(w, add_special_tokens=False).ids == [i] for w, i in sample)


def test_every_code_point_equals_the_library():
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not 0x34000 <= c < 0xE0000 and c < 0xE0200]
    marks = [c for c in points if unicodedata.combining(c)]
    forms = [f"a{c}b {c}" for c in points] + [f"q{c}\u0334\u0323{c}\u0300 1{c}\u0345" for c in marks] + ["\U00011935\U00011930", "\u0c3c\u0323e\u0301"]
    for name, kind in (("word_bpe_49k.json", bpe.Encoder), ("byte_bpe_50k.json", bpe.Encoder)):
        path = bpe.tokenizer_path(name)
        lib, own = Library.from_file(path), kind(bpe.load_tokenizer(path))
        for at in range(0, len(forms), 32):
            text = "\n".join(forms[at : at + 32])
            ids = np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert b"".join(own.encode(text)) == ids, [f for f in forms[at : at + 32] if b"".join(own.encode(f)) != np.array(lib.encode(f, add_special_tokens=False).ids, "<u4").tobytes()]


def test_merging_many_at_once_equals_one_by_one(monkeypatch):
    tok = bpe.load_tokenizer(bpe.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choice("abetnhioß中🙂") for _ in range(rng.randint(1, 48))) for _ in range(2_000)] + ["a", "x" * 62, "x" * 63, "é" * 48]
    merger, one = bpe.Merger(tok), lambda w: np.array(bpe.merge_symbols(tok.symbols(w), tok.merges), "<u4").tobytes()
    monkeypatch.setattr(merger, "one", lambda w: one(w) if len(w.encode()) > 62 else pytest.fail(f"{w} was merged alone"))
    assert merger.merged(words) == {w: one(w) for w in words}


def test_white_space_becomes_one_space():
    for text in ["", " ", "\t\n", " a", "a ", "a\u2003\x85 b\n", "a\x1c b", "\x1f", "\u200b a"]:
        assert bpe.one_space(text) == bpe.regex.sub(r"\s+", " ", text)


def test_a_full_cache_gives_the_same_ids(monkeypatch):
    tok = bpe.load_tokenizer(bpe.tokenizer_path("word_bpe_49k.json"))
    rows = [t or "" for t in texts()]
    want = [*bpe.Encoder(tok).encode_all(rows)]
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    assert [*bpe.Encoder(tok).encode_all(rows)] == want == [b"".join(bpe.Encoder(tok).encode(t)) for t in rows[:20]] + want[20:]


def test_unicode_tables_never_hold_all_code_points():
    tracemalloc.start()
    bpe._Unicode()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16e6
