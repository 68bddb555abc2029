"""Operator 13 against both libraries on whole texts and against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from stratalist.llm import alignment as al
from stratalist.llm.bpe import byte_letters, tokenizer_path

A, B = (tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {x: i for i, x in enumerate(byte_letters())}


def whole(text, libraries):
    """Tokens of a whole text by the libraries, and all its groups and links by trying every pair."""
    lib_a, lib_b, letters = libraries
    if not text:
        return None
    a, b = lib_a.encode(" " + text, add_special_tokens=False), lib_b.encode(text)
    spans = []
    pieces = [lib_b.id_to_piece(i) for i in b]
    for parts in ([bytes(letters[x] for x in t) for t in a.tokens], [bytes([int(p[3:-1], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode() for p, i in zip(pieces, b, strict=True)]):
        if b"".join(parts) != (" " + text).encode():
            return None
        at, own = 0, []
        for p in parts:
            own.append((at, at + len(p)))
            at += len(p)
        spans.append(own)
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    sides = []
    for ids, own in zip((a.ids, b), spans, strict=True):
        text_of, shared = "", {*ends}
        for i, s in zip(ids, own, strict=True):
            text_of += str(i) + (";" if s[1] in shared else ",")
        sides.append(text_of.split(";")[:-1])
    said = ";".join(map("|".join, zip(*sides, strict=True)))
    links, low = [], 0
    for x, (s, e) in zip(a.ids, spans[0], strict=True):
        while low < len(b) and spans[1][low][1] <= s:
            low += 1
        j = low
        while j < len(b) and spans[1][j][0] < e:
            links.append((x, b[j]))
            j += 1
    return len(a.ids), len(b), len(ends), said, links


def brute(texts, libraries):
    found = [whole(t, libraries) for t in texts]
    count = Counter(p for f in found if f for p in f[4])
    most: dict = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    none = (0,) * 6 + ("",)
    return [none if f is None else (*f[:3], len(f[4]), sum(count[p] == most[p[1]] for p in f[4]), sum(count[p] for p in f[4]), hashlib.sha256(f[3].encode()).hexdigest()) for f in found]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def made(n, seed=5):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "the", "The", "naïve", "don't", "'ll", "123", "4567", "...", ",", "###", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "漢字", "かな", "עברית", "é", "é", "ﬁ", "①", "😀", "👩‍👩‍👧", "​", "\x00", "ᲊ", "ß", "ch", "_", "()", "﻿", "ｆｕｌｌ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_galloping_finds_what_sets_find():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(400), rng.randint(0, n))) for n in (30, rng.choice([5, 30, 300])))
        assert al.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted({*a} & {*b})]


def test_all_documents_and_made_texts_equal_whole_texts(spark, libraries):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += made(1_500) + [None, "", "a▁b", " ", "\n", "x " * 9_000, "x" * 9_000, " " * 5_000, "the the", "the the"]
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in enumerate(texts)], "doc_id long, text string, pair string, n long").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in al.align(docs, A, B).collect()}
    want = brute(texts, libraries)
    assert len(got) == len(texts)
    assert [i for i, w in enumerate(want) if got[i] != w] == []
    sliced = {r.doc_id: tuple(r[c] for c in NAMES) for r in al.align(docs, A, B, slice_pairs=3_000).collect()}
    assert sliced == got


def test_bounds_of_what_a_worker_remembers_change_nothing(libraries, monkeypatch):
    with open(A, "rb") as f, open(B, "rb") as g:
        aligner = al.Aligner(al.Tokens(al.Files(f.read(), g.read(), "k")))
    monkeypatch.setattr(al, "WORD_ENTRIES", 10)
    for t in filter(None, made(60, 8)):
        if aligner.full:
            aligner.shrink()
            assert len(aligner.index) <= 5 and not aligner.full
        words, _ = aligner.read([t])
        w = whole(t, libraries)
        assert (w is None) == (not aligner.fine[words].all())
        if w:
            assert ";".join(aligner.groups[k] for k in words) == w[3]


def test_words_give_back_their_text():
    for t in [*filter(None, made(3_000, 4)), "a\nb c", "a\n\nb", " a", "a ", "\na", "a\n", "\x1ca b", " ", "\n", "a \nb", "a\n b", "a\tb c"]:
        words = al.words_of(t)
        assert "".join(map(al.spelled, words)) == " " + t
        cuts = {sum(len(al.spelled(w)) for w in words[:i]) for i in range(1, len(words))}
        assert all(not (" " + t)[c - 1].isspace() and (" " + t)[c] in " \n\t" for c in cuts)


def test_full_output(spark):
    docs = spark.createDataFrame([(1, "naïve tokenizers 漢字"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in al.align(docs, A, B, full=True).collect()}
    text, groups = " naïve tokenizers 漢字".encode(), rows[1].groups
    assert [g.start for g in groups] == [0, *(g.end for g in groups)][:-1] and groups[-1].end == len(text)
    assert sum(len(g.a) for g in groups) == rows[1].n_a and sum(len(g.b) for g in groups) == rows[1].n_b
    assert len(groups) == rows[1].n_groups and rows[2].groups == []


def test_empty(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
