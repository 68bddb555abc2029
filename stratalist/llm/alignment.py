"""Operator 13: cross-tokenizer alignment by galloping intersection.

A text is encoded by two tokenizers; the byte offsets at which tokens of both end cut the tokens into groups, and two tokens are linked where
their byte ranges overlap. The common ends are found by galloping: each end of the shorter list is sought in the longer one by
doubling steps from the last hit and a binary search between the last two. Inside a group, the ranks of a token's two ends in the
other list are its range of links.

Both tokenizers are cut where neither has a token across: before white space that follows something else. ``Tokens`` proves this
from the vocabulary and refuses a tokenizer without that property. So texts are aligned word by word, each distinct word of a task once, whatever
its length, and a text's values are sums over its words; a text with rare kinds of white space is one word.

Two passes over the texts. The first counts the links of each pair of ids; a task sums its own pairs before they are shuffled, and the
pair table has at most one row for two ids that ever met. The second needs each pair's count: the table is broadcast in slices of
at most ``slice_pairs`` rows, one pass a slice, so nothing broadcast grows with the corpus.

Defined results: null and empty texts, and texts whose tokens do not give back space + text in bytes (one with U+2581, say), have no tokens: zeros, '' for
the digest, and no part in the counts; repeated rows each count; strings of special tokens are plain text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import BYTE_LEVEL_PATTERN, byte_letters, tokenizer_path
from .shared import materialize, table

WORDS = re.compile(r"\s*\S+|\s+").findall
#: White space of other kinds than space, newline and tab: a text with any is one word.
RARE_SPACE = [chr(c) for c in (*range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Words that the ranked encoder takes: short ones of Latin letters, on which all versions of Unicode agree.
PLAIN_CHARS = 64
PLAIN = re.compile(rf"[\x00-ɏ]{{1,{PLAIN_CHARS}}}").fullmatch
#: Words and characters of words that a worker remembers, characters of texts at a time, and pairs that a task holds.
WORD_ENTRIES, WORD_CHARS, TEXT_CHARS, PAIRS_HELD = 400_000, 16_000_000, 4_000_000, 4_000_000
#: A pair of ids in one number.
SHIFT = 31


def words_of(text: str) -> list[str]:
    """The words of a text, each with the white space before it; one space before it is left out, so such a word starts with something else."""
    if not text:
        return []
    if any(c in text for c in RARE_SPACE):
        found = [" " + text]
    elif "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text or text[0] in " \n" or text[-1] in " \n":
        found = WORDS(" " + text)
    else:  # one space or newline between all words
        return text.replace("\n", " \n").split(" ")
    return [w[1:] if w[0] == " " and len(w) > 1 and not w[1].isspace() else w for w in found]


def spelled(word: str) -> str:
    """A word of ``words_of`` with all white space before it."""
    return word if word[0].isspace() else " " + word


class _Numbers(dict):
    """Words to numbers; a word that is asked for first gets the next number and is noted as new."""

    def __init__(self, known: dict[str, int] | None = None) -> None:
        super().__init__(known or {})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(i, j) with a[i] = b[j], both ascending. The shorter list drives."""
    swapped = len(a) > len(b)
    if swapped:
        a, b = b, a
    out, at, n = [], 0, len(b)
    for i, end in enumerate(a):
        if at < n and b[at] < end:
            step = 1
            while at + step < n and b[at + step] < end:
                step *= 2
            at = bisect_left(b, end, at + step // 2, min(at + step + 1, n))
        if at == n:
            break
        if b[at] == end:
            out.append((at, i) if swapped else (i, at))
    return out


def overlaps(ends_a: list[int], ends_b: list[int], first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
    """(i, j) of the overlapping tokens of a group: tokens ``first`` to ``last``, both inclusive, of either list."""
    (i0, j0), (i1, j1) = first, last
    if i0 == i1:
        return [(i0, j) for j in range(j0, j1 + 1)]
    if j0 == j1:
        return [(i, j0) for i in range(i0, i1 + 1)]
    out = []
    for i in range(i0, i1 + 1):
        start = ends_a[i - 1] if i else 0
        out += [(i, j) for j in range(bisect_right(ends_b, start, j0, j1), bisect_left(ends_b, ends_a[i], j0, j1) + 1)]
    return out


@dataclass(frozen=True)
class Files:
    """The contents of both tokenizer files, which executors may not have."""

    a: bytes
    b: bytes
    key: str


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, files: Files) -> None:
        letters = {x: i for i, x in enumerate(byte_letters())}
        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = {i: bytes(letters[x] for x in t) for t, i in self.a.get_vocab().items() if t not in special}
        # The ranked encoder merges by id, so ids must follow the merges.
        self.ranked = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={t: i for i, t in self.bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.bytes_b, spaced = {}, re.compile(r"\S[ \n\t]")
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:-1], 16)])
                continue
            plain = piece.replace("▁", " ")
            self.bytes_b[i] = plain.encode()
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (spaced.search(plain) or "\n" in plain):
                raise ValueError(f"piece {piece!r} goes on after white space, so texts cannot be cut there")

        self.bytes_a, self.bytes_b = ([of.get(i, b"") for i in range(max(of) + 1)] for of in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = ([len(x) for x in of] for of in (self.bytes_a, self.bytes_b))
        self.name = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        ranked = self.ranked.encode_ordinary
        a: list = [ranked(w) if (len(w) <= PLAIN_CHARS and w.isascii()) or PLAIN(w) else None for w in words]
        rest = [i for i, ids in enumerate(a) if ids is None]
        for i, found in zip(rest, self.a.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            a[i] = found.ids
        # The library puts a space before a text: the word's own, or one kept off it by a newline, which no piece holds.
        led = [w[0] == " " and len(w) > 1 for w in words]
        b = self.b.encode([w[1:] if x else "\n" + w for w, x in zip(words, led, strict=True)], num_threads=1)
        return a, [ids if x else ids[2:] for ids, x in zip(b, led, strict=True)]


def align_word(word: str, a: list[int], b: list[int], tokens: Tokens, spell: bool = True) -> tuple[tuple[int, int, int, int], str, list[int]] | None:
    """(tokens of a, of b, groups, links), the groups as text (if ``spell``), and the linked pairs; None if the tokens don't give back the word."""
    raw, bytes_b, name = word.encode(), tokens.bytes_b, tokens.name
    # Byte-level tokens give back their text always; that their lengths add up is enough to see that nothing was normalised away.
    if b"".join([bytes_b[i] for i in b]) != raw or sum([tokens.size_a[i] for i in a]) != len(raw):
        return None
    if len(a) == 1 or len(b) == 1:  # one group, in which all meet
        pairs = [x << SHIFT | y for x in a for y in b]
        return (len(a), len(b), 1, len(pairs)), f"{','.join([name[i] for i in a])}|{','.join([name[i] for i in b])}" if spell else "", pairs
    ends_a, ends_b = list(accumulate([tokens.size_a[i] for i in a])), list(accumulate([tokens.size_b[i] for i in b]))
    groups, pairs, i0, j0, n = [], [], 0, 0, 0
    for i, j in common_ends(ends_a, ends_b):
        n += 1
        if i == i0 and j == j0:
            if spell:
                groups.append(name[a[i]] + "|" + name[b[j]])
            pairs.append(a[i] << SHIFT | b[j])
        else:
            if spell:
                groups.append(",".join([name[x] for x in a[i0 : i + 1]]) + "|" + ",".join([name[x] for x in b[j0 : j + 1]]))
            pairs += [a[x] << SHIFT | b[y] for x, y in overlaps(ends_a, ends_b, (i0, j0), (i, j))]
        i0, j0 = i + 1, j + 1
    return (len(a), len(b), n, len(pairs)), ";".join(groups), pairs


class Aligner:
    """Texts to words, and each word's alignment, remembered within bounds."""

    def __init__(self, tokens: Tokens, spell: bool = True) -> None:
        self.tokens, self.spell = tokens, spell
        self.reset()

    def reset(self) -> None:
        self.index = _Numbers()
        self.chars, self.groups = 0, []
        self.fine = np.zeros(0, dtype=bool)
        self.sizes = np.zeros((0, 4), dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.values, self.valued_by = np.zeros((0, 2), dtype=np.int64), ""
        self.uses = np.zeros(0, dtype=np.int64)

    def shrink(self) -> None:
        """Keeps the words that were used most, at most half of what is remembered otherwise."""
        least = 2
        while (kept := self.uses >= least).sum() > WORD_ENTRIES // 2 or self.chars_of(kept) > WORD_CHARS // 2:
            least *= 2
        at = np.flatnonzero(kept)
        words = list(self.index)
        sizes = self.sizes[:, 3]
        self.index = _Numbers({words[k]: i for i, k in enumerate(at.tolist())})
        self.chars = sum(map(len, self.index))
        self.groups = [self.groups[k] for k in at.tolist()]
        self.pairs = self.pairs[np.repeat(kept, sizes)]
        self.fine, self.sizes, self.uses = self.fine[at], self.sizes[at], self.uses[at] // 2
        self.values = self.values[:0]

    def chars_of(self, kept: np.ndarray) -> int:
        return sum(len(w) for w, k in zip(self.index, kept.tolist(), strict=True) if k)

    @property
    def full(self) -> bool:
        return len(self.index) > WORD_ENTRIES or self.chars > WORD_CHARS

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts, one after the other, and how many words each has."""
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words])
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=counts.sum())
        if self.index.new:
            new, self.index.new = [spelled(w) for w in self.index.new], []
            gc.disable()  # many small lists and no cycles
            try:
                found = [align_word(w, a, b, self.tokens, self.spell) for w, a, b in zip(new, *self.tokens.encode(new), strict=True)]
            finally:
                gc.enable()
            self.chars += sum(map(len, new))
            self.groups += ["" if f is None else f[1] for f in found]
            self.fine = np.concatenate([self.fine, [f is not None for f in found]])
            self.sizes = np.concatenate([self.sizes, np.array([(0, 0, 0, 0) if f is None else f[0] for f in found], dtype=np.int64)])
            self.pairs = np.concatenate([self.pairs, np.fromiter(chain.from_iterable(f[2] for f in found if f is not None), dtype=np.int64)])
        uses = np.bincount(numbers, minlength=len(self.groups))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return numbers, counts

    def valued(self, slice_: Slice) -> np.ndarray:
        """For each word: its links of the highest count of their B id, and the sum of its links' counts, as far as the slice has them."""
        if self.valued_by != slice_.key:
            self.values, self.valued_by = self.values[:0], slice_.key
        sizes = self.sizes[len(self.values) :, 3]
        if len(sizes):
            own = self.pairs[self.sizes[: len(self.values), 3].sum() :]
            at = np.minimum(np.searchsorted(slice_.pairs, own), max(0, len(slice_.pairs) - 1))
            hit = slice_.pairs[at] == own if len(slice_.pairs) else np.zeros(len(own), dtype=bool)
            each = np.stack([hit & slice_.best[at], np.where(hit, slice_.counts[at], 0)], axis=1).astype(np.int64) if len(slice_.pairs) else np.zeros((len(own), 2), dtype=np.int64)
            self.values = np.concatenate([self.values, _sums(each, sizes)])
        return self.values


def _sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``sizes`` of them at a time."""
    run = np.concatenate([np.zeros((1, rows.shape[1]), dtype=np.int64), np.cumsum(rows, axis=0)])
    ends = np.cumsum(sizes)
    return run[ends] - run[ends - sizes]


@dataclass(frozen=True)
class Slice:
    """Part of the pair table: ascending pairs, their counts, and whether a count is its B id's highest."""

    key: str
    pairs: np.ndarray
    counts: np.ndarray
    best: np.ndarray


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(files: Files, spell: bool) -> Aligner:
    """One for each worker, reused by its next tasks; words without their groups' text serve only tasks that need none."""
    found = _ALIGNERS.get(files.key)
    if found is None or found.spell != spell:
        _ALIGNERS[files.key] = found = Aligner(found.tokens if found else Tokens(files), spell)
    return found


def _some(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about TEXT_CHARS characters, or one text that is longer."""
    texts, at, chars = batch.column("text").to_pylist(), 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= TEXT_CHARS or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, chars = i + 1, 0


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def pair_counts(docs: DataFrame, files: Broadcast) -> DataFrame:
    """(pair, n, best) of all pairs of ids that are linked anywhere; ``pair`` is a << SHIFT | b. docs: text, not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files.value, spell=False)
        seen, keys, counts, held = np.zeros(0, dtype=np.int64), [], [], 0

        def drain() -> None:
            """The links of the words seen so far."""
            nonlocal seen, keys, counts, held
            n = np.repeat(seen, aligner.sizes[: len(seen), 3])
            at = np.flatnonzero(n)
            keys, counts = ([x] for x in _added([*keys, aligner.pairs[at]], [*counts, n[at]]))
            held, seen = len(keys[0]), np.zeros(0, dtype=np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts, held
            for at in range(0, held, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[0][at : at + (1 << 16)]) for x in (keys, counts)], ["pair", "n"])
            keys, counts, held = [], [], 0

        for b in batches:
            for _, texts in _some(b):
                if aligner.full:
                    drain()
                    aligner.shrink()
                    if held > PAIRS_HELD:
                        yield from out()
                words, sizes = aligner.read(texts)
                odd = _sums(~aligner.fine[words][:, None], sizes)[:, 0] > 0  # texts that don't come back
                now = np.bincount(words[~np.repeat(odd, sizes)], minlength=len(aligner.groups))
                now[: len(seen)] += seen
                seen = now
        drain()
        yield from out()

    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    counted = materialize(docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    highest = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return counted.withColumn("b", b_id).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", slice_pairs: int = 2_000_000, full: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row; with ``full`` also ``groups``: for each
    its first byte, the byte after its last, and its ids of either tokenizer."""
    spark, files = docs.sparkSession, []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = spark.sparkContext.broadcast(Files(*files, hashlib.sha256(b"".join(files)).hexdigest()))
    Tokens(shared.value)  # refuses unfit tokenizers before any work
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = materialize(pair_counts(rows, shared), "pair-counts")
    parts = max(1, -(-pairs.count() // slice_pairs))
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for i in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i).orderBy("pair").toArrow()
        own = spark.sparkContext.broadcast(Slice(uuid.uuid4().hex, *(own.column(c).to_numpy() for c in ("pair", "n", "best"))))
        rows = _valued(rows, shared, own, last=i + 1 == parts, full=full)
        if i + 1 < parts:
            rows = materialize(rows, "alignment")
    return rows


def _valued(rows: DataFrame, files: Broadcast, slice_: Broadcast, *, last: bool, full: bool) -> DataFrame:
    """Adds a slice's part to n_best and count_sum; the last pass gives the result instead of the text."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] if last else ["doc_id", "text", "n_best", "count_sum"]
    group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files.value, spell=last)
        for b in batches:
            for part, texts in _some(b):
                if aligner.full:
                    aligner.shrink()
                words, sizes = aligner.read(texts)
                fine = _sums(~aligner.fine[words][:, None], sizes)[:, 0] == 0
                found = _sums(np.concatenate([aligner.sizes, aligner.valued(slice_.value)], axis=1)[words], sizes) * fine[:, None]
                found[:, 4] += part.column("n_best").to_numpy()
                found[:, 5] += part.column("count_sum").to_numpy()
                if not last:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(found[:, 4]), pa.array(found[:, 5])], names)
                    continue
                ends, said = np.cumsum(sizes), []
                for n, end, ok in zip(sizes.tolist(), ends.tolist(), fine.tolist(), strict=True):
                    said.append(";".join(map(aligner.groups.__getitem__, words[end - n : end].tolist())) if ok and n else "")
                columns = [part.column("doc_id"), *(pa.array(found[:, k]) for k in range(6)), pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said])]
                if full:
                    columns.append(pa.array([list(_parsed(s, aligner.tokens)) for s in said], pa.list_(group)))
                yield pa.RecordBatch.from_arrays(columns, [*names, *(["groups"] if full else [])])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"{c} {id_type if c == 'doc_id' else 'string' if c in ('text', 'groups_sha256') else 'long'}" for c in names)
    return rows.mapInArrow(run, kinds + (", groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>" if full and last else ""))


def _parsed(groups: str, tokens: Tokens) -> Iterator[dict]:
    at = 0
    for g in filter(None, groups.split(";")):
        a, b = ([int(x) for x in side.split(",")] for side in g.split("|"))
        end = at + sum(len(tokens.bytes_a[i]) for i in a)
        yield {"start": at, "end": end, "a": a, "b": b}
        at = end


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
