"""Operators 2 and 3: token counts by whole-token shortcut, and BPE encoding and decoding by segment tree.

Both read a public tokenizer file (its path is a parameter), build their tables on the driver and broadcast them;
their size is bounded by the vocabulary. The texts stay where they are: no shuffle, one pass, only text columns go to
the Arrow workers. Caches hold a bounded number of pre-tokens; a pre-token of any length is merged in
O(n log n) by the segment tree.

Defined results: a null text counts as empty (no tokens, empty decoded text); special strings inside a text become
their special token, as the library's default does; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored. Letters and numbers are those of Unicode 16, lower case is that of Unicode 17 and combining marks
are those of Unicode 9, as the library has them; a text with a character for which Python or the installed ``regex`` follow another version takes a
second, slower pattern and normaliser.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Fixed value: the pattern that the byte-level pre-tokenizer uses where the file says use_regex.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept by a worker's cache, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Characters of texts whose new pre-tokens are merged together.
AT_ONCE = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(rest.get(b, b)) for b in range(256)]


@dataclass
class Tokenizer:
    """What a tokenizer file says, as plain tables."""

    vocab: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # a pair of ids: its rank and the id it becomes
    pattern: str
    specials: dict[str, int]
    lower: bool  # normalise to NFC, one space and lower case
    suffix: str  # of the last symbol of a pre-token
    key: str
    whole: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.unicode = _Unicode()
        self.by_id = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        letters = byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]

    def symbols(self, word: str) -> list[int]:
        raw = word.encode()
        out = [self.first[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out


def load_tokenizer(path: str) -> Tokenizer:
    """Reads a ``tokenizers`` JSON file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path}: only plain BPE is supported")
    vocab, merges = model["vocab"], {}
    suffix = model.get("end_of_word_suffix") or ""
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None:
        pattern, lower = BYTE_LEVEL_PATTERN, False
    elif pre["type"] == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["invert"] and not pre["pretokenizers"][1]["use_regex"]:
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1] != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}:
            raise ValueError(f"{path}: unknown normaliser {steps}")
        pattern, lower = pre["pretokenizers"][0]["pattern"]["Regex"], True
    else:
        raise ValueError(f"{path}: unknown pre-tokenizer {pre['type']}")
    specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
        raise ValueError(f"{path}: only plain special tokens are supported")
    return Tokenizer(vocab, merges, pattern, specials, lower, suffix, f"{path}:{len(vocab)}:{len(merges)}")


NONE = 1 << 62


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges the leftmost pair of lowest rank until none is left.

    The leaves of a segment tree hold ``rank * n + position`` of the pair that starts at each position; an inner node
    holds the lower of its children, so the root names the leftmost pair of the lowest rank. A merge changes at most three
    leaves, each in logarithmic time. Positions are linked to their neighbours as symbols vanish.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = [*symbols]
    get = merges.get
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    found = False
    for i in range(n - 1):
        if (m := get((symbols[i], symbols[i + 1]))) is not None:
            tree[size + i] = m[0] * n + i
            found = True
    if not found:
        return symbols
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != NONE:
        i = top % n
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        # the pair at i, the pair at j (gone) and the pair before i
        leaves = [(j, NONE)] if j < n - 1 else []
        if i < n - 1:
            m = get((symbols[i], symbols[k])) if k < n else None
            leaves.append((i, NONE if m is None else m[0] * n + i))
        if (p := before[i]) >= 0:
            m = get((symbols[p], symbols[i]))
            leaves.append((p, NONE if m is None else m[0] * n + p))
        for at, value in leaves:
            at += size
            if tree[at] == value:
                continue
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1
    return [s for s in symbols if s >= 0]


class Merger:
    """Merges many words at once: the segment trees of words of about one length are the rows of one array.

    A row's leaves hold ``rank * width + position`` of the pair that starts at each position, and position 0 and the end are empty, so each
    symbol has neighbours. A round takes the root of each row that still has a pair, and repairs the paths above the three leaves that a merge changes.
    """

    #: Rows are at most so many positions wide; a longer word is merged on its own.
    WIDEST = 64

    def __init__(self, tok: Tokenizer) -> None:
        pairs = np.array([*tok.merges], dtype=np.int64).reshape(-1, 2)
        found = np.array([*tok.merges.values()], dtype=np.int64).reshape(-1, 2)
        keys = pairs[:, 0] * 2**32 + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], found[order, 0]
        self.becomes = np.zeros(found[:, 0].max(initial=0) + 1, dtype=np.int64)  # by rank
        self.becomes[found[:, 0]] = found[:, 1]
        self.first, self.last = np.array(tok.first, dtype=np.int64), np.array(tok.last, dtype=np.int64)
        self.one = lambda word: np.array(merge_symbols(tok.symbols(word), tok.merges), "<u4").tobytes()

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out, by_width = {}, {}
        for word in words:
            raw = word.encode()
            width = max(8, 1 << (len(raw) + 1).bit_length())
            if width <= self.WIDEST:
                by_width.setdefault(width, []).append((word, raw))
            else:
                out[word] = self.one(word)
        for width, group in by_width.items():
            for at in range(0, len(group), 2**17 // width):
                part = group[at : at + 2**17 // width]
                out.update(zip((w for w, _ in part), self._rows([raw for _, raw in part], width), strict=True))
        return out

    def _leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        key = a * 2**32 + b
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found] * width + at, NONE)

    def _rows(self, raws: list[bytes], width: int) -> list[bytes]:
        m, place = len(raws), np.arange(width)
        size = np.array([len(r) for r in raws])
        symbols = np.full((m, width), -1, dtype=np.int64)
        symbols[(place > 0) & (place <= size[:, None])] = self.first[np.frombuffer(b"".join(raws), np.uint8)]
        symbols[np.arange(m), size] = self.last[[r[-1] for r in raws]]
        after, before = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
        tree = np.full((m, 2 * width), NONE, dtype=np.int64)
        if len(self.keys):
            tree[:, width:-1] = self._leaves(symbols[:, :-1], symbols[:, 1:], place[:-1], width)
        for half in (width >> i for i in range(1, width.bit_length())):
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            rank, i = np.divmod(tree[row, 1], width)
            j = after[row, i]
            k, p = after[row, j], before[row, i]
            own = symbols[row, i] = self.becomes[rank]
            symbols[row, j] = -1
            after[row, i], before[row, k] = k, i
            tree[row, width + j] = NONE
            tree[row, width + i] = self._leaves(own, symbols[row, k], i, width)
            tree[row, width + p] = self._leaves(symbols[row, p], own, p, width)
            at = (width + np.stack([j, i, p])) >> 1
            while at[0, 0]:
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
                at >>= 1
            row = row[tree[row, 1] != NONE]
        kept = symbols >= 0
        ends = 4 * np.cumsum(kept.sum(axis=1))
        flat = symbols[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def prove_whole_tokens(tok: Tokenizer) -> dict[str, int]:
    """The vocabulary strings that are one pre-token and that the merges turn into that one token.

    Each string is merged here once, offline; a pre-token that is found among them needs no merge later.
    """
    letters = {x: b for b, x in enumerate(byte_letters())}
    pattern, proven = regex.compile(tok.pattern), {}
    for token, i in tok.vocab.items():
        if tok.suffix and not token.endswith(tok.suffix):
            continue
        try:
            word = bytes(letters[x] for x in token[: len(token) - len(tok.suffix)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if word and pattern.fullmatch(word) and merge_symbols(tok.symbols(word), tok.merges) == [i]:
            proven[word] = i
    return proven


def _points(ranges: str) -> set[int]:
    """The code points of blank-separated hexadecimal ranges."""
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return {c for r in ends for c in range(r[0], r[-1] + 1)}


#: Letters and numbers that came with Unicode 16.
LETTERS_16 = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 "
    "13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
)
NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Combining marks later than Unicode 9, which the library's normaliser neither reorders nor composes.
LATER_MARKS = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e "
    "11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)
#: Capitals that came with Unicode 16 and 17, and their small letters.
LATER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


class _Unicode:
    """How the library's Unicode versions differ from those of this Python and of ``regex``."""

    def __init__(self) -> None:
        if unicodedata.unidata_version >= "17":
            raise RuntimeError("Unicode 17 or later: fix the letters and numbers of Unicode 16 here")
        own, more, lacking = {"L": set(), "N": set()}, {"L": _points(LETTERS_16), "N": _points(NUMBERS_16)}, 0
        # A later Python may know more than Unicode 16: what it added in between is no letter to the library. By blocks, so that the driver never holds all code points.
        for at in range(0, 0x110000, 0x800):
            block = "" if 0xD800 <= at < 0xE000 else "".join(map(chr, range(at, at + 0x800)))
            for kind, added in more.items():
                known = {ord(c) for c in block if unicodedata.category(c)[0] == kind} | {c for c in added if at <= c < at + 0x800}
                found = {ord(c) for c in regex.findall(rf"\p{{{kind}}}", block)}
                own[kind] |= found - known
                lacking += len(known - found)
        if lacking:
            raise RuntimeError(f"regex is older than Unicode 16: {lacking} characters")
        #: Characters that send a text the slow way.
        self.odd = frozenset(chr(c) for c in {*own["L"], *own["N"], *_points(LATER_MARKS), *LATER_CAPITALS})
        self.classes = {rf"\p{{{k}}}": rf"[\p{{{k}}}--[{''.join(map(regex.escape, map(chr, sorted(v))))}]]" if v else rf"\p{{{k}}}" for k, v in own.items()}
        self.marks = regex.compile(f"([{''.join(map(chr, sorted(_points(LATER_MARKS))))}])")

    def pattern(self, pattern: str) -> str:
        for name, exact in self.classes.items():
            pattern = pattern.replace(name, exact)
        return f"(?V1){pattern}"

    def compose(self, text: str) -> str:
        return "".join(unicodedata.normalize("NFC", part) for part in self.marks.split(text))


def one_space(text: str) -> str:
    """Each run of white space as one space."""
    if any(x in text for x in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
        return regex.sub(r"\s+", " ", text)
    ends = [" " if x.isspace() else "" for x in (text[:1], text[-1:])]
    return (text and " ") if text.isspace() else " ".join(text.split()).join(ends)


def normalize(text: str, exact: _Unicode | None = None) -> str:
    """NFC, white space to one space, lower case letter by letter (a final sigma is no exception)."""
    composed = exact.compose(text) if exact else unicodedata.normalize("NFC", text)
    lower = one_space(composed).replace("Σ", "σ")
    return (lower.translate(LATER_CAPITALS) if exact else lower).lower()


class _Pieces:
    """Cuts texts at special strings, normalises the rest and finds the pre-tokens."""

    def __init__(self, tok: Tokenizer) -> None:
        self.findall = regex.compile(tok.pattern).findall
        self.exact, self.findall_exact = tok.unicode, regex.compile(tok.unicode.pattern(tok.pattern)).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(tok.specials, key=len, reverse=True)))) if tok.specials else None
        self.lower, self.marks = tok.lower, tuple(tok.specials)

    def of(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Pre-tokens up to each special string, and that string (None at the end)."""
        if not any(x in text for x in self.marks):
            yield self.words(text), None
            return
        at = 0
        for m in self.special.finditer(text):
            yield self.words(text[at : m.start()]), m[0]
            at = m.end()
        yield self.words(text[at:]), None

    def words(self, text: str) -> list[str]:
        if text.isascii() or self.exact.odd.isdisjoint(text):
            return self.findall(normalize(text) if self.lower else text)
        return self.findall_exact(normalize(text, self.exact) if self.lower else text)


class _Cache(dict):
    """Bounded: full, it falls back to what it started with."""

    def __init__(self, make, start: dict) -> None:
        super().__init__(start)
        self.make, self.start = make, start

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.start):
                self.clear()
                self.update(self.start)
            self[word] = value
        return value

    def learn(self, found: dict) -> None:
        """Takes these in, which may be over the bound by themselves."""
        if len(self) + len(found) > CACHE_ENTRIES + len(self.start):
            self.clear()
            self.update(self.start)
        self.update(found)


_WORKERS: dict[tuple[str, str], object] = {}


def _worker(kind: str, tok: Tokenizer, make):
    """One per Python worker and tokenizer, reused by its next tasks."""
    if (kind, tok.key) not in _WORKERS:
        _WORKERS[kind, tok.key] = make(tok)
    return _WORKERS[kind, tok.key]


class Counter:
    def __init__(self, tok: Tokenizer) -> None:
        self.pieces = _Pieces(tok)
        self.sizes = _Cache(lambda w: len(merge_symbols(tok.symbols(w), tok.merges)), dict.fromkeys(tok.whole, 1))

    def count(self, text: str) -> int:
        size = self.sizes.__getitem__
        return sum(sum(map(size, words)) + (special is not None) for words, special in self.pieces.of(text))


class Encoder:
    def __init__(self, tok: Tokenizer) -> None:
        self.tok, self.pieces, self.merger = tok, _Pieces(tok), Merger(tok)
        self.ids = _Cache(self.merger.one, {})
        self.names = [tok.by_id.get(i, "") for i in range(max(tok.by_id) + 1)]

    def encode(self, text: str) -> list[bytes]:
        """The ids of each pre-token or special token, as little-endian unsigned 32-bit integers."""
        return self._ids(self.pieces.of(text))

    def _ids(self, pieces: Iterable[tuple[list[str], str | None]]) -> list[bytes]:
        out: list[bytes] = []
        for words, special in pieces:
            out += map(self.ids.__getitem__, words)
            if special is not None:
                out.append(self.tok.specials[special].to_bytes(4, "little"))
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text. The new pre-tokens of about ``AT_ONCE`` characters are merged together."""
        held, chars = [], 0
        for text in texts:
            held.append([*self.pieces.of(text)])
            chars += len(text)
            if chars >= AT_ONCE:
                yield from self._learnt(held)
                held, chars = [], 0
        yield from self._learnt(held)

    def _learnt(self, held: list[list[tuple[list[str], str | None]]]) -> Iterator[bytes]:
        seen = set(chain.from_iterable(words for pieces in held for words, _ in pieces))
        self.ids.learn(self.merger.merged([w for w in seen if w not in self.ids and len(w) <= CACHE_CHARS]))
        for pieces in held:
            yield b"".join(self._ids(pieces))

    def decode(self, ids: list[int]) -> str:
        """The tokens with one space between them, as the library joins those of a file without a decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def token_counts(docs: DataFrame, path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over ``limit``, for each row."""
    tok = load_tokenizer(path)
    tok.whole = prove_whole_tokens(tok)
    shared = docs.sparkSession.sparkContext.broadcast(tok)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker("count", shared.value, Counter)
        for batch in batches:
            n = pa.array((counter.count(t.as_py() or "") for t in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(count, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def bpe_encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, with ids array and decoded text if ``full``."""
    shared = docs.sparkSession.sparkContext.broadcast(load_tokenizer(path))
    more = [("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if full else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker("encode", shared.value, Encoder)
        for batch in batches:
            out: list[list] = [[] for _ in range(3 + len(more))]
            for packed in encoder.encode_all(t.as_py() or "" for t in batch.column("text")):
                ids = np.frombuffer(packed, "<u4")
                decoded = encoder.decode(ids.tolist())
                row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for column, x in zip(out, (*row, *((ids.astype(np.int64), decoded) if full else ())), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), *(k for _, k in more)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(k for k, _ in more)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ddl = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, ddl + (", ids array<long>, decoded string" if full else ""))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), full=False)


QUERIES = {"op2_token_counts": op2_token_counts, "op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
