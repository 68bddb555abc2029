"""Text functions: Column in, Column out. Python is used for the accent step of ``normalize_text``, off ASCII only, and in ``grams_of``, whose digests
are many times dearer as column functions, which Spark does not compile for arrays."""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import strip_html  # noqa: F401  one of the text functions

# Word lists, patterns and weights that decide which titles and companies count as equal.
COMPANY_SUFFIXES = (
    "incorporated corporation technologies technology holdings solutions systems laboratories labs group limited company corp inc llc ltd plc gmbh co sa ag nv bv pte pvt the "
    "trading capital partners management securities markets ventures associates"
).split()
COMPANY_ALIASES = {
    "advanced micro devices": "amd", "alphabet": "google", "google llc": "google", "meta platforms": "meta", "facebook": "meta", "international business machines": "ibm",
    "amazon web services": "amazon", "aws": "amazon", "amazon com": "amazon", "nvidia corporation": "nvidia", "apple inc": "apple", "microsoft corporation": "microsoft",
    "alphabet inc": "google", "x formerly twitter": "x", "twitter": "x",
}
TITLE_NOISE = (
    r"\b(20\d{2}|summer|fall|autumn|winter|spring|req\s*id|requisition|job\s*id|remote|hybrid|onsite|on\s*site|us|usa|united\s+states|full[\s-]*time|part[\s-]*time|"
    r"new\s+grad(uate)?|university|college|student|program|programme)\b"
)
DISCRIMINATORS = {
    "verification": ["verification", "dv", "uvm", "validation"], "design": ["design", "rtl", "logic design", "micro-architecture", "microarchitecture"],
    "physical": ["physical design", "pnr", "place and route", "backend", "back-end", "sta"], "analog": ["analog", "mixed signal", "mixed-signal", "rf"],
    "software": ["software", "swe", "full stack", "fullstack", "backend engineer", "frontend"], "hardware": ["hardware", "asic", "fpga", "silicon", "soc"],
    "firmware": ["firmware", "embedded", "bsp", "driver", "kernel"], "ml": ["machine learning", "deep learning", "ml ", "ai ", "mlops"],
    "security": ["security", "cryptography", "crypto", "pentest"], "intern": ["intern", "internship"], "coop": ["co-op", "coop", "co op"], "phd": ["phd", "doctoral"],
    "masters": ["masters", "master's", "ms "], "summer": ["summer"], "fall": ["fall", "autumn"], "spring": ["spring"], "winter": ["winter"],
}
ROLE_STEMS = {
    "engineering": "engineer", "engineers": "engineer", "engineer": "engineer", "designer": "design", "designs": "design", "designing": "design", "development": "develop",
    "developer": "develop", "developing": "develop", "verification": "verify", "validation": "verify", "verifying": "verify", "architecture": "architect", "architectures": "architect",
    "systems": "system", "programming": "program", "programmer": "program", "internship": "intern", "internships": "intern", "interns": "intern", "coop": "intern",
    "researcher": "research", "analytics": "analyst",
}
ROLE_STOPWORDS = (
    "intern co op the of and for new at in to undergraduate undergrad graduate grad campus student summer fall autumn spring winter year years level phd masters master ms bs ba "
    "part full time opportunity opportunities position role job career i ii iii temporary seasonal paid unpaid"
).split()
ROLE_SYNONYMS = {
    "silicon": "hardware", "asic": "hardware", "soc": "hardware", "vlsi": "hardware", "chip": "hardware", "ic": "hardware", "semiconductor": "hardware", "circuit": "hardware",
    "circuits": "hardware", "firmware": "embedded", "microcontroller": "embedded", "swe": "software", "sde": "software", "ai": "ml", "machine": "ml", "learning": "ml",
    "fpgas": "fpga", "gpu": "hardware", "cpu": "hardware",
}
GENERIC_ROLE_WORDS = "engineer design develop system technical technology program".split()
FOREIGN_DISCIPLINES = (
    "mechanical mechanic technician civil chemical biomedical industrial manufacturing environmental structural aerospace sales marketing recruiting recruiter hr finance "
    "accounting accountant audit legal compliance paralegal nursing nurse clinical biology chemistry pharmacy journalism news editorial photographer teaching teacher "
    "construction logistics warehouse retail hospitality communications publicity advertising merchandising"
).split()
#: A character that titles and company names do not keep. Looked ahead for: Java takes ten times as long over the negated class.
STRANGE = r"(?s)(?![a-z0-9+#. ])."
GENERIC_WEIGHT = 0.35
SHINGLE_WORDS, SHINGLE_LIMIT = 5, 150


@F.pandas_udf(T.StringType())
def _without_accents(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value, or the key itself."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def normalize_ascii(text: Column) -> Column:
    """``normalize_text`` for text that is known to be ASCII."""
    return _tidy(F.coalesce(text, F.lit("")))


def normalize_text(text: Column) -> Column:
    """Lower case, no accents, single spaces; null becomes empty. ASCII text never leaves the JVM."""
    text = F.coalesce(text, F.lit(""))
    return _tidy(F.coalesce(_without_accents(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))


def _from_first(words: Column, fits: Callable[[Column], Column]) -> Column:
    """The words from the first that fits on; none if none does."""

    def cut(w: Column) -> Column:
        at = F.array_position(F.transform(w, fits), True)
        return F.when(at > 0, F.slice(w, at.cast("int"), F.size(w))).otherwise(F.array().cast("array<string>"))

    return let(words, cut)


def slug_from_normalized(base: Column) -> Column:
    base = F.trim(F.regexp_replace(F.regexp_replace(F.replace(base, F.lit("&"), F.lit(" and ")), STRANGE, " "), r"\s+", " "))
    # By words: a repeated group in a pattern recurses, and a long name would overflow the stack.
    words = F.split(base, " ")
    words = _from_first(F.reverse(words), lambda w: ~w.isin(COMPANY_SUFFIXES))
    bare = F.array_join(_from_first(F.reverse(words), lambda w: w != "the"), " ")
    known = F.create_map(*[F.lit(x) for kv in COMPANY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, base), F.nullif(lookup(COMPANY_ALIASES, bare), F.lit("")), base)


def slugify_company(name: Column) -> Column:
    return slug_from_normalized(normalize_text(name))


def title_core(title: Column, normalized=normalize_text) -> Column:
    """A title without brackets, requisition ids, seasons, years and punctuation."""
    # Each part before a closing bracket loses what follows its first opening one; what follows the last closing one stays. Most titles have none.
    title = F.coalesce(title, F.lit(""))
    parts = F.split(title, r"[\)\]\}]", -1)
    cut = lambda x, i: F.when(i < F.size(parts) - 1, F.regexp_replace(x, r"(?s)[\(\[\{].*", " ")).otherwise(x)
    text = F.when(title.rlike(r"[\)\]\}]"), F.array_join(F.transform(parts, cut), " ")).otherwise(title)
    text = normalized(F.regexp_replace(text, r"\b[A-Z]{1,4}[-_]?\d{4,}\b", " "))
    text = F.regexp_replace(F.translate(text, "/-,", "   "), TITLE_NOISE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, STRANGE, " "), r"\s+", " "))


def title_tokens(core: Column) -> Column:
    """Distinct words of two letters or more."""
    return F.array_distinct(F.filter(F.split(core, " "), lambda w: F.length(w) > 1))


def role_tokens(core: Column) -> Column:
    # A map is searched key by key, a set of words by hash: most words are in neither table.
    known = lambda table: lambda w: F.when(w.isin(list(table)), lookup(table, w)).otherwise(w)
    words = F.transform(F.filter(F.split(core, " "), lambda w: F.length(w) > 1), known(ROLE_STEMS))
    kept = F.filter(words, lambda w: ~w.isin(ROLE_STOPWORDS))
    return F.array_distinct(F.transform(kept, known(ROLE_SYNONYMS)))


def role_words(role: str) -> list[str]:
    """The tokens of a role phrase of the preferences, on the driver: plain lower-case words."""
    stems = [ROLE_STEMS.get(w, w) for w in role.lower().replace("/", " ").replace("-", " ").split() if len(w) > 1]
    return list(dict.fromkeys(ROLE_SYNONYMS.get(w, w) for w in stems if w not in ROLE_STOPWORDS))


def role_affinity(tokens: Column, role: str) -> Column:
    """0 to 1: the share of the role's words, weighted, that a title's tokens hold."""
    own = role_words(role)
    if not own:
        return F.lit(0.0)
    anchors = [w for w in own if w not in GENERIC_ROLE_WORDS] or own
    weight = {w: GENERIC_WEIGHT if w in GENERIC_ROLE_WORDS else 1.0 for w in own}
    got = sum((F.when(F.array_contains(tokens, w), weight[w]).otherwise(0.0) for w in own), F.lit(0.0))
    precision = F.size(F.array_intersect(tokens, words_array(own))) / F.size(tokens)
    off = (F.size(tokens) == 0) | F.arrays_overlap(tokens, words_array(FOREIGN_DISCIPLINES)) | ~F.arrays_overlap(tokens, words_array(anchors))
    return F.when(off, 0.0).otherwise(got / sum(weight.values()) * (0.75 + 0.25 * precision))


def discriminators(normalized: Column) -> Column:
    """The sorted groups of which some needle is a substring."""

    def groups(hay: Column) -> Column:
        hits = {name: reduce(lambda x, y: x | y, [F.contains(hay, F.lit(n)) for n in DISCRIMINATORS[name]]) for name in sorted(DISCRIMINATORS)}
        return F.array_compact(F.array(*[F.when(hit & (hay != "  "), name) for name, hit in hits.items()]))

    # The text is put together once, not once a needle.
    return let(F.concat(F.lit(" "), normalized, F.lit(" ")), groups)


def grams_of(size: int = SHINGLE_WORDS, limit: int = SHINGLE_LIMIT) -> Callable[[Column], Column]:
    """Of normalised text, a struct of the number ``n`` of its distinct word shingles (a shorter text is one) and the sorted ``lowest``: all, or of
    more than ``limit`` those with the smallest MD5."""

    @F.arrow_udf("struct<n: bigint, lowest: array<string>>")
    def grams(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            words = None if text is None else [w for w in text.split(" ") if w]
            if not words:
                out.append(None if text is None else {"n": 0, "lowest": []})
                continue
            found = {" ".join(words)} if len(words) < size else {*map(" ".join, zip(*(words[i:] for i in range(size)), strict=False))}
            lowest = found if len(found) <= limit else [g for _, g in heapq.nsmallest(limit, [(hashlib.md5(g.encode()).digest(), g) for g in found])]
            out.append({"n": len(found), "lowest": sorted(lowest)})
        return pa.array(out, pa.struct([("n", pa.int64()), ("lowest", pa.list_(pa.string()))]))

    return grams


def word_grams(normalized: Column, size: int = SHINGLE_WORDS) -> Column:
    """All distinct word shingles; a shorter text is one shingle."""
    empty = F.array().cast("array<string>")

    def of_words(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        grams = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))
        return F.when(F.size(w) == 0, empty).otherwise(grams)

    return let(F.filter(F.split(normalized, " "), lambda w: w != ""), of_words)


def lowest_grams(grams: Column, limit: int = SHINGLE_LIMIT) -> Column:
    """Shingles, sorted; of more than ``limit`` those with the smallest MD5."""
    by_hash = F.slice(F.array_sort(F.transform(grams, lambda g: F.struct(F.md5(g).alias("h"), g.alias("g")))), 1, limit)
    return F.array_sort(F.when(F.size(grams) <= limit, grams).otherwise(F.transform(by_hash, lambda x: x["g"])))


def shingles(normalized: Column, size: int = SHINGLE_WORDS, limit: int = SHINGLE_LIMIT) -> Column:
    """Distinct word shingles, sorted; of more than ``limit`` those with the smallest MD5. Like ``grams_of``, but without Python, so that lambdas can hold it."""
    return let(word_grams(normalized, size), lambda grams: lowest_grams(grams, limit))


def jaccard(a: Column, b: Column) -> Column:
    # The sets are intersected once, not once for either side of the quotient.
    share = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def token_set_ratio(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def sha256_of(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts]), 256)


def fingerprint(*parts: Column) -> Column:
    return F.substring(sha256_of(*parts), 1, 32)


def truncate(text: Column, limit: int = 280) -> Column:
    """At most ``limit`` characters, cut at a word, with an ellipsis."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    cut = F.substring(text, 1, limit - 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit("…")))


def clamp(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)
