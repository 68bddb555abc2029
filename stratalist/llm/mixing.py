"""Operator 4 [native]: mixing to target weights with soft membership.

A classifier fitted on the labelled table gives each document a posterior over the domains: naive Bayes over binned text
statistics and the presence of a few telling words. Nonnegative rates r of the documents are then fitted by projected-
gradient least squares so that the expected tokens of each domain, sum over documents of r * tokens * posterior, match
the targets, and of the rates that do, those nearest to 1 are taken. The gradient of a document is its posterior times the residuals of
the domains. The rounds' steps add up to one multiplier a domain, and the projection is taken of their sum (lazily): a document's rate
is max(0, 1 - posterior . multipliers), an expression of its own columns; nothing is joined back. A round is one aggregation over a compact
table, combined before its shuffle, which returns one row: for each of several step lengths the sums of the domains, and their curvature over
the documents above zero, which scales the next step. Rounds go on until the conditions of the optimum hold. Everything is DataFrame expressions.

Bounds: the classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of their id; ``WORDS``, ``SUPPORT`` and ``LIFT`` say which
words it looks at and are its parameters. All documents are scored, and the sums cover all of them.

Defined results: null and empty texts have no tokens and the posterior of their statistics; repeated rows are rated alike
and drawn alike; labels of unknown domains are ignored, and an id with several labels has the lowest in order of the
targets; a domain without labelled rows has no members; without labels all domains are equally likely; targets that
cannot be met are met as nearly as nonnegative rates allow; an empty table gives an empty result; other columns are kept by ``mix``,
whatever their names; a table without the column of sources has a null source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import UPPER
from .shared import materialize, table

SAMPLE_ROWS = 20_000
WORDS = 64
#: A word is looked at if it is in that share of the sampled rows of some domain.
SUPPORT = 0.02
#: and that many times as often as in the other domains.
LIFT = 4.0
SYMBOLS = "!#$%&*|<>{}[]=_~^@+\\/"
#: Weights of the distance from 1, from coarse to fine; the residual of the optimum, as a share of the tokens; and step lengths.
RIDGES, TOLERANCE, STEPS = (1e-2, 1e-4, 1e-6, 1e-8), 1e-9, (1.0, 0.5, 0.2, 0.05, 0.01, 1e-3)
#: Steps of the draw: a rate of 1.25 is one copy, and a second for a quarter of the ids.
DRAW_STEPS = 1 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0))


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __words, __tokens and __bins (one small number for each statistic)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns({"__words": words_of(text), "__length": F.length(text)})
    n = F.greatest("__length", F.lit(1))

    def share(letters: str) -> Column:
        return (F.col("__length") - F.length(F.translate(text, letters, ""))) / n

    docs = docs.withColumns({"__tokens": F.size("__words"), "__distinct": F.size(F.array_distinct("__words"))})
    tokens = F.greatest("__tokens", F.lit(1))
    bins = [
        F.least(F.floor(share(UPPER) * 20), F.lit(10)),
        F.least(F.ceil(share(SYMBOLS) * 50), F.lit(10)),
        # distinct words against what a text of that length has when it doesn't repeat itself
        F.floor(F.col("__distinct") / F.pow(tokens, 0.75) * 4),
        F.least(F.floor(n / tokens), F.lit(20)),
    ]
    return docs.withColumn("__bins", F.array(*[F.greatest(F.least(b, F.lit(40)), F.lit(0)).cast("int") for b in bins])).drop("__length", "__distinct")


BINNED = 4


def _adds(weight: Column):
    return lambda total, word: total + weight[word]


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    base: tuple[float, ...] = ()  # log prior, and that no word is there
    bins: dict[tuple[int, int], tuple[float, ...]] = field(default_factory=dict)
    unseen: tuple[float, ...] = ()
    words: dict[str, tuple[float, ...]] = field(default_factory=dict)  # what a word's presence adds

    def posteriors(self) -> list[Column]:
        """Of __words and __bins, in order of the domains: as logarithms up to a common term, or equal shares."""
        if not self.base:
            return [F.lit(1 / len(self.domains)) for _ in self.domains]
        present = F.array_intersect("__words", F.array(*map(F.lit, sorted(self.words)))) if self.words else F.array()
        logs = []
        for d in range(len(self.domains)):
            total = F.lit(self.base[d])
            for f in range(BINNED):
                own = F.array(*[F.lit(self.bins[f, b][d] if (f, b) in self.bins else self.unseen[d]) for b in range(41)])
                total = total + F.get(own, F.col("__bins")[f])
            if self.words:
                weight = F.create_map(*[F.lit(x) for w in sorted(self.words) for x in (w, self.words[w][d])])
                total = total + F.aggregate(present, F.lit(0.0), _adds(weight))
            logs.append(total)
        return logs

    def add_to(self, df: DataFrame) -> DataFrame:
        """Adds __p0, __p1, ... to a frame with statistics."""
        k = range(len(self.domains))
        df = df.withColumns({f"__l{d}": x for d, x in enumerate(self.posteriors())})
        if not self.base:
            return df.withColumnsRenamed({f"__l{d}": f"__p{d}" for d in k})
        top = F.greatest(*[f"__l{d}" for d in k]) if len(self.domains) > 1 else F.col("__l0")
        df = df.withColumns({f"__e{d}": F.exp(F.col(f"__l{d}") - top) for d in k})
        total = reduce(lambda a, b: a + b, [F.col(f"__e{d}") for d in k])
        df = df.withColumns({f"__p{d}": F.round(F.col(f"__e{d}") / total, 9) for d in k})
        return df.drop(*[f"__{x}{d}" for x in "le" for d in k])


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """``labels``: doc_id, domain."""
    rank = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    rows = labels.select("doc_id", rank.cast("int").alias("d")).where("d >= 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d").alias("d"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # At most SAMPLE_ROWS ids: broadcast, so the texts aren't shuffled.
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "doc_id")
    own = with_statistics(own, "text").select("d", "__bins", F.array_distinct("__words").alias("words"))
    own = materialize(own, "labelled")
    n = np.zeros(len(domains))
    for r in own.groupBy("d").count().collect():
        n[r.d] = r["count"]
    if not n.sum():
        return Classifier(tuple(domains))
    k = range(len(domains))
    counted = own.select("d", F.posexplode("__bins").alias("f", "b")).groupBy("f", "b").agg(*[F.count_if(F.col("d") == d).alias(f"n{d}") for d in k]).collect()  # at most 4 x 41 rows
    bins = {(r.f, r.b): tuple(float(math.log((r[f"n{d}"] + 0.5) / (n[d] + 20))) for d in k) for r in counted}
    words: dict[str, tuple[float, ...]] = {}
    base = np.array([math.log(x / n.sum()) if x else -50.0 for x in n])
    enough = reduce(lambda a, b: a | b, [F.col(f"n{d}") >= max(3.0, SUPPORT * n[d]) for d in k])
    # Only a word that is several times as frequent in one domain as in the others tells them apart by its presence.
    n_all, sums = float(n.sum()), [F.col(f"n{d}") for d in k]
    everywhere = reduce(lambda a, b: a + b, sums)
    lifted = reduce(lambda a, b: a | b, [(sums[d] / n[d] >= LIFT * (everywhere - sums[d] + 1) / (n_all - n[d] + 1)) for d in k if n[d]])
    seen = own.select("d", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("d") == d).alias(f"n{d}") for d in k]).where(enough & lifted)
    # How much a word tells: the information that its presence has about the domain.
    total = float(n.sum())
    here = reduce(lambda a, b: a + b, [F.col(f"n{d}") for d in k])

    def part(x: Column, row: Column, share: float) -> Column:
        return F.when((x > 0) & (row > 0), x / total * F.log(x / (row * F.lit(share)))).otherwise(0.0)

    told = reduce(lambda a, b: a + b, [part(F.col(f"n{d}"), here, n[d] / total) + part(F.lit(float(n[d])) - F.col(f"n{d}"), F.lit(total) - here, n[d] / total) for d in k if n[d]])
    for r in seen.withColumn("told", F.round(told, 12)).orderBy(F.desc("told"), "word").limit(WORDS).collect():
        q = [(r[f"n{d}"] + 0.25) / (n[d] + 1) for d in k]
        base += [math.log(1 - min(x, 0.999)) for x in q]
        words[r.word] = tuple(math.log(x / (1 - min(x, 0.999))) for x in q)
    return Classifier(tuple(domains), tuple(map(float, base)), bins, tuple(float(math.log(0.5 / (x + 20))) for x in n), words)


def rate_of(multipliers: tuple[float, ...]) -> Column:
    """A document's rate: 1 less the steps along its posterior, projected to what is not negative."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - reduce(lambda a, b: a + b, [F.col(f"__p{d}") * F.lit(float(x)) for d, x in enumerate(multipliers)]))


def fit_steps(rows: DataFrame, weights: list[float]) -> tuple[float, ...]:
    """The domains' multipliers that take the rates of (__tokens, __p0, ...) to the targets.

    They minimise sum(x r^2) / 2 + share . m + ridge |m|^2 / 2, x being a document's share of the tokens, whose gradient is that of
    the least squares: share - sum(x p r) + ridge m. It is piecewise quadratic, so a step scaled by the curvature of the documents
    above zero, shortened where it overshoots, ends at the optimum after a few rounds.
    """
    k = range(len(weights))
    share = np.array(weights, dtype=float) / sum(weights)
    total = float(rows.agg(F.sum("__tokens")).first()[0] or 0)
    m = np.zeros(len(weights))
    if not total:
        return tuple(m)
    pairs = [(i, j) for i in k for j in k if i <= j]
    x = F.col("__tokens") / total

    def sums(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each multipliers: half the sum of squares, the shares of the domains, and the curvature. One pass for all."""
        out = []
        for t in tried:
            r = rate_of(tuple(t))
            free = F.when(r > 0, x).otherwise(0.0)
            out += [F.sum(x * r * r) / 2, *(F.sum(x * r * F.col(f"__p{d}")) for d in k), *(F.sum(free * F.col(f"__p{i}") * F.col(f"__p{j}")) for i, j in pairs)]
        row, found = [float(v) for v in rows.agg(*out).first()], []
        for at in range(0, len(row), 1 + len(k) + len(pairs)):
            c = np.zeros((len(k), len(k)))
            for (i, j), v in zip(pairs, row[at + 1 + len(k) :], strict=False):
                c[i, j] = c[j, i] = v
            found.append((row[at], np.array(row[at + 1 : at + 1 + len(k)]), c))
        return found

    at = sums([m])[0]
    for ridge in RIDGES:
        while True:
            gradient = share - at[1] + ridge * m
            if np.abs(gradient).max() < TOLERANCE:
                break
            newton = -np.linalg.solve(at[2] + ridge * np.eye(len(m)), gradient)
            tried = [m + s * newton for s in STEPS]
            value = lambda t, f: f[0] + share @ t + ridge * (t @ t) / 2  # noqa: B023, E731
            found = sums(tried)
            best = min(range(len(tried)), key=lambda i: value(tried[i], found[i]))  # noqa: B023
            # At the precision of the sums no step goes down any more.
            if value(tried[best], found[best]) >= value(m, at) - 1e-15 * max(1.0, abs(value(m, at))):
                break
            m, at = tried[best], found[best]
        if np.abs(share - at[1]).max() < 1e-7:
            break
    return tuple(float(v) for v in m)


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Copies to keep: the rate in expectation over ids, and the same on every run."""
    return F.floor(rate + F.pmod(F.xxhash64(doc_id, F.lit(4)), F.lit(DRAW_STEPS)) / DRAW_STEPS).cast("long")


def _scored(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """The kept columns, __tokens and the posteriors of each row, as a written table."""
    model = fit_classifier(docs, labels, domains, id_col=id_col, text_col=text_col)
    p = [f"__p{d}" for d in range(len(domains))]
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("__text"))
    return materialize(model.add_to(with_statistics(rows, "__text")).select("kept", "__tokens", *p), "posteriors")


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, a posterior p_<domain> for each domain, rate and copies, for each row."""
    source = F.col(source_col) if source_col in docs.columns else F.lit(None).cast("string")
    scored = _scored(docs, labels, list(targets), id_col, text_col, [F.col(id_col).alias("doc_id"), source.alias("source")])
    rated = scored.withColumn("rate", F.round(rate_of(fit_steps(scored, list(targets.values()))), 6))
    names = [F.col(f"__p{d}").alias(f"p_{name}") for d, name in enumerate(targets)]
    return rated.select("kept.*", F.col("__tokens").alias("n_tokens"), *names, "rate", copies_of(F.col("rate"), F.col("kept.doc_id")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with all their columns."""
    scored = _scored(docs, labels, list(targets), id_col, text_col, [F.struct("*").alias("row"), F.col(id_col).alias("doc_id")])
    copies = copies_of(F.round(rate_of(fit_steps(scored, list(targets.values()))), 6), F.col("kept.doc_id"))
    drawn = scored.select("kept.row", copies.alias("copies")).where("copies > 0")
    return drawn.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """doc_id and the domain that quality and toxic stand for."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "plain")
    return labels.select("doc_id", domain.alias("domain"))


#: Shares of the tokens that the mixture should have.
TARGETS = {"plain": 0.90, "toxic": 0.05, "junk": 0.05}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rates(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels")), TARGETS)


QUERIES = {"op4_mixing": op4_mixing}
ORACLES: dict[str, str] = {}
