"""Recorded payloads of boards as a data source: failures as rows, filters pushed into the reader.

A recorded run is a folder in one of two layouts. A short registry goes into the option ``boards``: the pages of each board, one JSON page a
line, are at ``provider=<p>/board=<b>/``, one input partition a board. A registry of any length is recorded with the pages (``record_run``): each
file holds whole boards in order, every board's registration before its pages, and is one input partition; neither passes through the driver.
``recorded_boards`` reads a run in one of two modes: ``listings`` gives the postings of the boards that could be read, each as its JSON, and
``status`` one row a board. A board without pages, or one of whose pages cannot be read, fails alone: it has no postings and a status row with the error.

    register(spark)
    spark.read.format("recorded_boards").option("path", run).option("boards", registry_option(boards)).load()
    spark.read.format("recorded_boards").option("path", run).load()

Filters on ``provider`` and ``board`` prune partitions; filters on ``title`` drop a posting before anything else of it is touched. What
the reader cannot judge goes back to Spark. Options ``title_terms`` (words of which a title must hold one) and ``intern_titles`` (the title gate)
push what no column filter can say.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from ..operators.prefilter import INTERN_TITLE, OFF_DOMAIN
from .payloads import LISTS

# Where a posting has its id and title, where not under "id" and "title".
ID_FIELDS = {"workable": "shortcode", "arbeitnow": "slug"}
TITLE_FIELDS = {"lever": "text", "smartrecruiters": "name", "themuse": "name"}
TOP_LEVEL = ("lever", "curated")
ERROR_CHARS, EXAMPLE_CHARS = 500, 120
#: What a line of a file of boards is; registrations sort first.
REGISTERED, PAGE = "0", "1"


@dataclass
class Board(InputPartition):
    provider: str
    board: str
    speculative: bool = False


@dataclass
class Recorded(InputPartition):
    """A file of whole boards."""

    file: str


def registry_option(boards: Iterable[tuple[str, str, bool]]) -> str:
    """(provider, board, speculative) as the ``boards`` option."""
    return json.dumps([list(b) for b in boards])


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def pages(path: str, b: Board) -> Iterator[object]:
    """The parsed pages of a board; raises for a board without any, or with one that is no JSON."""
    from pyarrow import fs

    system, root = _folder(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/provider={b.provider}/board={b.board}", allow_not_found=True))
    files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    if not files:
        raise FileNotFoundError("no recorded payload")
    for at in files:
        with system.open_input_stream(at) as stream:
            for line in stream.read().decode().splitlines():
                if line.strip():
                    yield json.loads(line)


def recorded_files(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _folder(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith(("_", ".")))


def recorded_boards(path: str, file: str) -> Iterator[tuple[Board, Iterator[object]]]:
    """Each registered board of a file with its parsed pages, which must be read before the next board; pages of no registered board are passed over."""
    from itertools import groupby

    system, _ = _folder(path)
    with system.open_input_stream(file) as stream, io.TextIOWrapper(stream, encoding="utf-8", newline="\n") as text:
        lines = (line.rstrip("\n").split("\t", 2) for line in text)
        for name, own in groupby(lines, key=lambda x: x[0]):
            first = next(own)
            if first[1] == REGISTERED:
                yield Board(*json.loads(name), first[2] == "true"), _parsed(x[2] for x in own if x[1] == PAGE)


def _parsed(lines: Iterator[str]) -> Iterator[object]:
    some = False
    for line in lines:
        some = True
        if line.strip():
            yield json.loads(line)
    if not some:
        raise FileNotFoundError("no recorded payload")


def postings(page: object, provider: str, keep: Callable[[str | None], bool]) -> Iterator[tuple[str | None, str | None, dict]]:
    """(id, title, posting) of a page's postings whose title is kept; nothing else of the rest is looked at."""
    found = page if provider in TOP_LEVEL else page[LISTS.get(provider, "jobs")]
    if not isinstance(found, list):
        raise ValueError("the payload holds no list of postings")
    for p in found:
        title = p.get(TITLE_FIELDS.get(provider, "title"))
        if keep(title):
            key = p.get(ID_FIELDS.get(provider, "id"))
            yield None if key is None else str(key), title, p


def _java_free(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?iU)", ""), re.IGNORECASE)


def title_judge(filters: list[Filter], terms: list[str], intern_terms: list[str] | None) -> Callable[[str | None], bool]:
    """Whether a title passes all pushed filters and options."""
    tests: list[Callable[[str | None], bool]] = []
    for f in filters:
        test = {
            EqualTo: lambda t, v: t == v, In: lambda t, v: t in v, StringContains: lambda t, v: t is not None and v in t, StringStartsWith: lambda t, v: t is not None and t.startswith(v),
            StringEndsWith: lambda t, v: t is not None and t.endswith(v), IsNotNull: lambda t, v: t is not None,
        }[type(f)]
        tests.append(lambda t, test=test, value=getattr(f, "value", None): test(t, value))
    if terms:
        words = set(terms)
        tests.append(lambda t: not words.isdisjoint((t or "").lower().split()))
    if intern_terms is not None:
        intern, off = _java_free(INTERN_TITLE), _java_free(OFF_DOMAIN)
        signal = lambda t: not intern_terms or any(x in t.lower() for x in intern_terms)
        tests.append(lambda t: not t or (bool(intern.search(t)) and not (off.search(t) and not signal(t))))
    return lambda t: all(test(t) for test in tests)


class BoardReader(DataSourceReader):
    JUDGED = (EqualTo, In, StringContains, StringStartsWith, StringEndsWith, IsNotNull)

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.mode = options["path"], options.get("mode", "listings")
        self.boards = [Board(*b) for b in json.loads(options["boards"])] if "boards" in options else None
        self.wanted: list[tuple[str, set[str]]] = []
        self.terms = json.loads(options.get("title_terms", "[]"))
        self.intern_terms = json.loads(options["intern_titles"]) if "intern_titles" in options else None
        self.on_title: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what it can judge; yields the rest, which Spark judges."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, self.JUDGED) and len(f.attribute) == 1 else None
            if column in ("provider", "board") and isinstance(f, (EqualTo, In, IsNotNull)):
                if not isinstance(f, IsNotNull):
                    self.wanted.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif column == "title" and self.mode == "listings":
                self.on_title.append(f)
            else:
                yield f

    def judged(self, b: Board) -> bool:
        return all(getattr(b, column) in values for column, values in self.wanted)

    def partitions(self) -> list[InputPartition]:
        if self.boards is None:
            return [Recorded(f) for f in recorded_files(self.path)] or [Board("", "")]
        return [b for b in self.boards if self.judged(b)] or [Board("", "")]

    def read(self, part: Board | Recorded) -> Iterator[tuple]:
        keep = title_judge(self.on_title, self.terms, self.intern_terms)
        if isinstance(part, Recorded):
            for b, own in recorded_boards(self.path, part.file):
                if self.judged(b):
                    yield from self.board_rows(b, own, keep)
        elif part.provider:  # some board is left
            yield from self.board_rows(part, pages(self.path, part), keep)

    def board_rows(self, b: Board, own: Iterator[object], keep: Callable[[str | None], bool]) -> Iterator[tuple]:
        rows, error = [], None
        try:
            for page in own:
                rows += [(key, title, json.dumps(p)) for key, title, p in postings(page, b.provider, keep)] if self.mode == "listings" else [None] * sum(1 for _ in postings(page, b.provider, keep))
        except Exception as e:  # a failing board is a row, not the end of the job
            rows, error = [], f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        if self.mode == "listings":
            yield from ((b.provider, b.board, b.speculative, *r) for r in rows)
        else:
            yield b.provider, b.board, b.speculative, error is None, len(rows), error


class RecordedBoards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_boards"

    def schema(self) -> str:
        own = "ok boolean, found long, error string" if self.options.get("mode") == "status" else "source_job_id string, title string, posting string"
        return f"provider string, board string, speculative boolean, {own}"

    def reader(self, schema) -> DataSourceReader:
        return BoardReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedBoards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def record(payloads: DataFrame, path: str) -> None:
    """Writes pages (provider, board, payload: JSON in one line) as a recorded run."""
    payloads.select("provider", "board", F.col("payload").alias("value")).repartition("provider", "board").write.partitionBy("provider", "board").text(path)


def record_run(payloads: DataFrame, registry: DataFrame, path: str) -> None:
    """Writes pages (provider, board, payload: JSON in one line) and the registry (provider, board, speculative: a row a board) as one recorded run.

    The names as JSON hold no tab; whole boards go to one file, in as many files as Spark makes partitions of them.
    """
    name = F.to_json(F.array("provider", "board")).alias("name")
    lines = payloads.select(name, F.lit(PAGE).alias("kind"), F.coalesce("payload", F.lit("")).alias("rest"))
    lines = lines.unionByName(registry.select(name, F.lit(REGISTERED).alias("kind"), F.coalesce("speculative", F.lit(False)).cast("string").alias("rest")))
    lines.repartition("name").sortWithinPartitions("name", "kind").select(F.concat_ws("\t", "name", "kind", "rest").alias("value")).write.text(path)


def source_status(status: DataFrame, needs: dict[str, list[str]] | None = None, credentials: Iterable[str] = (), sources: Iterable[str] = ()) -> DataFrame:
    """One row a source: attempted, succeeded, found, status and error, over its registered boards.

    Speculative boards are guesses, so their failures count for nothing, but what they hold counts as found. All registered boards failing
    is a failure (and nothing is found), some failing is ``degraded``; a source whose credentials are missing is ``unconfigured``;
    one of ``sources`` without boards is ok.
    """
    spark, given = status.sparkSession, set(credentials)
    registered = ~F.col("speculative")
    failures = F.concat("board", F.lit(": "), F.substring("error", 1, EXAMPLE_CHARS))
    by = status.groupBy(F.col("provider").alias("source")).agg(
        F.count_if(registered).alias("attempted"), F.count_if(registered & F.col("ok")).alias("succeeded"), F.sum("found").alias("found"), F.min(F.when(registered & ~F.col("ok"), failures)).alias("example"),
    )
    known = spark.createDataFrame([(s, ", ".join(k for k in (needs or {}).get(s, []) if k not in given)) for s in sorted({*sources, *(needs or {})})], "source string, lacking string")
    both = by.join(F.broadcast(known), "source", "full_outer")  # a row a source
    lacking, failed = F.coalesce("lacking", F.lit("")) != "", (F.col("attempted") > 0) & (F.col("succeeded") == 0)
    status_ = F.when(lacking, "unconfigured").when(failed, "failed").when(F.col("succeeded") < F.col("attempted"), "degraded").otherwise("ok")
    error = F.when(lacking, F.concat(F.lit("missing credentials: "), "lacking")).when(failed, F.concat(F.lit("all "), "attempted", F.lit(" registered boards failed: "), "example"))
    error = error.when(F.col("succeeded") < F.col("attempted"), F.concat("succeeded", F.lit("/"), "attempted", F.lit(" boards succeeded")))
    n = lambda c: F.when(lacking, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return both.select("source", n("attempted"), n("succeeded"), F.when(failed | lacking, 0).otherwise(F.coalesce("found", F.lit(0))).cast("long").alias("found"), status_.alias("status"), error.alias("error"))


def query_status(results: DataFrame, most: int = 12) -> DataFrame:
    """The same for sources that are searched by phrases: results (source, query, at, ok, found). Of a source's queries the first ``most`` count;
    it has failed only if all of them did."""
    own = results.where(F.col("at") < most).groupBy("source").agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"), F.sum(F.when(F.col("ok"), F.col("found")).otherwise(0)).alias("found"))
    failed = (F.col("attempted") > 0) & (F.col("succeeded") == 0)
    return own.select("*", F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, F.concat(F.lit("all "), "attempted", F.lit(" queries failed"))).alias("error"))


def board_yield(status: DataFrame) -> DataFrame:
    """How many postings each registered board gave that could be read."""
    return status.where("ok and not speculative").select("provider", "board", "found")
