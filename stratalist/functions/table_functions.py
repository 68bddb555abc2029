"""Query expansion and board harvest as table functions, for use in SQL.

    register(spark)
    select * from search_phrases(array('FPGA Engineer'), array('uvm'), array('Austin'), 60)
    select * from harvest_boards(table(select provider, board, company, source, extra, at from seen))

Rows of a board come together, in the order of ``at``, and one row stays in memory however many there are. A row with a column ``n`` stands for so many:
``fold_seen`` leaves at most two rows of a board, before any reach Python. For frames ``discovery.harvest_boards`` is the faster way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .queries import search_phrases

PHRASES = StructType().add("phrase", StringType()).add("place", StringType())
HARVEST = StructType().add("provider", StringType()).add("board", StringType()).add("company", StringType()).add("source", StringType()).add("extra", StringType()).add("n", LongType())
SEEN = ["provider", "board", "company", "source", "extra", "at"]


class SearchPhrases:
    @staticmethod
    def analyze(roles: AnalyzeArgument, keywords: AnalyzeArgument | None = None, places: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, x in (("roles", roles), ("keywords", keywords), ("places", places)):
            if x is not None and not (isinstance(x.dataType, ArrayType) and isinstance(x.dataType.elementType, (StringType, NullType))):
                raise ValueError(f"{name} must be an array of strings")
        return AnalyzeResult(schema=PHRASES)

    def eval(self, roles, keywords=(), places=(), most=60):
        yield from search_phrases(list(roles or []), list(keywords or []), list(places or []), limit=most)


class HarvestBoards:
    @staticmethod
    def analyze(seen: AnalyzeArgument) -> AnalyzeResult:
        if not seen.isTable or (lacking := set(SEEN) - set(seen.dataType.names)):
            raise ValueError(f"a table with {', '.join(SEEN)} is needed" + ("" if not seen.isTable else f"; it lacks {', '.join(sorted(lacking))}"))
        return AnalyzeResult(schema=HARVEST, partitionBy=[PartitioningColumn("provider"), PartitioningColumn("board")], orderBy=[OrderingColumn("at")])

    def __init__(self) -> None:
        self.first, self.extra, self.n = None, None, 0

    def eval(self, row):
        if self.first is None:
            self.first = row
        self.extra = self.extra or row["extra"] or None
        self.n += row["n"] if "n" in row.__fields__ else 1

    def terminate(self):
        if self.first is not None:
            r = self.first
            yield r["provider"], r["board"], r["company"], r["source"], self.extra, self.n


def fold_seen(seen: DataFrame) -> DataFrame:
    """The rows of each board that its harvest is read from: the first, with the number of all, and the first with an extra, which counts as none."""
    row = F.struct("company", "source", "extra", "at")
    has = F.coalesce("extra", F.lit("")) != ""
    by = seen.groupBy("provider", "board").agg(F.min_by(row, "at").alias("first"), F.min_by(row, F.when(has, F.col("at"))).alias("said"), F.count("*").alias("n"))
    return by.select("provider", "board", "first.*", "n").unionByName(by.where("said.at > first.at").select("provider", "board", "said.*", F.lit(0).cast("long").alias("n")))


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("search_phrases", udtf(SearchPhrases))
    spark.udtf.register("harvest_boards", udtf(HarvestBoards))
