"""What the operators share: words, text columns, stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.session import shared_dir

#: White space that separates words: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
#: A word, for regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Whether Spark deletes the shuffle files of a query at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: lineage ends here.

    The table outlives lost executors; its folder may be deleted when the session is over. With
    ``release`` the shuffle files of the write go when it is done, not when the driver next collects
    garbage.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    try:
        if release:
            spark.conf.set(CLEAN_UP, "true")
        df.write.parquet(path)
    finally:
        if release and before is None:
            spark.conf.unset(CLEAN_UP)
        elif release:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Reading tasks at most; beyond that each takes more.
MOST_TASKS = 50_000


def dealt(ranges: DataFrame, n: int, a_task: int, *keys: str) -> DataFrame:
    """``n`` small rows that each stand for a large piece of work, dealt out to tasks: ``a_task`` each,
    fewer where there are cores to spare. The number is fixed, as AQE would put such small rows
    together in one task."""
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    tasks = min(max(-(-n // a_task), 2 * cores), n, MOST_TASKS)
    return ranges.repartition(max(1, tasks), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(place: Column, share: Column) -> Column:
    """Whether a row is in a sample of that share (0 to 1), by its 64-bit hash. Steps are of 2e-16, so
    that a bounded sample of a table of any size has rows."""
    million = F.pmod(place, F.lit(1_000_000)) + F.shiftrightunsigned(place, 32) / 2.0**32
    return million / 1e6 < share


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays, unlike ``lower``."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text without nulls, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where lambdas refer to it often."""
    return F.transform(F.array(value), use)[0]
