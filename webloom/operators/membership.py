"""A membership structure for the seen-set that allows deletion: counters of hashed places, as a table.

Each key has a word and ``PLACES`` bits of it; the table counts the keys of each bit (word, bit, n). Tables of shards, days or crawls are merged by adding up, and a key is taken
out by taking its counts away, so a filter is kept up to date without reading the seen-set again. What a filter rules out isn't in the set; only the rest goes on to the exact
anti join, so results are exact. With n keys and w words of 64 bits a key that isn't there gets through with a chance of about (1 - exp(-n x PLACES / (64 w))) ** PLACES: 2 % at 10 bits a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 4
#: A filter goes to all tasks as 16 bytes a word; more words than this are refused.
MOST_WORDS = 1 << 22


def _word(key: str, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _bits(key: str) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(64)).cast("int") for i in range(1, PLACES + 1)]))


def words_for(keys: int, bits_a_key: int = 10) -> int:
    """How many words hold so many keys."""
    return max(1, -(-keys * bits_a_key // 64))


def members(keys: DataFrame, key: str, words: int) -> DataFrame:
    """word, bit, n of the distinct keys; null is none."""
    if words > MOST_WORDS:
        raise ValueError(f"a filter has {MOST_WORDS} words at most")
    rows = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return rows.select(_word(key, words).alias("word"), F.explode(_bits(key)).alias("bit")).groupBy("word", "bit").agg(F.count("*").alias("n"))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all the keys of filters that share none: counts are added."""
    both = filters[0]
    for f in filters[1:]:
        both = both.unionByName(f)
    return both.groupBy("word", "bit").agg(F.sum("n").alias("n")).where("n > 0")


def without(filter_: DataFrame, gone: DataFrame, key: str, words: int) -> DataFrame:
    """The filter after keys that it holds were deleted."""
    return merged(filter_, members(gone, key, words).withColumn("n", -F.col("n")))


def split(df: DataFrame, filter_: DataFrame, key: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in the set, rows that aren't); the filter goes to all tasks, nothing of df is shuffled."""
    packed = F.broadcast(filter_.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("__bits")).withColumnRenamed("word", "__word"))  # at most words rows
    wanted = F.aggregate(_bits(key), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    marked = df.withColumn("__want", wanted).join(packed, _word(key, words) == F.col("__word"), "left")
    may = F.coalesce(F.col("__bits").bitwiseAND(F.col("__want")) == F.col("__want"), F.lit(False)) & F.col(key).isNotNull()
    return marked.where(may).select(*df.columns), marked.where(~may).select(*df.columns)


def unseen(candidates: DataFrame, seen: DataFrame, filter_: DataFrame, key: str, words: int) -> DataFrame:
    """Candidates that the seen-set lacks, exactly: those that the filter rules out at once, the others by an anti join."""
    may, new = split(candidates, filter_, key, words)
    return new.unionByName(may.join(seen.select(key).distinct(), key, "left_anti").select(*candidates.columns))
