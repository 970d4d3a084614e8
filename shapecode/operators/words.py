"""Word counts.

Words are the maximal runs of letters (of any script) of the lower-cased text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_PATTERN = r"\p{L}+"


def word_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, word_count=1)`` per occurrence (P9 lower-cases)."""
    return docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), 0))
                       .alias("word")).select("word", F.lit(1).cast("bigint").alias("word_count"))


def word_totals(rows: DataFrame) -> DataFrame:
    """A1: sum by word (map-side partial aggregation before the shuffle)."""
    return rows.groupBy(F.lower("word").alias("word")).agg(F.sum("word_count").cast("bigint").alias("word_count"))


def top_words(totals: DataFrame, k: int = 10) -> DataFrame:
    """L2: top-k by count, ties by word (TakeOrderedAndProject)."""
    return totals.orderBy(F.desc("word_count"), "word").limit(k)


def words_over(totals: DataFrame, minimum: int) -> DataFrame:
    """P10: words with ``word_count > minimum``."""
    return totals.where(F.col("word_count") > F.lit(minimum))
