"""Row-level cleaning flows over DataFrames with a ``text`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.functions import text as T
from seepage.functions.mail import mail_fields


def parse_mail(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace the raw message by its seven fields."""
    kept = [c for c in df.columns if c != raw]
    return df.select(*kept, *[c.alias(n) for n, c in mail_fields(F.col(raw)).items()])


def clean_mail(df: DataFrame) -> DataFrame:
    """Clean body, subject and date; addresses stay raw."""
    return df.withColumns({c: T.clean_mail(F.col(c)) for c in ("subject", "date", "body")})


def drop_null_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.dropna(subset=[column]).withColumn(column, F.col(column).cast("string"))


def clean_templates(df: DataFrame, column: str = "text") -> DataFrame:
    return drop_null_text(df, column).withColumn(column, T.squeeze(F.col(column)))


def drop_empty(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(F.length(column) > 0)


def clean_web(df: DataFrame, column: str = "text") -> DataFrame:
    return drop_empty(df.withColumn(column, T.clean_web(F.col(column))), column)


def drop_headings(df: DataFrame, column: str = "text") -> DataFrame:
    """Strip, then drop empty rows and ``=`` headings."""
    stripped = df.withColumn(column, T.strip(F.col(column)))
    return stripped.filter((F.col(column) != "") & ~T.is_heading(F.col(column)))


def clean_encyclopedia(df: DataFrame, column: str = "text") -> DataFrame:
    """Headings out, number marks joined, ASCII only. A row left empty stays."""
    return drop_headings(df, column).withColumn(
        column, T.ascii_only(T.join_number_marks(F.col(column)))
    )


def raw_clean_pairs(df: DataFrame, key: str, n: int = 1000, column: str = "text") -> DataFrame:
    """The first ``n`` rows, raw and cleaned side by side."""
    return (
        df.orderBy(key)
        .limit(n)
        .select(
            key,
            F.col(column).alias("raw_text"),
            T.clean_wiki(F.col(column)).alias("cleaned_text"),
        )
    )


def min_length(df: DataFrame, longer_than: int = 10, column: str = "text") -> DataFrame:
    return df.filter(F.length(T.strip(F.col(column))) > longer_than)


def prompt_pairs(df: DataFrame, order: str, n: int = 100, column: str = "text") -> DataFrame:
    """Prompt (first sentence) and reference (the rest) of the first ``n``
    texts, in order, that have both."""
    text = T.strip(F.col(column))
    pairs = (
        df.select(
            order,
            T.first_sentence(text).alias("prompt"),
            T.later_sentences(text).alias("reference"),
        )
        .filter((F.col("prompt") != "") & (F.col("reference") != ""))
        .orderBy(order)
        .limit(n)
    )
    # at most n rows reach this window
    place = F.row_number().over(Window.orderBy(order)) - 1
    return pairs.withColumn("pos", place.cast("bigint"))
