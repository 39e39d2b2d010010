"""Cutting oversized texts at natural boundaries (problem 4).

All in SQL functions.  ``regexp_extract_all`` with bounded quantifiers cuts a text into bodies: its
alternatives, ordered by the strength of the boundary, take as many characters as the limit allows
and end behind a blank line, a line break, a sentence, white space, and at last behind any
character.  All but the last must fill at least half of the limit.  The bodies' running lengths
give offsets; a piece reaches back from its body by the overlap.  Lengths are code points.

Cases: null and empty texts, and texts not above the limit, are not oversized and yield nothing.
An overlap of the limit or more is taken as the limit less one.  Rows without a limit yield
nothing.  Repeated rows yield their pieces once.  Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What must stand before a cut, strongest first.
BOUNDARIES = (r"(?<=\n\s?\n)", r"(?<=\n)", r"(?<=[.!?…;:])(?=\s)|(?<=[。！？．।])", r"(?<=\s)")

#: Elements that are summed before their array is put away.
CHUNK = 1024


def limits(size_limits: DataFrame, item_field: str) -> DataFrame:
    """The one limit in characters of a field: the table is fixed at a few rows."""
    one = size_limits.where((F.col("item_field") == item_field) & (F.col("unit") == "characters") & (F.col("max_size") > 0))
    return one.groupBy("item_field").agg(F.min("max_size").alias("max_size"), F.max(F.coalesce("overlap", F.lit(0))).alias("overlap"))


def body_pattern(size: Column, overlap: Column) -> Column:
    """The pattern of one body for a limit."""
    most = (size - overlap).cast("string")
    least = F.greatest(F.lit(1), F.floor((size - overlap) / 2)).cast("string")
    strong = [F.concat(F.lit("|.{"), least, F.lit(","), most, F.lit("}(?:" + b + ")")) for b in BOUNDARIES]
    return F.concat(F.lit("(?s).{1,"), most, F.lit(r"}\z"), *strong, F.lit("|.{1,"), most, F.lit("}"))


def bodies(texts: DataFrame, limit: DataFrame) -> DataFrame:
    """Oversized texts (item_table, item_id, text) with their bodies."""
    over = texts.join(F.broadcast(limit)).where(F.char_length("text") > F.col("max_size"))
    over = over.withColumn("overlap", F.least(F.greatest("overlap", F.lit(0)), F.col("max_size") - 1))
    return over.withColumn("bodies", F.regexp_extract_all("text", body_pattern(F.col("max_size"), F.col("overlap")), F.lit(0)))


def _starts(lengths: Column) -> Column:
    """Running sums of an array before each element, in chunks, so that time grows with the array's length."""
    zero = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("chunk"), F.lit(0).alias("at"))

    def step(acc: Column, n: Column) -> Column:
        full = F.size(acc["chunk"]) >= CHUNK
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["chunk"])).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(acc["at"])).otherwise(F.array_append(acc["chunk"], acc["at"])).alias("chunk"),
            (acc["at"] + n).alias("at"),
        )

    return F.aggregate(lengths, zero, step, lambda acc: F.flatten(F.array_append(acc["done"], acc["chunk"])))


def pieces(cut: DataFrame) -> DataFrame:
    """(item_table, item_id, piece_no, start_pos, end_pos, piece) of what ``bodies`` returns.

    A piece is its body behind the end of the bodies before it, of which at most ``back`` reach into
    the overlap; no piece is looked up in the whole text.
    """
    least = F.greatest(F.lit(1), F.floor((F.col("max_size") - F.col("overlap")) / 2))
    back = F.ceil(F.col("overlap") / least).cast("int")
    row = cut.select("item_table", "item_id", "bodies", F.col("overlap").cast("int").alias("overlap"), back.alias("back"), _starts(F.transform("bodies", F.char_length)).alias("starts"))

    def piece(body: Column, i: Column) -> Column:
        before = F.array_join(F.slice("bodies", F.greatest(F.lit(1), i + 1 - F.col("back")), F.least(i, F.col("back"))), "")
        start = F.element_at("starts", i + 1)
        end = start + F.char_length(body)
        return F.struct(F.greatest(F.lit(0), start - F.col("overlap")).alias("start_pos"), end.alias("end_pos"), F.concat(F.right(before, F.col("overlap")), body).alias("piece"))

    flat = row.select("item_table", "item_id", F.posexplode(F.transform("bodies", piece)).alias("piece_no", "p"))
    return flat.select("item_table", "item_id", "piece_no", "p.start_pos", "p.end_pos", "p.piece")


def items(sources: list[tuple[str, DataFrame, str, str, DataFrame]]) -> DataFrame:
    """The oversized items of several tables: (table, frame, key, text column, limit) each."""
    parts = [
        bodies(df.select(F.lit(name).alias("item_table"), F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")), limit)
        for name, df, key, text, limit in sources
    ]
    return reduce(DataFrame.unionByName, parts)
