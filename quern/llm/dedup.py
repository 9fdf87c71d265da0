"""Problem 3: duplicates hidden by formatting, by dictionary-encoded columns.

Each distinct value of the fields is canonicalised once and gets an integer identifier; records become sorted tuples of
identifiers, and the compact tuples are grouped. The identifier is a pair (64-bit hash of the canonical form, rank among the
canonical forms with that hash), so different values never share one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut, salted_lookup

_DROP = r"[^\p{L}\p{Nd}]+"


def canonical(value: Column) -> Column:
    """Lower-case letters and digits of value; after the first question mark the parts between & come in sorted order.

    Null stays null; a text without letters or digits becomes the empty text.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), _DROP, "")
    mark = F.locate("?", value)
    before = F.substring_index(value, "?", 1)
    after = F.when(mark > 0, value.substr(mark + 1, F.length(value))).otherwise(F.lit(""))
    ordered = F.array_sort(F.filter(F.transform(F.split(after, "&"), plain), lambda x: x != ""))
    return F.concat(plain(before), F.concat_ws("", ordered))


def encoded(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Rows (id, tuple) of df: the tuple holds the identifiers of the fields' values, sorted.

    Rows with a null field are left out. Every other row comes once, repeated rows as often as they stand in df.
    """
    rows = df.select(F.col(id_col).alias("row_id"), *[F.col(f).cast("string").alias(f"v{k}") for k, f in enumerate(fields)]).dropna(subset=[f"v{k}" for k in range(len(fields))])
    distinct = rows.select(F.explode(F.array(*[f"v{k}" for k in range(len(fields))])).alias("value")).groupBy("value").agg(F.count("*").alias("n_rows"))
    forms = distinct.withColumn("form", canonical(F.col("value"))).withColumn("hash", F.xxhash64("form"))
    rank = F.dense_rank().over(Window.partitionBy("hash").orderBy("form"))
    dictionary = forms.select("value", "n_rows", F.struct("hash", rank.alias("rank")).alias("ident"))
    for k in range(len(fields)):
        rows = salted_lookup(rows, dictionary.withColumnsRenamed({"value": f"v{k}", "ident": f"i{k}"}), [f"v{k}"]).drop(f"v{k}")
    return rows.select("row_id", F.array_sort(F.array(*[f"i{k}" for k in range(len(fields))])).alias("tuple"))


def duplicate_groups(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row (first_id, n_copies, tuple) for each group of rows that are the same but for formatting.

    Groups are counted before the shuffle, so a group may hold any share of the rows. Rows with a null field belong to no
    group; an empty table gives no rows; ties of id_col count as rows of their own.
    """
    return encoded(df, id_col, fields).groupBy("tuple").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n_copies"))


def duplicates(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """One row (first_id, copy_id) for each row that copies an earlier one (by id_col) of its group."""
    rows = encoded(df, id_col, fields)
    groups = rows.groupBy("tuple").agg(F.min("row_id").alias("first_id"), F.count("*").alias("n_rows")).where("n_rows > 1")
    return salted_lookup(rows, groups, ["tuple"]).where("row_id <> first_id").select("first_id", F.col("row_id").alias("copy_id"))


def collapsed(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """df with one row for each group and column n_copies; rows with a null field stay, each for itself, with 1.

    A group keeps its row of the smallest id, null ids last, one of them at ties. A column n_copies of df is replaced. The rows
    are numbered and written once, so that repeated and null ids don't matter.
    """
    numbered = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    rows = encoded(numbered, "__row", fields)
    ids = numbered.select(F.col("__row").alias("row_id"), F.col(id_col).alias("own"))
    first = F.min(F.struct(F.col("own").isNull().alias("late"), "own", "row_id")).alias("first")
    groups = rows.join(ids, "row_id").groupBy("tuple").agg(first, F.count("*").alias("n_copies")).select(F.col("first.row_id").alias("__row"), F.col("n_copies").alias("__copies"))
    with_null = F.lit(False)
    for f in fields:
        with_null = with_null | F.col(f).isNull()
    kept = numbered.join(groups, "__row", "left").where(F.col("__copies").isNotNull() | with_null)
    return kept.withColumn("n_copies", F.coalesce("__copies", F.lit(1).cast("long"))).drop("__row", "__copies")
