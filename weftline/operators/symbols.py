"""Symbols: boundary filter, line repair, normalisation and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import BOUNDARY_KINDS, qualified_name
from weftline.operators.dealing import dealt, tasks



def boundary_symbols(symbols: DataFrame, line_base: str = "auto") -> DataFrame:
    """Symbols that bound chunks, with 1-based lines. ``auto`` shifts a file's lines only if one of its boundary symbols starts or
    ends at 0; ``zero`` always does."""
    kept = symbols.where(F.lower("kind").isin(*BOUNDARY_KINDS))
    if line_base == "zero":
        shift = F.lit(1)
    else:
        shift = F.max(((F.col("start_line") == 0) | (F.col("end_line") == 0)).cast("int")).over(Window.partitionBy("file_path"))
    return kept.withColumn("shift", shift).withColumn("start_line", F.col("start_line") + F.col("shift")).withColumn("end_line", F.col("end_line") + F.col("shift")).drop("shift")


def symbol_error(name: Column, id_: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "EmptySymbolName").when(F.coalesce(id_, F.lit("")) == "", "EmptySymbolId")


def normalize_symbols(symbols: DataFrame, language: Column | None = None) -> DataFrame:
    """Valid symbols with qualified names; symbols of one file, kind and name are overloads, numbered by lines."""
    same = Window.partitionBy("file_path", "kind", "name")
    kept = symbols.where(symbol_error(F.col("name"), F.col("id")).isNull())
    many = F.count(F.lit(1)).over(same) > 1
    nth = F.row_number().over(same.orderBy("start_line", "end_line", "ord")) - 1
    return kept.select(
        "id", "name", qualified_name(F.col("name"), F.col("scope")).alias("qualified_name"), "kind", "file_path",
        (F.lit(None).cast("string") if language is None else language).alias("language"), "start_line", "end_line", "signature", many.alias("is_overloaded"), F.when(many, nth).otherwise(0).alias("overload_index"),
    )


def symbol_index(symbols: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """One symbol per file and id: of repeated ids the last counts. By default as many tasks as the files that are read ask for."""
    symbols = dealt(symbols, n_tasks or tasks(symbols), "file_path")
    last = F.row_number().over(Window.partitionBy("file_path", "id").orderBy(F.col("ord").desc()))
    return symbols.withColumn("nth", last).where("nth = 1").drop("nth")


def enclosing(symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """For each position (file_path, pos_id, start, end) the innermost symbol around it, null if none.

    The join runs inside the file; of the symbols around a position an aggregate keeps the smallest."""
    s = symbols.select("file_path", F.col("id").alias("caller_symbol_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"), "ord")
    around = positions.join(s, (positions["file_path"] == s["file_path"]) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")), "left").select(positions["*"], "caller_symbol_id", "s", "e", "ord")
    keys = positions.columns
    best = F.min_by("caller_symbol_id", F.struct(F.col("e") - F.col("s"), -F.col("s"), -F.col("ord")))
    return around.groupBy(*keys).agg(best.alias("caller_symbol_id"))
