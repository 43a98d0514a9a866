"""Tables of documents as text: cells to rows and whole tables that retrieval can index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """cells (table_id, row_index, column_index, raw_text), tables (table_id, column_count[, caption]) -> table_id, row_index, line: the row's
    texts in the order of the columns, absent ones empty."""
    by_column = F.map_from_entries(F.collect_list(F.struct("column_index", F.coalesce("raw_text", F.lit("")))))
    # of cells that repeat a place the greatest text stays
    one = cells.groupBy("table_id", "row_index", "column_index").agg(F.max("raw_text").alias("raw_text"))
    per = one.groupBy("table_id", "row_index").agg(by_column.alias("texts")).join(tables.select("table_id", "column_count"), "table_id")
    places = F.when(F.col("column_count") > 0, F.sequence(F.lit(0), F.col("column_count") - 1)).otherwise(F.array().cast("array<int>"))
    return per.select("table_id", "row_index", F.array_join(F.transform(places, lambda i: F.coalesce(F.try_element_at("texts", i), F.lit(""))), " | ").alias("line"))


def row_texts(cells: DataFrame, tables: DataFrame, headers: bool = True) -> DataFrame:
    """table_id, row_index, text: a row by itself, under the columns' names if the table has a row 0."""
    every = rows(cells, tables)
    own = F.concat(F.lit("Row "), F.col("row_index"), F.lit(": "), F.col("line"))
    if not headers:
        return every.select("table_id", "row_index", own.alias("text"))
    names = every.where("row_index = 0").select("table_id", F.col("line").alias("names"))
    with_names = F.when((F.col("row_index") > 0) & F.col("names").isNotNull(), F.concat(F.lit("Columns: "), F.col("names"), F.lit("\n"), own)).otherwise(own)
    return every.join(names, "table_id", "left").select("table_id", "row_index", with_names.alias("text"))


def table_texts(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, text: caption, columns and all rows of a table; a table without any of these is named by its id."""
    every = rows(cells, tables)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: F.concat(F.lit("Row "), x["row_index"], F.lit(": "), x["line"]))
    body = every.groupBy("table_id").agg(F.max(F.when(F.col("row_index") == 0, F.concat(F.lit("Columns: "), F.col("line")))).alias("names"), F.array_join(lines, "\n").alias("body"))
    caption = F.trim("caption") if "caption" in tables.columns else F.lit(None).cast("string")
    whole = tables.select("table_id", F.when(caption != "", F.concat(F.lit("Caption: "), caption)).alias("head")).join(body, "table_id", "left")
    text = F.concat_ws("\n", "head", "names", "body")
    return whole.select("table_id", F.when(text == "", F.concat(F.lit("Table: "), F.col("table_id").cast("string"))).otherwise(text).alias("text"))
