"""Tables: raw grids of cells to header and rows, and the cells of tables as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scalars import collapse


def clean_cell(cell: Column) -> Column:
    return F.coalesce(collapse(cell), F.lit(""))


def grid_to_table(grid: Column) -> Column:
    """struct<headers, rows> of array<array<string>>: cleaned, without blank rows, padded; null under two rows."""
    cleaned = F.filter(F.transform(grid, lambda r: F.transform(r, clean_cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(cleaned, lambda r: F.size(r)))
    padded = F.transform(cleaned, lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    return F.when(F.size(padded) >= 2, F.struct(padded[0].alias("headers"), F.slice(padded, 2, F.size(padded) - 1).alias("rows")))


def n_cells(headers: Column, rows: Column) -> Column:
    return F.coalesce(F.size(headers), F.lit(0)) + F.aggregate(F.coalesce(rows, F.array().cast("array<array<string>>")), F.lit(0), lambda a, r: a + F.coalesce(F.size(r), F.lit(0)))


def cells(tables: DataFrame, id_cols: list[str], headers: str = "headers", rows: str = "rows") -> DataFrame:
    """(*ids, r, c, cell): the header is row 0."""
    grid = F.concat(F.array(F.col(headers)), F.coalesce(F.col(rows), F.array().cast("array<array<string>>")))
    by_row = tables.select(*id_cols, F.posexplode(grid).alias("r", "row"))
    return by_row.select(*id_cols, "r", F.posexplode("row").alias("c", "cell"))
