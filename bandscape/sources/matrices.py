"""Matrix text files: row count, column count, then ``v, v, …,`` per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import attach
from ..functions.runtime import is_written, materialise


def parse_matrix_text(files: DataFrame) -> DataFrame:
    """``(path, value)`` whole files to ``(path, y, x, value)``; a file with too
    few lines or cells gives no rows."""
    lines = F.split("value", "\r?\n")
    body = (files.withColumn("_lines", lines)
            .withColumn("_rows", F.coalesce(F.expr("try_cast(trim(_lines[0]) AS int)"), F.lit(0)))
            .withColumn("_cols", F.coalesce(F.expr("try_cast(trim(_lines[1]) AS int)"), F.lit(0)))
            .withColumn("_cells", F.expr("transform(slice(_lines, 3, greatest(_rows, 0)), l -> split(l, ','))")))
    # A separator at the end of a line does not open another cell.
    complete = F.expr("size(_cells) = _rows AND forall(_cells, c -> "
                      "size(c) - if(element_at(c, -1) = '', 1, 0) >= _cols)")
    number = F.expr("coalesce(try_cast(trim(cell) AS float), 0.0F)")
    return (body.filter(complete)
            .select("path", "_cols", F.posexplode("_cells").alias("y", "_row"))
            .select("path", "_cols", "y", F.posexplode("_row").alias("x", "cell"))
            .filter("x < _cols").select("path", "y", "x", number.alias("value")))


def numbered_lines(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """``(path, line_no, line)`` of text files, lines from 0.

    Files are read in byte ranges, so a file may be larger than any task; a line's
    number is its place in its range plus the lines of earlier ranges.  With
    ``folders`` the files of a folder, by name, are parts of one text.
    """
    file = F.col("_metadata.file_path")
    lines = materialise(spark.read.text(path).select(
        (F.regexp_replace(file, "/[^/]*$", "") if folders else file).alias("path"), file.alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_at")))
    part = ["path", "_file", "_block"]
    ranges = lines.groupBy(*part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("path").orderBy("_file", "_block")         # one row per range
    starts = ranges.select(*part, (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_start"))
    return attach(lines, starts, part).select("path", (F.col("_at") + F.col("_start")).alias("line_no"), "line")


def parse_matrix_lines(lines: DataFrame) -> DataFrame:
    """``(path, line_no, line)`` to ``(path, y, x, value)``; a file with too few lines or cells gives no rows."""
    lines = lines if is_written(lines) else materialise(lines)             # read for sizes, completeness and cells
    number = F.expr("coalesce(try_cast(trim(line) AS int), 0)")
    heads = lines.filter("line_no < 2").groupBy("path").agg(
        *[F.coalesce(F.max(F.when(F.col("line_no") == i, number)), F.lit(0)).alias(c) for i, c in enumerate(("_rows", "_cols"))])
    rows = lines.filter("line_no >= 2").withColumn("y", (F.col("line_no") - 2).cast("int"))

    def cells(sizes: DataFrame) -> DataFrame:
        return (attach(rows, sizes, ["path"], "inner", reread=True).filter("y < _rows")
                .withColumn("_cells", F.split("line", ",")))

    # A separator at the end of a line does not open another cell.
    whole = F.expr("size(_cells) - if(element_at(_cells, -1) = '', 1, 0) >= _cols")
    complete = (cells(heads).groupBy("path")
                .agg(F.count("*").alias("_n"), F.max("_rows").alias("_rows"), F.max("_cols").alias("_cols"), F.bool_and(whole).alias("_whole"))
                .filter("_n = _rows AND _whole").select("path", "_rows", "_cols"))
    return (cells(complete).select("path", "_cols", "y", F.posexplode("_cells").alias("x", "cell")).filter("x < _cols")
            .select("path", "y", "x", F.expr("coalesce(try_cast(trim(cell) AS float), 0.0F)").alias("value")))


def read_matrix_text(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """Matrices of all text files below ``path``, one a file (or one a folder, in
    parts as :func:`write_matrix_text` leaves them), as ``(path, y, x, value)``."""
    return parse_matrix_lines(numbered_lines(spark, path, folders))


def matrix_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Text lines of each scene's matrix as ``(scene_id, line_no, line)``."""
    cell = F.col(value)
    text = cell.cast("string")
    if isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        text = F.when(cell == F.rint(cell), cell.cast("bigint").cast("string")).otherwise(text)
    rows = (df.groupBy("scene_id", "y")
              .agg(F.array_sort(F.collect_list(F.struct("x", text.alias("v")))).alias("_r"))
              .select("scene_id", (F.col("y") + 2).cast("bigint").alias("line_no"),
                      F.concat(F.array_join("_r.v", ", "), F.lit(", ")).alias("line")))
    heads = (df.groupBy("scene_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
               .select("scene_id", F.posexplode(F.array(F.col("h").cast("string"), F.col("w").cast("string")))
                       .alias("line_no", "line")))
    return heads.select("scene_id", F.col("line_no").cast("bigint").alias("line_no"), "line").unionByName(rows)


def write_matrix_text(df: DataFrame, path: str, value: str = "value") -> None:
    """One matrix per scene, in the folder ``path/scene_id=…``.

    Lines are dealt by ranges of scene and line, so a large scene is written by
    many tasks; its part files in order of their names, one after another, are the
    matrix.  A small scene has a single file.
    """
    lines = materialise(matrix_lines(df, value))            # dealing by ranges reads them twice
    (lines.repartitionByRange("scene_id", "line_no").sortWithinPartitions("scene_id", "line_no")
     .select("scene_id", "line").write.mode("overwrite").partitionBy("scene_id").text(path))
