"""Rasters and tables derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import bands as B
from .schema import PIXEL


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raster8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table of 8-band scenes of 8×8 pixels: one vector is one band image,
    so its range is known within the row and nothing is shuffled."""
    vectors = load(spark, sf_dir, "embeddings").select(
        F.expr("vec_id DIV 8").alias("scene_id"), (F.col("vec_id") % 8 + 1).cast("int").alias("band"), "embedding",
        F.array_min("embedding").cast("double").alias("_lo"), F.array_max("embedding").cast("double").alias("_hi"))
    return (vectors.select("scene_id", "band", "_lo", "_hi", F.posexplode("embedding").alias("_i", "_v"))
            .select("scene_id", "band", F.expr("int(_i DIV 8)").alias("y"), F.expr("_i % 8").alias("x"),
                    S.round_u8(S.stretch(F.col("_v").cast("double"), F.col("_lo"), F.col("_hi"))).alias("value")))


def signal8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal of the complete scenes."""
    return B.complete_scenes(B.to_signal(raster8(spark, sf_dir), 8))


def labelled8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal with its mask in the same row: foreground where band 2 is bright."""
    return signal8(spark, sf_dir).withColumn("label", F.when(F.col("b2") >= 160, 255).otherwise(0).cast("smallint"))


def mask8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled8(spark, sf_dir).select(*PIXEL, "label")


def features8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, a score from band 3, a mask and the trimap they give."""
    scored = labelled8(spark, sf_dir).withColumn("score", F.col("b3") / 255.0)
    return B.trimap(B.feature_composite(scored)).select(
        *PIXEL, "c0", "c1", "c2", "score", F.col("label").alias("base"), "trimap")


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grey image: a row per vector."""
    image = (load(spark, sf_dir, "embeddings")
             .select(F.lit(0).cast("bigint").alias("scene_id"), F.col("vec_id").cast("int").alias("y"),
                     F.posexplode("embedding").alias("x", "value"))
             .withColumn("value", F.col("value").cast("double")))
    return B.minmax(image, ["scene_id"])


def mosaic_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic(spark, sf_dir).select(
        *PIXEL, F.when(F.col("value") >= 175, 255).otherwise(0).cast("smallint").alias("label"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral rows without a grid, with a label."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("scene_id"), F.col("l_quantity").alias("b1"),
        (F.col("l_extendedprice") / 1000.0).alias("b2"), F.col("l_discount").alias("b3"), F.col("l_tax").alias("b4"),
        F.when(F.col("l_quantity") >= 40, 255).otherwise(0).cast("smallint").alias("label"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pixels on the mosaic grid: three neighbouring values of a vector, the
    last ones going on at its start, so that all 64 take part."""
    return (load(spark, sf_dir, "embeddings")
            .select(F.lit(0).cast("bigint").alias("scene_id"), F.col("vec_id").cast("int").alias("y"),
                    F.array_min("embedding").cast("double").alias("_lo"),
                    F.array_max("embedding").cast("double").alias("_hi"), "embedding",
                    F.explode(F.sequence(F.lit(0), F.lit(21))).alias("x"))
            .select(*PIXEL, *[S.round_u8(S.stretch(F.col("embedding")[(F.col("x") * 3 + i) % 64].cast("double"),
                                                   F.col("_lo"), F.col("_hi"))).alias(c)
                              for i, c in enumerate("rgb")]))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File lists with ground truth, ignored names, duplicate slots and odd sizes."""
    band = (F.col("vec_id") % 8 + 1).cast("string")
    base = load(spark, sf_dir, "embeddings").select(
        F.expr("vec_id DIV 8").alias("scene_id"), band.alias("_b")).withColumn("_k", F.col("scene_id") % 6)
    k, b = F.col("_k"), F.col("_b")
    name = (F.when((k == 3) & (b == "3"), "z3.png").when((k == 4) & (b == "5"), "F1x.png")
             .otherwise(F.concat(F.lit("F"), b, F.lit("s.png"))))
    width = F.when((k == 5) & (b == "2"), 9).otherwise(8)
    listed = base.select("scene_id", name.alias("name"), F.lit(8).alias("height"), width.alias("width"))
    truth = base.filter((k == 2) & (b == "1")).select(
        "scene_id", F.lit("FGT.png").alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return listed.unionByName(truth)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per order line; a scene is an order, of which line numbers may repeat."""
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene_id"), F.row_number().over(lines).cast("bigint").alias("seg_id"),
        F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100.0).alias("y0"),
        (F.col("l_extendedprice") / 1000.0).alias("x1"), (F.col("l_tax") * 100.0).alias("y1"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_type", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
