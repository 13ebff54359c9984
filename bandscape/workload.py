"""One query per operator, on rasters and tables derived from the parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .operators import bands as B
from .operators import cut as CUT
from .operators import blobs as BL
from .operators import forest as FO
from .operators import masks as M
from .operators import neighborhood as N
from .operators import score as SC
from .operators import segment as SG
from .operators import segments as SE
from .operators import stats as ST
from .plans import scenes as PL
from .schema import PIXEL
from .sources import catalog, images, matrices, sinks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str, digits: int | None = 6) -> DataFrame:
    """Round sums whose last bits depend on row order; adding 0.0 turns a
    negative zero into zero.  Row-wise arithmetic needs no digits."""
    value = (lambda c: F.col(c)) if digits is None else (lambda c: F.round(F.col(c), digits))
    return df.withColumns({c: value(c) + F.lit(0.0) for c in columns})


# --- sources and sinks -------------------------------------------------------

@query
def scene_catalog(spark, sf):
    return catalog.scene_catalog(fx.files(spark, sf))


@query
def scene_validation(spark, sf):
    return catalog.validate_scenes(catalog.scene_catalog(fx.files(spark, sf)))


@query
def scene_validation_plugin(spark, sf):
    return catalog.validate_scenes(catalog.scene_catalog(fx.files(spark, sf)), max_entries=8)


@query
def accepted_bands(spark, sf):
    listed = catalog.scene_catalog(fx.files(spark, sf))
    return catalog.accepted_bands(listed, catalog.validate_scenes(listed))


@query
def open_catalog(spark, sf):
    named = fx.files(spark, sf).withColumn("name", F.regexp_replace("name", "^FGT", "mask"))
    return catalog.open_catalog(named)


def _image_rows(spark, sf):
    """Decoded images as Spark's image source gives them, one per band image."""
    hexed = fx.raster8(spark, sf).groupBy("scene_id", "band").agg(
        F.array_sort(F.collect_list(F.struct("y", "x", F.lpad(F.hex("value"), 2, "0").alias("h")))).alias("_p"))
    return hexed.select(
        "scene_id", F.col("scene_id").cast("string").alias("scene"),
        F.concat(F.lit("F"), F.col("band"), F.lit("s.png")).alias("name"), F.lit(8).alias("height"),
        F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join("_p.h", "")).alias("data"))


@query
def image_scan(spark, sf):
    samples = images.image_samples(_image_rows(spark, sf))
    return images.grey_pixels(samples).select("scene_id", "name", "band", "y", "x", "value")


@query
def channel_split(spark, sf):
    c = fx.colours(spark, sf)
    return images.split_channels(c.select(*PIXEL, F.lit(3).alias("channels"), F.col("b").alias("c0"),
                                          F.col("g").alias("c1"), F.col("r").alias("c2")))


def _band_images(spark, sf):
    """Every band image as a scene of its own."""
    return fx.raster8(spark, sf).select((F.col("scene_id") * 8 + F.col("band") - 1).alias("scene_id"), "y", "x", "value")


def _matrix_lines(spark, sf):
    return matrices.matrix_lines(_band_images(spark, sf))


@query
def matrix_text_write(spark, sf):
    return _matrix_lines(spark, sf)


@query
def matrix_text_read(spark, sf):
    lines = _matrix_lines(spark, sf).select(F.col("scene_id").cast("string").alias("path"), "line_no", "line")
    return matrices.parse_matrix_lines(lines).withColumn("value", F.col("value").cast("double"))


@query
def mask_sink(spark, sf):
    return sinks.inverted(fx.mask8(spark, sf))


@query
def rotate_quarter(spark, sf):
    return sinks.rotate_quarter(fx.mosaic(spark, sf), 1)


# --- projections, filters, reshape -------------------------------------------

@query
def to_gray(spark, sf):
    return B.to_gray(fx.colours(spark, sf))


@query
def rescale_depth(spark, sf):
    deep = fx.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.floor(F.col("l_extendedprice")) % 2048).cast("int").alias("sample"))
    return B.rescale_depth(deep, "sample", "value")


@query
def normalise_mixed_depth(spark, sf):
    deep = F.col("band") % 2 == 0
    pixels = fx.raster8(spark, sf).withColumns({
        "depth": F.when(deep, 16).otherwise(8), "value": F.when(deep, F.col("value") * 5 + F.col("band")).otherwise(F.col("value"))})
    return B.normalise_bands(pixels)


@query
def band_minmax(spark, sf):
    halved = fx.raster8(spark, sf).withColumn("value", F.expr("value DIV 2 + 7").cast("int"))
    return B.minmax(halved)


@query
def band_selectors(spark, sf):
    pixels = fx.raster8(spark, sf)
    return (B.vis_band(pixels).withColumn("role", F.lit("vis"))
            .unionByName(B.bg_band(pixels).withColumn("role", F.lit("bg"))))


@query
def background_removed(spark, sf):
    return B.remove_background(B.to_signal(fx.raster8(spark, sf), 8)).select(*PIXEL, "value")


@query
def mask_invert(spark, sf):
    return B.invert(fx.mask8(spark, sf))


@query
def mask_binarise(spark, sf):
    return B.binarise(fx.raster8(spark, sf), "value")


@query
def unit_scaling(spark, sf):
    return _rounded(B.to_unit(fx.raster8(spark, sf), "value"), "value")


@query
def foreground_rows(spark, sf):
    return B.foreground(fx.signal8(spark, sf), fx.mask8(spark, sf))


@query
def outlier_flags(spark, sf):
    return ST.flag_outliers(fx.labelled8(spark, sf)).select(*PIXEL, "label")


@query
def spectral_mean_std(spark, sf):
    return B.spectral_mean_std(fx.signal8(spark, sf)).select(*PIXEL, "mean", "std")


@query
def feature_composite(spark, sf):
    return B.feature_composite(fx.signal8(spark, sf)).select(*PIXEL, "c0", "c1", "c2")


@query
def trimap(spark, sf):
    scores = fx.signal8(spark, sf).select(*PIXEL, (F.col("b3") / 255.0).alias("score"))
    return B.trimap(scores, fx.mask8(spark, sf)).select(*PIXEL, "label", "trimap")


@query
def trimap_forest(spark, sf):
    scored = fx.labelled8(spark, sf).withColumn("score", F.col("b3") / 255.0)
    return B.trimap(scored, preset="forest").select(*PIXEL, "label", "trimap")


@query
def trimap_to_mask(spark, sf):
    return B.trimap_to_mask(fx.features8(spark, sf)).select(*PIXEL, "label")


@query
def pseudo_color(spark, sf):
    return B.pseudo_color(fx.features8(spark, sf)).select(*PIXEL, "r", "g", "b")


@query
def zero_scores(spark, sf):
    table = fx.features8(spark, sf)
    return _rounded(B.zero_scores(table.select(*PIXEL, "score"), table.filter("c0 > 200")), "score")


@query
def segment_attrs(spark, sf):
    return _rounded(SE.segment_attrs(fx.segments(spark, sf)), "x0", "y0", "x1", "y1", "length", "cx", "cy",
                    "slope", digits=None)


@query
def rotate_segments(spark, sf):
    turned = SE.rotate_segments(fx.segments(spark, sf), 20.0, 5.0, 0.5)
    return _rounded(turned, "x0", "y0", "x1", "y1", "slope", digits=None)


@query
def extend_segments(spark, sf):
    out = SE.extend_segments(fx.segments(spark, sf), 0.0, 0.0, 110.0, 12.0)
    return _rounded(out, "x0", "y0", "x1", "y1", "slope", digits=None)


@query
def sigmoid_weight(spark, sf):
    table = B.to_unit(fx.signal8(spark, sf), "b2", "b8")
    return _rounded(B.sigmoid_weight(table, 15.0, "b2", "b8").select(*PIXEL, "weight"), "weight")


@query
def saturation_gray(spark, sf):
    return B.enhance_saturation(fx.colours(spark, sf), 0.5)


@query
def band_to_signal(spark, sf):
    return B.to_signal(fx.raster8(spark, sf), 8)


@query
def signal_to_bands(spark, sf):
    return B.to_pixels(B.to_signal(fx.raster8(spark, sf), 8))


# --- aggregations ------------------------------------------------------------

@query
def target_signature(spark, sf):
    return _rounded(ST.target_signature(fx.spectra(spark, sf)), "signature")


@query
def band_centered(spark, sf):
    out = ST.center(fx.spectra(spark, sf)).select("scene_id", "b1", "b2", "b3", "b4")
    return _rounded(out, "b1", "b2", "b3", "b4")


@query
def band_covariance(spark, sf):
    return _rounded(ST.covariance(fx.spectra(spark, sf)), "cov")


@query
def band_covariance8(spark, sf):
    return _rounded(ST.covariance(fx.signal8(spark, sf)), "cov")


@query
def iqr_bounds(spark, sf):
    return ST.iqr_bounds(fx.labelled8(spark, sf))


@query
def band_histogram(spark, sf):
    return ST.histogram(fx.mosaic(spark, sf))


@query
def otsu_threshold(spark, sf):
    return ST.otsu(ST.histogram(_band_images(spark, sf)))


@query
def array_profile(spark, sf):
    return ST.profile(fx.raster8(spark, sf))


@query
def blob_areas(spark, sf):
    return BL.blob_areas(BL.label_runs(fx.mosaic_mask(spark, sf)))


@query
def blob_size_limit(spark, sf):
    return BL.isolation_limit(BL.blob_areas(BL.label_runs(fx.mosaic_mask(spark, sf))))


@query
def pca_angle(spark, sf):
    return _rounded(ST.pca_angle(fx.points(spark, sf), ["event_type"]), "angle")


@query
def bounding_box(spark, sf):
    return ST.bounding_box(fx.points(spark, sf), ["event_type"])


@query
def blob_boxes(spark, sf):
    return ST.bounding_box(BL.label_blobs(fx.mosaic_mask(spark, sf)), ["scene_id", "blob_id"])


def _contrast_and_mask(spark, sf):
    contrast = N.local_contrast(fx.mosaic(spark, sf))
    return contrast.withColumn("label", F.when(F.col("value") >= 175, 255).otherwise(0))


@query
def confidence(spark, sf):
    out = ST.confidence(_contrast_and_mask(spark, sf))
    return _rounded(out, "mean_contrast", "ink_contrast", "share", "confidence", digits=10)


@query
def overlap_share(spark, sf):
    other = fx.signal8(spark, sf).select(*PIXEL, F.when(F.col("b3") >= 160, 255).otherwise(0).alias("label"))
    return _rounded(ST.overlap_share(other, fx.mask8(spark, sf)), "share")


@query
def contrast_scale(spark, sf):
    return _rounded(M.contrast_scale(fx.features8(spark, sf)), "beta", digits=12)


# --- neighbourhoods ----------------------------------------------------------

@query
def local_contrast(spark, sf):
    return _rounded(N.local_contrast(fx.mosaic(spark, sf)).select(*PIXEL, "contrast"), "contrast")


@query
def contrast_edges(spark, sf):
    edges = N.contrast_edges(N.local_contrast(fx.mosaic(spark, sf)))
    return edges.select(*PIXEL, F.col("edge").cast("int").alias("edge"))


@query
def stroke_width(spark, sf):
    return N.stroke_width(N.contrast_edges(N.local_contrast(fx.mosaic(spark, sf))))


@query
def local_threshold(spark, sf):
    edges = fx.mosaic(spark, sf).withColumn("edge", F.col("value") >= 150)
    out = N.local_threshold(edges, 4, 6).select(*PIXEL, "n_edge", "threshold", "label")
    return _rounded(out, "threshold")


@query
def binarise_local(spark, sf):
    return N.binarise_local(fx.mosaic(spark, sf)).select(*PIXEL, "label")


@query
def binarise_local_smoothed(spark, sf):
    return N.binarise_local(fx.mosaic(spark, sf), median=3).select(*PIXEL, "label")


@query
def binarise_fixed_stroke(spark, sf):
    return N.binarise_local(fx.mosaic(spark, sf), stroke=3).select(*PIXEL, "label")


@query
def binarise_weighted(spark, sf):
    return N.binarise_weighted(fx.mosaic(spark, sf)).select(*PIXEL, "weighted", "label")


@query
def binarise_color(spark, sf):
    return N.binarise_color(fx.colours(spark, sf)).withColumn("enhanced", F.col("enhanced").cast("int"))


@query
def sensor_noise(spark, sf):
    return N.remove_sensor_noise(fx.mosaic(spark, sf))


@query
def erode_cross(spark, sf):
    return N.erode(_bright(spark, sf), 1)


@query
def erode_cross_repeated(spark, sf):
    return N.erode(_bright(spark, sf), 3)


def _bright(spark, sf):
    """A mask with thick regions: everything but the darkest pixels."""
    return fx.mosaic(spark, sf).select(*PIXEL, F.when(F.col("value") >= 70, 255).otherwise(0)
                                       .cast("smallint").alias("label"))


@query
def erode_border(spark, sf):
    return N.erode_border(_bright(spark, sf), 4)


@query
def row_runs(spark, sf):
    return N.row_runs(fx.mosaic_mask(spark, sf))


# --- joins and sets ----------------------------------------------------------

@query
def neighbor_pairs(spark, sf):
    return M.neighbor_pairs(fx.features8(spark, sf), ["c0", "c1", "c2"])


@query
def run_edges(spark, sf):
    return M.run_edges(N.row_runs(fx.mosaic_mask(spark, sf)))


@query
def near_blob_filter(spark, sf):
    mask = fx.mosaic_mask(spark, sf)
    anchors = fx.mosaic(spark, sf).filter("value >= 225")
    return M.keep_near(mask, anchors, 5.5)


@query
def mask_and(spark, sf):
    other = fx.signal8(spark, sf).select(*PIXEL, F.when(F.col("b3") >= 160, 255).otherwise(0).alias("label"))
    return M.mask_and(fx.mask8(spark, sf), other)


@query
def mask_minus(spark, sf):
    other = fx.signal8(spark, sf).select(*PIXEL, F.when(F.col("b3") >= 160, 255).otherwise(0).alias("label"))
    return M.mask_minus(fx.mask8(spark, sf), other)


IMAGES = ["r", "g", "b", "mask", "r_norm", "g_norm", "b_norm", "gray", "gray_unit", "gray_norm", "mask_unit",
          "eroded_mask", "eroded_mask_unit"]


def _page(spark, sf, channel: str):
    page = fx.colours(spark, sf)
    return page.withColumn("label", F.when(F.col(channel) >= 40, 255).otherwise(0).cast("smallint"))


@query
def reconcile(spark, sf):
    one = _page(spark, sf, "g")
    two = _page(spark, sf, "b").withColumns({"r": F.col("b"), "b": F.col("r")})
    out = M.reconcile(M.derived_images(one, 4), M.derived_images(two, 4), IMAGES)
    return _rounded(out, "difference", digits=4)


@query
def segment_pairs(spark, sf):
    lines = fx.segments(spark, sf)
    follow = lines.select("scene_id", F.col("seg_id").alias("id1"), (F.col("seg_id") + 1).alias("id2")).distinct()
    return _rounded(SE.segment_pairs(lines, follow), "px", "py", "distance", "distance_sq", digits=None)


@query
def segment_axis_hits(spark, sf):
    axes = fx.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("scene_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("y").alias("axis"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 5000.0)
        .otherwise(F.col("o_totalprice") / 50000.0).alias("c"))
    return _rounded(SE.segment_axis_hits(fx.segments(spark, sf), axes), "c", "px", "py", digits=None)


@query
def balanced_sample(spark, sf):
    return M.balanced_sample(fx.labelled8(spark, sf), 10)


# --- scoring, grouping, iteration --------------------------------------------

@query
def ace_score_2band(spark, sf):
    two = fx.spectra(spark, sf).select("scene_id", "b1", "b2", "label")
    return _rounded(SC.ace_score(two).select("scene_id", "b1", "b2", "score"), "score")


@query
def ace_score(spark, sf):
    return _rounded(SC.ace_score(fx.labelled8(spark, sf)).select(*PIXEL, "score", "status"), "score")


@query
def blob_labels(spark, sf):
    return BL.label_blobs(fx.mosaic_mask(spark, sf))


@query
def blob_filter(spark, sf):
    return BL.filter_blobs(fx.mosaic_mask(spark, sf), 3)


@query
def blob_filter_auto(spark, sf):
    return BL.filter_blobs_auto(fx.mosaic_mask(spark, sf))


@query
def isolated_blobs(spark, sf):
    return BL.remove_isolated(fx.mosaic_mask(spark, sf), 0.75, 3)


@query
def forest_score(spark, sf):
    return SC.forest_score(fx.labelled8(spark, sf))


def _colour_signal(spark, sf):
    """The colour mosaic as three bands; foreground where the first two are bright together."""
    c = fx.colours(spark, sf)
    bright = F.col("r").cast("int") + F.col("g") >= 280
    return c.select(*PIXEL, F.col("r").alias("b1"), F.col("g").alias("b2"), F.col("b").alias("b3"),
                    F.when(bright, 255).otherwise(0).cast("smallint").alias("label"))


@query
def forest_counts(spark, sf):
    """Weighted class counts of all trees' roots, over all pixels."""
    return FO.value_counts(FO.bootstrap(_colour_signal(spark, sf), 3, 7)).drop("node")


@query
def forest_splits(spark, sf):
    """The first split of every tree, over all pixels."""
    splits = FO.best_splits(FO.value_counts(FO.bootstrap(_colour_signal(spark, sf), 10, 7)))
    return splits.select("scene_id", "tree", "n", "hits", "band", "value")


@query
def scene_forests(spark, sf):
    return _rounded(FO.scene_forests(_colour_signal(spark, sf)), "probability")


@query
def gmm_components(spark, sf):
    start = SG.start_components(SG.colour_counts(fx.features8(spark, sf)), 0)
    return _rounded(start.select("scene_id", "side", "component", "n", "share", "m0", "m1", "m2"),
                    "share", "m0", "m1", "m2")


@query
def gmm_round(spark, sf):
    """One round from the quintile start."""
    return SG.gmm_segment(fx.features8(spark, sf), 0).select(
        *PIXEL, "label", F.round("fg_cost", 4).alias("fg_cost"), F.round("bg_cost", 4).alias("bg_cost"))


@query
def gmm_segment(spark, sf):
    return SG.gmm_segment(fx.features8(spark, sf)).select(*PIXEL, "label")


@query
def smooth_labels(spark, sf):
    table = fx.features8(spark, sf)
    return CUT.cut_labels(SG.gmm_segment(table), M.contrast_scale(table)).select(*PIXEL, "label")


@query
def refine_round(spark, sf):
    table = B.trimap_to_mask(fx.features8(spark, sf))
    marked = SG.refine_round(table)
    return _rounded(marked.select(
        *PIXEL, "erosions", F.col("violation").cast("int").alias("violation"),
        F.when(F.col("violation"), 0.0).otherwise(F.col("score")).alias("score")), "score")


@query
def refine(spark, sf):
    return SG.refine(fx.features8(spark, sf)).select(*PIXEL, "label")


# --- whole scenes ------------------------------------------------------------

@query
def binarize_msi(spark, sf):
    return PL.binarize_msi(fx.raster8(spark, sf), min_area=3)


@query
def binarize_rgb(spark, sf):
    c = fx.colours(spark, sf)
    bands = images.split_channels(c.select(*PIXEL, F.lit(3).alias("channels"), F.col("b").alias("c0"),
                                           F.col("g").alias("c1"), F.col("r").alias("c2")))
    return PL.binarize_rgb(bands, min_area=3)


@query
def ace_map(spark, sf):
    return _rounded(PL.ace_map(fx.raster8(spark, sf), fx.mask8(spark, sf)), "score")


@query
def visualize_msi(spark, sf):
    return PL.visualize_msi(fx.raster8(spark, sf), min_area=3)
