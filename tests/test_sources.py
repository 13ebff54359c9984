import struct
import zlib

import numpy as np
import pytest
from helpers import image, table
from pyspark.sql import functions as F

from bandscape.functions import joins as J
from bandscape.sources import catalog, images, matrices, sinks


def png(path, pixels, bits=8):
    """Write an uncompressed-filter PNG: grey (2-D) or colour (3-D)."""
    a = np.asarray(pixels)
    rows = a.astype(">u2" if bits == 16 else np.uint8)
    raw = b"".join(b"\0" + rows[y].tobytes() for y in range(a.shape[0]))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], bits, 2 if a.ndim == 3 else 0, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


GREY = np.arange(12).reshape(3, 4) * 20
COLOUR = np.arange(36).reshape(3, 4, 3) * 7


@pytest.fixture
def folder(tmp_path):
    for k in range(1, 9):
        png(tmp_path / "z35" / f"F{k}s.png", GREY + k)
    png(tmp_path / "z35" / "z35GT.png", GREY)
    png(tmp_path / "z35" / "F9.png", GREY * 100, bits=16)
    png(tmp_path / "rgb" / "F1.png", COLOUR)
    (tmp_path / "z35" / "notes_F7.png").write_bytes(b"no image")
    return str(tmp_path)


def test_grey_scan(spark, folder):
    px = images.read_pixels(spark, folder + "/z35").filter("name = 'F3s.png'")
    got = {(r.band, r.y, r.x): r.value for r in px.collect()}
    assert got == {(3, y, x): GREY[y, x] + 3 for y in range(3) for x in range(4)}


def test_colour_scan_and_split(spark, folder):
    samples = images.read_samples(spark, folder + "/rgb")
    bands = {(r.band, r.y, r.x): r.value for r in images.split_channels(samples).collect()}
    assert bands == {(3 - c, y, x): COLOUR[y, x, c] for y in range(3) for x in range(4) for c in range(3)}
    want = np.rint(COLOUR @ [0.299, 0.587, 0.114])
    got = {(r.y, r.x): r.value for r in images.grey_pixels(samples).collect()}
    assert got == {(y, x): want[y, x] for y in range(3) for x in range(4)}


def test_deep_images_are_rejected(spark, folder):
    assert "F9.png" not in {r.name for r in images.read_samples(spark, folder + "/z35").select("name").distinct().collect()}


def test_catalogue_of_a_folder(spark, folder):
    files = images.list_files(spark, folder + "/z35")
    roles = {r.name: (r.role, r.slot) for r in catalog.scene_catalog(files).collect()}
    assert roles["F4s.png"] == ("band", 4) and roles["z35GT.png"][0] == "ignored" and roles["notes_F7.png"][0] == "ignored"
    lenient = {r.name: r.role for r in catalog.scene_catalog(files, strict=False).collect()}
    assert lenient["z35GT.png"] == "gt"
    scene = catalog.validate_scenes(catalog.scene_catalog(files)).collect()
    assert [(s.status, s.height, s.width) for s in scene] == [("valid", 3, 4)]


def test_folder_to_pixel_table(spark, folder):
    listed = catalog.scene_catalog(images.list_files(spark, folder + "/z35"))
    bands = catalog.accepted_bands(listed, catalog.validate_scenes(listed))
    px = images.band_pixels(images.read_samples(spark, folder + "/z35"), bands)
    assert px.count() == 8 * GREY.size
    assert {(r.band, r.value) for r in px.filter("y = 0 AND x = 0").collect()} == {(k, k) for k in range(1, 9)}


def test_open_folder_with_mask(spark, tmp_path):
    for name, a in (("a.png", GREY), ("b.png", GREY + 9), ("c.png", GREY.T), ("the_mask.png", np.where(GREY > 90, 255, 0))):
        png(tmp_path / "page" / name, a)
    path = str(tmp_path / "page")
    listed = catalog.open_catalog(images.list_files(spark, path))
    samples = images.read_samples(spark, path)
    px = images.band_pixels(samples, listed.filter("role = 'band'"))
    assert {r.band for r in px.select("band").distinct().collect()} == {1, 2}
    assert images.mask_pixels(samples, listed).filter("label = 255").count() == (GREY > 90).sum()


def files_table(spark, rows):
    return spark.createDataFrame(rows, "scene_id bigint, name string, height int, width int")


def test_slot_is_the_lowest_digit_anywhere(spark):
    rows = [(0, n, 2, 2) for n in ("F28", "F81", "F10", "F90", "F", "F3GT")]
    got = {r.name: (r.slot, r.role) for r in catalog.scene_catalog(files_table(spark, rows)).collect()}
    assert got == {"F28": (2, "band"), "F81": (1, "band"), "F10": (1, "band"), "F90": (None, "gt"),
                   "F": (None, "ignored"), "F3GT": (3, "ignored")}


def test_reasons_for_rejection(spark):
    full = lambda s: [(s, f"F{k}.png", 4, 4) for k in range(1, 9)]
    rows = (full(0) + full(1) + [(1, "F12.png", 4, 4)] + full(2)[:7] + full(3) + [(3, f"extra{k}", None, None) for k in range(9)]
            + [(4, "a.txt", None, None)] + [(5, "F1.png", 4, 4), *[(5, f"F{k}.png", 4, 5) for k in range(2, 9)]])
    scenes = catalog.validate_scenes(catalog.scene_catalog(files_table(spark, rows)), max_entries=15).collect()
    assert {s.scene_id: s.status for s in scenes} == {
        0: "valid", 1: "duplicate_slot", 2: "empty_slot", 3: "too_many_files", 4: "empty_slot", 5: "empty_slot"}


def test_open_catalogue(spark):
    rows = [(0, "a.tif", 4, 4), (0, "b.tif", 4, 5), (0, "c.tif", 4, 4), (0, "mask.png", 4, 4), (0, "d.txt", None, None)]
    got = {r.name: (r.role, r.band) for r in catalog.open_catalog(files_table(spark, rows)).collect()}
    assert got == {"a.tif": ("band", 1), "b.tif": ("resized", None), "c.tif": ("band", 2), "mask.png": ("mask", None),
                   "d.txt": ("ignored", None)}


def test_matrix_text_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    matrices.write_matrix_text(table(spark, {4: GREY, 5: GREY.T}, "value"), path)
    got = matrices.read_matrix_text(spark, path + "/scene_id=5")
    assert (image(got.withColumn("scene_id", F.lit(0)), "value") == GREY.T).all()


def test_matrix_text_rejects_short_files(spark):
    rows = [("ok", "2\n2\n1, 2.5, \n3, x, \n"), ("rows", "3\n2\n1, 2, \n3, 4, \n"), ("cols", "1\n3\n1, 2,\n"), ("none", "")]
    got = matrices.parse_matrix_text(spark.createDataFrame(rows, "path string, value string")).collect()
    assert {(r.path, r.y, r.x): r.value for r in got} == {
        ("ok", 0, 0): 1.0, ("ok", 0, 1): 2.5, ("ok", 1, 0): 3.0, ("ok", 1, 1): 0.0}


def test_lines_of_many_matrices_meet_their_sizes_without_copies(spark):
    rows = [(f"m{k}", i, line) for k in range(30) for i, line in enumerate(["2", "3", "1, 2, 3, ", "4, 5, 6, "])]
    rows += [("short", 0, "2"), ("short", 1, "3"), ("short", 2, "1, 2, 3, ")]
    rows += [("long", 0, "1"), ("long", 1, "2"), *(("long", i, "7, 8, 9, ") for i in range(2, 200))]
    lines = spark.createDataFrame(rows, "path string, line_no bigint, line string")
    want = sorted(map(tuple, matrices.parse_matrix_lines(lines).collect()))
    assert len(want) == 30 * 6 + 2
    spark.conf.set(J.BROADCAST_ROWS, "0")
    spark.conf.set(J.HOT_KEYS, "3")                         # "long" is hot
    try:
        got = matrices.parse_matrix_lines(lines)
    finally:
        spark.conf.unset(J.BROADCAST_ROWS)
        spark.conf.unset(J.HOT_KEYS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, got.collect())) == want


def test_matrix_text_of_a_scene_in_parts(spark, tmp_path):
    path, rng = str(tmp_path / "m"), np.random.default_rng(6)
    images = {1: rng.integers(0, 255, (150, 9)), 2: rng.integers(0, 255, (3, 4))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        matrices.write_matrix_text(table(spark, images, "value"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "m" / "scene_id=1").glob("part-*.txt"))
    assert len(parts) > 3
    text = "".join(p.read_text() for p in parts)
    assert text == "150\n9\n" + "".join(", ".join(map(str, row)) + ", \n" for row in images[1])
    got = matrices.read_matrix_text(spark, path + "/*", folders=True).withColumn(
        "scene_id", F.regexp_extract("path", "scene_id=([0-9]+)", 1).cast("bigint"))
    for scene, grid in images.items():
        assert (image(got, "value", scene) == grid).all()


def test_matrix_text_in_many_ranges(spark, tmp_path):
    """Files of many byte ranges, complete and incomplete ones, equal the same files read whole."""
    rng = np.random.default_rng(4)
    for name, (h, w), ending, cut in [("a", (90, 7), "\n", 0), ("b", (40, 60), "\r\n", 0), ("c", (1, 1), "\n", 0),
                                      ("d", (30, 5), "\n", 1), ("e", (0, 4), "\n", 0)]:
        lines = [str(h + cut), str(w), *[", ".join(map(str, row)) + ", " for row in rng.integers(0, 999, (h, w))]]
        (tmp_path / f"{name}.txt").write_bytes((ending.join(lines) + ending).encode())
    (tmp_path / "short.txt").write_bytes(b"2\n3\n1, 2, 3\n4, 5\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    want = sorted(map(tuple, matrices.parse_matrix_text(whole).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = matrices.numbered_lines(spark, str(tmp_path))
        got = sorted(map(tuple, matrices.parse_matrix_lines(lines).collect()))
        blocks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert sorted(r.line_no for r in lines.filter("path LIKE '%a.txt'").collect()) == list(range(92))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(got) == 90 * 7 + 40 * 60 + 1 and blocks > 20


def test_mask_sink_is_inverted_and_partitioned(spark, tmp_path):
    mask = np.where(GREY > 100, 255, 0)
    sinks.write_mask(table(spark, {0: mask, 1: mask}, "label"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert (image(back, "label", 1) == 255 - mask).all()


@pytest.mark.parametrize("turns", [0, 1, 2, 3, 5])
def test_rotation(spark, turns):
    got = image(sinks.rotate_quarter(table(spark, {0: GREY}, "value"), turns), "value")
    assert (got == np.rot90(GREY, turns)).all()


def tiff(path, pixels, bits=8, order="<", channels=1):
    """Write a TIFF of one strip whose directory follows the samples."""
    a = np.asarray(pixels).astype(order + ("u2" if bits == 16 else "u1"))
    data = a.tobytes() + b"\0" * (a.nbytes % 2)
    extra = 8 + len(data)
    many = struct.pack(order + f"{channels}H", *[bits] * channels)
    at = extra + (len(many) if channels > 2 else 0)
    depth = struct.pack(order + "I", extra) if channels > 2 else many.ljust(4, b"\0")
    short = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
    tags = [short(256, a.shape[1]), short(257, a.shape[0]), struct.pack(order + "HHI", 258, 3, channels) + depth, short(259, 1),
            short(262, 1 if channels == 1 else 2), struct.pack(order + "HHII", 273, 4, 1, 8), short(277, channels),
            short(278, a.shape[0]), struct.pack(order + "HHII", 279, 4, 1, a.nbytes)]
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    path.write_bytes(head + data + (many if channels > 2 else b"") + struct.pack(order + "H", len(tags)) + b"".join(tags) + b"\0" * 4)


@pytest.mark.parametrize("order", ["<", ">"])
def test_deep_tiff_is_refused(spark, tmp_path, order):
    tiff(tmp_path / "F1.tif", GREY, order=order)
    tiff(tmp_path / "F2.tif", [[300, 400], [500, 600]], 16, order)
    tiff(tmp_path / "F3.tif", COLOUR * 300, 16, order, 3)
    assert [images.sample_bits((tmp_path / f"F{k}.tif").read_bytes()) for k in (1, 2, 3)] == [8, 16, 16]
    assert {r.name for r in images.list_files(spark, str(tmp_path)).collect()} == {"F1.tif"}


def test_headers():
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"\0" * 14 + b"\xff\xc0\x00\x0b" + bytes([12]) + b"\0" * 9
    assert images.sample_bits(jpeg) == 12 and images.sample_bits(b"") == 8 and images.sample_bits(b"GIF89a") == 8
    assert images.sample_bits(b"II*\0\xff\xff\0\0") == 64 and images.sample_bits(b"II+\0" + b"\0" * 20) == 64
