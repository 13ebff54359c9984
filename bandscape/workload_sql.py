"""The same queries in SQL, written independently of the Spark operators:
brute-force joins stand in for tiles, windows and distance passes."""

from __future__ import annotations

import math
import re

# Fixed values, written out here so that a wrong one in an operator shows.
TRIMAP_PRESETS = {"score": (0.3, 0.1, 0.0, 0.0), "forest": (0.95, 0.8, 0.4, 0.1)}
EPSILON = 1e-6
NOISE = 0.01
SINGULAR = 1e-9

# --- expressions -------------------------------------------------------------


def u8(v: str) -> str:
    return f"CAST(least(greatest(round_even({v}, 0), 0), 255) AS SMALLINT)"


def floor8(v: str) -> str:
    return f"CAST(floor(least(greatest(CAST({v} AS DOUBLE), 0), 255)) AS SMALLINT)"


def stretch(v: str, lo: str, hi: str, top: str = "255.0") -> str:
    return (f"CASE WHEN ({v}) IS NOT NULL THEN coalesce(CAST(({v}) - ({lo}) AS DOUBLE)"
            f" / nullif(CAST(({hi}) - ({lo}) AS DOUBLE), 0) * CAST({top} AS DOUBLE), 0) END")


def r(v: str, digits: int | None = 6) -> str:
    return f"({v}) + CAST(0 AS DOUBLE)" if digits is None else f"round({v}, {digits}) + 0.0"


B8 = [f"b{k}" for k in range(1, 9)]

# --- inputs ------------------------------------------------------------------

INPUTS: dict[str, str] = {}

INPUTS["raster"] = f"""
  SELECT vec_id // 8 AS scene_id, CAST(vec_id % 8 + 1 AS INTEGER) AS band, CAST((i - 1) // 8 AS INTEGER) AS y,
         CAST((i - 1) % 8 AS INTEGER) AS x, {u8(stretch('v', 'lo', 'hi'))} AS value
  FROM (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v, CAST(list_min(embedding) AS DOUBLE) AS lo,
               CAST(list_max(embedding) AS DOUBLE) AS hi
        FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(1, 65)))"""

INPUTS["band_images"] = "SELECT scene_id * 8 + band - 1 AS scene_id, y, x, value FROM raster"
INPUTS["signal_all"] = ("SELECT scene_id, y, x, " + ", ".join(
    f"max(value) FILTER (WHERE band = {k}) AS b{k}" for k in range(1, 9)) + " FROM raster GROUP BY scene_id, y, x")
INPUTS["signal"] = "SELECT * FROM signal_all WHERE " + " AND ".join(f"{b} IS NOT NULL" for b in B8)
INPUTS["labelled"] = "SELECT *, CAST(CASE WHEN b2 >= 160 THEN 255 ELSE 0 END AS SMALLINT) AS label FROM signal"
INPUTS["mask3"] = "SELECT scene_id, y, x, CASE WHEN b3 >= 160 THEN 255 ELSE 0 END AS label FROM signal"

_MEAN = "((" + " + ".join(f"CAST({b} AS DOUBLE)" for b in B8) + ") / 8.0)"
_SQUARE = "((" + " + ".join(f"CAST({b} AS DOUBLE) * CAST({b} AS DOUBLE)" for b in B8) + ") / 8.0)"
INPUTS["raw_features"] = f"""
  SELECT *, CAST(b2 AS INTEGER) - CAST(b8 AS INTEGER) AS f0, {floor8(f'CAST({_MEAN} AS FLOAT)')} AS f1,
         {floor8(f'CAST(sqrt(greatest({_SQUARE} - {_MEAN} * {_MEAN}, 0)) AS FLOAT)')} AS f2 FROM labelled"""
INPUTS["ranges"] = "SELECT scene_id, " + ", ".join(
    f"min(f{i}) AS lo{i}, max(f{i}) AS hi{i}" for i in range(3)) + " FROM raw_features GROUP BY scene_id"


def _trimap(preset: str) -> str:
    fgd, pr_fgd, pr_bgd, bgd = TRIMAP_PRESETS[preset]
    return (f"CASE WHEN score > {fgd} AND label = 255 THEN 'FGD' WHEN score <= {bgd} AND label = 0 THEN 'BGD'"
            f" WHEN score > {pr_fgd} THEN 'PR_FGD' WHEN score <= {pr_bgd} THEN 'PR_BGD'"
            " WHEN label = 0 THEN 'BGD' ELSE 'PR_FGD' END")


INPUTS["scored"] = "SELECT *, CAST(b3 AS DOUBLE) / 255.0 AS score FROM labelled"
INPUTS["features"] = ("SELECT f.scene_id, y, x, " + ", ".join(
    f"{u8(stretch(f'f{i}', f'lo{i}', f'hi{i}'))} AS c{i}" for i in range(3))
    + ", CAST(b3 AS DOUBLE) / 255.0 AS score, label FROM raw_features f JOIN ranges USING (scene_id)")
INPUTS["guided"] = f"SELECT *, {_trimap('score')} AS trimap FROM features"

INPUTS["grid"] = """
  SELECT CAST(0 AS BIGINT) AS scene_id, CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
         CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, (SELECT CAST(range AS INTEGER) AS i FROM range(1, 65))"""
INPUTS["mosaic"] = f"""
  SELECT scene_id, y, x, {u8(stretch('v', 'lo', 'hi'))} AS value
  FROM grid, (SELECT min(v) AS lo, max(v) AS hi FROM grid)"""
INPUTS["mosaic_mask"] = """
  SELECT scene_id, y, x, CAST(CASE WHEN value >= 175 THEN 255 ELSE 0 END AS SMALLINT) AS label FROM mosaic"""
INPUTS["ink"] = "SELECT scene_id, y, x FROM mosaic_mask WHERE label > 0"
INPUTS["bright"] = """
  SELECT scene_id, y, x, CAST(CASE WHEN value >= 70 THEN 255 ELSE 0 END AS SMALLINT) AS label FROM mosaic"""
INPUTS["colours"] = ("SELECT CAST(0 AS BIGINT) AS scene_id, CAST(vec_id AS INTEGER) AS y, CAST(j AS INTEGER) AS x, "
    + ", ".join(u8(stretch(f"CAST(embedding[(j * 3 + {i}) % 64 + 1] AS DOUBLE)", "CAST(list_min(embedding) AS DOUBLE)",
                           "CAST(list_max(embedding) AS DOUBLE)")) + f" AS {c}" for i, c in enumerate("rgb"))
    + " FROM embeddings, (SELECT CAST(range AS INTEGER) AS j FROM range(0, 22))")
INPUTS["spectra"] = """
  SELECT l_returnflag AS scene_id, l_quantity AS b1, l_extendedprice / 1000.0 AS b2, l_discount AS b3, l_tax AS b4,
         CASE WHEN l_quantity >= 40 THEN 255 ELSE 0 END AS label FROM lineitem"""
INPUTS["listed"] = """
  SELECT vec_id // 8 AS scene_id, (vec_id // 8) % 6 AS k, vec_id % 8 + 1 AS b FROM embeddings"""
INPUTS["files"] = """
  SELECT scene_id, CASE WHEN k = 3 AND b = 3 THEN 'z3.png' WHEN k = 4 AND b = 5 THEN 'F1x.png'
                        ELSE 'F' || b || 's.png' END AS name,
         CAST(8 AS INTEGER) AS height, CAST(CASE WHEN k = 5 AND b = 2 THEN 9 ELSE 8 END AS INTEGER) AS width FROM listed
  UNION ALL SELECT scene_id, 'FGT.png', 8, 8 FROM listed WHERE k = 2 AND b = 1"""
_SLOT = "CASE " + " ".join(f"WHEN contains(name, '{d}') THEN {d}" for d in range(1, 9)) + " END"
INPUTS["slots"] = f"""
  SELECT *, {_SLOT} AS slot, contains(name, 'F') AND NOT contains(name, 'GT') AND ({_SLOT}) IS NOT NULL AS is_band
  FROM files"""
INPUTS["catalog"] = """
  SELECT scene_id, name, height, width, slot,
         CASE WHEN is_band THEN 'band'
              WHEN contains(name, 'F') AND name = max(CASE WHEN contains(name, 'F') AND NOT is_band THEN name END)
                   OVER (PARTITION BY scene_id) THEN 'gt'
              ELSE 'ignored' END AS role FROM slots"""
INPUTS["sizes"] = """
  SELECT scene_id, height AS ref_height, width AS ref_width
  FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY name) AS k FROM catalog WHERE role = 'band')
  WHERE k = 1"""


def validation(limit: int | None = None) -> str:
    many = f"WHEN entries > {limit} THEN 'too_many_files' " if limit else ""
    return f"""
  SELECT *, CASE {many}WHEN accepted > slots THEN 'duplicate_slot' WHEN slots < 8 THEN 'empty_slot'
                 ELSE 'valid' END AS status
  FROM (SELECT c.scene_id, ref_height AS height, ref_width AS width, count(*) AS entries,
               count(*) FILTER (WHERE role = 'band' AND height = ref_height AND width = ref_width) AS accepted,
               count(DISTINCT slot) FILTER (WHERE role = 'band' AND height = ref_height AND width = ref_width) AS slots
        FROM catalog c LEFT JOIN sizes USING (scene_id) GROUP BY ALL)"""


INPUTS["validated"] = validation()
INPUTS["segments"] = """
  SELECT l_orderkey AS scene_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount,
         l_extendedprice, l_tax) AS seg_id, l_quantity AS x0, l_discount * 100.0 AS y0,
         l_extendedprice / 1000.0 AS x1, l_tax * 100.0 AS y1 FROM lineitem"""
INPUTS["ordered"] = """
  SELECT scene_id, seg_id, CASE WHEN x0 < x1 THEN x0 ELSE x1 END AS x0, CASE WHEN x0 < x1 THEN y0 ELSE y1 END AS y0,
         CASE WHEN x0 < x1 THEN x1 ELSE x0 END AS x1, CASE WHEN x0 < x1 THEN y1 ELSE y0 END AS y1 FROM segments"""
INPUTS["points"] = "SELECT event_type, CAST(user_id AS DOUBLE) AS x, value AS y FROM events"

_SLOPE = "CASE WHEN x1 - x0 <> 0 THEN (y1 - y0) / (x1 - x0) ELSE 3.4028234663852886e38 END"

# --- neighbourhoods ----------------------------------------------------------


def box(src: str, aggs: dict[str, tuple[str, str]], before: str, after: str | None = None, keep: str = "") -> str:
    """Separable window aggregates over a rectangle."""
    after = after or before
    rows = ", ".join(f"{f}({v}) OVER (PARTITION BY scene_id, y ORDER BY x RANGE BETWEEN {before} PRECEDING"
                     f" AND {after} FOLLOWING) AS r_{n}" for n, (f, v) in aggs.items())
    cols = ", ".join(f"{f}(r_{n}) OVER (PARTITION BY scene_id, x ORDER BY y RANGE BETWEEN {before} PRECEDING"
                     f" AND {after} FOLLOWING) AS {n}" for n, (f, _) in aggs.items())
    return f"SELECT *, {cols} FROM (SELECT *, {rows} FROM {src})"


def contrast(src: str, value: str = "value") -> dict[str, str]:
    spread = "(CAST(mx AS DOUBLE) - CAST(mn AS DOUBLE))", "(CAST(mx AS DOUBLE) + CAST(mn AS DOUBLE)"
    return {
        f"{src}_box": box(src, {"mn": ("min", value), "mx": ("max", value)}, "1"),
        f"{src}_contrast": f"SELECT *, {spread[0]} / {spread[1]} + {EPSILON}) AS contrast FROM {src}_box"}


def histogram(src: str, value: str, out: str) -> dict[str, str]:
    return {out: f"""
  SELECT s.scene_id, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT scene_id FROM {src}) s CROSS JOIN (SELECT range AS bin FROM range(256))
  LEFT JOIN (SELECT scene_id, CAST({value} AS BIGINT) AS bin, count(*) AS n FROM {src} GROUP BY ALL) h
    USING (scene_id, bin)"""}


def otsu(hist: str, out: str) -> dict[str, str]:
    return {f"{out}_sums": f"""
  SELECT scene_id, bin, sum(CAST(n AS DOUBLE)) OVER upto AS n0, sum(CAST(n AS DOUBLE) * bin) OVER upto AS s0,
         sum(CAST(n AS DOUBLE)) OVER whole AS n, sum(CAST(n AS DOUBLE) * bin) OVER whole AS s FROM {hist}
  WINDOW upto AS (PARTITION BY scene_id ORDER BY bin), whole AS (PARTITION BY scene_id)""",
            out: f"""
  SELECT scene_id, bin AS threshold
  FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY
          CASE WHEN n0 > 0 AND n0 < n THEN (s0 * n - s * n0) * (s0 * n - s * n0) / (n0 * (n - n0)) ELSE 0 END DESC,
          bin) AS k FROM {out}_sums) WHERE k = 1"""}


def edges(src: str, value: str = "value") -> dict[str, str]:
    return {**contrast(src, value),
            f"{src}_binned": f"SELECT *, {u8('contrast * 255.0')} AS level FROM {src}_contrast",
            **histogram(f"{src}_binned", "level", f"{src}_hist"), **otsu(f"{src}_hist", f"{src}_cut"),
            f"{src}_edges": f"SELECT b.*, level > threshold AS edge FROM {src}_binned b JOIN {src}_cut USING (scene_id)"}


def strokes(src: str) -> dict[str, str]:
    return {f"{src}_gaps": f"""
  SELECT scene_id, dist, count(*) AS n
  FROM (SELECT scene_id, x - lag(x) OVER (PARTITION BY scene_id, y ORDER BY x) AS dist FROM {src}_edges WHERE edge)
  WHERE dist IS NOT NULL GROUP BY ALL""",
            f"{src}_strokes": f"""
  SELECT s.scene_id, coalesce(dist, 1) AS stroke_width FROM (SELECT DISTINCT scene_id FROM {src}_edges) s
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, dist) AS k FROM {src}_gaps) g
    ON s.scene_id = g.scene_id AND k = 1"""}


def threshold(src: str, radius: str, n_min: str, out: str, value: str = "value") -> dict[str, str]:
    e = "CAST(CASE WHEN edge THEN 1 ELSE 0 END AS BIGINT)"
    v = f"CAST({value} AS BIGINT)"
    mean = "(CAST(s AS DOUBLE) / nullif(CAST(n_edge AS DOUBLE), 0))"
    sq = "(CAST(q AS DOUBLE) / nullif(CAST(n_edge AS DOUBLE), 0))"
    return {f"{out}_sums": box(src, {"n_edge": ("sum", e), "s": ("sum", f"{e} * {v}"), "q": ("sum", f"{e} * {v} * {v}")}, radius),
            f"{out}_levels": f"SELECT *, {mean} + sqrt(greatest({sq} - {mean} * {mean}, 0)) / 2.0 AS threshold FROM {out}_sums",
            out: f"""
  SELECT *, CAST(CASE WHEN n_edge >= {n_min} AND {value} <= threshold THEN 255 ELSE 0 END AS SMALLINT) AS label
  FROM {out}_levels"""}


def weighted(src: str, value: str, out: str) -> dict[str, str]:
    weight = f"(1.0 / (1.0 + exp(-15.0 * (mean / 255.0 - {value} / 255.0))))"
    return {f"{out}_sums": box(src, {"bs": ("sum", value), "bn": ("sum", "1")}, "16", "15"),
            f"{out}_means": f"SELECT scene_id, y, x, {value}, bs / bn AS mean FROM {out}_sums",
            out: f"SELECT scene_id, y, x, {u8(f'255.0 - {weight} * (255.0 - {value})')} AS weighted FROM {out}_means"}


def median(src: str, value: str, radius: int, out: str) -> dict[str, str]:
    """Brute force: every pixel looks up its clamped neighbours."""
    span = f"range({-radius}, {radius + 1})"
    clamped = lambda c, d: f"CAST(least(greatest({c} + {d}, 0), last_{c}) AS INTEGER) AS n{c}"
    return {f"{out}_wanted": f"""
  SELECT p.scene_id, y, x, {clamped('y', 'dy')}, {clamped('x', 'dx')} FROM {src} p
  JOIN (SELECT scene_id, max(y) AS last_y, max(x) AS last_x FROM {src} GROUP BY scene_id) USING (scene_id)
  CROSS JOIN (SELECT range AS dy FROM {span}) CROSS JOIN (SELECT range AS dx FROM {span})""",
            out: f"""
  SELECT w.scene_id, w.y, w.x, list_sort(list(q.{value}))[{((2 * radius + 1) ** 2) // 2 + 1}] AS median
  FROM {out}_wanted w JOIN {src} q ON q.scene_id = w.scene_id AND q.y = w.ny AND q.x = w.nx GROUP BY ALL"""}


def eroded(src: str, n: int, out: str) -> dict[str, str]:
    """Step by step: minimum over the pixel and its four neighbours."""
    steps, last = {}, src
    for k in range(1, n + 1):
        name = out if k == n else f"{out}_{k}"
        steps[name] = f"""
  SELECT scene_id, y, x, least(
    min(label) OVER (PARTITION BY scene_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING),
    min(label) OVER (PARTITION BY scene_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS label
  FROM {last}"""
        last = name
    return steps


RUNS = {"runs": """
  SELECT scene_id, y, min(x) AS x0, max(x) AS x1
  FROM (SELECT *, x - row_number() OVER (PARTITION BY scene_id, y ORDER BY x) AS k FROM ink) GROUP BY scene_id, y, k"""}

BLOBS = {
    "links": """
  SELECT a.y, a.x, b.y AS ny, b.x AS nx FROM ink a CROSS JOIN (SELECT range AS dy FROM range(-1, 2))
  CROSS JOIN (SELECT range AS dx FROM range(-1, 2)) JOIN ink b ON b.y = a.y + dy AND b.x = a.x + dx""",
    "reach(y, x, ty, tx)": """
  SELECT y, x, y, x FROM ink UNION SELECT r.y, r.x, l.ny, l.nx FROM reach r JOIN links l ON r.ty = l.y AND r.tx = l.x""",
    "blobs": """
  SELECT CAST(0 AS BIGINT) AS scene_id, y, x, min(CAST(ty AS BIGINT) * 4294967296 + tx) AS blob_id
  FROM reach GROUP BY y, x""",
    "areas": "SELECT scene_id, blob_id, count(*) AS area FROM blobs GROUP BY ALL",
    "limits": "SELECT scene_id, CAST(round_even(avg(area) * 0.75, 0) AS BIGINT) AS \"limit\" FROM areas GROUP BY scene_id"}


def near(mask: str, anchors: str, d: float) -> str:
    return f"""
  SELECT m.scene_id, m.y, m.x, m.label FROM {mask} m WHERE m.label > 0 AND EXISTS (
    SELECT 1 FROM {anchors} a WHERE a.scene_id = m.scene_id
      AND (a.y - m.y) * (a.y - m.y) + (a.x - m.x) * (a.x - m.x) < {d * d})"""


PAIRS = {"pairs": """
  SELECT a.scene_id, a.y, a.x, a.c0, a.c1, a.c2, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx,
         b.c0 AS c0_n, b.c1 AS c1_n, b.c2 AS c2_n
  FROM features a CROSS JOIN (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) o(dy, dx)
  JOIN features b ON b.scene_id = a.scene_id AND b.y = a.y + dy AND b.x = a.x + dx"""}

# --- coherence score in closed form ------------------------------------------


def coherence(bands: list[str], src: str) -> dict[str, str]:
    """Score by the Cholesky factor L of the covariance: with a = L⁻¹(x − mean)
    and t = L⁻¹(target − mean), g = a·t and the denominators are |t|², |a|²."""
    n = len(bands)
    steps = {"ace_means": "SELECT scene_id, " + ", ".join(
        f"avg(CAST({b} AS DOUBLE)) AS m{i}, avg(CASE WHEN label = 255 THEN CAST({b} AS DOUBLE) END) AS t{i}"
        for i, b in enumerate(bands)) + f" FROM {src} GROUP BY scene_id"}
    steps["ace_cov"] = "SELECT scene_id, " + ", ".join(
        f"covar_samp(CAST({bands[i]} AS DOUBLE), CAST({bands[j]} AS DOUBLE)) AS v{i}_{j}"
        for i in range(n) for j in range(i + 1)) + f" FROM {src} GROUP BY scene_id"
    last = "ace_cov"
    for j in range(n):
        pivot = f"v{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k}" for k in range(j))
        steps[f"ace_d{j}"] = f"SELECT *, sqrt({pivot}) AS l{j}_{j} FROM {last}"
        last = f"ace_d{j}"
        if j < n - 1:
            cols = ", ".join("(" + f"v{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
                             + f") / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, n))
            steps[f"ace_c{j}"] = f"SELECT *, {cols} FROM {last}"
            last = f"ace_c{j}"
    steps["ace_rows"] = (f"SELECT p.*, m.* EXCLUDE (scene_id), f.* EXCLUDE (scene_id) FROM {src} p"
                         f" JOIN ace_means m USING (scene_id) JOIN {last} f USING (scene_id)")
    last = "ace_rows"
    for i in range(n):
        solve = lambda head, v: "(" + head + "".join(f" - l{i}_{k} * {v}{k}" for k in range(i)) + f") / l{i}_{i} AS {v}{i}"
        steps[f"ace_s{i}"] = (f"SELECT *, {solve(f'CAST({bands[i]} AS DOUBLE) - m{i}', 'xa')},"
                              f" {solve(f't{i} - m{i}', 'ta')} FROM {last}")
        last = f"ace_s{i}"
    dot = lambda a, b: "(" + " + ".join(f"{a}{i} * {b}{i}" for i in range(n)) + ")"
    g = dot("xa", "ta")
    steps["ace_raw"] = (f"SELECT *, least(greatest(coalesce({g} * abs({g}) / nullif({dot('ta', 'ta')} * {dot('xa', 'xa')}, 0), 0),"
                        f" 0), 1) AS raw FROM {last}")
    steps["ace_range"] = "SELECT scene_id, min(raw) AS lo, max(raw) AS hi FROM ace_raw GROUP BY scene_id"
    steps["ace"] = (f"SELECT p.*, {stretch('raw', 'lo', 'hi', '1.0')} AS score"
                    " FROM ace_raw p JOIN ace_range USING (scene_id)")
    return steps


# --- mixture -----------------------------------------------------------------

_P = [(i, j) for i in range(3) for j in range(i, 3)]


def _v(i: int, j: int) -> str:
    return f"v{min(i, j)}{max(i, j)}"


_DET = (f"({_v(0,0)} * ({_v(1,1)} * {_v(2,2)} - {_v(1,2)} * {_v(1,2)}) - {_v(0,1)} * ({_v(0,1)} * {_v(2,2)} - {_v(1,2)} * {_v(0,2)})"
        f" + {_v(0,2)} * ({_v(0,1)} * {_v(1,2)} - {_v(1,1)} * {_v(0,2)}))")


def _cofactor(i: int, j: int) -> str:
    a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    minor = f"({_v(a[0], b[0])} * {_v(a[1], b[1])} - {_v(a[0], b[1])} * {_v(a[1], b[0])})"
    return minor if (i + j) % 2 == 0 else f"-{minor}"


def learn(src: str, out: str) -> dict[str, str]:
    d = lambda i: f"CAST(c{i} AS DOUBLE)"
    return {
        f"{out}_m": "SELECT scene_id, side, component, count(*) AS n, " + ", ".join(
            f"sum({d(i)}) / count(*) AS m{i}" for i in range(3)) + ", " + ", ".join(
            f"sum({d(i)} * {d(j)}) / count(*) - (sum({d(i)}) / count(*)) * (sum({d(j)}) / count(*)) AS {_v(i, j)}"
            for i, j in _P) + f" FROM {src} GROUP BY scene_id, side, component",
        f"{out}_f": f"""
  SELECT *, n / sum(n) OVER (PARTITION BY scene_id, side) AS share,
         {_DET} <= greatest({SINGULAR} * {_v(0,0)} * {_v(1,1)} * {_v(2,2)}, 2.220446049250313e-16) AS flat FROM {out}_m""",
        f"{out}_v": f"SELECT * REPLACE ({', '.join(f'{_v(i, i)} + CASE WHEN flat THEN {NOISE} ELSE 0 END AS {_v(i, i)}' for i in range(3))}) FROM {out}_f",
        out: f"SELECT *, {_DET} AS det, {', '.join(f'{_cofactor(i, j)} / {_DET} AS i{i}{j}' for i, j in _P)} FROM {out}_v"}


def density(p: str, k: str) -> str:
    d = [f"(CAST({p}.c{i} AS DOUBLE) - {k}.m{i})" for i in range(3)]
    form = " + ".join(f"{k}.i{i}{j} * {d[i]} * {d[j]}" + ("" if i == j else " * 2.0") for i, j in _P)
    return f"exp(-0.5 * ({form})) / sqrt({k}.det)"


SIDES = {
    "sided": """
  SELECT *, CAST(CASE WHEN trimap IN ('FGD', 'PR_FGD') THEN 1 ELSE 0 END AS INTEGER) AS side,
         CAST(c0 AS INTEGER) + CAST(c1 AS INTEGER) + CAST(c2 AS INTEGER) AS hue FROM guided""",
    "quintiles": """
  SELECT scene_id, side, quantile_cont(CAST(hue AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM sided GROUP BY ALL""",
    "started": "SELECT s.*, CAST(" + " + ".join(f"CASE WHEN hue > q[{i}] THEN 1 ELSE 0 END" for i in range(1, 5))
               + " AS INTEGER) AS component FROM sided s JOIN quintiles USING (scene_id, side)",
    **learn("started", "start")}

ROUND = {
    **SIDES,
    "worth": f"""
  SELECT s.scene_id, s.y, s.x, s.c0, s.c1, s.c2, s.side, s.trimap, k.component, row_number() OVER (
           PARTITION BY s.scene_id, s.y, s.x ORDER BY {density('s', 'k')} DESC, k.component) AS pos
  FROM sided s JOIN start k USING (scene_id, side)""",
    "assigned": "SELECT * FROM worth WHERE pos = 1",
    **learn("assigned", "learned"),
    "costs": f"""
  SELECT s.scene_id, s.y, s.x, s.trimap,
         -ln(greatest(sum(CASE WHEN k.side = 1 THEN k.share * {density('s', 'k')} ELSE 0 END), 1e-300)) AS fg_cost,
         -ln(greatest(sum(CASE WHEN k.side = 0 THEN k.share * {density('s', 'k')} ELSE 0 END), 1e-300)) AS bg_cost
  FROM sided s JOIN learned k USING (scene_id) GROUP BY ALL"""}

# --- colour ------------------------------------------------------------------

_M = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_I = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


def _root(t: str) -> str:
    return f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0 / CAST(3 AS DOUBLE)) ELSE 7.787 * {t} + 16.0 / CAST(116 AS DOUBLE) END"


def _cube(f: str) -> str:
    return f"CASE WHEN {f} > 6.0 / CAST(29 AS DOUBLE) THEN {f} * {f} * {f} ELSE ({f} - 16.0 / CAST(116 AS DOUBLE)) / 7.787 END"


def _gamma(c: str) -> str:
    u = f"least(greatest({c}, 0), 1)"
    return f"CASE WHEN {u} <= 0.0031308 THEN 12.92 * {u} ELSE 1.055 * pow({u}, 1.0 / CAST(2.4 AS DOUBLE)) - 0.055 END"


def _dot(row: tuple, names: list[str]) -> str:
    return " + ".join(f"{w} * {n}" for w, n in zip(row, names))


COLOR = {
    "lin": "SELECT *, " + ", ".join(f"{_linear(f'CAST(c{i} AS DOUBLE)')} AS n{i}" for i in range(3)) + " FROM features",
    "xyz": f"SELECT *, ({_dot(_M[0], ['n0', 'n1', 'n2'])}) / 0.950456 AS tx, {_dot(_M[1], ['n0', 'n1', 'n2'])} AS ty,"
           f" ({_dot(_M[2], ['n0', 'n1', 'n2'])}) / 1.088754 AS tz FROM lin",
    "roots": f"SELECT *, {_root('tx')} AS fx, {_root('ty')} AS fy, {_root('tz')} AS fz FROM xyz",
    "lab": f"SELECT *, {u8('(CASE WHEN ty > 0.008856 THEN 116.0 * fy - 16.0 ELSE 903.3 * ty END) * 2.55')} AS l8,"
           f" {u8('500.0 * (fx - fy) + 128.0')} AS a8, {u8('200.0 * (fy - fz) + 128.0')} AS b8 FROM roots",
    "mixed": f"SELECT scene_id, y, x, l8 / CAST(2.55 AS DOUBLE) AS light, {u8(f'a8 * 0.5 + ' + u8('score * 255.0') + ' * 0.5')} AS a8, b8 FROM lab",
    "fs": "SELECT *, (light + 16.0) / 116.0 AS gy, (a8 - 128.0) / 500.0 + (light + 16.0) / 116.0 AS gx,"
          " (light + 16.0) / 116.0 - (b8 - 128.0) / 200.0 AS gz FROM mixed",
    "back": f"SELECT *, ({_cube('gx')}) * 0.950456 AS ux, CASE WHEN light > 7.9996 THEN gy * gy * gy ELSE light / CAST(903.3 AS DOUBLE) END AS uy,"
            f" ({_cube('gz')}) * 1.088754 AS uz FROM fs"}

# --- assembly ----------------------------------------------------------------



def sql(final: str, steps: dict[str, str] | None = None) -> str:
    """A statement with the given steps and the inputs that it needs."""
    steps = steps or {}
    names = set(re.findall(r"\w+", " ".join([final, *steps.values()])))
    for k in reversed(INPUTS):          # inputs only use earlier ones
        if k in names:
            names |= set(re.findall(r"\w+", INPUTS[k]))
    parts = {k: v for k, v in INPUTS.items() if k in names} | steps
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n" + final


# --- statements --------------------------------------------------------------

ORACLES: dict[str, str] = {
    "scene_catalog": sql("SELECT scene_id, name, height, width, slot, role FROM catalog"),
    "scene_validation": sql("SELECT * FROM validated"),
    "scene_validation_plugin": sql(validation(8)),
    "accepted_bands": sql("""
SELECT c.scene_id, c.name, CAST(c.slot AS INTEGER) AS band FROM catalog c JOIN validated v USING (scene_id)
WHERE v.status = 'valid' AND c.role = 'band' AND c.height = v.height AND c.width = v.width"""),
    "open_catalog": sql("""
SELECT scene_id, name, height, width, role,
       CAST(CASE WHEN role = 'band' THEN row_number() OVER (PARTITION BY scene_id, role ORDER BY name) END AS INTEGER) AS band
FROM roles""", {
        "renamed": "SELECT scene_id, regexp_replace(name, '^FGT', 'mask') AS name, height, width FROM files",
        "firsts": """
  SELECT scene_id, height AS h, width AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY name) AS k FROM renamed WHERE NOT contains(name, 'mask'))
  WHERE k = 1""",
        "masks": "SELECT scene_id, max(name) AS last FROM renamed WHERE contains(name, 'mask') GROUP BY scene_id",
        "roles": """
  SELECT n.*, CASE WHEN name = last THEN 'mask' WHEN NOT contains(name, 'mask') AND height = h AND width = w THEN 'band'
                   WHEN NOT contains(name, 'mask') THEN 'resized' ELSE 'ignored' END AS role
  FROM renamed n LEFT JOIN firsts USING (scene_id) LEFT JOIN masks USING (scene_id)"""}),
    "image_scan": sql("SELECT scene_id, 'F' || band || 's.png' AS name, band, y, x, value FROM raster"),
    "channel_split": sql("""
SELECT scene_id, CAST(1 AS INTEGER) AS band, y, x, b AS value FROM colours
UNION ALL SELECT scene_id, 2, y, x, g FROM colours UNION ALL SELECT scene_id, 3, y, x, r FROM colours"""),
    "matrix_text_write": sql("""
SELECT scene_id, CAST(y + 2 AS BIGINT) AS line_no, string_agg(CAST(value AS VARCHAR), ', ' ORDER BY x) || ', ' AS line
FROM band_images GROUP BY scene_id, y
UNION ALL SELECT scene_id, k, '8' FROM (SELECT DISTINCT scene_id FROM band_images), (VALUES (0), (1)) h(k)"""),
    "matrix_text_read": sql("""
SELECT CAST(scene_id AS VARCHAR) AS path, y, x, CAST(value AS DOUBLE) AS value FROM band_images"""),
    "mask_sink": sql("SELECT scene_id, y, x, CAST(255 - label AS SMALLINT) AS label FROM labelled"),
    "rotate_quarter": sql("""
SELECT scene_id, CAST((SELECT max(x) FROM mosaic) - x AS INTEGER) AS y, y AS x, value FROM mosaic"""),

    "to_gray": sql(f"SELECT *, {u8('CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b')} AS gray FROM colours"),
    "rescale_depth": f"""
SELECT l_orderkey, l_linenumber, sample, {u8('sample * CAST(255 AS DOUBLE) / CAST(1024 AS DOUBLE)')} AS value
FROM (SELECT *, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 2048 AS INTEGER) AS sample FROM lineitem)""",
    "normalise_mixed_depth": sql(f"""
SELECT scene_id, band, y, x,
       CASE WHEN band % 2 = 0 THEN {u8('(value * 5 + band) * CAST(255 AS DOUBLE) / CAST(1024 AS DOUBLE)')}
            ELSE {u8(stretch('value', 'lo', 'hi'))} END AS value
FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM raster WINDOW w AS (PARTITION BY scene_id, band))"""),
    "band_minmax": sql(f"""
SELECT scene_id, band, y, x, {u8(stretch('v', 'lo', 'hi'))} AS value FROM halved JOIN (
  SELECT scene_id, band, min(v) AS lo, max(v) AS hi FROM halved GROUP BY ALL) USING (scene_id, band)""",
        {"halved": "SELECT *, CAST(value // 2 + 7 AS INTEGER) AS v FROM raster"}),
    "band_selectors": sql("""
SELECT scene_id, band, y, x, value, 'vis' AS role FROM raster WHERE band = 2
UNION ALL SELECT scene_id, band, y, x, value, 'bg' FROM raster JOIN (
  SELECT scene_id, max(band) AS last FROM raster GROUP BY scene_id) USING (scene_id) WHERE band = last"""),
    "background_removed": sql(f"""
SELECT scene_id, y, x, CASE WHEN n8 = n2 THEN {u8(stretch('CAST(b2 AS INTEGER) - CAST(b8 AS INTEGER)', 'lo', 'hi'))} ELSE b2 END AS value
FROM signal_all JOIN (
  SELECT scene_id, min(CAST(b2 AS INTEGER) - CAST(b8 AS INTEGER)) AS lo, max(CAST(b2 AS INTEGER) - CAST(b8 AS INTEGER)) AS hi,
         count(b8) AS n8, count(b2) AS n2 FROM signal_all GROUP BY scene_id) USING (scene_id)"""),
    "mask_invert": sql("SELECT scene_id, y, x, CAST(255 - label AS SMALLINT) AS label FROM labelled"),
    "mask_binarise": sql("""
SELECT scene_id, band, y, x, CAST(CASE WHEN value > 0 THEN 255 ELSE 0 END AS SMALLINT) AS value FROM raster"""),
    "unit_scaling": sql(f"SELECT scene_id, band, y, x, {r('value / CAST(255 AS DOUBLE)')} AS value FROM raster"),
    "foreground_rows": sql("SELECT scene_id, y, x, " + ", ".join(B8) + " FROM labelled WHERE label > 0"),
    "spectral_mean_std": sql("SELECT f.scene_id, y, x, " + ", ".join(
        f"{u8(stretch(f'f{i}', f'lo{i}', f'hi{i}'))} AS {n}" for i, n in ((1, "mean"), (2, "std")))
        + " FROM raw_features f JOIN ranges USING (scene_id)"),
    "feature_composite": sql("SELECT scene_id, y, x, c0, c1, c2 FROM features"),
    "trimap": sql(f"SELECT scene_id, y, x, label, {_trimap('score')} AS trimap FROM scored"),
    "trimap_forest": sql(f"SELECT scene_id, y, x, label, {_trimap('forest')} AS trimap FROM scored"),
    "trimap_to_mask": sql("""
SELECT scene_id, y, x, CAST(CASE WHEN trimap IN ('FGD', 'PR_FGD') THEN 255 ELSE 0 END AS SMALLINT) AS label FROM guided"""),
    "pseudo_color": sql("SELECT scene_id, y, x, " + ", ".join(
        f"{u8(f'({_gamma(_dot(row, ['ux', 'uy', 'uz']))}) * 255.0')} AS {c}" for row, c in zip(_I, "rgb")) + " FROM back", COLOR),
    "zero_scores": sql(f"SELECT scene_id, y, x, {r('CASE WHEN c0 > 200 THEN 0 ELSE score END')} AS score FROM features"),
    "segment_attrs": sql("SELECT scene_id, seg_id, " + ", ".join(f"{r(c, None)} AS {c}" for c in ("x0", "y0", "x1", "y1"))
        + f", {r(_SLOPE, None)} AS slope, {r('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))', None)} AS length,"
        f" {r('x0 + (x1 - x0) * 0.5', None)} AS cx, {r('y0 + (y1 - y0) * 0.5', None)} AS cy FROM ordered"),
    "rotate_segments": sql("SELECT scene_id, seg_id, " + ", ".join(f"{r(c, None)} AS {c}" for c in ("x0", "y0", "x1", "y1"))
        + f", {r(_SLOPE, None)} AS slope FROM turned", {"turned": "SELECT scene_id, seg_id, " + ", ".join(
        f"(x{i} - 20.0) * {math.cos(0.5)!r} - (y{i} - 5.0) * {math.sin(0.5)!r} + 20.0 AS x{i},"
        f" (x{i} - 20.0) * {math.sin(0.5)!r} + (y{i} - 5.0) * {math.cos(0.5)!r} + 5.0 AS y{i}" for i in (0, 1)) + " FROM ordered"}),
    "extend_segments": sql("SELECT scene_id, seg_id, " + ", ".join(f"{r(c, None)} AS {c}" for c in ("x0", "y0", "x1", "y1"))
        + f", {r(_SLOPE, None)} AS slope FROM prolonged", {
        # A line leaves a box where it meets the nearer of the two sides ahead.
        "slanted": """
  SELECT *, x1 - x0 AS gx, y1 - y0 AS gy, CASE WHEN (x1 - x0) * (y1 - y0) < 0 THEN 0.0 ELSE 12.0 END AS ye,
         CASE WHEN (x1 - x0) * (y1 - y0) < 0 THEN 12.0 ELSE 0.0 END AS ys FROM ordered""",
        "slopes": """
  SELECT *, gy / nullif(gx, 0) AS m, coalesce(abs(gy / nullif(gx, 0)) > abs((ye - y0) / nullif(110.0 - x0, 0)), false) AS se,
         coalesce(abs(gy / nullif(gx, 0)) > abs((ys - y0) / nullif(0.0 - x0, 0)), false) AS ss FROM slanted""",
        "prolonged": """
  SELECT scene_id, seg_id,
    CASE WHEN gx = 0 THEN x0 WHEN gy = 0 THEN 0.0 WHEN ss THEN x0 + gx / gy * (ys - y0) ELSE 0.0 END AS x0,
    CASE WHEN gx = 0 THEN 12.0 WHEN gy = 0 THEN y0 WHEN ss THEN ys ELSE y0 + m * (0.0 - x0) END AS y0,
    CASE WHEN gx = 0 THEN x0 WHEN gy = 0 THEN 110.0 WHEN se THEN x0 + gx / gy * (ye - y0) ELSE 110.0 END AS x1,
    CASE WHEN gx = 0 THEN 0.0 WHEN gy = 0 THEN y0 WHEN se THEN ye ELSE y0 + m * (110.0 - x0) END AS y1 FROM slopes"""}),
    "sigmoid_weight": sql(f"""
SELECT scene_id, y, x, {r('1.0 / (1.0 + exp(-15.0 * (b8 / CAST(255 AS DOUBLE) - b2 / CAST(255 AS DOUBLE))))')} AS weight FROM signal"""),
    "saturation_gray": sql(f"""
SELECT *, {u8('0.5 * (CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b) + 0.5 * (255.0 - (greatest(r, g, b) - least(r, g, b)))')} AS gray
FROM colours"""),
    "band_to_signal": sql("SELECT * FROM signal_all"),
    "signal_to_bands": sql("SELECT scene_id, band, y, x, value FROM raster"),

    "target_signature": sql(" UNION ALL ".join(
        f"SELECT scene_id, CAST({k} AS INTEGER) AS band, {r(f'avg(b{k}) / 255.0')} AS signature FROM spectra WHERE label = 255 GROUP BY scene_id"
        for k in range(1, 5))),
    "band_centered": sql("SELECT scene_id, " + ", ".join(
        f"{r(f'b{k} - avg(b{k}) OVER (PARTITION BY scene_id)')} AS b{k}" for k in range(1, 5)) + " FROM spectra"),
    "band_covariance": sql(" UNION ALL ".join(
        f"SELECT scene_id, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, {r(f'covar_samp(b{i}, b{j})')} AS cov FROM spectra GROUP BY scene_id"
        for i in range(1, 5) for j in range(i, 5))),
    "band_covariance8": sql(" UNION ALL ".join(
        f"SELECT scene_id, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, {r(f'covar_samp(CAST(b{i} AS DOUBLE), CAST(b{j} AS DOUBLE))')} AS cov FROM signal GROUP BY scene_id"
        for i in range(1, 9) for j in range(i, 9))),
    "band_histogram": sql("SELECT * FROM hist", histogram("mosaic", "value", "hist")),
    "otsu_threshold": sql("SELECT * FROM cut", {
        **histogram("band_images", "value", "hist"), **otsu("hist", "cut")}),
    "array_profile": sql("""
SELECT scene_id, band, max(y) + 1 AS rows, max(x) + 1 AS cols, min(value) AS lo, max(value) AS hi FROM raster GROUP BY ALL"""),
    "blob_areas": sql("SELECT * FROM areas", BLOBS),
    "blob_size_limit": sql("SELECT * FROM limits", BLOBS),
    "pca_angle": sql(f"""
SELECT event_type, {r('0.5 * atan2(2.0 * covar_samp(x, y), var_samp(x) - var_samp(y))')} AS angle FROM points GROUP BY ALL"""),
    "bounding_box": sql("""
SELECT event_type, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY ALL"""),
    "blob_boxes": sql("""
SELECT scene_id, blob_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM blobs GROUP BY ALL""", BLOBS),
    "confidence": sql(f"""
SELECT scene_id, {r('mc', 10)} AS mean_contrast, {r('ic', 10)} AS ink_contrast, {r('share', 10)} AS share,
       {r('greatest(1.0 - abs(share - 0.2) / 0.2, 0) * ic', 10)} AS confidence
FROM (SELECT scene_id, avg(contrast) AS mc, coalesce(avg(contrast) FILTER (WHERE value >= 175), 0) AS ic,
             count(*) FILTER (WHERE value >= 175) / CAST(count(*) AS DOUBLE) AS share
      FROM mosaic_contrast GROUP BY scene_id)""", contrast("mosaic")),
    "overlap_share": sql(f"""
SELECT scene_id, count(*) FILTER (WHERE b3 >= 160 AND label > 0) AS overlap, count(*) FILTER (WHERE label > 0) AS positive,
       {r('count(*) FILTER (WHERE b3 >= 160 AND label > 0) / nullif(CAST(count(*) FILTER (WHERE label > 0) AS DOUBLE), 0)')} AS share
FROM labelled GROUP BY scene_id"""),
    "contrast_scale": sql(f"""
SELECT scene_id, {r('coalesce(1.0 / (2.0 * nullif(avg(CAST((c0 - c0_n) * (c0 - c0_n) + (c1 - c1_n) * (c1 - c1_n) + (c2 - c2_n) * (c2 - c2_n) AS DOUBLE)), 0)), 0)', 12)} AS beta
FROM (SELECT scene_id, """ + ", ".join(f"CAST(c{i}{s} AS INTEGER) AS c{i}{s}" for i in range(3) for s in ("", "_n"))
        + " FROM pairs) GROUP BY scene_id", PAIRS),

    "local_contrast": sql(f"SELECT scene_id, y, x, {r('contrast')} AS contrast FROM mosaic_contrast", contrast("mosaic")),
    "contrast_edges": sql("SELECT scene_id, y, x, CAST(edge AS INTEGER) AS edge FROM mosaic_edges", edges("mosaic")),
    "stroke_width": sql("SELECT * FROM mosaic_strokes", {**edges("mosaic"), **strokes("mosaic")}),
    "local_threshold": sql(f"SELECT scene_id, y, x, CAST(n_edge AS BIGINT) AS n_edge, {r('threshold')} AS threshold, label FROM inked", {
        "flagged": "SELECT *, value >= 150 AS edge FROM mosaic", **threshold("flagged", "4", "6", "inked")}),
    "binarise_local": sql("SELECT scene_id, y, x, label FROM inked", {
        **edges("mosaic"), **strokes("mosaic"),
        "sized": "SELECT e.*, stroke_width AS sw FROM mosaic_edges e JOIN mosaic_strokes USING (scene_id)",
        **threshold("sized", "sw", "sw", "inked")}),
    "binarise_local_smoothed": sql("SELECT scene_id, y, x, median AS label FROM smoothed", {
        **edges("mosaic"), **strokes("mosaic"),
        "sized": "SELECT e.*, stroke_width AS sw FROM mosaic_edges e JOIN mosaic_strokes USING (scene_id)",
        **threshold("sized", "sw", "sw", "inked"), **median("inked", "label", 1, "smoothed")}),
    "binarise_fixed_stroke": sql("SELECT scene_id, y, x, label FROM inked", {
        **edges("mosaic"), **threshold("mosaic_edges", "3", "3", "inked")}),
    "binarise_weighted": sql("SELECT scene_id, y, x, weighted, label FROM inked", {
        **weighted("mosaic", "value", "faded"), **edges("faded", "weighted"),
        **threshold("faded_edges", "3", "3", "inked", "weighted")}),
    "binarise_color": sql("""
SELECT scene_id, y, x, CASE WHEN enhanced = 1 THEN e.label ELSE p.label END AS label, enhanced
FROM ink_e e JOIN ink_p p USING (scene_id, y, x) JOIN trust USING (scene_id)""", {
        "grey_e": f"SELECT scene_id, y, x, {u8('0.5 * (CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b) + 0.5 * (255.0 - (greatest(r, g, b) - least(r, g, b)))')} AS value FROM colours",
        "grey_p": f"SELECT scene_id, y, x, {u8('CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b')} AS value FROM colours",
        **{k: v for s in "ep" for k, v in {
            **weighted(f"grey_{s}", "value", f"faded_{s}"), **edges(f"faded_{s}", "weighted"),
            **threshold(f"faded_{s}_edges", "3", "3", f"ink_{s}", "weighted")}.items()},
        "trust": """
  SELECT scene_id, CAST(greatest(1.0 - abs(share - 0.2) / 0.2, 0) * ic >= 0.1 AS INTEGER) AS enhanced
  FROM (SELECT scene_id, coalesce(avg(contrast) FILTER (WHERE label > 0), 0) AS ic,
               count(*) FILTER (WHERE label > 0) / CAST(count(*) AS DOUBLE) AS share FROM ink_e GROUP BY scene_id)"""}),
    "sensor_noise": sql(f"""
SELECT scene_id, y, x, CASE WHEN mn = 0 AND mx = 255 THEN value ELSE {u8(stretch('v', 'lo', 'hi'))} END AS value
FROM bounded, (SELECT min(v) AS lo, max(v) AS hi FROM bounded)""", {
        **median("mosaic", "value", 2, "medians"),
        "bounded": """
  SELECT *, least(greatest(value, mn), mx) AS v FROM mosaic, (SELECT min(median) AS mn, max(median) AS mx FROM medians)"""}),
    "erode_cross": sql("SELECT * FROM done", eroded("bright", 1, "done")),
    "erode_cross_repeated": sql("SELECT * FROM done", eroded("bright", 3, "done")),
    "erode_border": sql("SELECT scene_id, y, x, mn AS label FROM boxed", {
        "boxed": box("bright", {"mn": ("min", "label")}, "2", "1")}),
    "row_runs": sql("SELECT scene_id, y, x0, x1 FROM runs", RUNS),

    "neighbor_pairs": sql("SELECT * FROM pairs", PAIRS),
    "run_edges": sql("""
SELECT a.scene_id, a.y, a.x0 AS ax0, a.x1 AS ax1, b.x0 AS bx0, b.x1 AS bx1
FROM runs a JOIN runs b ON b.scene_id = a.scene_id AND b.y = a.y + 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1""", RUNS),
    "near_blob_filter": sql(near("mosaic_mask", "anchors", 5.5), {"anchors": "SELECT * FROM mosaic WHERE value >= 225"}),
    "mask_and": sql("""
SELECT scene_id, y, x, CAST(255 AS SMALLINT) AS label FROM labelled WHERE label > 0 AND b3 >= 160"""),
    "mask_minus": sql("SELECT scene_id, y, x FROM labelled WHERE label > 0 AND b3 < 160"),
    "segment_pairs": sql(f"""
SELECT scene_id, id1, id2, {r('CASE WHEN d <> 0 THEN ax0 + n / d * gx END', None)} AS px,
       {r('CASE WHEN d <> 0 THEN ay0 + n / d * gy END', None)} AS py, {r('sqrt(sq)', None)} AS distance, {r('sq', None)} AS distance_sq
FROM (SELECT a.scene_id, a.seg_id AS id1, b.seg_id AS id2, a.x0 AS ax0, a.y0 AS ay0, a.x1 - a.x0 AS gx, a.y1 - a.y0 AS gy,
             (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) AS d,
             (b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0) AS n,
             (a.x1 - b.x0) * (a.x1 - b.x0) + (a.y1 - b.y0) * (a.y1 - b.y0) AS sq
      FROM ordered a JOIN ordered b ON b.scene_id = a.scene_id AND b.seg_id = a.seg_id + 1)"""),
    "segment_axis_hits": sql(f"""
SELECT scene_id, seg_id, axis, {r('c', None)} AS c,
  {r("CASE WHEN axis = 'x' AND gx <> 0 THEN c WHEN axis = 'y' AND gy <> 0 THEN x0 + (c - y0) * gx / gy END", None)} AS px,
  {r("CASE WHEN axis = 'y' AND gy <> 0 THEN c WHEN axis = 'x' AND gx <> 0 THEN y0 + (c - x0) * gy / gx END", None)} AS py
FROM (SELECT o.*, x1 - x0 AS gx, y1 - y0 AS gy, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END AS axis,
             o_totalprice / CASE WHEN o_orderkey % 2 = 0 THEN 5000.0 ELSE 50000.0 END AS c
      FROM ordered o JOIN orders ON o_orderkey = scene_id)"""),
    "balanced_sample": sql("SELECT scene_id, y, x, " + ", ".join(B8) + """, label FROM placed JOIN (
  SELECT DISTINCT scene_id, label, CAST(floor(i * total / take) AS BIGINT) AS p FROM sized, (SELECT range AS i FROM range(10))
  WHERE i < take) USING (scene_id, label, p)""", {
        "placed": "SELECT *, row_number() OVER (PARTITION BY scene_id, label ORDER BY y, x) - 1 AS p FROM labelled",
        "sized": """
  SELECT scene_id, label, count(*) AS total, least(10, min(count(*)) OVER (PARTITION BY scene_id)) AS take
  FROM labelled GROUP BY scene_id, label QUALIFY count(*) OVER (PARTITION BY scene_id) = 2"""}),

    "ace_score_2band": sql(f"SELECT scene_id, b1, b2, {r('score')} AS score FROM ace", coherence(["b1", "b2"], "spectra")),
    "ace_score": sql(f"SELECT scene_id, y, x, {r('score')} AS score, 'ok' AS status FROM ace", coherence(B8, "labelled")),
    "blob_labels": sql("SELECT * FROM blobs", BLOBS),
    "blob_filter": sql("""
SELECT scene_id, m.y, m.x, CAST(CASE WHEN area > 3 THEN label ELSE 0 END AS SMALLINT) AS label
FROM mosaic_mask m LEFT JOIN blobs b USING (scene_id, y, x) LEFT JOIN areas USING (scene_id, blob_id)""", BLOBS),
    "blob_filter_auto": sql("""
SELECT scene_id, m.y, m.x, CAST(CASE WHEN area > l."limit" THEN label ELSE 0 END AS SMALLINT) AS label
FROM mosaic_mask m LEFT JOIN blobs b USING (scene_id, y, x) LEFT JOIN areas USING (scene_id, blob_id)
LEFT JOIN limits l USING (scene_id)""", BLOBS),
    "isolated_blobs": sql("""
SELECT m.scene_id, m.y, m.x, CASE WHEN k.label IS NOT NULL THEN m.label ELSE CAST(0 AS SMALLINT) END AS label
FROM mosaic_mask m LEFT JOIN kept k USING (scene_id, y, x)""", {
        **BLOBS, "anchors": 'SELECT b.* FROM blobs b JOIN areas USING (scene_id, blob_id) JOIN limits USING (scene_id) WHERE area > "limit"',
        "kept": near("mosaic_mask", "anchors", 3)}),
    "gmm_components": sql(f"""
SELECT scene_id, side, component, n, {r('share')} AS share, {r('m0')} AS m0, {r('m1')} AS m1, {r('m2')} AS m2 FROM start""", SIDES),
    "gmm_round": sql(f"""
SELECT scene_id, y, x, CAST(CASE WHEN trimap = 'FGD' THEN 255 WHEN trimap = 'BGD' THEN 0 WHEN fg_cost < bg_cost THEN 255 ELSE 0 END
       AS SMALLINT) AS label, round(fg_cost, 4) AS fg_cost, round(bg_cost, 4) AS bg_cost FROM costs""", ROUND),
    "refine_round": sql(f"""
SELECT d.scene_id, d.y, d.x, erosions, CAST(depth > erosions AND base = 0 AS INTEGER) AS violation,
       {r('CASE WHEN depth > erosions AND base = 0 THEN 0 ELSE score END')} AS score
FROM depths d JOIN ends USING (scene_id)""", {
        "segmented": "SELECT *, label AS base, trimap IN ('FGD', 'PR_FGD') AS ink FROM guided",
        "depths": """
  SELECT a.scene_id, a.y, a.x, a.base, a.score, coalesce(min(abs(a.y - b.y) + abs(a.x - b.x)), 101) AS depth
  FROM segmented a LEFT JOIN segmented b ON a.scene_id = b.scene_id AND NOT b.ink GROUP BY ALL""",
        "counts": """
  SELECT scene_id, n, count(*) FILTER (WHERE depth > n) AS rest, count(*) FILTER (WHERE depth > n AND base > 0) AS hit,
         count(*) FILTER (WHERE base > 0) AS positive FROM depths, (SELECT range AS n FROM range(1, 101)) GROUP BY ALL""",
        "ends": """
  SELECT scene_id, CAST(coalesce(min(n) FILTER (WHERE rest = 0 OR hit / nullif(CAST(positive AS DOUBLE), 0) < 5.0 / 127.5), 100)
         AS INTEGER) AS erosions FROM counts GROUP BY scene_id"""}),
    "ace_map": sql(f"SELECT scene_id, CAST(7 - x AS INTEGER) AS y, y AS x, {r('score')} AS score FROM ace", coherence(B8, "labelled")),
}

CELLS = {"cells": " UNION ALL ".join(
    f"SELECT scene_id, y, x, label, CAST({k} AS INTEGER) AS band, b{k} AS value FROM labelled" for k in range(1, 9)),
    "quartiles": """
  SELECT scene_id, band, quantile_cont(CAST(value AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(value AS DOUBLE), 0.75) AS q75
  FROM cells WHERE label > 0 GROUP BY ALL""",
    "fences": f"""
  SELECT *, {floor8('q25 - 1.5 * (q75 - q25)')} AS lower, {floor8('q75 + 1.5 * (q75 - q25)')} AS upper FROM quartiles"""}
ORACLES["iqr_bounds"] = sql("SELECT * FROM fences", CELLS)
ORACLES["outlier_flags"] = sql("""
SELECT l.scene_id, l.y, l.x, CAST(CASE WHEN label > 0 AND bad THEN 100 ELSE label END AS SMALLINT) AS label
FROM labelled l JOIN (
  SELECT c.scene_id, c.y, c.x, bool_or(value < lower OR value > upper) AS bad
  FROM cells c LEFT JOIN fences f USING (scene_id, band) GROUP BY ALL) USING (scene_id, y, x)""", CELLS)


def _page(name: str, red: str, blue: str, key: str) -> dict[str, str]:
    grey = u8(f"CAST(0.299 AS DOUBLE) * {red} + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * {blue}")
    norm = lambda v, lo, hi: stretch(v, lo, hi, "1.0")
    return {
        f"{name}_in": f"SELECT scene_id, y, x, {red} AS r, g, {blue} AS b, CASE WHEN {key} >= 40 THEN 255 ELSE 0 END AS mask, {grey} AS gray FROM colours",
        f"{name}_box": box(f"{name}_in", {"eroded_mask": ("min", "mask")}, "2", "1"),
        f"{name}_range": f"""
  SELECT min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi, min(gray) AS glo, max(gray) AS ghi FROM {name}_in""",
        name: f"""
  SELECT scene_id, y, x, r, g, b, mask, {norm('r', 'lo', 'hi')} AS r_norm, {norm('g', 'lo', 'hi')} AS g_norm,
         {norm('b', 'lo', 'hi')} AS b_norm, gray, gray / CAST(255 AS DOUBLE) AS gray_unit, {norm('gray', 'glo', 'ghi')} AS gray_norm,
         mask / CAST(255 AS DOUBLE) AS mask_unit, eroded_mask, eroded_mask / CAST(255 AS DOUBLE) AS eroded_mask_unit
  FROM {name}_box, {name}_range"""}


_IMAGES = ["r", "g", "b", "mask", "r_norm", "g_norm", "b_norm", "gray", "gray_unit", "gray_norm", "mask_unit",
           "eroded_mask", "eroded_mask_unit"]
ORACLES["reconcile"] = sql(" UNION ALL ".join(f"""
SELECT coalesce(p.scene_id, q.scene_id) AS scene_id, count(*) FILTER (WHERE p.x IS NOT NULL AND q.x IS NOT NULL) AS matched,
       count(*) FILTER (WHERE q.x IS NULL) AS only_a, count(*) FILTER (WHERE p.x IS NULL) AS only_b, '{c}' AS image,
       {r(f'sum(CAST(p.{c} AS DOUBLE) - CAST(q.{c} AS DOUBLE))', 4)} AS difference
FROM one p FULL JOIN two q ON p.scene_id = q.scene_id AND p.y = q.y AND p.x = q.x GROUP BY 1""" for c in _IMAGES),
    {**_page("one", "r", "b", "g"), **_page("two", "b", "r", "b")})

# Shares of rows that a tree sees up to 0, 1, ... times, written out again.
_SHARES = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917]


def _forest(trees: int, seed: int = 7) -> dict[str, str]:
    drawn = " + ".join(f"CAST(u >= {int(s * 2 ** 32)} AS INTEGER)" for s in _SHARES)
    return {
        "painted": """SELECT scene_id, y, x, r AS b1, g AS b2, b AS b3, CASE WHEN CAST(r AS INTEGER) + g >= 280 THEN 255 ELSE 0 END AS label
  FROM colours""",
        "hashed": f"""SELECT *, CAST('0x' || substr(md5(concat_ws('|', scene_id, y, x, tree, {seed})), 1, 8) AS BIGINT) AS u
  FROM painted, (SELECT CAST(range AS INTEGER) AS tree FROM range(1, {trees + 1}))""",
        "drawn": f"SELECT *, {drawn} AS w FROM hashed",
        "tall": " UNION ALL ".join(f"SELECT scene_id, tree, {k} AS band, CAST(b{k} AS DOUBLE) AS value, w, label FROM drawn WHERE w > 0"
                                   for k in (1, 2, 3)),
        "tallied": """SELECT scene_id, tree, CAST(band AS INTEGER) AS band, value, CAST(sum(w) AS BIGINT) AS n,
         CAST(coalesce(sum(w) FILTER (WHERE label = 255), 0) AS BIGINT) AS hits FROM tall GROUP BY ALL"""}


ORACLES["forest_counts"] = sql("SELECT * FROM tallied", _forest(3))

_pure = "(CAST({1} AS DOUBLE) * {1} + CAST({0} - {1} AS DOUBLE) * ({0} - {1})) / {0}"
ORACLES["forest_splits"] = sql(f"""
SELECT scene_id, tree, any_value(total) AS n, any_value(total_hits) AS hits,
       arg_min(band, (-gain, band, value)) FILTER (WHERE gain > 1e-9) AS band,
       arg_min(value, (-gain, band, value)) FILTER (WHERE gain > 1e-9) AS value
FROM weighed GROUP BY scene_id, tree""", {**_forest(10),
    "summed": """
  SELECT a.scene_id, a.tree, a.band, a.value, CAST(sum(b.n) AS BIGINT) AS total, CAST(sum(b.hits) AS BIGINT) AS total_hits,
         CAST(sum(b.n) FILTER (WHERE b.value <= a.value) AS BIGINT) AS l, CAST(sum(b.hits) FILTER (WHERE b.value <= a.value) AS BIGINT) AS h
  FROM tallied a JOIN tallied b USING (scene_id, tree, band) GROUP BY ALL""",
    "weighed": f"""
  SELECT *, CASE WHEN l >= 50 AND total - l >= 50 THEN round({_pure.format('l', 'h')} + {_pure.format('(total - l)', '(total_hits - h)')}
         - {_pure.format('total', 'total_hits')}, 9) END AS gain FROM summed"""})
