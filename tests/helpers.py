"""Small dense images as pixel tables, and back."""

import numpy as np
import pandas as pd


def table(spark, images: dict, column: str, kind: str = "smallint"):
    """``{scene_id: 2-D array}`` as (scene_id, y, x, column)."""
    parts = []
    for scene, image in images.items():
        image = np.asarray(image)
        y, x = np.indices(image.shape)
        parts.append(pd.DataFrame({"scene_id": np.int64(scene), "y": y.ravel(), "x": x.ravel(), column: image.ravel()}))
    frame = pd.concat(parts, ignore_index=True).sample(frac=1.0, random_state=3)
    return spark.createDataFrame(frame, "scene_id bigint, y int, x int, "
                                 + f"{column} {'double' if kind == 'double' else 'int'}").selectExpr(
        "scene_id", "y", "x", f"cast({column} as {kind}) as {column}")


def image(df, column: str, scene: int = 0, fill=0):
    rows = df.filter(f"scene_id = {scene}").select("y", "x", column).toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    out = np.full((rows.y.max() + 1, rows.x.max() + 1), fill, float)
    out[rows.y, rows.x] = rows[column].astype(float)
    return out


def signal(spark, cube: np.ndarray, label: np.ndarray | None = None, scene: int = 0):
    """(height, width, bands) array as a signal table."""
    h, w, c = cube.shape
    y, x = np.indices((h, w))
    frame = pd.DataFrame({"scene_id": np.int64(scene), "y": y.ravel(), "x": x.ravel(),
                          **{f"b{k + 1}": cube[:, :, k].ravel() for k in range(c)}})
    names = ["scene_id bigint", "y int", "x int", *[f"b{k + 1} int" for k in range(c)]]
    if label is not None:
        frame["label"] = label.ravel()
        names.append("label int")
    df = spark.createDataFrame(frame, ", ".join(names))
    return df.selectExpr("scene_id", "y", "x", *[f"cast({n.split()[0]} as smallint) {n.split()[0]}" for n in names[3:]])
