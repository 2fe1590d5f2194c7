"""Text boxes on a frame: reading order, lines, clusters and bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import _CJK

#: Side of the tiles that density clusters are found in, in reaches.
TILE = 8


def smart_join(parts: list[str]) -> str:
    """Parts of one line; a space between them unless CJK meets CJK."""
    out = ""
    for p in (p.strip() for p in parts):
        if p:
            out += ("" if not out or (_CJK.match(out[-1]) and _CJK.match(p[0])) else " ") + p
    return out


def lines_of(boxes: list[tuple[float, float, float, float, str]], ratio: float = 0.30, least_px: float = 5.0) -> list[list[int]]:
    """Indexes of (x0, y0, x1, y1, text) boxes as lines from top to bottom, each from left to right.

    A box joins the line whose running mean height centre is within max(ratio * its height, least_px)."""
    lines: list[tuple[float, list[int]]] = []
    for i in sorted(range(len(boxes)), key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, boxes[i][0], i)):
        x0, y0, x1, y1, _ = boxes[i]
        y = (y0 + y1) / 2
        if lines and abs(lines[-1][0] - y) <= max(ratio * (y1 - y0), least_px):
            mean, own = lines[-1]
            lines[-1] = ((mean * len(own) + y) / (len(own) + 1), [*own, i])
        else:
            lines.append((y, [i]))
    return [sorted(own, key=lambda i: (boxes[i][0], i)) for _, own in lines]


def joined_text(frames: DataFrame, ratio: float = 0.30, least_px: float = 5.0) -> DataFrame:
    """frames with `text`: boxes joined into lines, lines by line breaks; one Arrow pass, no shuffle."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for boxes in texts:
            flat = []
            for b in boxes if boxes is not None else []:
                xs, ys = [p["x"] for p in b["polygon"]] or [0], [p["y"] for p in b["polygon"]] or [0]
                flat.append((min(xs), min(ys), max(xs), max(ys), b["text"] or ""))
            out.append("\n".join(filter(None, (smart_join([flat[i][4] for i in line]) for line in lines_of(flat, ratio, least_px)))))
        return pd.Series(out)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return frames.withColumn("text", F.pandas_udf(run, "string")("boxes"))


def reading_order(boxes: DataFrame, by: list[str], tolerance: float, tie: list[str] | None = None) -> DataFrame:
    """rank: rows of near heights from top to bottom, within a row from left to right; boxes at one place in the order of `tie`."""
    w = W.partitionBy(*by).orderBy("y_min", "x_min", *(tie or []))
    new = F.when(F.lag("y_min").over(w).isNull() | (F.col("y_min") - F.lag("y_min").over(w) > tolerance), 1).otherwise(0)
    rows = boxes.withColumn("_new", new).withColumn("_row", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("_row", "x_min", "y_min", *(tie or [])))).drop("_new", "_row")


def density_cluster(boxes: DataFrame, clusters: DataFrame) -> DataFrame:
    """The first cluster rectangle (video_id, cluster, cx0, cy0, cx1, cy1) that holds each box's centre, or null."""
    x, y = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    b = boxes.withColumn("_id", F.monotonically_increasing_id())
    hit = b.join(clusters, "video_id").where(x.between(F.col("cx0"), F.col("cx1")) & y.between(F.col("cy0"), F.col("cy1"))).groupBy("_id").agg(F.min("cluster").alias("cluster"))
    return b.join(hit, "_id", "left").drop("_id")


def grid_heat(boxes: DataFrame, cell: float) -> DataFrame:
    """(video_id, gx, gy, heat): per frame the strongest confidence**1.5 in each cell, summed over frames."""
    weight = F.pow(F.col("confidence"), 1.5)
    cells = boxes.withColumns({"_w": weight, "gx": F.explode(F.sequence(F.floor(F.col("x_min") / cell), F.floor(F.col("x_max") / cell)))})
    cells = cells.withColumn("gy", F.explode(F.sequence(F.floor(F.col("y_min") / cell), F.floor(F.col("y_max") / cell))))
    return cells.groupBy("video_id", "frame_idx", "gx", "gy").agg(F.max("_w").alias("w")).groupBy("video_id", "gx", "gy").agg(F.sum("w").alias("heat"))


def heat_clusters(boxes: DataFrame, cell: float = 16.0) -> DataFrame:
    """Rectangles of connected hot cells: over Q1 - IQR / 2 of the video's heats, after closing and one dilation.

    The grid of a video is bounded by its frame size, so it fits one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q1, q3 = np.percentile(pdf["heat"], [25, 75])
        hot = pdf[pdf["heat"] >= max(q1 - 0.5 * (q3 - q1), 1e-9)]
        gx0, gy0 = int(hot["gx"].min()) - 2, int(hot["gy"].min()) - 2
        grid = np.zeros((int(hot["gy"].max()) - gy0 + 3, int(hot["gx"].max()) - gx0 + 3), bool)
        grid[hot["gy"] - gy0, hot["gx"] - gx0] = True
        grid = dilate(erode(dilate(grid)))
        out = [(pdf["video_id"].iloc[0], k, (xs.min() + gx0) * cell, (ys.min() + gy0) * cell, (xs.max() + gx0 + 1) * cell, (ys.max() + gy0 + 1) * cell, len(xs)) for k, (ys, xs) in enumerate(components(grid))]
        return pd.DataFrame(out, columns=["video_id", "cluster", "cx0", "cy0", "cx1", "cy1", "cells"])

    return grid_heat(boxes, cell).groupBy("video_id").applyInPandas(run, "video_id string, cluster int, cx0 double, cy0 double, cx1 double, cy1 double, cells long")


def dilate(grid: np.ndarray) -> np.ndarray:
    p = np.pad(grid, 1)
    return np.logical_or.reduce([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def erode(grid: np.ndarray) -> np.ndarray:
    p = np.pad(grid, 1, constant_values=True)
    return np.logical_and.reduce([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


def components(grid: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells of each connected part, neighbours on eight sides, in reading order of their first cells."""
    label = np.where(grid, np.arange(grid.size).reshape(grid.shape) + 1, 0)
    while True:
        p = np.pad(label, 1)
        big = np.where(p == 0, np.iinfo(p.dtype).max, p)
        near = np.minimum.reduce([big[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        new = np.where(grid, near, 0)
        if (new == label).all():
            break
        label = new
    return [np.nonzero(label == k) for k in np.unique(label[grid])]


def density_scan(points: np.ndarray, eps: tuple[float, float], least: int) -> np.ndarray:
    """DBSCAN labels (-1: noise) of 2-D points under different reaches per axis, by grid cells of that size."""
    scaled = points / np.asarray(eps)
    cell: dict[tuple[int, int], list[int]] = {}
    keys = [tuple(k) for k in np.floor(scaled).astype(int)]
    for i, k in enumerate(keys):
        cell.setdefault(k, []).append(i)
    near = []
    for i, (cx, cy) in enumerate(keys):
        cand = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cell.get((cx + dx, cy + dy), ())])
        near.append(cand[((scaled[cand] - scaled[i]) ** 2).sum(1) <= 1.0])
    label, k = np.full(len(points), -1), 0
    for i in range(len(points)):
        if label[i] != -1 or len(near[i]) < least:
            continue
        label[i], stack = k, list(near[i])
        while stack:
            j = stack.pop()
            if label[j] == -1:
                label[j] = k
                if len(near[j]) >= least:
                    stack.extend(near[j])
        k += 1
    return label


def _tile_links(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """Of one tile and the border around it, per place (x, y): 0, its local cluster, for own cores; 1, the local cluster that reaches it, for
    cores of the border; 2, a core beside it, for own places that aren't cores.  A cluster is named after its smallest own core."""
    pdf = pdf.sort_values(["x", "y"])
    xy, s, own = pdf[["x", "y"]].to_numpy(), pdf[["sx", "sy"]].to_numpy(), pdf["own"].to_numpy()
    weight, cell = pdf["n"].to_numpy(), {}
    keys = [tuple(k) for k in np.floor(s).astype(int)]
    for i, k in enumerate(keys):
        cell.setdefault(k, []).append(i)
    around: dict[tuple[int, int], np.ndarray] = {}
    near: dict[int, np.ndarray] = {}

    def beside(i: int) -> np.ndarray:
        if i not in near:
            k = keys[i]
            if k not in around:
                around[k] = np.array([j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cell.get((k[0] + dx, k[1] + dy), ())])
            near[i] = around[k][((s[around[k]] - s[i]) ** 2).sum(1) <= 1.0]
        return near[i]

    core = np.zeros(len(s), np.int8) - 1  # -1: not asked yet

    def is_core(i: int) -> bool:
        if core[i] < 0:
            core[i] = weight[beside(i)].sum() >= least
        return bool(core[i])

    out, seen = [], np.zeros(len(s), bool)
    for i in np.flatnonzero(own):
        if not is_core(i):
            out += [(i, 2, j) for j in beside(i) if is_core(j)]
        elif not seen[i]:
            seen[i], stack, reached = True, [i], set()
            while stack:
                at = stack.pop()
                out.append((at, 0, i))
                for j in beside(at):
                    if not is_core(j):
                        continue
                    if not own[j]:
                        reached.add(j)
                    elif not seen[j]:
                        seen[j] = True
                        stack.append(j)
            out += [(j, 1, i) for j in reached]
    at, kind, to = (np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"video_id": pd.Series([pdf["video_id"].iloc[0]] * len(at), dtype=object), "x": xy[at, 0], "y": xy[at, 1], "kind": kind, "to_x": xy[to, 0], "to_y": xy[to, 1]})


def _smallest_of_linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """(to_x, to_y) and (ux, uy) are one cluster: the smallest name of each."""
    root: dict[tuple, tuple] = {}

    def find(a):
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b, c, d in pdf[["to_x", "to_y", "ux", "uy"]].itertuples(index=False, name=None):
        low, high = sorted((find((a, b)), find((c, d))))
        root[high] = low
    found = [(*k, *find(k)) for k in list(root)]
    return pd.DataFrame(found, columns=["to_x", "to_y", "root_x", "root_y"]).assign(video_id=pd.Series([pdf["video_id"].iloc[0]] * len(found), dtype=object))[["video_id", "to_x", "to_y", "root_x", "root_y"]]


def density_clusters(boxes: DataFrame, eps_x: float, eps_y: float, least: int = 5) -> DataFrame:
    """boxes with `cluster` (-1: noise), by density of their centres per video.

    A video is cut into tiles of TILE reaches, each with a border of two, in
    which the cores are told exactly; clusters that meet in a border are one.
    Clusters are numbered by their smallest core (x, then y); a box beside
    cores of several belongs to the first."""
    x, y = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    places = boxes.select("video_id", x.alias("x"), y.alias("y")).groupBy("video_id", "x", "y").agg(F.count(F.lit(1)).alias("n")).withColumns({"sx": F.col("x") / eps_x, "sy": F.col("y") / eps_y})
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 2.001) / TILE), F.floor((F.col(c) + 2.001) / TILE)))
    dealt = places.withColumn("tx", tiles("sx")).withColumn("ty", tiles("sy")).withColumn("own", (F.floor(F.col("sx") / TILE) == F.col("tx")) & (F.floor(F.col("sy") / TILE) == F.col("ty")))
    kind = boxes.schema["video_id"].dataType.simpleString()
    # read several times below; Spark keeps it until its cache is cleared
    found = dealt.groupBy("video_id", "tx", "ty").applyInPandas(lambda pdf: _tile_links(pdf, least), f"video_id {kind}, x double, y double, kind int, to_x double, to_y double").persist()

    def at(left: DataFrame, right: DataFrame, how: str, *names: tuple[str, str]) -> DataFrame:
        """left with what right has besides the video and the place that both name; a null video is one too."""
        r = right.withColumnsRenamed({"video_id": "_v", **{b: f"_{b}" for _, b in names}})
        on = F.col("video_id").eqNullSafe(F.col("_v"))
        for a, b in names:
            on &= F.col(a) == F.col(f"_{b}")
        return left.join(r, on, how).drop("_v", *(f"_{b}" for _, b in names))

    own = found.where("kind = 0").drop("kind")
    met = at(found.where("kind = 1").select("video_id", "x", "y", "to_x", "to_y"), own.withColumnsRenamed({"to_x": "ux", "to_y": "uy"}), "inner", ("x", "x"), ("y", "y"))
    roots = met.select("video_id", "to_x", "to_y", "ux", "uy").distinct().groupBy("video_id").applyInPandas(_smallest_of_linked, f"video_id {kind}, to_x double, to_y double, root_x double, root_y double")
    cores = at(own, roots, "left", ("to_x", "to_x"), ("to_y", "to_y")).select("video_id", "x", "y", F.coalesce("root_x", "to_x").alias("root_x"), F.coalesce("root_y", "to_y").alias("root_y"))
    numbers = cores.select("video_id", "root_x", "root_y").distinct().withColumn("cluster", F.row_number().over(W.partitionBy("video_id").orderBy("root_x", "root_y")) - 1)
    cores = at(cores, numbers, "inner", ("root_x", "root_x"), ("root_y", "root_y")).select("video_id", "x", "y", "cluster")
    beside = at(found.where("kind = 2").select("video_id", F.col("x").alias("bx"), F.col("y").alias("by"), "to_x", "to_y"), cores, "inner", ("to_x", "x"), ("to_y", "y"))
    label = cores.union(beside.groupBy("video_id", "bx", "by").agg(F.min("cluster").alias("cluster")))
    known = at(boxes.withColumns({"_cx": x, "_cy": y}), label.withColumnRenamed("cluster", "_c"), "left", ("_cx", "x"), ("_cy", "y"))
    return known.select(*boxes.columns, F.coalesce("_c", F.lit(-1)).cast("int").alias("cluster"))


def cluster_stats(boxes: DataFrame) -> DataFrame:
    """Extents, confidence-weighted centre, orientation and alignment of each cluster."""
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    x, y, c = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, F.col("confidence")
    spread = lambda v: F.percentile(v, 0.95) - F.percentile(v, 0.05)
    s = boxes.groupBy("video_id", "cluster").agg(
        F.min("x_min").alias("cx0"), F.min("y_min").alias("cy0"), F.max("x_max").alias("cx1"), F.max("y_max").alias("cy1"), F.count(F.lit(1)).alias("boxes"), F.countDistinct("frame_idx").alias("frames"),
        (F.sum(x * c) / F.sum(c)).alias("mass_x"), (F.sum(y * c) / F.sum(c)).alias("mass_y"), F.median(w / F.greatest(h, F.lit(1e-9))).alias("aspect"), spread(x).alias("sx"), spread(y).alias("sy"), spread(F.col("x_min")).alias("left"), spread(F.col("x_max")).alias("right"),
    )
    width = F.greatest(F.col("cx1") - F.col("cx0"), F.lit(1.0))
    shift = (F.col("mass_x") - (F.col("cx0") + F.col("cx1")) / 2) / width
    return s.withColumns({"orientation": F.when((F.col("aspect") < 0.8) & (F.col("sy") > F.col("sx")), "VERTICAL").otherwise("HORIZONTAL"), "alignment": F.when(shift < -0.1, "LEFT").when(shift > 0.1, "RIGHT").otherwise("CENTER")}).drop("sx", "sy", "left", "right")


def merge_clusters(clusters: DataFrame, gap: float, iou: float = 0.2, contained: float = 0.85, scale: float = 1.8) -> DataFrame:
    """Clusters that overlap, contain or nearly touch one another at like heights, as one; components within each video."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.sort_values("cluster")
        x0, y0, x1, y1 = (c[k].to_numpy() for k in ("cx0", "cy0", "cx1", "cy1"))
        bw, bh = np.minimum(x1[:, None], x1) - np.maximum(x0[:, None], x0), np.minimum(y1[:, None], y1) - np.maximum(y0[:, None], y0)
        both, area, h = np.maximum(bw, 0) * np.maximum(bh, 0), (x1 - x0) * (y1 - y0), y1 - y0
        alike = np.maximum(h[:, None], h) <= scale * np.minimum(h[:, None], h)
        near = (both / (area[:, None] + area - both) >= iou) | (both / np.minimum(area[:, None], area) >= contained) | ((bh > 0) & (-bw <= gap) & alike)
        label = np.arange(len(c))
        while True:
            new = np.where(near, label, len(c)).min(1)
            if (new == label).all():
                break
            label = new
        g = c.assign(cluster=label).groupby("cluster", as_index=False).agg(cx0=("cx0", "min"), cy0=("cy0", "min"), cx1=("cx1", "max"), cy1=("cy1", "max"), merged=("cx0", "size"))
        return g.assign(video_id=pdf["video_id"].iloc[0])[["video_id", "cluster", "cx0", "cy0", "cx1", "cy1", "merged"]]

    return clusters.groupBy("video_id").applyInPandas(run, "video_id string, cluster int, cx0 double, cy0 double, cx1 double, cy1 double, merged long")


def density_profile(boxes: DataFrame, low: str = "y_min", high: str = "y_max", around: int = 2) -> DataFrame:
    """How many boxes cover each height: +1 where one begins, -1 where it ends, summed up, and smoothed over neighbours."""
    ends = boxes.select("video_id", F.explode(F.array(F.struct(F.floor(low).alias("y"), F.lit(1).alias("d")), F.struct(F.floor(high).alias("y"), F.lit(-1).alias("d")))).alias("e")).select("video_id", "e.*")
    sums = ends.groupBy("video_id", "y").agg(F.sum("d").alias("d"))
    w = W.partitionBy("video_id").orderBy("y")
    covered = sums.withColumn("cover", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return covered.withColumn("smooth", F.avg("cover").over(w.rowsBetween(-around, around))).drop("d")


def refined_band(boxes: DataFrame, peak: float = 0.5, core: float = 0.3) -> DataFrame:
    """The range of heights around the highest cover in which it stays over `core` of it, if some of it is over `peak`."""
    p = density_profile(boxes)
    top = p.groupBy("video_id").agg(F.max("smooth").alias("_top"), F.max_by("y", F.struct("smooth", -F.col("y"))).alias("_at"))
    p = p.join(top, "video_id").withColumn("_below", F.when(F.col("smooth") < core * F.col("_top"), F.col("y")))
    lo = F.max(F.when(F.col("_below") < F.col("_at"), F.col("_below")))
    hi = F.min(F.when(F.col("_below") > F.col("_at"), F.col("_below")))
    return p.groupBy("video_id").agg(F.coalesce(lo, F.min("y")).alias("band_low"), F.coalesce(hi, F.max("y")).alias("band_high"), F.first("_top").alias("peak"))


def dominant_band(boxes: DataFrame, height: float, bins: int = 60, peak: float = 0.80, grow: float = 0.30) -> DataFrame:
    """The lowest bin on screen with `peak` of the fullest one's boxes, grown while neighbours have `grow` of it."""
    size = height / bins
    b = boxes.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("y_min") + F.col("y_max")) / 2 / size).cast("int")))
    c = b.groupBy("video_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    most = c.groupBy("video_id").agg(F.max("n").alias("_most"))
    c = c.join(most, "video_id")
    seed = c.where(F.col("n") >= peak * F.col("_most")).groupBy("video_id").agg(F.max("bin").alias("_seed"))
    strong = c.where(F.col("n") >= grow * F.col("_most")).withColumn("_i", F.col("bin") - F.row_number().over(W.partitionBy("video_id").orderBy("bin")))
    island = strong.join(seed, (strong["video_id"] == seed["video_id"]) & (F.col("bin") == F.col("_seed"))).select(strong["video_id"], "_i")
    return strong.join(island, ["video_id", "_i"]).groupBy("video_id").agg((F.min("bin") * size).alias("y_low"), ((F.max("bin") + 1) * size).alias("y_high"), F.sum("n").alias("boxes"))


def best_region(clusters: DataFrame, height: float) -> DataFrame:
    """The cluster with the best of presence, lowness and width per video."""
    score = 0.6 * F.col("frames") / F.max("frames").over(W.partitionBy("video_id")) + 0.25 * F.col("mass_y") / height + 0.15 * F.least(F.lit(1.0), (F.col("cx1") - F.col("cx0")) / F.greatest(F.max("cx1").over(W.partitionBy("video_id")), F.lit(1.0)))
    w = W.partitionBy("video_id").orderBy(F.desc("score"), "cluster")
    return clusters.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def band_iou(a0, a1, b0, b1):
    from ..functions.text import time_iou

    return time_iou(a0, a1, b0, b1)


def region_quality(boxes: DataFrame, regions: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """Per video: IoU of the region's heights with the label's, else the share of boxes in it times its compactness."""
    b = boxes.join(regions, "video_id")
    y = (F.col("y_min") + F.col("y_max")) / 2
    s = b.groupBy("video_id", "y_low", "y_high").agg(F.avg(y.between(F.col("y_low"), F.col("y_high")).cast("double")).alias("coverage"), F.max("y_max").alias("_h"))
    compact = 1 - (F.col("y_high") - F.col("y_low")) / F.greatest(F.col("_h"), F.lit(1.0))
    s = s.withColumn("score", F.col("coverage") * F.greatest(F.lit(0.0), compact))
    if label is not None:
        s = s.join(label.select("video_id", F.col("y_low").alias("_l"), F.col("y_high").alias("_u")), "video_id", "left").withColumn("score", F.coalesce(band_iou("y_low", "y_high", "_l", "_u"), F.col("score"))).drop("_l", "_u")
    return s.drop("_h")


def to_frame_coordinates(frames: DataFrame, border: float, scale: float, dx: int = 0, dy: int = 0) -> DataFrame:
    """Polygons of a scaled and bordered crop back in frame coordinates."""
    move = lambda v, d: (F.bround((v - border) / scale) + d).cast("int")
    return frames.withColumn("boxes", F.transform("boxes", lambda b: b.withField("polygon", F.transform(b["polygon"], lambda p: F.struct(move(p["x"], dx).alias("x"), move(p["y"], dy).alias("y"))))))
