"""Tracks across frames, hard frames and the synthesis plan."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import arrays
from fieldlens.functions import boxes as bx
from fieldlens.operators.ordering import ensure_checkpoint_dir, ranked

COORDS = ("x1", "y1", "x2", "y2")


def frame_pairs(
    boxes: DataFrame,
    weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0),
    diagonal: float = 1000.0,
) -> DataFrame:
    """(deployment, frame, cur, prev, cost) for moth boxes of consecutive frames, met on the frame number.

    This is the cost table itself; ``frame_assignment`` needs no pairs.
    """
    moths = boxes.filter(F.col("class") == "moth")
    cols = [*COORDS, "feature", "box_id"]
    cur = moths.select("deployment", "frame", *[F.col(c).alias(f"b_{c}") for c in cols])
    prev = moths.select("deployment", (F.col("frame") + 1).alias("frame"), *[F.col(c).alias(f"a_{c}") for c in cols])
    cosine = arrays.cosine_similarity("a_feature", "b_feature")
    return cur.join(prev, ["deployment", "frame"]).select(
        "deployment", "frame", F.col("b_box_id").alias("cur"), F.col("a_box_id").alias("prev"),
        bx.tracking_cost(cosine, weights, diagonal).alias("cost"),
    )


def solve_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost one-to-one pairs of a small matrix, by shortest augmenting paths with dual prices."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    rows, cols = c.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        shortest = np.full(cols, np.inf)
        came_from = np.full(cols, -1)
        done = np.zeros(cols, dtype=bool)
        visited = [start]
        row, reach = start, 0.0
        while True:
            slack = reach + c[row] - row_price[row] - col_price
            better = ~done & (slack < shortest)
            shortest[better] = slack[better]
            came_from[better] = row
            col = int(np.argmin(np.where(done, np.inf, shortest)))
            reach = shortest[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
            visited.append(row)
        # prices move so that every edge on the tree stays tight
        row_price[start] += reach
        for r in visited[1:]:
            row_price[r] += reach - shortest[np.where(owner == r)[0][0]]
        col_price[done] += shortest[done] - reach
        while True:
            row = came_from[col]
            before = np.where(owner == row)[0]
            owner[col] = row
            if row == start:
                break
            col = int(before[before != col][0])
    pairs = [(int(owner[j]), j) for j in range(cols) if owner[j] >= 0]
    return [(j, i) for i, j in pairs] if flipped else pairs


def cost_matrix(
    cur: tuple[np.ndarray, np.ndarray], prev: tuple[np.ndarray, np.ndarray], weights: tuple[float, float, float, float], diagonal: float
) -> np.ndarray:
    """The costs of ``frame_pairs`` between two photographs, each given as corners (n x 4) and features (n x d)."""
    (b, fb), (a, fa) = cur, prev
    b, a = b[:, None, :], a[None, :, :]

    def area(v: np.ndarray) -> np.ndarray:
        return (v[..., 2] - v[..., 0] + 1) * (v[..., 3] - v[..., 1] + 1)

    inter = np.prod([np.maximum(0, np.minimum(b[..., i + 2], a[..., i + 2]) - np.maximum(b[..., i], a[..., i]) + 1) for i in (0, 1)], axis=0)
    # halves go up, as in SQL; the inner rounding keeps a half that the division left just below
    iou = np.floor(np.round(inter / (area(a) + area(b) - inter) * 100, 9) + 0.5) / 100
    ratio = np.minimum(area(a), area(b)) / np.maximum(area(a), area(b))
    shift = [(b[..., i] + b[..., i + 2]) / 2 - (a[..., i] + a[..., i + 2]) / 2 for i in (0, 1)]
    cosine = fb @ fa.T / (np.linalg.norm(fb, axis=1)[:, None] * np.linalg.norm(fa, axis=1)[None, :])
    parts = (1 - cosine, 1 - iou, 1 - ratio, np.hypot(*shift) / diagonal)
    return sum(w * p for w, p in zip(weights, parts, strict=True))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def frame_assignment(
    boxes: DataFrame,
    cost_threshold: float = 10000.0,
    weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0),
    diagonal: float = 1000.0,
) -> DataFrame:
    """(deployment, frame, cur, prev, cost): the cheapest one-to-one links of the moths of consecutive frames; a
    link at or above the threshold is cut.

    Every box goes once to its own frame and once to the next, so two photographs meet as n + m rows in one
    shuffle; their n x m costs exist only as a matrix inside the task. All boxes need features of one length.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of a deployment and frame come one after another; the last one of a batch may go on in the next."""
        held: dict[str, list[np.ndarray]] = {}
        for b in _with_end(batches):
            if b is not None:
                feature = b.column("feature")
                width = len(feature.flatten()) // max(len(b), 1)
                parts = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("deployment", "frame", "_earlier", "box_id")}
                parts["corners"] = np.stack([b.column(c).to_numpy().astype(float) for c in COORDS], axis=1)
                parts["feature"] = feature.flatten().to_numpy().reshape(len(b), width)
                held = {c: np.concatenate([held[c], v]) if held else v for c, v in parts.items()}
            if not held or not len(held["frame"]):
                continue
            change = np.flatnonzero((np.diff(held["frame"]) != 0) | (np.diff(held["deployment"]) != 0)) + 1
            edges = [0, *change.tolist(), *([len(held["frame"])] if b is None else [])]
            links: list[tuple] = []
            for x, y in itertools.pairwise(edges):
                # boxes of the frame itself come before those of the one before it
                middle = x + int(np.searchsorted(held["_earlier"][x:y], True))
                if x < middle < y:
                    cur, prev = ((held["corners"][i:j], held["feature"][i:j]) for i, j in ((x, middle), (middle, y)))
                    cost = cost_matrix(cur, prev, weights, diagonal)
                    for i, j in solve_assignment(cost):
                        links.append((held["deployment"][x], held["frame"][x], held["box_id"][x + i], held["box_id"][middle + j], cost[i, j]))
            held = {c: v[edges[-1] :] for c, v in held.items()}
            columns = list(zip(*links, strict=True)) if links else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["deployment", "frame", "cur", "prev", "cost"])

    roles = F.array(*[F.struct((F.col("frame") + d).alias("frame"), F.lit(d == 1).alias("_earlier")) for d in (0, 1)])
    feature = F.col("feature").cast("array<double>").alias("feature")
    met = boxes.filter(F.col("class") == "moth").select(
        F.col("deployment").cast("long").alias("deployment"), F.explode(roles).alias("_r"), F.col("box_id").cast("long").alias("box_id"), *COORDS, feature
    ).select("deployment", F.col("_r.frame").cast("long").alias("frame"), "_r._earlier", "box_id", *COORDS, "feature")
    laid = met.repartition("deployment", "frame").sortWithinPartitions("deployment", "frame", "_earlier", "box_id")
    links = laid.mapInArrow(assign, "deployment long, frame long, cur long, prev long, cost double")
    return links.filter(F.col("cost") < cost_threshold)


#: Photographs of a deployment that are walked through as one segment.
SEGMENT = 1000
WALKED = "deployment long, box_id long, frame long, root long, came_from long, prev_x long, prev_y long"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of the chains inside a segment, whose rows come by frame, links first. ``came_from`` is the box before the
    root where that lies in the segment before. Two frames are held at a time."""
    now, frame = None, None
    before: dict[int, tuple] = {}
    current: dict[int, tuple] = {}
    links: dict[int, int] = {}
    for b in batches:
        out = []
        columns = ("deployment", "seg", "frame", "kind", "box_id", "prev", "x", "y")
        for deployment, seg, f, kind, box, prev, x, y in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if (deployment, seg) != now:
                now, frame, before, current, links = (deployment, seg), f, {}, {}, {}
            elif f != frame:
                before, current, links = current if f == frame + 1 else {}, {}, {}
                frame = f
            if kind == 0:
                links[box] = prev
                continue
            root, came, px, py = box, None, None, None
            if box in links and links[box] in before:
                root, came, px, py = before[links[box]]
                if root is None:  # of the frame in front of the segment
                    root, came = box, links[box]
            current[box] = (None if kind == 1 else root, came, x, y)
            if kind == 2:
                out.append((deployment, box, f, root, came, px, py))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in WALKED.split(", ")])


def track_ids(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """Every box with its track id (null for non-moths), centre and the centre it came from.

    Links join consecutive photographs one to one. A segment of a deployment is walked through by one task, frame by frame; only what
    goes on from one segment to the next is then followed, by pointer doubling over the few chains that cross.
    """
    ensure_checkpoint_dir(boxes.sparkSession)
    key = "deployment"
    moths = boxes.filter(F.col("class") == "moth").select(
        *[F.col(c).cast("long").alias(c) for c in (key, "frame", "box_id")], bx.centre("x1", "x2").cast("long").alias("x"), bx.centre("y1", "y2").cast("long").alias("y"))
    seg = F.floor(F.col("frame") / SEGMENT)
    none = F.lit(None).cast("long")
    # the last frame of a segment also stands, as frame before the first, in the next one
    ahead = moths.filter(F.col("frame") % SEGMENT == SEGMENT - 1)
    rows = moths.select(key, seg.alias("seg"), "frame", F.lit(2).alias("kind"), "box_id", none.alias("prev"), "x", "y").unionByName(
        ahead.select(key, (seg + 1).alias("seg"), "frame", F.lit(1).alias("kind"), "box_id", none.alias("prev"), "x", "y")
    ).unionByName(links.select(
        F.col(key).cast("long").alias(key), seg.alias("seg"), F.col("frame").cast("long").alias("frame"), F.lit(0).alias("kind"),
        F.col("cur").cast("long").alias("box_id"), F.col("prev").cast("long").alias("prev"), none.alias("x"), none.alias("y")))
    walked = rows.repartition(key, "seg").sortWithinPartitions(key, "seg", "frame", "kind", "box_id").mapInArrow(_walked, WALKED).checkpoint()
    # chains that cross into a segment: their root there, and the root that goes on in the segment before
    crossing = walked.filter((F.col("box_id") == F.col("root")) & F.col("came_from").isNotNull()).select(key, "root", F.col("came_from").alias("box_id"))
    state = crossing.join(walked.select(key, "box_id", F.col("root").alias("next")), [key, "box_id"]).select(key, "root", "next").checkpoint()
    while True:
        hop = state.select(key, F.col("root").alias("next"), F.col("next").alias("_next"))
        moved = state.join(hop, [key, "next"], "left").withColumn("_moved", F.col("_next").isNotNull()).select(
            key, "root", F.coalesce("_next", "next").alias("next"), "_moved").checkpoint()
        state = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    first = walked.join(state, [key, "root"], "left").withColumn("root", F.coalesce("next", "root")).drop("next")
    starts = walked.filter((F.col("box_id") == F.col("root")) & F.col("came_from").isNull()).select(key, "root", "frame")
    numbered = ranked(starts, [key], [F.col("frame"), F.col("root")], F.floor(F.col("frame") / SEGMENT), "track_id").select(key, "root", "track_id")
    ids = first.join(numbered, [key, "root"]).select(key, "box_id", "track_id", "prev_x", "prev_y")
    placed = boxes.withColumn("centre_x", bx.centre("x1", "x2")).withColumn("centre_y", bx.centre("y1", "y2"))
    return placed.join(ids, [key, "box_id"], "left")


def export_tracks(tracks: DataFrame) -> DataFrame:
    """Track table with ``NA`` for boxes outside any track."""
    return tracks.withColumn("track_id", F.coalesce(F.col("track_id").cast("string"), F.lit("NA")))


def hard_example_window(
    frames: DataFrame, window: int, threshold: float, tile: int = 10_000
) -> DataFrame:
    """Frames whose 2*window neighbours agree on one class with enough confidence while the frame disagrees.

    Frames are cut into tiles that share ``window`` frames at their borders, so a long video is many groups.
    Only frames with all neighbours count.
    """
    f = F.col("frame")
    tiles = F.array_distinct(F.array(*[F.floor((f + d) / tile) for d in (-window, 0, window)]))
    laid = frames.select("*", F.floor(f / tile).alias("_own"), F.explode(tiles).alias("_tile"))
    around = Window.partitionBy("video", "_tile").orderBy("frame").rangeBetween(-window, window)
    seen = laid.withColumn("_w", F.collect_list(F.struct("frame", "class", "confidence")).over(around))
    others = F.filter("_w", lambda x: x["frame"] != f)
    first = F.col("_o")[0]["class"]
    agreed = F.forall("_o", lambda x: (x["class"] == first) & (x["confidence"] >= threshold))
    return (
        seen.filter((F.col("_tile") == F.col("_own")) & (F.size("_w") == 2 * window + 1))
        .withColumn("_o", others).filter(agreed & (F.col("class") != first))
        .select("video", "frame", "class", first.alias("correct_class"))
    )


def cyclic_assignment(
    backgrounds: DataFrame, crops: DataFrame, position: str, copies: int, crops_per_image: int
) -> DataFrame:
    """Which crop and transform each slot of each synthetic image gets: crops in turn, one of six transforms per cycle.

    ``position`` is the 0-based order of the backgrounds.
    """
    n = crops.agg(F.count("*")).scalar()
    plan = (
        backgrounds.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(crops_per_image - 1))))
        .withColumn("iter", F.col(position) * copies + F.col("copy"))
    )
    cycle = F.floor(F.col("iter") * crops_per_image / n) % 6
    return plan.select(
        "*",
        ((F.col("iter") * crops_per_image + F.col("slot")) % n).alias("crop"),
        F.when(cycle < 4, cycle).otherwise(0).cast("int").alias("rot90"),
        F.when(cycle >= 4, cycle - 4).cast("int").alias("flip_axis"),
    )
