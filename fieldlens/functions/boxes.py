"""Box arithmetic on x1, y1, x2, y2 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _corners(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2"))


def _overlap(a: str, b: str, pad: int) -> Column:
    ax1, ay1, ax2, ay2 = _corners(a)
    bx1, by1, bx2, by2 = _corners(b)
    w = F.greatest(F.lit(0), F.least(ax2, bx2) - F.greatest(ax1, bx1) + pad)
    h = F.greatest(F.lit(0), F.least(ay2, by2) - F.greatest(ay1, by1) + pad)
    return w * h


def area(prefix: str = "", pad: int = 0) -> Column:
    x1, y1, x2, y2 = _corners(prefix)
    return (x2 - x1 + pad) * (y2 - y1 + pad)


def iou(a: str = "a_", b: str = "b_", inclusive: bool = False) -> Column:
    """Intersection over union; ``inclusive`` counts whole pixels (+1 per side) and rounds to 2 decimals."""
    pad = 1 if inclusive else 0
    inter = _overlap(a, b, pad)
    ratio = F.try_divide(inter, area(a, pad) + area(b, pad) - inter)
    return F.round(ratio, 2) if inclusive else ratio


def area_ratio(a: str = "a_", b: str = "b_") -> Column:
    """Smaller over larger area, whole pixels."""
    return F.least(area(a, 1), area(b, 1)) / F.greatest(area(a, 1), area(b, 1))


def centre_distance(a: str = "a_", b: str = "b_", diagonal: float | Column = 1.0) -> Column:
    """Distance of the centres over the image diagonal."""
    ax1, ay1, ax2, ay2 = _corners(a)
    bx1, by1, bx2, by2 = _corners(b)
    dx = (bx1 + (bx2 - bx1) / 2) - (ax1 + (ax2 - ax1) / 2)
    dy = (by1 + (by2 - by1) / 2) - (ay1 + (ay2 - ay1) / 2)
    return F.sqrt(dx * dx + dy * dy) / diagonal


def centre(low: str | Column, high: str | Column) -> Column:
    """Whole-pixel centre of one axis."""
    return _c(low) + F.floor((_c(high) - _c(low)) / 2)


def percent_to_yolo(x="x", y="y", width="width", height="height") -> list[Column]:
    """Corner box in percent -> centre box as fractions, capped at 1, five decimals."""
    w, h = _c(width), _c(height)
    values = {"xc": (_c(x) + w / 2) / 100, "yc": (_c(y) + h / 2) / 100, "w": w / 100, "h": h / 100}
    return [F.round(F.least(v, F.lit(1.0)), 5).alias(n) for n, v in values.items()]


def yolo_to_pixels(xc="xc", yc="yc", w="w", h="h", image_width="image_width", image_height="image_height") -> list[Column]:
    """Centre box as fractions -> crop corners, each value cut toward zero before adding."""
    iw, ih = _c(image_width), _c(image_height)
    left = ((_c(xc) - _c(w) / 2) * iw).cast("int")
    top = ((_c(yc) - _c(h) / 2) * ih).cast("int")
    return [
        left.alias("x1"), top.alias("y1"),
        (left + (_c(w) * iw).cast("int")).alias("x2"), (top + (_c(h) * ih).cast("int")).alias("y2"),
    ]


def box_share(image_width: str | Column, image_height: str | Column) -> Column:
    """Share of the image in whole percent."""
    return (area() * 100 / (_c(image_width) * _c(image_height))).cast("int")


def square_crop_box(x, y, width, height, image_width, image_height) -> list[Column]:
    """Square of 1.2 times the longer side around the box, clipped to the image, cut to whole pixels."""
    iw, ih = _c(image_width), _c(image_height)
    left, top, w, h = _c(x) * iw, _c(y) * ih, _c(width) * iw, _c(height) * ih
    half = F.greatest(w, h) * 1.2 / 2
    cx, cy = left + w / 2, top + h / 2
    return [
        F.greatest(F.lit(0.0), cx - half).cast("int").alias("left"),
        F.greatest(F.lit(0.0), cy - half).cast("int").alias("upper"),
        F.least(iw.cast("double"), cx + half).cast("int").alias("right"),
        F.least(ih.cast("double"), cy + half).cast("int").alias("lower"),
    ]


def tracking_cost(cosine: Column, weights: tuple[float, float, float, float], diagonal: float | Column) -> Column:
    w_cnn, w_iou, w_box, w_dis = weights
    return (
        w_cnn * (1 - cosine) + w_iou * (1 - iou(inclusive=True)) + w_box * (1 - area_ratio())
        + w_dis * centre_distance(diagonal=diagonal)
    )
