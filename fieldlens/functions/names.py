"""Path, key and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def image_path(dataset_key="datasetKey", coreid="coreid", count="cnt") -> Column:
    """``dataset/coreid[_count].jpg``; a missing dataset prints as ``nan``."""
    suffix = F.when(_c(count) > 0, F.concat(F.lit("_"), _c(count).cast("string"))).otherwise(F.lit(""))
    return F.concat(
        F.coalesce(_c(dataset_key), F.lit("nan")), F.lit("/"), _c(coreid).cast("string"), suffix, F.lit(".jpg")
    )


def sample_key(path="image_path") -> Column:
    """Path without its last extension, lower case, dots as underscores."""
    return F.translate(F.lower(F.regexp_replace(_c(path), r"(?<=[^/])\.[^./]*$", "")), ".", "_")


def base_name(path) -> Column:
    """Last path part, trailing slashes ignored."""
    return F.element_at(F.split(F.regexp_replace(_c(path), "/+$", ""), "/"), -1)


def file_stem(path) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def true_label(filename) -> Column:
    """Text after the last '-', extension removed."""
    return F.regexp_replace(F.substring_index(_c(filename), "-", -1), r"\.[^.]*$", "")


def true_rank(filename) -> Column:
    """Last '_' part of the text before the first '-'."""
    return F.substring_index(F.substring_index(_c(filename), "-", 1), "_", -1)


def path_part(path, back: int) -> Column:
    """Path part counted from the end (1 = file name); null when the path is shorter."""
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-back))


def decoded(path) -> Column:
    """Scan metadata gives file paths percent-encoded; a plus sign stands for itself there."""
    return F.url_decode(F.replace(_c(path), F.lit("+"), F.lit("%2B")))


def file_time(ts) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' in the session time zone."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def region_of_deployment(deployment) -> Column:
    """Region by place name, first rule wins; null when no place is known."""
    # fixed values
    rules = [
        (("Panama",), "CentralAmerica"),
        (("UK", "Denmark"), "WesternEurope"),
        (("Quebec", "Vermont"), "NorthEasternAmerica"),
    ]
    out = F.lit(None).cast("string")
    for places, region in reversed(rules):
        hit = F.lit(False)
        for place in places:
            hit = hit | _c(deployment).contains(place)
        out = F.when(hit, F.lit(region)).otherwise(out)
    return out


def binary_label(label) -> Column:
    """Moth / Non-Moth ground truth; crops without a usable label give null."""
    return (
        F.when(_c(label).isin("Unidentifiable", "Unclassified"), F.lit(None).cast("string"))
        .when(_c(label) == "Non-Moth", F.lit("Non-Moth"))
        .when(_c(label).isNotNull(), F.lit("Moth"))
    )


def binary_prediction(order_name) -> Column:
    return F.when(_c(order_name) == "Lepidoptera", F.lit("Moth")).otherwise(F.lit("Non-Moth"))
