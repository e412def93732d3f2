"""Declared column types of the metadata tables."""

from __future__ import annotations

MEDIA = {"coreid": "bigint", "identifier": "string"}

OCCURRENCE = {
    "id": "bigint",
    "datasetKey": "string",
    "speciesKey": "bigint",
    "familyKey": "bigint",
    "orderKey": "bigint",
    "acceptedTaxonKey": "bigint",
    "lifeStage": "string",
    "decimalLatitude": "double",
    "decimalLongitude": "double",
    "eventDate": "timestamp",
}

VERIFICATION = "image_path string, width int, height int, fetch_date timestamp, file_size bigint, corrupted boolean"

LIFESTAGE_PREDICTIONS = "image_path string, life_stage_prediction string"

ANNOTATION_ITEM = (
    "struct<id:string,type:string,value:struct<x:double,y:double,width:double,height:double,"
    "labels:array<string>,taxonomy:array<array<string>>>>"
)

ANNOTATION_TASK = (
    "data struct<image:string,deployment:string>, annotations array<struct<result:array<"
    + ANNOTATION_ITEM
    + ">,reviews:array<struct<fixed_annotation_history:array<string>,fixed_annotation_history_result:array<"
    + ANNOTATION_ITEM
    + ">>>>>"
)


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())
