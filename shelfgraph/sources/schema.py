"""Catalogue graph tables: five node kinds, five stored edge kinds, one derived edge."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _TEXT, _TIME = T.LongType(), T.StringType(), T.TimestampType()

SCHEMAS: dict[str, T.StructType] = {
    "product": _schema(
        productId=_LONG, productName=_TEXT, productDescription=_TEXT,
        brandId=_LONG, categoryId=_LONG, created_at=_TIME,
    ),
    "brand": _schema(brandId=_LONG, name=_TEXT, created_at=_TIME),
    "category": _schema(categoryId=_LONG, categoryName=_TEXT, parentCategoryId=_LONG, created_at=_TIME),
    "parameter": _schema(
        parameterId=_LONG, parameterName=_TEXT, value=_TEXT, created_at=_TIME, updated_at=_TIME
    ),
    "segment": _schema(segmentId=_LONG, segmentName=_TEXT),
    "made_by": _schema(productId=_LONG, brandId=_LONG),
    "belongs_to": _schema(productId=_LONG, categoryId=_LONG),
    "has_parameter": _schema(productId=_LONG, parameterId=_LONG, value=_TEXT),
    "child_of": _schema(childId=_LONG, parentId=_LONG),
    "in_segment": _schema(categoryId=_LONG, segmentId=_LONG),
}

SIMILAR_TO = _schema(sourceId=_LONG, targetId=_LONG, score=T.DoubleType(), sameBrand=T.BooleanType())

NODE_KEYS: dict[str, list[str]] = {
    "product": ["productId"],
    "brand": ["brandId"],
    "category": ["categoryId"],
    "parameter": ["parameterId", "value"],
    "segment": ["segmentId"],
}

# edge table -> list of (edge columns, node table, node columns)
EDGE_ENDS: dict[str, list[tuple[list[str], str, list[str]]]] = {
    "made_by": [(["productId"], "product", ["productId"]), (["brandId"], "brand", ["brandId"])],
    "belongs_to": [(["productId"], "product", ["productId"]), (["categoryId"], "category", ["categoryId"])],
    "has_parameter": [
        (["productId"], "product", ["productId"]),
        (["parameterId", "value"], "parameter", ["parameterId", "value"]),
    ],
    "child_of": [(["childId"], "category", ["categoryId"]), (["parentId"], "category", ["categoryId"])],
    "in_segment": [(["categoryId"], "category", ["categoryId"]), (["segmentId"], "segment", ["segmentId"])],
}


@dataclass(frozen=True)
class CatalogGraph:
    """The ten stored tables. Edges are assumed to have both ends (see quality.dangling_edges)."""

    product: DataFrame
    brand: DataFrame
    category: DataFrame
    parameter: DataFrame
    segment: DataFrame
    made_by: DataFrame
    belongs_to: DataFrame
    has_parameter: DataFrame
    child_of: DataFrame
    in_segment: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
