"""Tag filters: ``{"tags": x}`` and ``{"$and": [a, b]}``, nested at will."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTER_RESULT = T.StructType(
    [
        T.StructField("required", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


def _matches(node: Any) -> list[tuple[str, Any]]:
    """The single-field matches a filter asks for, all of which must hold."""
    if not isinstance(node, dict) or len(node) != 1:
        raise ValueError("a filter is an object with one key")
    ((field, value),) = node.items()
    if field != "$and":
        return [(field, value)]
    if not isinstance(value, list) or len(value) != 2:
        raise ValueError("$and takes two operands")
    return _matches(value[0]) + _matches(value[1])


def required_tags(text: str | None) -> list[str] | None:
    """Distinct tags a filter asks for; None for no filter."""
    if text is None:
        return None
    node = json.loads(text)
    if node is None:
        return None
    tags = []
    for field, value in _matches(node):
        if field != "tags":
            raise ValueError(f"unknown filter field {field!r}")
        if not isinstance(value, str):
            raise ValueError("a tag is a string")
        tags.append(value)
    return sorted(set(tags))


@F.pandas_udf(FILTER_RESULT)
def parse_filter(texts: pd.Series) -> pd.DataFrame:
    """``required`` tags of a JSON filter, or the ``error`` that rejects it."""
    required, errors = [], []
    for text in texts:
        try:
            required.append(required_tags(text))
            errors.append(None)
        except ValueError as problem:
            required.append(None)
            errors.append(str(problem))
    return pd.DataFrame({"required": required, "error": errors})


def with_required(queries, column: str = "filter", on_error: str = "raise"):
    """Queries with the ``required`` tag set of their filter.

    ``on_error``: ``raise`` fails the job on a malformed filter; ``keep`` leaves
    a ``filter_error`` column for the caller to route.
    """
    parsed = queries.withColumn("_f", parse_filter(F.col(column)))
    required, error = F.col("_f.required"), F.col("_f.error")
    if on_error == "keep":
        out = parsed.withColumn("required", required).withColumn("filter_error", error)
    else:
        failed = F.raise_error(F.concat(F.lit("malformed filter: "), error))
        out = parsed.withColumn(
            "required",
            F.when(error.isNull(), required).otherwise(failed.cast("array<string>")),
        )
    return out.drop("_f")


def has_tag(tags: Column, value: str | Column) -> Column:
    """Does the tag list hold the value; null lists hold nothing."""
    return F.coalesce(F.array_contains(tags, value), F.lit(False))


def tags_satisfy(tags: Column, required: Column) -> Column:
    """Null ``required`` asks for nothing; null ``tags`` satisfy only that."""
    held = F.coalesce(tags, F.array().cast("array<string>"))
    return required.isNull() | (F.size(F.array_except(required, held)) == 0)


def union_tags(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def field_list(metadata: Column, field: str) -> Column:
    """A metadata field as a list of JSON texts; null unless it is a list."""
    return F.from_json(F.get_json_object(metadata, f"$['{field}']"), "array<string>")


def contains(metadata: Column, field: str, value: Any) -> Column:
    """Does the list in ``field`` of a JSON document hold ``value``.

    Compared as JSON values, so the number 1 is not the text "1": the list is
    read as VARIANT elements and their JSON text is compared.
    """
    listed = F.try_variant_get(F.try_parse_json(metadata), f"$['{field}']", "array<variant>")
    wanted = F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":")))
    return F.coalesce(F.exists(listed, lambda v: F.to_json(v) == wanted), F.lit(False))


def filter_predicate(text: str | None, metadata: Column) -> Column:
    """A literal filter as a predicate on JSON metadata, for ``where``."""
    node = None if text is None else json.loads(text)
    if node is None:
        return F.lit(True)
    predicate = F.lit(True)
    for field, value in _matches(node):
        predicate = predicate & contains(metadata, field, value)
    return predicate
