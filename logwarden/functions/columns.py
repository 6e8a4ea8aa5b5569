"""Column lookup over flat and nested request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logwarden.schema import FEATURE_PREFIX, NESTED_PATHS

_NESTED_ROOTS = ("request.", "preprocessed.", "features.", "detection.", "scoring.")
_PREDICTION_NAMES = {"label": "label", "attack_type": "attack_type",
                     "score": "probability", "probability": "probability"}


def nested_path(name: str) -> str:
    """Place of a flat name in the nested document; unknown names stay as they are."""
    if not name or name.startswith(_NESTED_ROOTS):
        return name
    if name in NESTED_PATHS:
        return NESTED_PATHS[name]
    if name.startswith(FEATURE_PREFIX):
        return "features.vector." + name[len(FEATURE_PREFIX):]
    if name.startswith("prediction."):
        tail = name[len("prediction."):]
        return "detection.ml." + _PREDICTION_NAMES.get(tail, tail)
    return name


def has_path(schema: T.StructType, path: str) -> bool:
    """True when a dotted path leads through structs (or into a map) of ``schema``."""
    node: T.DataType = schema
    for part in path.split("."):
        if isinstance(node, T.MapType):
            node = node.valueType
            continue
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return False
        node = node[part].dataType
    return True


def path_col(df: DataFrame, path: str) -> Column | None:
    """Column for a dotted path, or None when the table has no such field."""
    if path in df.columns:
        return F.col(f"`{path}`")
    return F.col(path) if has_path(df.schema, path) else None


def pick(df: DataFrame, *names: str, default: object = None, skip_blank: bool = False) -> Column:
    """First non-null value among the named fields that exist in ``df``."""
    found = []
    for name in names:
        c = path_col(df, name)
        if c is not None:
            found.append(F.nullif(c.cast("string"), F.lit("")) if skip_blank else c)
    if default is not None:
        found.append(F.lit(default))
    if not found:
        return F.lit(None)
    return F.coalesce(*found) if len(found) > 1 else found[0]


def field(df: DataFrame, name: str, cast: str | None = None) -> Column:
    """A request field by flat name, read from the flat or the nested layout."""
    c = pick(df, name, nested_path(name))
    return c.cast(cast) if cast else c


def pinned(c: Column) -> Column:
    """``c`` itself, computed where it is written.

    The optimizer pushes a filter below a projection by copying the filtered column's whole
    expression into it, which explodes for columns built from other built columns. It does
    not do so for expressions that depend on the partition.
    """
    return F.when(F.spark_partition_id() >= 0, c)
