"""Native selectors: which nodes of one type match. Each is one filter over one wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SelectionError(ValueError):
    """A selector that can't be answered; an empty answer is not an error."""

    def __init__(self, category: str, message: str):
        super().__init__(f"{category}: {message}")
        self.category = category


def scalar_type(value: object) -> str:
    """bool, int, float, str and null are types of their own: true isn't 1, and 1 isn't '1'."""
    if value is None:
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "str"}[type(value)]


SQL_TYPES = {
    "str": (T.StringType,),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "bool": (T.BooleanType,),
}


def same_type(df: DataFrame, feature: str, values: list) -> None:
    """Refuse values whose type isn't the feature's, as SQL would otherwise cast them."""
    if feature not in df.columns:
        raise SelectionError("feature_missing", feature)
    found = type(df.schema[feature].dataType)
    for v in values:
        if found not in SQL_TYPES.get(scalar_type(v), ()):
            raise SelectionError("value_type", f"{feature} doesn't hold {v!r}")


def membership(nodes: DataFrame) -> DataFrame:
    """All nodes of the type."""
    return nodes.select("node")


def value_predicate(nodes: DataFrame, feature: str, value) -> DataFrame:
    """Nodes whose feature has one value of the feature's own type."""
    same_type(nodes, feature, [value])
    return nodes.where(F.col(feature) == F.lit(value)).select("node")


def value_set_predicate(nodes: DataFrame, feature: str, values: list) -> DataFrame:
    """Nodes whose feature has one of some values: one filter, no union."""
    if not values or len(set(map(repr, values))) != len(values):
        raise SelectionError("value_set", "values must be distinct, and one at least")
    same_type(nodes, feature, values)
    return nodes.where(F.col(feature).isin(values)).select("node").distinct()


def present(feature: str) -> Column:
    """Null and the empty string aren't values."""
    return F.col(feature).isNotNull() & (F.col(feature).cast("string") != "")


def guarded_membership(nodes: DataFrame, feature: str | None = None) -> DataFrame:
    """Nodes of the type; with a guard, those alone that have a value of it."""
    return (nodes if feature is None else nodes.where(present(feature))).select("node")


def text_value(nodes: DataFrame, feature: str, value: str) -> DataFrame:
    """Nodes whose feature, written as text, equals a value: the catalog's rule."""
    return nodes.where(F.col(feature).cast("string") == value).select("node")


def invalid_nodes(nodes: DataFrame, key: str = "node") -> DataFrame:
    """Ids that aren't positive, are null, or occur more than once, with how often they do."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col(key) <= 0) | (F.col("n") > 1))


def all_values(nodes: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Nodes whose features each have one of some values: atoms over one table are one filter, and reach its scan."""
    condition = F.lit(True)
    for feature, values in wanted.items():
        if not values or len(set(map(repr, values))) != len(values):
            raise SelectionError("value_set", "values must be distinct, and one at least")
        same_type(nodes, feature, values)
        condition = condition & F.col(feature).isin(values)
    return nodes.where(condition).select("node").distinct()


def required(nodes: DataFrame, what: str) -> DataFrame:
    """The nodes, if there are any; a type that was found before and is empty now is an error and no answer."""
    if nodes.isEmpty():
        raise SelectionError("invalid_result_nodes", f"{what} has no nodes")
    return nodes
