"""Values deep inside JSON, as VARIANT: the nodes of a document as rows, the first value of a key, totals of objects, and numbers under several names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _under(node: Column, key: str) -> Column:
    """The value of an object's key, JSON's null too; other kinds of nodes have none."""
    if "'" in key or "\\" in key:
        return F.try_element_at(F.try_variant_get(node, "$", "map<string,variant>"), F.lit(key))
    return F.try_variant_get(node, f"$['{key}']", "variant")


def _own(node: Column, key: str) -> Column:
    """The value of an object's key, or null; other kinds of nodes have none. JSON's null counts as none."""
    found = _under(node, key)
    return F.when(~F.coalesce(F.is_variant_null(found), F.lit(True)), found)


def _levels(documents: DataFrame, id: str, json: str, depth: int, without: str | None = None) -> tuple[DataFrame, list[str]]:
    """(id, and a column for each level): arrays of struct(path, node, below) of a document's objects and arrays level by level, the root alone first, with the
    values that stand in each. What stands under the key `without` isn't entered. Each level comes from the one above within the row, so a document is
    parsed once and no node is handed on but in its row."""

    def within(path: Column, node: Column) -> Column:
        fields = F.try_variant_get(node, "$", "map<string,variant>")
        if without is not None:
            fields = F.map_filter(fields, lambda key, _: key != without)
        below = F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.map_values(fields))
        return F.struct(path.alias("path"), node.alias("node"), below.alias("below"))

    def entered(n: Column) -> Column:
        return F.filter(F.transform(n["below"], lambda c, k: within(F.concat(n["path"], F.array(k)), c)), lambda m: m["below"].isNotNull())

    rows = documents.select(id, F.try_parse_json(json).alias("_node"))
    rows = rows.select(id, F.array(within(F.array().cast("array<int>"), F.col("_node"))).alias("_0"))
    for k in range(depth):
        known = F.filter(f"_{k}", lambda n: n["below"].isNotNull()) if k == 0 else F.col(f"_{k}")
        rows = rows.withColumn(f"_{k + 1}", F.flatten(F.transform(known, entered)))
    return rows, [f"_{k}" for k in range(depth + 1)]


def nodes(documents: DataFrame, id: str, json: str, depth: int, without: str | None = None) -> DataFrame:
    """(id, path, node) of objects and arrays down to `depth` levels under the root; what stands under the key `without` isn't entered.

    path holds places: elements in order, an object's values in the order of their keys (JSON gives them none of its own). Null texts and such as aren't
    JSON have no node.
    """
    rows, levels = _levels(documents, id, json, depth, without)
    return rows.select(id, F.explode_outer(F.concat(*levels)).alias("n")).select(id, "n.path", "n.node").where("node IS NOT NULL")


def _holding(documents: DataFrame, id: str, json: str, key: str, depth: int, without: str | None = None) -> DataFrame:
    """(id, path, value): what stands under a key in the nodes that have it. No other node leaves its row."""
    rows, levels = _levels(documents, id, json, depth, without)
    held = lambda level: F.filter(F.transform(level, lambda n: F.struct(n["path"].alias("path"), _under(n["node"], key).alias("value"))), lambda h: h["value"].isNotNull() & ~F.is_variant_null(h["value"]))
    # explode would have Spark test the arrays first, for which it derives every level anew.
    return rows.select(id, F.explode_outer(F.concat(*map(held, levels))).alias("h")).select(id, "h.path", "h.value").where("value IS NOT NULL")


def first_under(documents: DataFrame, id: str, json: str, key: str, depth: int = 6) -> DataFrame:
    """(id, value): the first value that isn't null under a key, parents before children and elements in order, as text; a document without one has no row."""
    held = _holding(documents, id, json, key, depth)
    plain = F.coalesce(F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")), F.to_json("value"))
    return held.select(id, "path", plain.alias("value")).groupBy(id).agg(F.min_by("value", "path").alias("value"))


def first_finite(node: Column, *keys: str) -> Column:
    """The first of several keys whose value is a finite number (texts of digits and booleans aren't); null where none is, so unknown stays unknown."""

    def one(key: str) -> Column:
        found = _own(node, key)
        number = F.when(F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(found, "$", "double"))
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)

    return F.coalesce(*map(one, keys))


def totals(documents: DataFrame, id: str, json: str, under: str, fields: dict[str, tuple[str, ...]], depth: int = 8) -> DataFrame:
    """One row for each document: sums of numbers in all objects under a key, down to `depth` levels, which themselves aren't searched. A field is the first
    finite of its names; a sum without any number is null, not 0."""
    held = _holding(documents, id, json, under, depth, without=under).withColumnRenamed("value", "_held")
    sums = held.groupBy(id).agg(*(F.sum(first_finite(F.col("_held"), *names)).alias(name) for name, names in fields.items()))
    return documents.select(id).join(sums, id, "left")
