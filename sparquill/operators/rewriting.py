"""Formulas as trees of rows: parts are put in the place of names, trees are written out again, and units are derived upwards."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..sources.tables import spread, stage
from . import formula, units

SYMBOLS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}
#: How strongly operators bind; a part that binds less, or as much on the right, is put in parentheses.
BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "**": 4}
NODE = ArrayType(StructType([StructField("path", ArrayType(IntegerType())), StructField("kind", StringType()), StructField("value", StringType())]))
CUT = 6


def nodes_of(text: str | None) -> list[dict] | None:
    """The nodes of a formula with their places from the root, or None where it isn't one."""
    try:
        waiting = [((), formula.parse(text or ""))]
    except ValueError:
        return None
    found = []
    while waiting:
        path, n = waiting.pop()
        kind, value, inner = "name", None, []
        if isinstance(n, ast.Constant):
            whole = float(n.value).is_integer() and abs(n.value) < 1e15
            kind, value = "number", str(int(n.value)) if whole else repr(float(n.value))
        elif isinstance(n, ast.Name):
            value = n.id
        elif isinstance(n, ast.UnaryOp):
            kind, inner = "neg", [n.operand]
        else:
            kind, inner = SYMBOLS[type(n.op)], [n.left, n.right]
        found.append({"path": list(path), "kind": kind, "value": value})
        waiting += [((*path, k), c) for k, c in enumerate(inner)]
    return found


@F.arrow_udf(NODE)
def _nodes(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("path", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string())]))
    return pa.array([nodes_of(t) for t in texts.to_pylist()], kind)


def trees(formulas: DataFrame, text: str = "formula") -> DataFrame:
    """One row for each node of each formula: the other columns, path (places from the root), kind (an operator, neg, name or number) and value. What isn't a
    formula, a null included, has no row."""
    keys = [c for c in formulas.columns if c != text]
    return formulas.select(*keys, _nodes(text).alias("_n")).select(*keys, F.inline("_n"))


def replaced(tree: DataFrame, parts: DataFrame, key: str = "model") -> DataFrame:
    """The trees with every leaf named in `parts` (key, name, formula; one row for each key and name) replaced by that formula's tree: its paths are
    appended to the leaf's. Names within parts stay."""
    own = trees(spread(parts.select(key, "name", "formula"))).select(key, F.col("name").alias("value"), F.lit("name").alias("kind"), F.col("path").alias("_path"), F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    hit = tree.join(own.hint("merge"), [key, "value", "kind"], "left")
    as_is = F.col("_kind").isNull()
    return hit.select(key, F.when(as_is, F.col("path")).otherwise(F.concat("path", "_path")).alias("path"), F.when(as_is, F.col("kind")).otherwise(F.col("_kind")).alias("kind"), F.when(as_is, F.col("value")).otherwise(F.col("_value")).alias("value"))


def _wrapped(part: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit("("), part["text"], F.lit(")"))).otherwise(part["text"])


def folded(tree: DataFrame, named: DataFrame, key: str = "model") -> DataFrame:
    """(key, text, vector, problem) of each tree: the formula written with as few parentheses as keep its tree, the vector of its unit, and why it has none: a
    name without a known unit in `named` (key, name, unit), a sum of different units or factors, or a power that isn't a plain number.

    One level is folded into the next by an aggregation of at most two parts for each node; a formula has at most 200 nodes, and every few levels are written.
    What grows with the models is joined by sorting: files of it are much smaller than its rows, so Spark would broadcast them.
    """
    tree = stage(tree)
    vectors = stage(named.select("unit").distinct().withColumn("_u", units.vector(F.col("unit"))))
    unit = named.join(vectors, "unit", "left").select(key, F.col("name").alias("value"), F.lit("name").alias("kind"), "_u").hint("merge")
    number = F.col("kind") == "number"
    vector = F.when(number, units.none()).otherwise(F.col("_u"))
    leaves = tree.where(F.col("kind").isin("name", "number")).join(unit, [key, "value", "kind"], "left")
    problem = F.when(~number & F.col("_u").isNull(), F.concat(F.lit("no unit of "), "value"))
    leaves = leaves.select(key, "path", F.col("value").alias("text"), F.lit(9).alias("binds"), F.when(number, F.col("value").cast("double")).alias("number"), vector.alias("vector"), problem.alias("problem"))
    leaves = stage(leaves)
    done = None
    for depth in range(tree.agg(F.max(F.size("path"))).first()[0] or 0, -1, -1):
        here = leaves.where(F.size("path") == depth)
        if done is not None:
            kids = done.groupBy(key, F.slice("path", 1, depth).alias("path")).agg(F.array_sort(F.collect_list(F.struct(*(c for c in done.columns if c != key)))).alias("_kids"))
            kids = kids.select(key, "path", F.get("_kids", F.lit(0)).alias("a"), F.get("_kids", F.lit(1)).alias("b")).hint("merge")
            here = here.unionByName(_joined(tree.where((F.size("path") == depth) & ~F.col("kind").isin("name", "number")).join(kids, [key, "path"]), key))
        done = stage(here) if depth % CUT == 0 else here
    return done.select(key, "text", F.when(F.col("problem").isNull(), F.col("vector")).alias("vector"), "problem")


def _joined(ops: DataFrame, key: str) -> DataFrame:
    """Nodes with their parts a and b, put together."""
    a, b, kind = F.col("a"), F.col("b"), F.col("kind")
    binds = F.try_element_at(F.create_map(*(F.lit(x) for p in BINDS.items() for x in p)), kind)
    left = _wrapped(a, (a["binds"] < binds) | (kind == "**") & (a["binds"] <= binds))
    text = F.when(kind == "neg", F.concat(F.lit("-"), left)).otherwise(F.concat(left, F.lit(" "), kind, F.lit(" "), _wrapped(b, b["binds"] <= binds)))
    vector = F.when(kind == "*", units.times(a["vector"], b["vector"])).when(kind == "/", units.times(a["vector"], b["vector"], -1)).when(kind == "**", units.raised(a["vector"], b["number"])).otherwise(a["vector"])
    own = F.when(kind.isin("+", "-") & ~F.coalesce(units.same(a["vector"], b["vector"]), F.lit(False)), "units of a sum differ").when((kind == "**") & b["number"].isNull(), "power of no number")
    return ops.select(key, "path", text.alias("text"), binds.alias("binds"), F.lit(None).cast("double").alias("number"), vector.alias("vector"), F.coalesce(a["problem"], b["problem"], own).alias("problem"))


def rewritten(models: DataFrame, parts: DataFrame, named: DataFrame, key: str = "model") -> DataFrame:
    """Each model (key, formula, wanted: the unit of its result) with the formulas of `parts` in the place of names, accepted only where the result has the
    wanted unit and scale.

    Returns key, formula (the new one if accepted, else the old one, both written out), accepted and reason ('no formula', a problem of its units, 'other
    dimensions', 'other scale', or null). A model without parts is checked as it is; one whose own text is no formula keeps it.
    """
    old = trees(spread(models.select(key, "formula")))
    bad = parts.where(_nodes("formula").isNull()).select(key).distinct().withColumn("_bad", F.lit(True))
    new = folded(replaced(old, parts, key), named, key).withColumnRenamed("text", "_new")
    was = folded(old, named, key).select(key, F.col("text").alias("_old"))
    both = models.select(key, "formula", units.vector(F.col("wanted")).alias("_w")).join(new.hint("merge"), key, "left").join(was.hint("merge"), key, "left").join(bad.hint("merge"), key, "left")
    kind, scale = F.coalesce(units.comparable(F.col("vector"), F.col("_w")), F.lit(False)), F.coalesce(units.same(F.col("vector"), F.col("_w")), F.lit(False))
    reason = F.when(F.col("_new").isNull() | F.col("_bad"), "no formula").when(F.col("problem").isNotNull(), F.col("problem")).when(~kind, "other dimensions").when(~scale, "other scale")
    both = both.withColumn("reason", reason)
    return both.select(key, F.when(F.col("reason").isNull(), F.col("_new")).otherwise(F.coalesce("_old", "formula")).alias("formula"), F.col("reason").isNull().alias("accepted"), "reason")
