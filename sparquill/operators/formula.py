"""Formulas as columns: a small arithmetic language that becomes a Catalyst expression, and the units of its result."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import units

MOST_CHARS, MOST_NODES, MOST_EXPONENT = 2000, 200, 8
UNITS = {"": ({}, 1.0), **units.DEFINED}


def parse(formula: str) -> ast.expr:
    """The tree of a formula of names, numbers, + - * / ** and minus; anything else is an error."""
    if len(formula) > MOST_CHARS:
        raise ValueError("formula too long")
    try:
        tree = ast.parse(formula, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"no formula: {formula!r}") from e
    nodes = list(ast.walk(tree))
    if len(nodes) > MOST_NODES:
        raise ValueError("formula too large")
    for n in nodes:
        fine = isinstance(n, ast.Name | ast.Load | ast.BinOp | ast.Add | ast.Sub | ast.Mult | ast.Div | ast.Pow | ast.USub) or isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) or isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool)
        if not fine:
            raise ValueError(f"not allowed: {type(n).__name__}")
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow) and not (isinstance(n.right, ast.Constant) and abs(n.right.value) <= MOST_EXPONENT):
            raise ValueError("exponent must be a small number")
    return tree


def names(formula: str) -> set[str]:
    return {n.id for n in ast.walk(parse(formula)) if isinstance(n, ast.Name)}


def column(formula: str, values: dict[str, Column]) -> Column:
    """The formula over columns; null where a divisor is 0."""

    def build(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id not in values:
                raise ValueError(f"no value for {n.id}")
            return values[n.id].cast("double")
        if isinstance(n, ast.UnaryOp):
            return -build(n.operand)
        a, b = build(n.left), build(n.right)
        return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.Pow: lambda: F.pow(a, b)}[type(n.op)]()

    return build(parse(formula))


def unit(text: str) -> tuple[dict[str, int], float]:
    """Dimensions and factor of a unit such as event/(item*year)."""

    def build(n: ast.expr) -> tuple[dict[str, int], float]:
        if isinstance(n, ast.Name):
            if n.id not in UNITS:
                raise ValueError(f"no unit {n.id}")
            return UNITS[n.id]
        if isinstance(n, ast.Constant):
            return {}, float(n.value)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mult | ast.Div):
            return _times(build(n.left), build(n.right), 1 if isinstance(n.op, ast.Mult) else -1)
        raise ValueError(f"no unit: {text!r}")

    return build(parse(text)) if text else UNITS[""]


def _times(a: tuple, b: tuple, sign: int) -> tuple[dict[str, int], float]:
    dims = {k: a[0].get(k, 0) + sign * b[0].get(k, 0) for k in a[0] | b[0]}
    return {k: v for k, v in dims.items() if v}, a[1] * b[1] ** sign


def unit_of(formula: str, named: dict[str, str]) -> tuple[dict[str, int], float]:
    """Dimensions and factor of a formula's result; sums need equal ones."""

    def build(n: ast.expr) -> tuple[dict[str, int], float]:
        if isinstance(n, ast.Constant):
            return {}, 1.0
        if isinstance(n, ast.Name):
            return unit(named[n.id])
        if isinstance(n, ast.UnaryOp):
            return build(n.operand)
        a = build(n.left)
        if isinstance(n.op, ast.Pow):
            return reduce(lambda x, _: _times(x, a, 1 if n.right.value > 0 else -1), range(abs(int(n.right.value))), ({}, 1.0))
        b = build(n.right)
        if isinstance(n.op, ast.Mult | ast.Div):
            return _times(a, b, 1 if isinstance(n.op, ast.Mult) else -1)
        if a[0] != b[0] or abs(a[1] / b[1] - 1) > 1e-6:
            raise ValueError("units of a sum differ")
        return a

    return build(parse(formula))


def same_unit(formula: str, named: dict[str, str], wanted: str) -> bool:
    a, b = unit_of(formula, named), unit(wanted)
    return a[0] == b[0] and abs(a[1] / b[1] - 1) <= 1e-6
