"""Row expressions in text, compiled once to a Column. Names are columns; only what is listed here is allowed."""

from __future__ import annotations

import ast
import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: lambda a, b: F.pmod(a, b), ast.Pow: F.pow, ast.FloorDiv: lambda a, b: F.floor(a / b)}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_CALLS = {
    "abs": F.abs, "len": F.length, "min": F.least, "max": F.greatest, "round": lambda x, n=None: F.round(x, 0 if n is None else n),
    "int": lambda x: x.cast("long"), "float": lambda x: x.cast("double"), "str": lambda x: x.cast("string"), "bool": lambda x: x.cast("boolean"),
}


def compile_expression(text: str, columns: list[str]) -> Column:
    """Arithmetic, comparisons (chains, in, is None), and / or / not, and calls of a few functions. ValueError on anything else."""

    def value(node: ast.AST):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool, type(None))):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return -node.operand.value
        raise ValueError("only constants are allowed there")

    def go(node: ast.AST) -> Column:
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise ValueError(f"no column {node.id}")
            return F.col(f"`{node.id}`")
        if isinstance(node, ast.Constant):
            return F.lit(value(node))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](go(node.left), go(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.Not, ast.UAdd)):
            x = go(node.operand)
            return -x if isinstance(node.op, ast.USub) else ~x if isinstance(node.op, ast.Not) else x
        if isinstance(node, ast.BoolOp):
            return reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, map(go, node.values))
        if isinstance(node, ast.Compare):
            out, left = None, node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)):
                    one = go(left).isin([value(x) for x in right.elts])
                    one = ~one if isinstance(op, ast.NotIn) else one
                elif isinstance(op, (ast.Is, ast.IsNot)):
                    one = go(left).isNull() if isinstance(op, ast.Is) else go(left).isNotNull()
                elif type(op) in _COMPARE:
                    one = _COMPARE[type(op)](go(left), go(right))
                else:
                    raise ValueError("comparison isn't allowed")
                out, left = one if out is None else out & one, right
            return out
        if isinstance(node, ast.IfExp):
            return F.when(go(node.test), go(node.body)).otherwise(go(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            args = [go(x) for x in node.args]
            if node.func.id == "round" and len(node.args) == 2:
                args[1] = value(node.args[1])
            return _CALLS[node.func.id](*args)
        raise ValueError(f"{type(node).__name__} isn't allowed")

    try:
        return go(ast.parse(text, mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text}") from e


_WHERE = re.compile(r"(?is)^\s*(\w+)\s+(?:(not\s+)?(like|in|between)\s+(.*)|is\s+(not\s+)?null|(=|<>|!=|<=|>=|<|>)\s*(.*))\s*$|^\s*(\w+)\s*(=|<>|!=|<=|>=|<|>)\s*(.*)$")


def compile_where(text: str, columns: list[str]) -> Column:
    """A single predicate: column and =, <>, <, <=, >, >=, LIKE (any case), IN, BETWEEN or IS NULL."""
    m = _WHERE.match(text)
    name = m and (m[1] or m[8])
    if not m or name not in columns:
        raise ValueError(f"not a predicate: {text}")
    literal = lambda s: ast.literal_eval(s.strip())
    c = F.col(f"`{name}`")
    if m[8] or m[6]:
        op, right = (m[9], m[10]) if m[8] else (m[6], m[7])
        return {"=": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op](c, F.lit(literal(right)))
    if m[3] is None:
        return c.isNotNull() if m[5] else c.isNull()
    kind = m[3].lower()
    if kind == "like":
        out = F.lower(c).like(literal(m[4]).lower())
    elif kind == "in":
        got = literal(m[4])
        out = c.isin(list(got) if isinstance(got, tuple) else [got])
    else:
        lo, hi = re.split(r"(?i)\s+and\s+", m[4])
        out = F.coalesce(c, F.lit(0)).between(literal(lo), literal(hi))
    return ~out if m[2] else out
