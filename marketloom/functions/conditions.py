"""Stored condition texts as columns: Python's own grammar, of which few parts are allowed."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from functools import reduce
from io import StringIO
from tokenize import TokenError, generate_tokens, untokenize

from pyspark.sql import Column
from pyspark.sql import functions as F


class Refused(ValueError):
    """A text that is no condition over the allowed columns."""


_COMPARE: dict[type, tuple[Callable[[Column, Column], Column], bool]] = {
    # The value where a side is missing: only "differs" holds.
    ast.Lt: (lambda a, b: a < b, False), ast.LtE: (lambda a, b: a <= b, False), ast.Gt: (lambda a, b: a > b, False), ast.GtE: (lambda a, b: a >= b, False),
    ast.Eq: (lambda a, b: a == b, False), ast.NotEq: (lambda a, b: a != b, True),
}
_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
}
_LOGIC: dict[type, Callable[[Column, Column], Column]] = {ast.And: lambda a, b: a & b, ast.Or: lambda a, b: a | b}
#: Signs that mean words here, so that they bind as weakly.
_WORDS = {"&": " and ", "|": " or "}

#: Kinds of values: a comparison takes two of one kind, arithmetic takes numbers, logic takes truths.
NUMBER, TEXT, TRUTH = "number", "text", "truth"
#: Characters and nested parts of a text at most.
LONGEST, DEEPEST = 2000, 50


class _Compiler:
    def __init__(self, columns: dict[str, str]):
        self.columns = columns

    def want(self, node: ast.expr, kind: str, depth: int) -> Column:
        column, own = self.value(node, depth)
        if own != kind:
            raise Refused(f"{ast.unparse(node)} is no {kind}")
        return column

    def value(self, node: ast.expr, depth: int = 0) -> tuple[Column, str]:
        if depth > DEEPEST:
            raise Refused("nested too deeply")
        below = depth + 1
        match node:
            case ast.Constant(value=bool() as x):
                return F.lit(x), TRUTH
            case ast.Constant(value=int() | float() as x):
                return F.lit(float(x)), NUMBER
            case ast.Constant(value=str() as x):
                return F.lit(x), TEXT
            case ast.Name(id=name) if name.lower() in ("true", "false"):
                return F.lit(name.lower() == "true"), TRUTH
            case ast.Name(id=name) if name in self.columns:
                return F.col(f"`{name}`"), self.columns[name]
            case ast.BoolOp(op=op, values=parts):
                return reduce(_LOGIC[type(op)], [self.want(x, TRUTH, below) for x in parts]), TRUTH
            case ast.BinOp(op=op, left=a, right=b) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](self.want(a, NUMBER, below), self.want(b, NUMBER, below)), NUMBER
            case ast.UnaryOp(op=ast.Not() | ast.Invert(), operand=x):
                return ~self.want(x, TRUTH, below), TRUTH
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.want(x, NUMBER, below), NUMBER
            case ast.Compare(left=first, ops=ops, comparators=rest):
                sides = [first, *rest]
                return reduce(lambda a, b: a & b, [self.compared(a, op, b, below) for a, op, b in zip(sides, ops, rest)]), TRUTH
        raise Refused(f"{type(node).__name__} is not allowed" if not isinstance(node, ast.Name) else f"no such column: {node.id}")

    def compared(self, a: ast.expr, op: ast.cmpop, b: ast.expr, depth: int) -> Column:
        left, kind = self.value(a, depth)
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple)):
            hit = reduce(lambda x, y: x | y, [F.coalesce(left == self.want(x, kind, depth), F.lit(False)) for x in b.elts], F.lit(False))
            return ~hit if isinstance(op, ast.NotIn) else hit
        if type(op) not in _COMPARE:
            raise Refused(f"{type(op).__name__} is not allowed here")
        f, missing = _COMPARE[type(op)]
        return F.coalesce(f(left, self.want(b, kind, depth)), F.lit(missing))


def compile_condition(text: str, columns: dict[str, str]) -> Column:
    """A boolean column, never null, of a text such as "price < 10 and (rate > 0.1 or symbol in ['A', 'B'])".

    columns gives the kind (number, text) of every name that a text may use. Allowed are these names, numbers, texts, true, false, + - * /,
    comparisons (also chained, and in lists), and, or, not, & and | for and and or, ~ and brackets; anything else raises Refused, as do texts of
    more than LONGEST characters. A comparison with a missing value is false, only != is true.
    """
    if len(text) > LONGEST:
        raise Refused(f"longer than {LONGEST} characters")
    try:
        tokens = [(t.type, _WORDS.get(t.string, t.string)) for t in generate_tokens(StringIO(text.strip()).readline)]
        tree = ast.parse(untokenize(tokens), mode="eval")
        return _Compiler(columns).want(tree.body, TRUTH, 0)
    except (SyntaxError, RecursionError, MemoryError, ValueError, TokenError) as e:
        raise e if isinstance(e, Refused) else Refused(f"no condition: {type(e).__name__}") from e


def compile_all(texts: Iterable[str], columns: dict[str, str]) -> tuple[dict[str, Column], dict[str, str]]:
    """The columns of the texts that are conditions, and why the others are refused."""
    compiled, refused = {}, {}
    for text in texts:
        try:
            compiled[text] = compile_condition(text, columns)
        except Refused as e:
            refused[text] = str(e)
    return compiled, refused
