"""Model formulas compiled to columns.

`age + C(site) * np.log(dose) - 1` names terms: products of factors. A factor is a column, Q("any name"),
C(column), np.f(...) or I(...) of arithmetic on columns and numbers. Numeric factors become one
column of doubles; text, booleans and C(...) become 0/1 columns of their levels, the first left out
where the term without the factor is in the model too (treatment coding), else all.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

_FUNCTIONS = {
    "log": F.log, "log2": F.log2, "log10": F.log10, "log1p": F.log1p, "exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil, "sign": F.signum, "square": lambda x: x * x, "cbrt": F.cbrt,
}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: F.pow(a, b)}


def split_groups(formula: str) -> tuple[str, list[str]]:
    """Fixed part and random-intercept groups of a formula such as 'age + (1|study)'."""
    if not formula or not formula.strip():
        raise ValueError("formula must not be empty")
    term = r"\(\s*1\s*\|\s*([\w.]+)\s*\)"
    fixed = re.sub(r"\+(\s*\+)+", "+", re.sub(term, "", formula))
    return re.sub(r"^[\s+]+|[\s+]+$", "", fixed), re.findall(term, formula)


class Formula:
    """The terms of a fixed part, in order; a term is a tuple of factors (syntax trees by their text)."""

    def __init__(self, fixed: str):
        self.factors: dict[str, ast.expr] = {}
        self.intercept = True
        # ':' binds tighter than '*', as '**' does here; inside quotes it is part of a name.
        text = "".join(p if i % 2 else p.replace(":", "**") for i, p in enumerate(re.split(r"(\"[^\"]*\"|'[^']*')", fixed)))
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise ValueError(f"cannot read formula {fixed!r}") from e
        found = self._terms(tree)
        self.terms = sorted(dict.fromkeys(found), key=len)

    def _terms(self, node: ast.expr) -> list[tuple[str, ...]]:
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub)):
            left, plus = self._terms(node.left), isinstance(node.op, ast.Add)
            if isinstance(node.right, ast.Constant) and node.right.value in (0, 1):
                self.intercept = bool(node.right.value) == plus
                return left
            right = self._terms(node.right)
            return left + right if plus else [t for t in left if t not in right]
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Mult, ast.Pow)):
            left, right = self._terms(node.left), self._terms(node.right)
            both = [tuple(dict.fromkeys(a + b)) for a in left for b in right]
            return left + right + both if isinstance(node.op, ast.Mult) else both
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and node.operand.value == 1:
            self.intercept = False
            return []
        if isinstance(node, ast.Constant) and node.value in (0, 1):
            self.intercept = bool(node.value)
            return []
        if isinstance(node, ast.Name) or isinstance(node, ast.Call) and (self._called(node) in ("C", "Q", "I") or self._called(node).startswith("np.")):
            name = ast.unparse(node)
            self.factors[name] = node
            return [(name,)]
        raise ValueError(f"cannot read term {ast.unparse(node)!r}")

    @staticmethod
    def _called(node: ast.Call) -> str:
        return ast.unparse(node.func)

    def columns(self) -> list[str]:
        """Names of the table's columns that the formula reads, once each."""
        return list(dict.fromkeys(c for node in self.factors.values() for c in self._read(node)))

    def _read(self, node: ast.AST) -> list[str]:
        if isinstance(node, ast.Call):
            if self._called(node) == "Q":
                if not isinstance(node.args[0], ast.Constant):
                    raise ValueError("Q() takes a name in quotes")
                return [str(node.args[0].value)]
            return [c for a in node.args for c in self._read(a)]
        if isinstance(node, ast.Name):
            return [node.id]
        return [c for child in ast.iter_child_nodes(node) for c in self._read(child)]

    def value(self, node: ast.expr) -> Column:
        """A factor as a Column."""
        if isinstance(node, ast.Name):
            return F.col(f"`{node.id}`")
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](self.value(node.left), self.value(node.right))
        if isinstance(node, ast.Call) and len(node.args) >= 1:
            name = self._called(node)
            if name == "Q":
                return F.col(f"`{self._read(node)[0]}`")
            if name in ("I", "C"):
                return self.value(node.args[0])
            if name.startswith("np.") and name[3:] in _FUNCTIONS and len(node.args) == 1:
                return _FUNCTIONS[name[3:]](self.value(node.args[0]).cast("double"))
        raise ValueError(f"cannot compute {ast.unparse(node)!r}")

    def design(self, df: DataFrame, most_levels: int = 1000) -> tuple[list[str], list[Column]]:
        """Names and columns of the design. Levels of categories are read first (at most most_levels each)."""
        levels: dict[str, list] = {}
        for name, node in self.factors.items():
            # The kind of a call is that of what it computes: numbers, but for C() and names.
            plain = isinstance(node, ast.Name) or isinstance(node, ast.Call) and self._called(node) == "Q"
            kind = df.select(self.value(node)).schema[0].dataType
            if isinstance(node, ast.Call) and self._called(node) == "C" or plain and (not isinstance(kind, NumericType) or isinstance(kind, BooleanType)):
                held = [r[0] for r in df.select(self.value(node).alias("v")).where("v is not null").distinct().orderBy("v").limit(most_levels + 1).collect()]
                if len(held) > most_levels:
                    raise ValueError(f"{name} has more than {most_levels} levels")
                levels[name] = held
        names, columns = (["Intercept"], [F.lit(1.0)]) if self.intercept else ([], [])
        have = {frozenset()} if self.intercept else set()
        for term in self.terms:
            made = [("", F.lit(1.0))]
            for f in term:
                value = self.value(self.factors[f])
                if f in levels:
                    brief = frozenset(term) - {f} in have
                    parts = [(f"{f}[{'T.' if brief else ''}{v}]", F.when(value == F.lit(v), 1.0).when(value.isNotNull(), 0.0)) for v in levels[f][1 if brief else 0 :]]
                else:
                    parts = [(f, value.cast("double"))]
                made = [(f"{a}:{b}" if a else b, x * y if a else y) for a, x in made for b, y in parts]
            have.add(frozenset(term))
            names += [a for a, _ in made]
            columns += [x for _, x in made]
        return names, columns
