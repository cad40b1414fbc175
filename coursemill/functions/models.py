"""Pluggable models: embedders by name, with a deterministic one that needs no files, and a safe calculator."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType

from coursemill.functions.text import TOKEN

Embedder = Callable[[list[str]], np.ndarray]
_embedders: dict[str, Embedder] = {}


def hashing_embedder(size: int) -> Embedder:
    """Signed hashed counts of tokens, of length one; texts without tokens are zero."""
    import re
    from zlib import crc32

    pattern = re.compile(TOKEN)

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts):
            for token in pattern.findall((text or "").lower()):
                code = crc32(token.encode())
                row[code % size] += 1 if code & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def register(name: str, load: Callable[[], Embedder]) -> None:
    """Make an embedder known in this process; load runs once per process, at first use."""
    _embedders[name] = _Lazy(load)


class _Lazy:
    def __init__(self, load: Callable[[], Embedder]) -> None:
        self.load, self.model = load, None

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            self.model = self.load()
        return self.model(texts)


def embed(text: Column, size: int = 384, batch: int = 32, load: Callable[[], Embedder] | None = None) -> Column:
    """Vectors of a text column in batches; load builds the model once per worker (default: the hashing embedder)."""
    build = load or (lambda: hashing_embedder(size))

    @F.pandas_udf(ArrayType(FloatType()))
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for series in values:
            texts = series.fillna("").tolist()
            rows = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch]).tolist()]
            yield pd.Series(rows)

    return run(text)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}
_NAMES = {"pi": math.pi, "E": math.e, "e": math.e}
_FUNCTIONS = {"sqrt": math.sqrt, "Rational": operator.truediv, "abs": abs}


def calculate(expression: str | None) -> float | None:
    """The value of arithmetic with + - * / **, sqrt, pi, E and Rational; None for anything else."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            base, power = value(node.left), value(node.right)
            if abs(power) > 64:
                raise ValueError("power")
            return base**power
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Name) and node.id in _NAMES:
            return _NAMES[node.id]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
            return _FUNCTIONS[node.func.id](*map(value, node.args))
        raise ValueError(type(node).__name__)

    try:
        out = float(value(ast.parse((expression or "").strip(), mode="eval").body))
        return out if math.isfinite(out) else None
    except (ValueError, SyntaxError, TypeError, ZeroDivisionError, OverflowError, RecursionError):
        return None


@F.pandas_udf(BooleanType())
def equals(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether an expression has the expected value, within 1e-4 of it and at least 1e-8; false where either is no number."""
    for expressions, expected in pairs:
        out = []
        for a, b in zip(expressions, expected):
            x, y = calculate(a), calculate(b)
            out.append(x is not None and y is not None and abs(x - y) <= max(1e-8, 1e-4 * abs(y)))
        yield pd.Series(out, dtype="boolean")
