"""Column builders: SQL text, which Catalyst parses once, instead of long chains of Column calls."""

from __future__ import annotations


def num(x: float) -> str:
    return f"cast({float(x)!r} as double)" if abs(float(x)) != float("inf") else f"double('{'-' if x < 0 else ''}Infinity')"


def dot(features: list[str], weights, intercept: float = 0.0) -> str:
    return " + ".join([num(intercept), *(f"{num(w)} * {f}" for w, f in zip(weights, features))])


def sigmoid(z: str) -> str:
    return f"1 / (1 + exp(-least(greatest({z}, -500D), 500D)))"


def squared_distance(features: list[str], center) -> str:
    return " + ".join(f"({f} - {num(c)}) * ({f} - {num(c)})" for f, c in zip(features, center))


def array_distance(a: str, b: str, metric: str = "euclidean") -> str:
    """Distance of two array<double> columns."""
    if metric == "euclidean":
        return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"
    if metric == "manhattan":
        return f"aggregate(zip_with({a}, {b}, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"
    if metric == "cosine":
        return f"1 - {array_dot(a, b)} / (sqrt({array_dot(a, a)}) * sqrt({array_dot(b, b)}) + 1e-10D)"
    raise ValueError(f"unknown metric {metric!r}")


def array_dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"


def argmin(columns: list[str]) -> str:
    """Place of the least of the columns, the first on a tie, from 0."""
    return f"array_position(array({', '.join(columns)}), least({', '.join(columns)})) - 1" if len(columns) > 1 else "0"


def argmax(columns: list[str]) -> str:
    return f"array_position(array({', '.join(columns)}), greatest({', '.join(columns)})) - 1" if len(columns) > 1 else "0"


def lse(columns: list[str]) -> str:
    """Stable log of a sum of exponentials."""
    if len(columns) == 1:
        return columns[0]
    top = f"greatest({', '.join(columns)})"
    return f"{top} + ln({' + '.join(f'exp({c} - {top})' for c in columns)})"
