"""A small expression language without side effects, evaluated on the driver.

Calls that touch data (``query``, column queries, ``fetch``)
run on Spark; everything else works on their small results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from strandmill.catalog import Catalog, UnknownSymbol
from strandmill.plans.column_query import collected, column_query, columnar, plain
from strandmill.plans.fetch import fetch
from strandmill.plans.forms import Call, Form, Keyword, MapForm, SetForm, Symbol, freeze, quoted, read
from strandmill.plans.relational import relational_query


def truthy(x) -> bool:
    """Only nil and false are false."""
    return x is not None and x is not False


# -- numbers ------------------------------------------------------------------
def is_number(x) -> bool:
    return isinstance(x, (int, float, np.number)) and not isinstance(x, bool)


def matrix(x):
    """Numbers and nested lists as doubles; nil is a missing value."""
    if is_number(x):
        return float(x)
    if isinstance(x, np.ndarray):
        return x.astype(float)
    return np.array([[np.nan if v is None else v for v in r] if isinstance(r, (list, tuple, np.ndarray)) else np.nan if r is None else r for r in x], float)


def back(x):
    """Arrays as nested lists of floats."""
    return x.tolist() if isinstance(x, np.ndarray) else float(x) if isinstance(x, np.number) else x


def fold(op: Callable, unit: float | None = None) -> Callable:
    """An element-wise operator of any number of arguments; rows broadcast over a matrix."""

    def run(*args):
        if not args:
            if unit is None:
                raise TypeError("an argument is needed")
            return unit
        vals = [matrix(a) for a in args]
        with np.errstate(divide="ignore", invalid="ignore"):
            if len(vals) == 1 and op in (np.subtract, np.divide):
                return back(op(0.0 if op is np.subtract else 1.0, vals[0]))
            out = vals[0]
            for v in vals[1:]:
                out = op(out, v)
        return back(out)

    return run


def compare(op: Callable) -> Callable:
    """A chain of comparisons; arrays compare element by element and give 1 and 0."""

    def run(*args):
        vals = [matrix(a) for a in args]
        if all(np.ndim(v) == 0 for v in vals):
            return all(bool(op(a, b)) for a, b in zip(vals, vals[1:]))
        out = 1.0
        for a, b in zip(vals, vals[1:]):
            out = out * op(a, b).astype(float)
        return back(out)

    return run


def equal(*args) -> bool:
    """Numerical equality of numbers and arrays; other values are equal if they are the same."""
    for a, b in zip(args, args[1:]):
        try:
            x, y = matrix(a), matrix(b)
        except (TypeError, ValueError):
            if a != b:
                return False
            continue
        if np.shape(x) != np.shape(y) or not np.all(x == y):
            return False
    return True


def mean(m, dim) -> list:
    """Mean along a dimension without missing values; the dimension stays, with size 1; NaN where all are missing."""
    a = np.atleast_2d(np.asarray(matrix(m), float)) if len(m) else np.zeros((0, 0))
    if a.ndim != 2 or int(dim) not in (0, 1):
        raise ValueError("mean works along dimension 0 or 1 of a matrix")
    ok = ~np.isnan(a)
    n = ok.sum(int(dim), keepdims=True)
    total = np.where(ok, a, 0).sum(int(dim), keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, total / n, np.nan).tolist()


# -- collections ----------------------------------------------------------------
def items(c) -> list:
    """The elements of a collection; a map's are its pairs."""
    if c is None:
        return []
    if isinstance(c, dict):
        return [[k, v] for k, v in c.items()]
    return list(c)


def invoke(f, *args):
    """Call a function, keyword, map, set or vector."""
    if isinstance(f, Keyword):
        return f(*args)
    if isinstance(f, dict):
        return get(f, *args)
    if isinstance(f, (set, frozenset)):
        return args[0] if freeze(args[0]) in f else None
    if isinstance(f, (list, tuple)):
        return f[int(args[0])]
    if callable(f):
        return f(*args)
    raise TypeError(f"{f!r} can't be called")


def get(c, k, default=None):
    if isinstance(c, dict):
        return c.get(freeze(k), default)
    if isinstance(c, (set, frozenset)):
        return k if freeze(k) in c else default
    if isinstance(c, (list, tuple, str, np.ndarray)) and is_number(k):
        i = int(k)
        return c[i] if 0 <= i < len(c) else default
    return default


def assoc(c, *kvs):
    if isinstance(c, (list, tuple)):
        out = list(c)
        for k, v in zip(kvs[::2], kvs[1::2]):
            i = int(k)
            if i == len(out):
                out.append(v)
            else:
                out[i] = v
        return out
    return {**(c or {}), **{freeze(k): v for k, v in zip(kvs[::2], kvs[1::2])}}


def group_by(f, c) -> dict:
    out: dict = {}
    for x in items(c):
        out.setdefault(freeze(invoke(f, x)), []).append(x)
    return out


def _first_of_each(xs: list) -> list:
    seen, out = set(), []
    for x in xs:
        k = freeze(x) if not isinstance(x, dict) else freeze(sorted(map(repr, x.items())))
        if k not in seen:
            seen.add(k)
            out.append(x)
    return out


FUNCTIONS: dict[str, Callable] = {
    "+": fold(np.add, 0.0),
    "-": fold(np.subtract),
    "*": fold(np.multiply, 1.0),
    "/": fold(np.divide),
    ">": compare(np.greater),
    "<": compare(np.less),
    ">=": compare(np.greater_equal),
    "<=": compare(np.less_equal),
    "=": equal,
    "map": lambda f, *cs: [invoke(f, *xs) for xs in zip(*map(items, cs))],
    "get": get,
    "assoc": assoc,
    "cons": lambda x, c: [x, *items(c)],
    "car": lambda c: next(iter(items(c)), None),
    "cdr": lambda c: items(c)[1:],
    "group-by": group_by,
    "mean": mean,
    "count": lambda c: len(items(c)) if not isinstance(c, str) else len(c),
    "distinct": lambda c: _first_of_each(items(c)),
    "apply": lambda f, *args: invoke(f, *args[:-1], *items(args[-1])),
}


def data_functions(catalog: Catalog, names: dict[str, str] | None = None) -> dict[str, Callable]:
    """The functions that reach the datasets: ``query``, ``column-query`` and ``fetch``.

    ``names`` gives further names for them, ``{"other-name": "column-query"}``,
    so that expressions written for another server run unchanged.
    """

    def query(q):
        return [{Keyword(k): plain(v) for k, v in r.asDict().items()} for r in collected(relational_query(catalog, q))]

    query.frame = lambda q: relational_query(catalog, q)  # for calls that need less than all rows and columns
    out = {
        "query": query,
        "column-query": lambda q: columnar(column_query(catalog, q)),
        "fetch": lambda reqs: fetch(catalog, reqs),
    }
    return out | {alias: out[name] for alias, name in (names or {}).items()}


# -- evaluation -------------------------------------------------------------------
def evaluate(node, scopes: list[dict]):
    if isinstance(node, Symbol):
        for s in scopes:
            if node.name in s:
                return s[node.name]
        if node.name in SPECIALS:
            return SPECIALS[node.name]
        raise UnknownSymbol(node.name)
    if isinstance(node, Form):
        if not node:
            return []
        f = evaluate(node[0], scopes)
        if any(f is s for s in SPECIALS.values()):
            return f(node, scopes)
        if (frame := _queried(node[-1], scopes)) is not None:
            if f is FUNCTIONS["map"] and len(node) == 3 and isinstance(node[1], Keyword):
                return _column(frame, node[1].name)
            if f is FUNCTIONS["count"] and len(node) == 2:
                return frame.count()
        return invoke(f, *[evaluate(x, scopes) for x in node[1:]])
    if isinstance(node, bool) or node is None or isinstance(node, (str, Keyword)):
        return node
    if is_number(node):
        return float(node)
    if isinstance(node, Call):
        return Call(evaluate(node.name, scopes), [evaluate(a, scopes) for a in node.args])
    if isinstance(node, MapForm):
        return {freeze(evaluate(k, scopes)): evaluate(v, scopes) for k, v in node}
    if isinstance(node, SetForm):
        return {freeze(evaluate(x, scopes)) for x in node}
    if isinstance(node, list):
        return [evaluate(x, scopes) for x in node]
    return node


def _queried(node, scopes):
    """The frame of an argument that is a call of the relational query; None if it isn't."""
    if not (isinstance(node, Form) and len(node) == 2 and isinstance(node[0], Symbol)):
        return None
    f = evaluate(node[0], scopes)
    return f.frame(evaluate(node[1], scopes)) if hasattr(f, "frame") else None


def _column(frame, name: str) -> list:
    """``(map :name (query ...))``: one column is planned and fetched, not all."""
    if name not in frame.columns:
        return [None] * frame.count()
    return [plain(r[0]) for r in collected(frame.select(f"`{name}`"))]


def _fn(node, scopes):
    _, names, body = node

    def run(*args):
        return evaluate(body, [dict(zip((n.name for n in names), args)), *scopes])

    return run


def _if(node, scopes):
    branch = 2 if truthy(evaluate(node[1], scopes)) else 3
    return evaluate(node[branch], scopes) if len(node) > branch else None


def _let(node, scopes):
    _, pairs, body = node
    for name, value in zip(pairs[::2], pairs[1::2]):
        scopes = [{name.name: evaluate(value, scopes)}, *scopes]
    return evaluate(body, scopes)


SPECIALS: dict[str, Callable] = {"fn": _fn, "if": _if, "let": _let, "quote": lambda node, scopes: quoted(node[1])}


def run(text: str, *scopes: dict, catalog: Catalog | None = None, names: dict[str, str] | None = None):
    """The value of an expression, with the standard functions and, given a catalog, the data functions."""
    data = data_functions(catalog, names) if catalog is not None else {}
    return evaluate(read(text), [*scopes, FUNCTIONS, data])
