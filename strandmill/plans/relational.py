"""Relational queries written as maps, compiled to Spark SQL over the catalog's views.

Identifiers are keywords (``Keyword`` objects, or strings that start with a
colon); other strings are literals. Only SELECT exists here, functions come
from an allow-list, and result columns have lower-case names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from strandmill.catalog import Catalog, QueryError
from strandmill.plans.forms import Call, Keyword

#: fixed values: functions a query may call
FUNCTIONS = frozenset(
    """abs ceil floor round sqrt exp ln log log10 log2 power pow sign mod pi rand sin cos tan asin acos atan atan2 degrees radians
    lower upper trim ltrim rtrim length char_length substring substr replace concat concat_ws left right lpad rpad instr locate
    position repeat reverse ascii chr char space translate split regexp_replace regexp_extract initcap hex unhex
    coalesce nullif ifnull nvl if greatest least isnan nanvl
    year month day dayofmonth hour minute second quarter date_add date_sub datediff current_date current_timestamp date_trunc
    count sum avg min max stddev stddev_pop stddev_samp variance var_pop var_samp median any_value first last
    count_distinct collect_list collect_set array size array_contains element_at sort_array array_distinct explode
    cast try_cast distinct group_concat listagg""".split()
)
#: fixed values: spelling of operators
BINARY = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "not=": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "like": "LIKE", "regexp": "RLIKE",
          "+": "+", "-": "-", "*": "*", "/": "/", "%": "%", "mod": "%"}
JOINS = {"join": "INNER JOIN", "left-join": "LEFT JOIN", "right-join": "RIGHT JOIN", "full-join": "FULL JOIN", "semi-join": "LEFT SEMI JOIN", "anti-join": "LEFT ANTI JOIN"}
CLAUSES = {"select", "modifiers", "from", "where", "group-by", "having", "order-by", "limit", "offset", "cross-join", *JOINS}
SET_OPS = {"union": "UNION", "union-all": "UNION ALL", "intersect": "INTERSECT", "except": "EXCEPT"}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


def is_name(x) -> bool:
    return isinstance(x, Keyword) or (isinstance(x, str) and x.startswith(":"))


def text_of(x) -> str:
    return x.name if isinstance(x, Keyword) else x[1:]


def ident(x) -> str:
    """``:dataset.probe-map`` -> ```dataset`.`probe_map```; ``-`` is written for ``_``."""
    parts = []
    for p in text_of(x).split("."):
        if p == "*":
            parts.append("*")
            continue
        p = p.replace("-", "_")
        if not NAME.match(p):
            raise QueryError(f"not an identifier: {x}")
        parts.append(f"`{p.lower()}`")
    return ".".join(parts)


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, float):
        if x != x:
            return "double('NaN')"
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x) + "D"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise QueryError(f"not a value: {x!r}")


class Compiler:
    """Map -> SQL. Inline tables become temporary views of the compiler."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.made: list[str] = []  # views, which go when the plan is made
        self.views: dict[str, str] = {}  # table -> view; only of the tables that the query names

    # -- expressions -----------------------------------------------------
    def call(self, name: str, args: list) -> str:
        name = name.lower().replace("-", "_")
        if name not in FUNCTIONS:
            raise QueryError(f"function {name!r} is not allowed")
        if name == "group_concat":
            return self.group_concat(args)
        if name == "distinct":
            return f"DISTINCT {self.expr(args[0])}"
        if name == "count_distinct":
            return f"count(DISTINCT {', '.join(map(self.expr, args))})"
        if name in ("cast", "try_cast"):
            kind = text_of(args[1]) if is_name(args[1]) else str(args[1])
            if not re.fullmatch(r"[A-Za-z]+(\(\d+(,\s*\d+)?\))?", kind):
                raise QueryError(f"not a type: {kind}")
            return f"{name}({self.expr(args[0])} AS {kind})"
        if name == "count" and args and is_name(args[0]) and text_of(args[0]) == "*":
            return "count(*)"
        return f"{name}({', '.join(self.expr(a) for a in args)})"

    def group_concat(self, args: list) -> str:
        """``[:group_concat x :order y :separator s]``: texts joined in the order of ``y``."""
        value, order, sep = args[0], None, ","
        rest = list(args[1:])
        while rest:
            key = text_of(rest[0]) if is_name(rest[0]) else ""
            if key in ("order", "order-by") and len(rest) > 1:
                order, rest = rest[1], rest[2:]
            elif key == "separator" and len(rest) > 1:
                sep, rest = rest[1], rest[2:]
            else:
                raise QueryError(f"group_concat: unexpected {rest[0]!r}")
        if order is not None and isinstance(order, (list, tuple)) and order and isinstance(order[0], (list, tuple)):
            order = order[0]
        by = value if order is None else order
        sep_sql = self.expr(sep)
        if sep_sql.startswith("'"):
            return f"listagg(CAST({self.expr(value)} AS STRING), {sep_sql}) WITHIN GROUP (ORDER BY {self.expr(by)})"
        # a computed separator: listagg takes constants only
        pairs = f"array_sort(collect_list(named_struct('o', {self.expr(by)}, 'v', CAST({self.expr(value)} AS STRING))))"
        return f"array_join(transform({pairs}, x -> x.v), {sep_sql})"

    def expr(self, x) -> str:
        if isinstance(x, Call):
            return self.call(text_of(x.name) if is_name(x.name) else str(x.name), x.args)
        if is_name(x):
            t = text_of(x)
            if t.startswith("%"):  # :%count.id, :%distinct.col, :%now
                name, _, arg = t[1:].partition(".")
                return self.call(name, [Keyword(arg)] if arg else [])
            return ident(x)
        if isinstance(x, dict):
            return f"({self.query(x)})"
        if isinstance(x, (list, tuple)):
            if x and (is_name(x[0]) or isinstance(x[0], str)):
                return self.predicate(x)
            return "(" + ", ".join(self.expr(v) for v in x) + ")"
        return literal(x)

    def predicate(self, x) -> str:
        op = text_of(x[0]) if is_name(x[0]) else str(x[0])
        low, args = op.lower(), list(x[1:])
        if low in ("and", "or"):
            if not args:
                return "TRUE" if low == "and" else "FALSE"
            return "(" + f" {low.upper()} ".join(self.expr(a) for a in args) + ")"
        if low == "not":
            return f"(NOT {self.expr(args[0])})"
        if low in ("is", "is-not", "is_not"):
            a, b = args if args[1] is None else args[::-1]
            if b is not None:
                raise QueryError("is: one side must be nil")
            return f"({self.expr(a)} IS {'NOT ' if low != 'is' else ''}NULL)"
        if low in ("in", "not-in"):
            inner = f"({self.query(args[1])})" if isinstance(args[1], dict) else self.values(args[1])
            return f"({self.expr(args[0])} {'NOT ' if low == 'not-in' else ''}IN {inner})"
        if low == "between":
            return f"({self.expr(args[0])} BETWEEN {self.expr(args[1])} AND {self.expr(args[2])})"
        if low == "exists":
            return f"(EXISTS ({self.query(args[0])}))"
        if low == "case":
            pairs = [(args[i], args[i + 1]) for i in range(0, len(args) - 1, 2)]
            out = "CASE"
            for k, v in pairs:
                if is_name(k) and text_of(k) == "else":
                    out += f" ELSE {self.expr(v)}"
                else:
                    out += f" WHEN {self.expr(k)} THEN {self.expr(v)}"
            return out + " END"
        if low in ("=", "<>", "!=", "not=") and None in args:
            other = args[0] if args[1] is None else args[1]
            return f"({self.expr(other)} IS {'' if low == '=' else 'NOT '}NULL)"
        if low in BINARY:
            if len(args) == 1 and low == "-":
                return f"(- {self.expr(args[0])})"
            return "(" + f" {BINARY[low]} ".join(self.expr(a) for a in args) + ")"
        return self.call(op, args)

    def values(self, items) -> str:
        some = [v for v in items if v is not None]  # a NULL in the list never matches
        return "(" + ", ".join(self.expr(v) for v in some) + ")" if some else "(SELECT NULL WHERE FALSE)"

    # -- tables ----------------------------------------------------------
    def table(self, x) -> str:
        """A table, ``[table alias]``, a subquery or a literal relation."""
        alias = None
        if isinstance(x, (list, tuple)):
            if len(x) != 2:
                raise QueryError(f"not a table: {x!r}")
            x, alias = x
        if isinstance(x, dict):
            keys = {text_of(k) if is_name(k) else str(k): v for k, v in x.items()}
            if "table" in keys:
                spec = keys["table"]
                name = self.inline(spec[0])
                alias = alias or spec[1]
            else:
                name = f"({self.query(x)})"
            if alias is None:
                return name
            return f"{name} AS {ident(alias)}"
        name = ident(x).replace("`", "")
        if name not in self.views:
            if name not in self.catalog.names():
                raise QueryError(f"unknown table {name!r}")
            self.views[name] = self.view(self.catalog.system(name))
        return f"`{self.views[name]}` AS {ident(alias) if alias is not None else f'`{name}`'}"

    def view(self, df: DataFrame) -> str:
        name = f"mill_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self.made.append(name)
        return name

    def inline(self, columns) -> str:
        """``[[name type values]...]`` as a view; the planner broadcasts it after a check of its size."""
        kinds = {"varchar": "string", "int": "int", "integer": "int", "bigint": "bigint", "double": "double", "float": "float", "boolean": "boolean"}
        if columns and not isinstance(columns[0], (list, tuple)):
            columns = [columns]
        schema, data = [], []
        for name, kind, values in columns:
            k = kinds.get((text_of(kind) if is_name(kind) else str(kind)).lower())
            if k is None:
                raise QueryError(f"unknown type {kind}")
            cast = {"string": str, "int": int, "bigint": int, "double": float, "float": float, "boolean": bool}[k]
            schema.append(f"{ident(name)} {k}")
            data.append([None if v is None else cast(v) for v in values])
        if len({len(d) for d in data}) > 1:
            raise QueryError("columns of a literal table differ in length")
        return f"`{self.view(self.catalog.spark.createDataFrame(list(zip(*data)), ', '.join(schema)))}`"

    # -- queries -----------------------------------------------------------
    def column(self, x) -> str:
        if isinstance(x, (list, tuple)) and len(x) == 2 and is_name(x[1]) and not (isinstance(x[0], str) and not is_name(x[0])):
            return f"{self.expr(x[0])} AS {ident(x[1])}"
        return self.expr(x)

    def grouped(self, x, keys: list[str]) -> str:
        """A selected column of a grouped query; a plain column that is no key has any of its values in the group."""
        name, alias = (x[0], x[1]) if isinstance(x, (list, tuple)) and len(x) == 2 and is_name(x[1]) and is_name(x[0]) else (x, None)
        if not is_name(name) or text_of(name).startswith("%") or text_of(name).endswith("*"):
            return self.column(x)
        sql = ident(name)
        if sql in keys or (sql.count(".") == 0 and any(k.endswith("." + sql) for k in keys)) or (sql.split(".")[-1] in keys):
            return self.column(x)
        return f"any_value({sql}) AS {ident(alias) if alias is not None else sql.split('.')[-1]}"

    def query(self, q: dict) -> str:
        q = {(text_of(k) if is_name(k) else str(k)).replace("_", "-"): v for k, v in q.items()}
        for k, sql in SET_OPS.items():
            if k in q:
                out = f" {sql} ".join(f"({self.query(p)})" for p in q[k])
                return out + self.tail(q)
        if bad := set(q) - CLAUSES:
            raise QueryError(f"not allowed in a query: {', '.join(sorted(bad))}")
        if "select" not in q:
            raise QueryError("only SELECT queries are allowed")
        keys = [self.expr(g) for g in q.get("group-by") or []]
        columns = [self.grouped(c, keys) if keys else self.column(c) for c in q["select"]]
        mods = [text_of(m) if is_name(m) else str(m) for m in q.get("modifiers", [])]
        sql = "SELECT " + ("DISTINCT " if "distinct" in mods else "") + ", ".join(columns)
        if q.get("from"):
            sql += " FROM " + ", ".join(self.table(t) for t in q["from"])
        for k, j in JOINS.items():
            pairs = q.get(k) or []
            for t, cond in zip(pairs[::2], pairs[1::2]):
                sql += f" {j} {self.table(t)} ON {self.expr(cond)}"
        for t in q.get("cross-join") or []:
            sql += f" CROSS JOIN {self.table(t)}"
        if q.get("where"):
            sql += f" WHERE {self.expr(q['where'])}"
        if keys:
            sql += " GROUP BY " + ", ".join(keys)
        if q.get("having"):
            sql += f" HAVING {self.expr(q['having'])}"
        return sql + self.tail(q)

    def tail(self, q: dict) -> str:
        sql = ""
        if q.get("order-by"):
            sql += " ORDER BY " + ", ".join(self.order(o) for o in q["order-by"])
        if q.get("limit") is not None:
            sql += f" LIMIT {int(q['limit'])}"
        if q.get("offset"):
            sql += f" OFFSET {int(q['offset'])}"
        return sql

    def order(self, o) -> str:
        if isinstance(o, (list, tuple)) and len(o) == 2 and is_name(o[1]) and text_of(o[1]).lower() in ("asc", "desc"):
            return f"{self.expr(o[0])} {text_of(o[1]).upper()}"
        return self.expr(o)


def relational_query(catalog: Catalog, q: dict) -> DataFrame:
    """The result of a query map, with lower-case column names."""
    c = Compiler(catalog)
    try:
        df = catalog.spark.sql(c.query(q))  # resolves the views
    finally:
        for view in c.made:
            catalog.spark.catalog.dropTempView(view)
    names = [n.lower() for n in df.columns]
    return df.toDF(*names)
