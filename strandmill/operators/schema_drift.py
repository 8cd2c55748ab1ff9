"""Schemas that drift between versions: one conformed table and every change.

Each version of an object gets a schema fingerprint (its keys and JSON types).
A :class:`Registry` holds the migration from one fingerprint to another: which
keys stay, which are new, which change type, and which key is spelled like a
field. Every version is routed by the pair of its predecessor's fingerprint and
its own to that migration, which is made once however many objects take it, and
goes through its rules: a field's key is renamed, its value gets the default
(NULL) or is cast to the target type, and every step is recorded. The key that
stands for a field after a step is the state the next step starts from, so
renames chain.

The versions of a name are read in order, as a stream. A name is cut into
blocks of ``2**block_bits`` versions; for the few names that have several, a
first pass finds what each block makes of every state it may start from, these
are chained from block to block, and the second pass starts each block with its
true state. So no task holds a name's history, whatever share of the rows it has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 12
#: fingerprints and migrations a worker keeps; beyond it they are made again, which changes no result
KEPT = 50_000

STEPS = "array<struct<field string, change string, from_key string, to_key string, from_type string, to_type string>>"
JSON_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}


@dataclass(frozen=True)
class Rules:
    """Canonical fields, characters that don't count in a key, casts of values."""

    fields: tuple[str, ...]
    ignored: str = r"[:_\-. ]"

    def field_of(self, key: str) -> str | None:
        low = re.sub(self.ignored, "", key.lower())
        return low if low in self.fields else None


def document(content: str | None) -> dict:
    """The keys and values of a JSON object, without NULL values; empty if it is none."""
    try:
        doc = json.loads(content) if content is not None else None
    except (ValueError, RecursionError):
        doc = None
    return {k: v for k, v in doc.items() if v is not None} if isinstance(doc, dict) else {}


def canonical(value) -> str:
    """A value as JSON text that is the same for equal values."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


class Shape:
    """A schema: types by key, its fingerprint, and the key that is spelled like each field (the first in order, of several)."""

    def __init__(self, rules: Rules, types: dict[str, str]):
        self.types = types
        self.fingerprint = hashlib.md5("\x1e".join(f"{k}\x1f{t}" for k, t in sorted(types.items())).encode()).hexdigest()
        spelled: dict[str, list[str]] = {f: [] for f in rules.fields}
        for k in types:
            if f := rules.field_of(k):
                spelled[f].append(k)
        self.own = {f: min(ks, default=None) for f, ks in spelled.items()}


class Migration:
    """The rules from one fingerprint to another."""

    def __init__(self, a: Shape, b: Shape):
        self.a, self.b = a, b
        self.new = [k for k in b.types if k not in a.types]

    def key(self, field: str, old: str | None, before: dict, after: dict) -> str | None:
        """The rename rule: the key that stands for a field, given the one before.

        It stays while it is there; else the key spelled like the field takes
        its place; else the only new key with the same value, which is the one
        thing the fingerprints can't tell.
        """
        if old is not None and old in self.b.types:
            return old
        own = self.b.own[field]
        if own is not None or old is None:
            return own
        kind, value = self.a.types[old], canonical(before[old])
        heirs = [k for k in self.new if self.b.types[k] == kind and canonical(after[k]) == value]
        return heirs[0] if len(heirs) == 1 else None

    def steps(self, field: str, old: str | None, new: str | None) -> list[dict]:
        """What is recorded of one field."""
        a, b = self.a.types.get(old), self.b.types.get(new)
        if old is None:
            whats = ["added"] if new is not None else []
        elif new is None:
            whats = ["removed"]
        else:
            whats = ["renamed"] * (old != new) + ["retyped"] * (a != b)
        return [{"field": field, "change": w, "from_key": old, "to_key": new, "from_type": a, "to_type": b} for w in whats]


class Registry:
    """Shapes by their keys and types, migrations by their pair of fingerprints."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.shapes: dict[tuple, Shape] = {}
        self.migrations: dict[tuple[str, str], Migration] = {}

    def shape(self, doc: dict) -> Shape:
        at = tuple((k, type(v)) for k, v in doc.items())
        found = self.shapes.get(at)
        if found is None:
            if len(self.shapes) >= KEPT:
                self.shapes.clear()
            found = self.shapes[at] = Shape(self.rules, {k: JSON_TYPES[t] for k, t in at})
        return found

    def migration(self, a: Shape, b: Shape) -> Migration:
        at = (a.fingerprint, b.fingerprint)
        found = self.migrations.get(at)
        if found is None:
            if len(self.migrations) >= KEPT:
                self.migrations.clear()
            found = self.migrations[at] = Migration(a, b)
        return found


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        yield from pdf.itertuples(index=False, name=None)


def _versions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The first row of each name, block and version."""
    last = None
    for row in _rows(batches):
        if row[:3] != last:
            last = row[:3]
            yield row


def _text(doc: dict, key: str | None) -> str | None:
    """The cast rule: strings as they are, all else as JSON text; the default rule: NULL."""
    if key is None:
        return None
    v = doc[key]
    return v if isinstance(v, str) else canonical(v)


def conform(
    df: DataFrame,
    rules: Rules,
    name: str = "name",
    version: str = "version",
    content: str = "content",
    newest: tuple[str, ...] = (),
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """One row per name and version: ``name``, ``version``, ``prev_version``,
    ``prev_fingerprint``, ``fingerprint``, the fields' values as text, and
    ``steps``, the changes since the next lower version that is present.

    Defined cases: rows with a NULL name or version are left out; content that
    is no JSON object has no keys; NULL values count as absent; repeated rows
    count once, and of several contents of one version that with the greatest
    ``newest`` columns, then the greatest text, is taken; an empty table gives
    an empty result; other columns are dropped.
    """
    order = [f"o{i}" for i in range(len(newest))]
    block = F.shiftright(F.col(version).cast("long"), block_bits)
    known = df.where(F.col(name).isNotNull() & F.col(version).isNotNull())

    def picked(rows: DataFrame) -> DataFrame:
        """Copies are dropped by hash before they meet; the ties that are left are settled in the stream."""
        return rows.select(
            F.col(name).alias("name"), block.alias("block"), F.col(version).cast("long").alias("version"), F.col(content).alias("content"),
            *[F.col(c).alias(o) for c, o in zip(newest, order)],
        ).distinct()

    newest_first = [F.desc(c) for c in [*order, "content"]]
    # names and versions only; for the names of one block the passes below have nothing to do
    many = known.groupBy(F.col(name).alias("l_name")).agg(F.min(block).alias("a"), F.max(block).alias("b")).where("a < b").select("l_name")

    def transfers(batches):
        """Per block: its first and last content, and the last key for each possible first key."""
        registry = Registry(rules)

        def done(n, blk, first, last, states):
            return pd.DataFrame([{"name": n, "block": blk, "first": first, "last_version": last[0], "last": last[1], "map": json.dumps(states)}])

        at = None
        for n, blk, ver, text in _versions(batches):
            now = document(text)
            shape = registry.shape(now)
            if at != (n, blk):
                if at:
                    yield done(*at, first, last, states)
                at, first = (n, blk), text
                states = {f: [[k, k] for k in [*now, None]] for f in rules.fields}
            else:
                step = registry.migration(was, shape)
                for f, pairs in states.items():
                    for p in pairs:
                        p[1] = step.key(f, p[1], before, now)
            before, was, last = now, shape, (ver, text)
        if at:
            yield done(*at, first, last, states)

    def chain(batches):
        """The state each block but a name's first starts from."""
        registry, at = Registry(rules), None
        for n, blk, first, last_version, last, states in _rows(batches):
            now = document(first)
            shape, maps = registry.shape(now), json.loads(states)
            if n != at:
                held = dict(shape.own)
            else:
                yield pd.DataFrame([{"name": n, "block": blk, "p_version": prev[0], "p_content": prev[1], "p_state": json.dumps(held)}])
                before = document(prev[1])
                step = registry.migration(registry.shape(before), shape)
                held = {f: step.key(f, held[f], before, now) for f in rules.fields}
            held = {f: {a: b for a, b in maps[f]}[held[f]] for f in rules.fields}  # None stands for no key
            at, prev = n, (last_version, last)

    def migrate(batches):
        registry, out, at = Registry(rules), [], None
        for n, blk, ver, text, p_version, p_content, p_state in _versions(batches):
            now = document(text)
            shape = registry.shape(now)
            if at != (n, blk):
                at, prev = (n, blk), None
                if isinstance(p_state, str):
                    prev, before, held = int(p_version), document(p_content), json.loads(p_state)
                    was = registry.shape(before)
            if prev is None:
                new, steps = dict(shape.own), []
            else:
                step = registry.migration(was, shape)
                new = {f: step.key(f, held[f], before, now) for f in rules.fields}
                steps = [x for f in rules.fields for x in step.steps(f, held[f], new[f])]
            row = {"name": n, "version": ver, "prev_version": prev, "prev_fingerprint": None if prev is None else was.fingerprint, "fingerprint": shape.fingerprint}
            out.append({**row, **{f: _text(now, k) for f, k in new.items()}, "steps": steps})
            prev, before, was, held = ver, now, shape, new
            if len(out) >= 2000:
                yield pd.DataFrame(out).astype({"prev_version": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out).astype({"prev_version": "Int64"})

    blocks = (
        picked(known.join(many, F.col(name) == F.col("l_name"), "left_semi"))
        .repartition("name", "block")
        .sortWithinPartitions("name", "block", "version", *newest_first)
        .select("name", "block", "version", "content")
        .mapInPandas(transfers, "name string, block long, first string, last_version long, last string, map string")
    )
    incoming = (
        blocks.repartition("name")
        .sortWithinPartitions("name", "block")
        .mapInPandas(chain, "name string, block long, p_version long, p_content string, p_state string")
    )
    values = ", ".join(f"`{f}` string" for f in rules.fields)
    return (
        picked(known)
        .join(incoming, ["name", "block"], "left")
        .repartition("name", "block")
        .sortWithinPartitions("name", "block", "version", *newest_first)
        .select("name", "block", "version", "content", "p_version", "p_content", "p_state")
        .mapInPandas(migrate, f"name string, version long, prev_version long, prev_fingerprint string, fingerprint string, {values}, steps {STEPS}")
    )


def changes(conformed: DataFrame) -> DataFrame:
    """The list of changes: ``name``, ``version``, the fingerprints it leads from and to, ``field``, ``change`` and what changed."""
    at = ["name", "version", F.col("prev_fingerprint").alias("from_fingerprint"), F.col("fingerprint").alias("to_fingerprint")]
    return conformed.select(*at, F.explode("steps").alias("s")).select("name", "version", "from_fingerprint", "to_fingerprint", "s.*")


def migrations(conformed: DataFrame) -> DataFrame:
    """The registry as a table: every step between two fingerprints that was taken, and by how many versions (``n``)."""
    by = ["from_fingerprint", "to_fingerprint", "field", "change", "from_key", "to_key", "from_type", "to_type"]
    return changes(conformed).groupBy(*by).agg(F.count("*").alias("n"))
