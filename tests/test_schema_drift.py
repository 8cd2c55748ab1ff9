import json
import random
import re

from strandmill.operators import schema_drift as D

RULES = D.Rules(("type", "datasubtype", "probemap"))
SCHEMA = "name string, version int, received int, content string"


def changes(spark, data, schema=SCHEMA, **kw):
    df = D.conform(spark.createDataFrame(data, schema), RULES, newest=("received",), **kw)
    return sorted((r["name"], r["version"], r["field"], r["change"]) for r in D.changes(df).collect())


def versions(*docs, name="n", at=1):
    return [(name, at + i, 0, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]


def test_changes_of_one_field(spark):
    data = versions({"type": "a"}, {":Type": "b"}, {"TY-PE": 5}, {"x": 1}, {"type": True}, {"type": "q"})
    assert changes(spark, data) == [
        ("n", 2, "type", "renamed"), ("n", 3, "type", "renamed"), ("n", 3, "type", "retyped"), ("n", 4, "type", "removed"), ("n", 5, "type", "added"), ("n", 6, "type", "retyped"),
    ]


def test_a_heir_stands_until_it_goes(spark):
    data = versions({"type": "a"}, {"kind": "a"}, {"kind": "b"}, {"sort": "b"}, {"other": "z"}, {"sort": "b"})
    assert changes(spark, data) == [("n", 2, "type", "renamed"), ("n", 4, "type", "renamed"), ("n", 5, "type", "removed")]
    two = versions({"type": "a"}, {"kind": "a", "sort": "a"})
    assert changes(spark, two) == [("n", 2, "type", "removed")]
    old = versions({"type": "a", "kind": "a"}, {"kind": "a"})
    assert changes(spark, old) == [("n", 2, "type", "removed")]


def test_nulls_broken_content_ties_and_holes(spark):
    data = [("n", 1, 0, '{"type": "a"}'), ("n", 4, 0, '{"type": null}'), ("n", 9, 0, '{"type": "c"}'), ("n", 9, 0, '{"type": "c"}'), ("n", 9, 1, '{"type": 1}')]
    data += [(None, 1, 0, "{}"), ("n", None, 0, "{}"), ("m", 1, 0, None), ("m", 2, 0, "[1]"), ("m", 3, 0, "{broken"), ("m", 4, 0, '{"type": [1]}'), ("m", 5, 0, '{"type": {"a": 1}}')]
    assert changes(spark, data) == [
        ("m", 4, "type", "added"), ("m", 5, "type", "retyped"), ("n", 4, "type", "removed"), ("n", 9, "type", "added"),
    ]


def test_empty_extra_columns_and_conformed_values(spark):
    assert changes(spark, []) == []
    data = [("n", 1, 0, '{"probe map": "p", "data_sub.type": 2.5, "type": "t"}', "x", 3)]
    df = D.conform(spark.createDataFrame(data, SCHEMA + ", type string, block int"), RULES)
    r = df.collect()[0]
    assert (r["probemap"], r["datasubtype"], r["type"], r["prev_version"], r["steps"]) == ("p", "2.5", "t", None, [])


def brute(data):
    by = {}
    for n, v, r, c in data:
        by.setdefault(n, {})[v] = {k: x for k, x in json.loads(c).items() if x is not None}
    kind = lambda x: "b" if isinstance(x, bool) else {str: "s", int: "n", float: "n", list: "a", dict: "o"}[type(x)]
    out = []
    for n, vs in by.items():
        for f in RULES.fields:
            held = prev = None
            for v in sorted(vs):
                d = vs[v]
                own = sorted(k for k in d if re.sub("[:_. -]", "", k.lower()) == f)
                if held in d and held is not None:
                    new = held
                elif own:
                    new = own[0]
                else:
                    heirs = [k for k in d if held is not None and k not in prev and json.dumps(d[k]) == json.dumps(prev[held])]
                    new = heirs[0] if len(heirs) == 1 else None
                if prev is not None:
                    if held is None and new:
                        out.append((n, v, f, "added"))
                    elif held and new is None:
                        out.append((n, v, f, "removed"))
                    elif held:
                        out += [(n, v, f, "renamed")] * (held != new) + [(n, v, f, "retyped")] * (kind(prev[held]) != kind(d[new]))
                held, prev = new, d
    return sorted(out)


def test_against_brute_force_and_over_blocks(spark):
    rnd = random.Random(4)
    keys = ["type", "Type", ":type", "kind", "sort", "probeMap", "probe_map", "map", "dataSubType"]
    values = ["a", "b", 1, True, None, ["a"]]
    data = []
    for n in range(25):
        for v in range(1, rnd.choice([3, 9, 40])):
            if rnd.random() < 0.9:
                data.append((f"n{n}", v, 0, json.dumps({k: rnd.choice(values) for k in rnd.sample(keys, rnd.randrange(5))})))
    want = brute(data)
    assert changes(spark, data) == want
    assert changes(spark, data, block_bits=2) == want


def test_an_empty_key_is_a_key(spark):
    # the key '' stands for the field over the edge of a block
    data = versions({"type": "a"}, {"": "a"}, {"": "a", "x": 1}, {"": "b"}, {"y": "b"}, {})
    assert changes(spark, data) == changes(spark, data, block_bits=1) == [("n", 2, "type", "renamed"), ("n", 5, "type", "renamed"), ("n", 6, "type", "removed")]


def test_versions_are_routed_by_fingerprints():
    registry = D.Registry(RULES)
    docs = [{"type": "a", "n": 1}, {"kind": "a", "n": 2}]
    steps = set()
    for v in range(100):  # other values, the same schemas
        a, b = ({**d, "n": v} for d in docs)
        step = registry.migration(registry.shape(a), registry.shape(b))
        assert step.key("type", "type", a, b) == "kind"
        steps.add(id(step))
    assert len(steps) == len(registry.migrations) == 1 and len(registry.shapes) == 2
    # the order of the keys makes no other schema
    assert registry.shape({"n": 1, "type": "a"}).fingerprint == registry.shape(docs[0]).fingerprint


def test_registry_table(spark):
    data = versions({"type": "a"}, {"kind": "a"}) + versions({"type": "b"}, {"kind": "b"}, name="m") + versions({"type": "b"}, {"type": 1}, name="k")
    df = D.conform(spark.createDataFrame(data, SCHEMA), RULES, newest=("received",))
    got = {(r["change"], r["from_key"], r["to_key"], r["from_type"], r["to_type"]): r["n"] for r in D.migrations(df).collect()}
    assert got == {("renamed", "type", "kind", "string", "string"): 2, ("retyped", "type", "type", "string", "number"): 1}
