import math
import random
import struct

import pytest

from strandmill.catalog import ROW, Catalog, QueryError, UnknownSymbol
from strandmill.functions.output import respond, short_float, short_float_column, to_json
from strandmill.plans.expression import run
from strandmill.plans.forms import Call, Form, Keyword, ReadError, Symbol, read
from strandmill.plans.relational import relational_query
from strandmill.sources.loader import write_dataset

NAN = float("nan")


@pytest.mark.parametrize(
    "text,value",
    [
        ("5", 5.0), ("(+ 5 2)", 7.0), ("((fn [x] x) 3)", 3.0), ("((fn [x] (+ 1 x)) 3)", 4.0), ("((fn [f x] (f x)) (fn [x] (+ 1 x)) 3)", 4.0),
        ("(/ 5 2)", 2.5), ("(- 3)", -3.0), ("(* 2 3 4)", 24.0), ("(if false 3 4)", 4.0), ("(if true 3 4)", 3.0), ("(if nil 1)", None), ("(if 0 1 2)", 1.0), ('(if "" 1 2)', 1.0),
        ("(apply + (quote (1 2 3)))", 6.0), ("(let [a 1 b (+ a 1)] (* b 10))", 20.0), ("(let [x 1] ((fn [y] (+ x y)) 5))", 6.0),
        ("(map + [1 2 3] [10 20])", [11.0, 22.0]), ('(map :a [{:a 1} {:b 2}])', [1.0, None]), ("({:a 1} :a)", 1.0), ("(:a {:a 1})", 1.0), ("(#{1 2} 2)", 2.0), ("(#{1 2} 3)", None),
        ("(get [5 6] 1)", 6.0), ("(get {:a 1} :b 9)", 9.0), ("(assoc {:a 1} :b 2)", {Keyword("a"): 1.0, Keyword("b"): 2.0}), ("(assoc [1 2] 0 9)", [9.0, 2.0]),
        ("(cons 1 [2 3])", [1.0, 2.0, 3.0]), ("(car [7 8])", 7.0), ("(car [])", None), ("(cdr [7 8])", [8.0]), ("(cdr [])", []), ("(count [1 2 3])", 3), ("(count nil)", 0),
        ("(distinct [3 1 3 2 1])", [3.0, 1.0, 2.0]), ("(group-by (fn [x] (> x 2)) [1 3 2 4])", {False: [1.0, 2.0], True: [3.0, 4.0]}),
        ("(mean [[1 2 3] [4 nil 6]] 0)", [[2.5, 2.0, 4.5]]), ("(mean [[1 2 3] [4 nil 6]] 1)", [[2.0], [5.0]]),
        ("(+ [1 2 3] 2)", [3.0, 4.0, 5.0]), ("(* [-1 0 1] [1 2 3] 2)", [-2.0, 0.0, 6.0]), ("(/ [12 10 3] [3 -2 3] [2 1 -1])", [2.0, -5.0, -1.0]),
        ("(- [[1 2 3] [4 5 6]] [1 2 3])", [[0.0, 0.0, 0.0], [3.0, 3.0, 3.0]]), ("(> 3 2 1)", True), ("(<= 3 2)", False), ("(= 2 2.0)", True), ("(= [1 2] [1 2])", True), ("(= [1 2] [1 3])", False),
        (":kw", Keyword("kw")), ('"a\\n\\"b\\u0041"', 'a\n"bA'), ("; note\n #_ 3 4", 4.0),
    ],
)
def test_values(text, value):
    assert run(text) == value


def test_quote_keeps_forms_and_variables_are_found_inside_out():
    assert run("(quote (5 a :b))") == Form([5, Symbol("a"), Keyword("b")])
    assert run("(+ x 2)", {"x": 9}) == 11 and run("((fn [x] (+ x y)) 1)", {"x": 100, "y": 2}) == 3
    with pytest.raises(UnknownSymbol):
        run("(nope 1)")
    m = run("(mean y 0)", {"y": [[NAN, 1], [NAN, 3]]})
    assert math.isnan(m[0][0]) and m[0][1] == 2
    for bad in ("(1 2", "[1)", '"abc', "{:a}", "#foo 1", ""):
        with pytest.raises(ReadError):
            read(bad)


def test_short_floats():
    cases = {
        1.0: "1", -3.0: "-3", NAN: '"NaN"', 10.4169: "10.42", 0.00012345: "1.234e-4", 1234567.5: "1235000", 0.001: "1e-3", 0.5: "0.5", 99999.5: "1e5", 0.0123: "0.0123", 1e20: str(10**20), 2.5e-7: "2.5e-7",
    }
    assert {k: short_float(k) for k in cases} == cases
    rnd = random.Random(2)
    for _ in range(2000):
        x = struct.unpack("f", struct.pack("f", rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randrange(-30, 30)))[0]
        s = short_float(x)
        if x != int(x):
            assert float(s) == float(f"{x:.4g}") and len(s) <= len(f"{x:.4g}")
    assert to_json({Keyword("a"): [1.5, None, True, "x"], "b": {"c": NAN}}) == '{"a":[1.5,null,true,"x"],"b":{"c":"NaN"}}'
    assert respond([1.0, None, Keyword("a"), {"k": "v"}], "application/edn") == '[1.0 nil :a {"k" "v"}]'


def test_short_float_column_agrees(spark):
    from pyspark.sql import functions as F

    xs = [1.0, -3.5, NAN, None, 10.4169, 0.00012345, 1234567.5, 0.001, -0.25, 99999.5, 2.5e-7, 123.456, 1e9]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", short_float_column(F.col("x")).alias("t"))
    assert [r["t"] for r in df.collect()] == [None if x is None else short_float(x).strip('"') for x in xs]


# -- relational maps ---------------------------------------------------------------
@pytest.fixture(scope="module")
def cat(spark):
    c = Catalog(spark)
    d = spark.createDataFrame([(1, "a", "X", None), (2, "b", None, "p"), (3, "c", "X", "p")], "id int, name string, cohort string, probemap string")
    f = spark.createDataFrame([(10, 1, "sampleID"), (11, 1, "v"), (12, 2, "sampleID")], "id int, dataset_id int, name string")
    k = spark.createDataFrame([(1, 10, 1, "s2"), (2, 10, 0, "s1"), (3, 12, 0, "s9")], "id int, field_id int, ordering int, value string")
    c.use_tables(dataset=d, field=f, code=k)
    write_dataset(c, "m", spark.createDataFrame([(0, "s1", 1.0), (1, "s2", 3.0)], f"{ROW} long, sampleID string, v float"))
    return c


def ask(cat, text):
    return run(text, catalog=cat)


def test_client_queries(cat):
    assert ask(cat, "(map :cohort (query {:select [:%distinct.cohort] :from [:dataset] :where [:not [:is nil :cohort]]}))") == ["X"]
    got = ask(
        cat,
        """(map :value (query {:select [:%distinct.value] :from [:dataset] :join [:field [:= :dataset.id :dataset_id] :code [:= :field_id :field.id]]
             :where [:and [:= :cohort "X"] [:= :field.name "sampleID"]]}))""",
    )
    assert sorted(got) == ["s1", "s2"]
    assert ask(cat, '(:probemap (car (query {:select [:probemap] :from [:dataset] :where [:= :name "b"]})))') == "p"
    both = '(let [q (column-query {:select ["sampleID"] :from ["m"] :where [:in "v" [3]]})] [(q "sampleID") (fetch [{:table "m" :columns ["v"] :samples ["s2" "s1"]}])])'
    assert ask(cat, both) == [["s2"], [[3.0, 1.0]]]
    assert run('((rows {:select ["v"] :from ["m"]}) "v")', catalog=cat, names={"rows": "column-query"}) == [1.0, 3.0]


def test_sql_shapes(cat):
    rows = lambda q: [tuple(r) for r in relational_query(cat, q).collect()]
    q = {":select": [":field-id", [Call("group_concat", [":value", ":order", ":ordering", ":separator", Call("chr", [9])]), ":all"]], ":from": [":code"], ":group-by": [":field-id"], ":order-by": [":field-id"]}
    assert rows(q) == [(10, "s1\ts2"), (12, "s9")]
    q = {":select": [":d.id", ":f.name"], ":from": [[":dataset", ":d"]], ":left-join": [[":field", ":f"], [":= ".strip(), ":d.id", ":f.dataset-id"]], ":order-by": [":d.id", [":f.name", ":desc"]], ":limit": 3}
    assert rows(q) == [(1, "v"), (1, "sampleID"), (2, "sampleID")]
    q = {":select": [":t.x", ":id"], ":from": [[{":table": [[":x", ":varchar", ["s1", "zz", "s9"]], ":t"]}, ":t"]], ":left-join": [":code", [":=", ":value", ":t.x"]], ":order-by": [":t.x"]}
    assert rows(q) == [("s1", 2), ("s9", 3), ("zz", None)]
    assert rows({":select": [[Call("exp", [0.0]), ":e"]]}) == [(1.0,)]
    assert rows({":select": [":ID"], ":from": [":Dataset"], ":where": [":in", ":name", ["a", None, "it's"]]}) == [(1,)]
    assert relational_query(cat, {":select": [[":name", ":NAME-Of"]], ":from": [":dataset"]}).columns == ["name_of"]
    assert rows({":select": [":id"], ":from": [":dataset"], ":where": [":=", ":name", "\\' or 1=1 --"]}) == []


@pytest.mark.parametrize(
    "q",
    [
        {":insert-into": ":dataset", ":values": []}, {":select": [Call("java_method", ["java.lang.System", "exit"])]}, {":select": [":a; drop"], ":from": [":dataset"]},
        {":select": [":id"], ":from": [":nowhere"]}, {":select": [":id"], ":from": [":dataset"], ":set": {}}, {":from": [":dataset"]}, {":select": [Call("cast", ["1", "int); drop"])]},
    ],
)
def test_only_select_and_known_functions(cat, q):
    with pytest.raises(QueryError):
        relational_query(cat, q)
