"""The engine's own operators as queries over the test tables, with the SQL that gives the same rows.

The tables hold no genomics, so operators run on tables of the same shape:
suppliers stand for chromosomes, parts for probes, customers for samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import client
from strandmill.catalog import ROW, Catalog
from strandmill.functions import scalars as S
from strandmill.functions.output import short_float_column
from strandmill.operators import aggregates as A
from strandmill.operators.overlap import overlap_join
from strandmill.plans.column_query import column_query
from strandmill.plans.fetch import long_values
from strandmill.plans.forms import Call
from strandmill.plans.relational import relational_query
from strandmill.session import own_dir, table
from strandmill.sources.readers import number_names, tabbed
from strandmill.streaming.counts import FolderCounts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- datasets ----------------------------------------------------------------
def catalog(spark: SparkSession, sf: str, *names: str) -> Catalog:
    """The tables as datasets (for column queries and fetch) and as views (for relational queries)."""
    c = Catalog(spark)
    rows = {
        "lineitem": "l_orderkey * 8 + l_linenumber", "orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey",
        "nation": "n_nationkey", "supplier": "s_suppkey", "region": "r_regionkey",
    }
    for n in names:
        df = table(spark, sf, n)
        c.use_tables(**{n: df})
        if n in rows:
            c.register(n, df, row=rows[n])
    return c


def probes(spark: SparkSession, sf: str) -> Catalog:
    """Parts as probes: the words of the name are the genes, the key gives the position."""
    c = Catalog(spark)
    df = table(spark, sf, "part").select(
        F.col("p_partkey").alias("__row"),
        "p_partkey",
        F.col("p_name").alias("name"),
        F.split("p_name", " ").alias("genes"),
    )
    c.register("probes", df)
    return c


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as segments: ``chrom``, ``start``, ``end``; coordinates are of 64 bits, as keys are."""
    start = F.col("l_partkey").cast("long") * 1000
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("chr"), (F.col("l_suppkey") % 22).cast("string")).alias("chrom"),
        start.alias("start"), F.rint(start + F.col("l_quantity") * 500).cast("long").alias("end"),
    )


SEGMENTS = "(select l_orderkey, l_linenumber, 'chr' || (l_suppkey % 22) as chrom, l_partkey * 1000 as s, (l_partkey * 1000 + l_quantity * 500)::bigint as e from lineitem)"


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Every part number times 10 000 as a gene: the table of intervals to overlap with; coordinates are of 64 bits."""
    k = F.col("p_partkey").cast("long")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene"), F.concat(F.lit("chr"), (k % 22).cast("string")).alias("gchrom"),
        (k * 10000).alias("gstart"), (k * 10000 + F.col("p_size").cast("long") * 100).alias("gend"),
    )


GENES = "(select p_partkey as gene, 'chr' || (p_partkey % 22) as gchrom, p_partkey * 10000 as gs, p_partkey * 10000 + p_size * 100 as ge from part)"


# -- column queries ------------------------------------------------------------
@query("select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag in ('R', 'A')")
def colq_in(spark, sf):
    q = {"select": ["l_orderkey", "l_linenumber", "l_returnflag"], "from": ["lineitem"], "where": ["in", "l_returnflag", ["R", "A", None]]}
    return column_query(catalog(spark, sf, "lineitem"), q).drop(ROW)


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and (l_linenumber in (1, 2) or l_linestatus = 'O')")
def colq_and_or(spark, sf):
    where = ["and", ["in", "l_returnflag", ["R"]], ["or", ["in", "l_linenumber", [1, 2]], ["in", "l_linestatus", ["O"]]]]
    return column_query(catalog(spark, sf, "lineitem"), {"select": ["l_orderkey", "l_linenumber"], "from": ["lineitem"], "where": where}).drop(ROW)


@query("select o_orderkey, o_orderstatus from orders order by o_orderkey limit 20 offset 5")
def colq_limit_offset(spark, sf):
    q = {"select": ["o_orderkey", "o_orderstatus"], "from": ["orders"], "limit": 20, "offset": 5}
    return column_query(catalog(spark, sf, "orders"), q).drop(ROW)


@query("select p_partkey, cast(null as varchar) as nope from part")
def colq_unknown_field(spark, sf):
    return column_query(catalog(spark, sf, "part"), {"select": ["p_partkey", "nope"], "from": ["part"]}).drop(ROW)


@query("select o_orderkey from orders")
def colq_empty_terms(spark, sf):
    where = ["or", ["and"], ["or"], ["in", "nope", ["x"]]]
    return column_query(catalog(spark, sf, "orders"), {"select": ["o_orderkey"], "from": ["orders"], "where": where}).drop(ROW)


@query("select c_custkey from customer where c_nationkey in (3, 7) and c_mktsegment in ('BUILDING', 'MACHINERY')")
def colq_numbers(spark, sf):
    where = ["and", ["in", "c_nationkey", [3.0, 7.0]], ["in", "c_mktsegment", ["BUILDING", "MACHINERY"]]]
    return column_query(catalog(spark, sf, "customer"), {"select": ["c_custkey"], "from": ["customer"], "where": where}).drop(ROW)


@query("select p_partkey from part where list_has_any(string_split(p_name, ' '), ['red', 'small'])")
def genes_any(spark, sf):
    q = {"select": ["p_partkey"], "from": ["probes"], "where": ["in", "any", "genes", ["RED", "small"]]}
    return column_query(probes(spark, sf), q).drop(ROW)


@query("select p_partkey from part where len(list_filter(string_split(p_name, ' '), lambda x: not list_contains(['red', 'small', 'rod', 'gear', 'anvil'], x))) = 0")
def genes_all(spark, sf):
    q = {"select": ["p_partkey"], "from": ["probes"], "where": ["in", "all", "genes", ["red", "small", "rod", "gear", "anvil"]]}
    return column_query(probes(spark, sf), q).drop(ROW)


@query(f"select l_orderkey, l_linenumber from {SEGMENTS} where (chrom = 'chr3' and s <= 900000 and e >= 100000) or (chrom = 'chr7' and s <= 60000 and e >= 50000)")
def position_overlap(spark, sf):
    seg = segments(spark, sf)
    df = seg.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(ROW), "l_orderkey", "l_linenumber",
        F.struct("chrom", F.col("start").alias("chromStart"), F.col("end").alias("chromEnd"), F.lit(".").alias("strand")).alias("position"),
    )
    c = Catalog(spark)
    c.register("segments", df)
    q = {"select": ["l_orderkey", "l_linenumber"], "from": ["segments"], "where": ["in", "position", [["chr3", 100000, 900000], ["chr7", 50000, 60000]]]}
    return column_query(c, q).drop(ROW)


@query(f"select l_orderkey, l_linenumber, gene from {SEGMENTS} a join {GENES} b on chrom = gchrom and s <= ge and e >= gs")
def interval_join(spark, sf):
    out = overlap_join(segments(spark, sf), genes(spark, sf), ("chrom", "gchrom"), ("start", "end"), ("gstart", "gend"))
    return out.select("l_orderkey", "l_linenumber", "gene")


@query(f"select l_orderkey, l_linenumber from {SEGMENTS} a where exists (select 1 from {GENES} b where chrom = gchrom and s <= ge and e >= gs)")
def interval_semi_join(spark, sf):
    out = overlap_join(segments(spark, sf), genes(spark, sf), ("chrom", "gchrom"), ("start", "end"), ("gstart", "gend"), how="left_semi")
    return out.select("l_orderkey", "l_linenumber")


# -- fetch ---------------------------------------------------------------------
_WANTED = ["Customer#000000007", "nobody", "Customer#000000003", "Customer#000000007", "Customer#000000001"]


def _samples(spark: SparkSession, sf: str) -> Catalog:
    c = Catalog(spark)
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(ROW), F.col("c_name").alias("sampleID"), "c_acctbal", "c_nationkey", F.col("c_mktsegment").alias("segment")
    )
    ds = c.register("samples", df)
    ds.codes = A.first_codes(df, "segment", ROW).select(F.lit("segment").alias("field"), F.col("code").alias("ordering"), F.col("segment").alias("value"))
    return c


@query(
    "select p.pos, c_acctbal as value from (select unnest([0, 1, 2, 3, 4]) as pos, unnest(["
    + ", ".join(f"'{x}'" for x in _WANTED)
    + "]) as n) p left join customer on c_name = n"
)
def fetch_gather(spark, sf):
    df = long_values(_samples(spark, sf), "samples", ["c_acctbal"], _WANTED)
    return df.select("pos", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query(
    "with p as (select unnest([0, 1, 2, 3, 4]) as pos, unnest(["
    + ", ".join(f"'{x}'" for x in _WANTED)
    + """]) as n), k as (select c_mktsegment s, dense_rank() over (order by min(c_custkey)) - 1 as code from customer group by 1),
    j as (select pos, c_acctbal, c_nationkey, k.code from p left join customer on c_name = n left join k on k.s = c_mktsegment)
    select 0 as col, pos, c_acctbal as value from j union all select 1, pos, c_nationkey from j union all select 2, pos, code from j
    union all select 3, pos, null from j"""
)
def fetch_matrix(spark, sf):
    df = long_values(_samples(spark, sf), "samples", ["c_acctbal", "c_nationkey", "segment", "nope"], _WANTED)
    return df.select("col", "pos", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query(
    """with v as (select l_partkey, l_linenumber, case when l_linenumber <> 7 then l_extendedprice end as x from lineitem)
    select g.gene, v.l_linenumber as pos, round(avg(x), 4) as score from v join (select p_partkey, unnest(string_split(p_name, ' ')) as gene from part) g
    on g.p_partkey = v.l_partkey group by 1, 2"""
)
def gene_score_mean(spark, sf):
    """Mean over the probes of each gene and slot; line 7 is planted as missing."""
    values = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("pos"), F.lit(0).alias(ROW),
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("value"),
    )
    names = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("gene_no"), F.col("p_partkey").alias("name"))
    out = client.gene_scores(names, values)
    return out.select(F.col("gene_no").alias("gene"), "pos", F.round(F.when(~F.isnan("score"), F.col("score")), 4).alias("score"))


@query(
    """select l_suppkey, case when count(x) > 0 then round(avg(x), 4) end as m from
    (select l_suppkey, case when l_linenumber < 7 then l_discount end as x from lineitem) group by 1"""
)
def nan_mean_group(spark, sf):
    x = F.when(F.col("l_linenumber") >= 7, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(A.nan_mean(x).alias("m"))
    return out.select("l_suppkey", F.round(F.when(~F.isnan("m"), F.col("m")), 4).alias("m"))


@query(
    """select g.gene, p.p_partkey as probe, c.pos, s.s_acctbal as value from (select unnest([0, 1]) gno, unnest(['red', 'small']) gene) g
    join (select p_partkey, unnest(string_split(p_name, ' ')) w from part) p on p.w = g.gene
    join (select distinct l_partkey, l_suppkey from lineitem where l_suppkey in (1, 2, 3)) l on l.l_partkey = p.p_partkey
    join (select unnest([0, 1, 2]) pos, unnest([1, 2, 3]) k) c on c.k = l.l_suppkey join supplier s on s.s_suppkey = l.l_suppkey"""
)
def gene_probe_lookup(spark, sf):
    """Gene to probes to the rows of a matrix in the order of the samples."""
    p = client.probes_of_genes(_renamed(probes(spark, sf)), "probes", ["red", "small"])
    matrix = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("sample")).where(
        F.col("sample").isin(1, 2, 3)
    ).distinct()
    slots = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "pos int, sample long")
    value = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("value"))
    out = p.join(matrix, "name").join(slots, "sample").join(value, "sample")
    return out.select("gene", F.col("name").alias("probe"), "pos", "value")


def _renamed(c: Catalog) -> Catalog:
    ds = c.dataset("probes")
    ds.df = ds.df.drop("name").withColumnRenamed("p_partkey", "name")
    return c


# -- aggregates and dictionaries ---------------------------------------------------
@query("select distinct c_mktsegment as cohort from customer")
def distinct_cohort(spark, sf):
    q = {":select": [":%distinct.cohort"], ":from": [":dataset"], ":where": [":not", [":is", None, ":cohort"]]}
    c = Catalog(spark)
    c.use_tables(dataset=table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cohort")))
    return relational_query(c, q)


@query("select n_regionkey, string_agg(n_name, chr(9) order by n_nationkey) as codes from nation group by 1")
def group_concat_codes(spark, sf):
    q = {
        ":select": [":n_regionkey", [Call("group_concat", [":n_name", ":order", ":n_nationkey", ":separator", "\t"]), ":codes"]],
        ":from": [":nation"], ":group-by": [":n_regionkey"],
    }
    return relational_query(catalog(spark, sf, "nation"), q)


@query("select c_mktsegment, dense_rank() over (order by min(c_custkey)) - 1 as code from customer group by 1")
def code_dictionary(spark, sf):
    out = A.first_codes(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")
    return out.select("c_mktsegment", F.col("code").cast("long").alias("code"))


@query(
    """select p_partkey, case when n = 1 then p_name else p_name || ' (' || n || ')' end as field from
    (select *, row_number() over (partition by p_name order by p_partkey) as n from part)"""
)
def dup_names_suffix(spark, sf):
    return A.numbered_copies(table(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "field")


@query(
    """select id, case when n = 1 then cut else cut || ' (' || n || ')' end as field, coalesce(length(name) > 250, false) as long_name from
    (select *, row_number() over (partition by dataset_id, cut order by id, name) as n from
      (select distinct id, dataset_id, name, left(name, 250) as cut from field where dataset_id is not null and name is not null))"""
)
def field_names(spark, sf):
    """The writer's rule on the catalog's own fields: names cut to 250 characters, repeats numbered."""
    f = table(spark, sf, "field").distinct().where("dataset_id is not null and name is not null")
    return number_names(f, "name", "id", "name", within=["dataset_id"]).select("id", "field", F.col("__long").alias("long_name"))


@query("select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as parts from lineitem group by 1")
def group_by_rows(spark, sf):
    """The rows of each group, in order."""
    return A.rows_of_groups(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "parts")


@query("select max(n) as n_rows from (select l_suppkey, count(*) as n from lineitem group by 1)")
def dataset_row_count(spark, sf):
    by = {":select": [":l_suppkey", [":%count.*", ":n"]], ":from": [":lineitem"], ":group-by": [":l_suppkey"]}
    return relational_query(catalog(spark, sf, "lineitem"), {":select": [[":%max.n", ":n_rows"]], ":from": [[by, ":t"]]})


# -- relational queries -------------------------------------------------------------
@query(
    """select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where o_orderstatus = 'F' and not n_name is null"""
)
def join_inner(spark, sf):
    q = {
        ":select": [":o_orderkey", ":customer.c-name", ":n_name"], ":from": [":orders"],
        ":join": [":customer", [":=", ":o_custkey", ":c_custkey"], ":nation", [":=", ":c_nationkey", ":n_nationkey"]],
        ":where": [":and", [":=", ":o_orderstatus", "F"], [":not", [":is", None, ":n_name"]]],
    }
    return relational_query(catalog(spark, sf, "orders", "customer", "nation"), q)


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
def join_left(spark, sf):
    q = {":select": [":c_custkey", ":o_orderkey"], ":from": [":customer"], ":left-join": [":orders", [":=", ":o_custkey", ":c_custkey"]]}
    return relational_query(catalog(spark, sf, "orders", "customer"), q)


@query("select o.o_orderkey, c.c_custkey from (select * from orders where o_orderstatus = 'F') o right join customer c on o.o_custkey = c.c_custkey")
def join_right(spark, sf):
    sub = {":select": [":*"], ":from": [":orders"], ":where": [":=", ":o_orderstatus", "F"]}
    q = {":select": [":o.o_orderkey", ":c.c_custkey"], ":from": [[sub, ":o"]], ":right-join": [[":customer", ":c"], [":=", ":o.o_custkey", ":c.c_custkey"]]}
    return relational_query(catalog(spark, sf, "orders", "customer"), q)


@query("select s_suppkey, n_nationkey from (select * from supplier where s_acctbal > 0) s full join (select * from nation where n_regionkey < 3) n on s_nationkey = n_nationkey")
def join_full(spark, sf):
    q = {
        ":select": [":s_suppkey", ":n_nationkey"],
        ":from": [[{":select": [":*"], ":from": [":supplier"], ":where": [":>", ":s_acctbal", 0]}, ":s"]],
        ":full-join": [[{":select": [":*"], ":from": [":nation"], ":where": [":<", ":n_regionkey", 3]}, ":n"], [":=", ":s_nationkey", ":n_nationkey"]],
    }
    return relational_query(catalog(spark, sf, "supplier", "nation"), q)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def join_anti(spark, sf):
    q = {":select": [":c_custkey"], ":from": [":customer"], ":anti-join": [":orders", [":and", [":=", ":c_custkey", ":o_custkey"], [":>", ":o_totalprice", 300000]]]}
    return relational_query(catalog(spark, sf, "customer", "orders"), q)


@query("select o_orderkey from orders where o_custkey in (1, 5, 9, 77, 1400)")
def join_values(spark, sf):
    """A list of values as an inline table that is joined."""
    q = {
        ":select": [":o_orderkey"], ":from": [[{":table": [[[":k", ":bigint", [1, 5, 9, 77, 1400]]], ":t"]}, ":t"]],
        ":join": [":orders", [":=", ":o_custkey", ":t.k"]],
    }
    return relational_query(catalog(spark, sf, "orders"), q)


@query("select o_orderkey, o_totalprice from orders where o_totalprice = (select max(o_totalprice) from orders)")
def subquery_scalar(spark, sf):
    top = {":select": [Call("max", [":o_totalprice"])], ":from": [":orders"]}
    q = {":select": [":o_orderkey", ":o_totalprice"], ":from": [":orders"], ":where": [":=", ":o_totalprice", top]}
    return relational_query(catalog(spark, sf, "orders"), q)


@query("select n.n_name, t.cnt from (select c_nationkey, count(*) as cnt from customer group by 1) t join nation n on n.n_nationkey = t.c_nationkey")
def subquery_from(spark, sf):
    sub = {":select": [":c_nationkey", [Call("count", [":*"]), ":cnt"]], ":from": [":customer"], ":group-by": [":c_nationkey"]}
    q = {":select": [":n.n_name", ":t.cnt"], ":from": [[sub, ":t"]], ":join": [[":nation", ":n"], [":=", ":n.n_nationkey", ":t.c_nationkey"]]}
    return relational_query(catalog(spark, sf, "customer", "nation"), q)


@query(
    """select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total, min(o_orderdate) as first_day from orders
    group by 1 having count(*) > 10"""
)
def group_by_having(spark, sf):
    q = {
        ":select": [":o_orderpriority", [":%count.*", ":n"], [Call("round", [Call("sum", [":o_totalprice"]), 2]), ":total"], [":%min.o_orderdate", ":first_day"]],
        ":from": [":orders"], ":group-by": [":o_orderpriority"], ":having": [":>", Call("count", [":*"]), 10],
    }
    return relational_query(catalog(spark, sf, "orders"), q)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 3")
def order_limit(spark, sf):
    q = {":select": [":o_orderkey", ":o_totalprice"], ":from": [":orders"], ":order-by": [[":o_totalprice", ":desc"], ":o_orderkey"], ":limit": 25, ":offset": 3}
    return relational_query(catalog(spark, sf, "orders"), q)


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(spark, sf):
    q = {":union-all": [{":select": [[":c_nationkey", ":k"]], ":from": [":customer"]}, {":select": [[":s_nationkey", ":k"]], ":from": [":supplier"]}]}
    return relational_query(catalog(spark, sf, "customer", "supplier"), q)


@query("select c_nationkey as k from customer union select n_regionkey from nation")
def union_distinct(spark, sf):
    q = {":union": [{":select": [[":c_nationkey", ":k"]], ":from": [":customer"]}, {":select": [[":n_regionkey", ":k"]], ":from": [":nation"]}]}
    return relational_query(catalog(spark, sf, "customer", "nation"), q)


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def intersect_rows(spark, sf):
    q = {":intersect": [{":select": [[":c_nationkey", ":k"]], ":from": [":customer"]}, {":select": [[":s_nationkey", ":k"]], ":from": [":supplier"]}]}
    return relational_query(catalog(spark, sf, "customer", "supplier"), q)


@query("select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000")
def except_rows(spark, sf):
    q = {
        ":except": [
            {":select": [[":n_nationkey", ":k"]], ":from": [":nation"]},
            {":select": [[":s_nationkey", ":k"]], ":from": [":supplier"], ":where": [":>", ":s_acctbal", 5000]},
        ]
    }
    return relational_query(catalog(spark, sf, "nation", "supplier"), q)


@query(
    """select p_partkey, case when p_size < 10 then 'small' when p_size between 10 and 30 then 'middle' else 'large' end as size_class,
    p_retailprice * 2 - 1 as price from part where p_name like 'red%' and (p_size <> 5 or p_type is null) and p_brand not in ('Brand#11')"""
)
def where_forms(spark, sf):
    case = [":case", [":<", ":p_size", 10], "small", [":between", ":p_size", 10, 30], "middle", ":else", "large"]
    q = {
        ":select": [":p_partkey", [case, ":size_class"], [[":-", [":*", ":p_retailprice", 2], 1], ":price"]], ":from": [":part"],
        ":where": [":and", [":like", ":p_name", "red%"], [":or", [":<>", ":p_size", 5], [":is", ":p_type", None]], [":not-in", ":p_brand", ["Brand#11"]]],
    }
    return relational_query(catalog(spark, sf, "part"), q)


@query("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)")
def where_exists(spark, sf):
    sub = {":select": [1], ":from": [[":orders", ":o"]], ":where": [":and", [":=", ":o.o_custkey", ":c.c_custkey"], [":>", ":o.o_totalprice", 400000]]}
    q = {":select": [":c_custkey"], ":from": [[":customer", ":c"]], ":where": [":exists", sub]}
    return relational_query(catalog(spark, sf, "customer", "orders"), q)


@query("select round(exp(1.0), 6) as e, upper('abc') as u, 7 % 3 as m")
def sql_calls(spark, sf):
    q = {":select": [[Call("round", [Call("exp", [1.0]), 6]), ":e"], [Call("upper", ["abc"]), ":u"], [[":%", 7, 3], ":m"]]}
    return relational_query(Catalog(spark), q)


_CALLS = {
    "abs": (["c_acctbal"], "abs(c_acctbal)"), "ceil": (["c_acctbal"], "ceil(c_acctbal)::bigint"), "floor": (["c_acctbal"], "floor(c_acctbal)::bigint"),
    "sign": (["c_acctbal"], "sign(c_acctbal)::double"), "power": (["c_nationkey", 2], "power(c_nationkey, 2)"), "mod": (["c_custkey", 7], "c_custkey % 7"),
    "lower": (["c_name"], "lower(c_name)"), "length": (["c_name"], "length(c_name)::int"), "substring": (["c_name", 3, 4], "substring(c_name, 3, 4)"),
    "replace": (["c_name", "0", "-"], "replace(c_name, '0', '-')"), "concat": (["c_name", "c_mktsegment"], "concat(c_name, c_mktsegment)"), "left": (["c_name", 5], "left(c_name, 5)"),
    "right": (["c_name", 5], "right(c_name, 5)"), "lpad": (["c_mktsegment", 12, "*"], "lpad(c_mktsegment, 12, '*')"), "rpad": (["c_mktsegment", 12, "*"], "rpad(c_mktsegment, 12, '*')"),
    "reverse": (["c_name"], "reverse(c_name)"), "ascii": (["c_mktsegment"], "ascii(c_mktsegment)"), "repeat": (["c_mktsegment", 2], "repeat(c_mktsegment, 2)"),
    "nullif": (["c_nationkey", 3], "nullif(c_nationkey, 3)"), "coalesce": ([None, "c_nationkey"], "coalesce(null, c_nationkey)"), "greatest": (["c_nationkey", 9], "greatest(c_nationkey, 9)"),
    "least": (["c_nationkey", 9], "least(c_nationkey, 9)"), "instr": (["c_name", "#"], "instr(c_name, '#')::int"), "trim": (["c_name"], "trim(c_name)"),
    "radians": (["c_nationkey"], "radians(c_nationkey)"), "degrees": (["c_nationkey"], "degrees(c_nationkey)"), "translate": (["c_name", "0C", "oK"], "translate(c_name, '0C', 'oK')"),
}


@query("select c_custkey, " + ", ".join(f"{sql} as f_{name}" for name, (_, sql) in _CALLS.items()) + " from customer")
def sql_functions(spark, sf):
    """Scalar functions of the allow-list over a table."""
    arg = lambda x: f":{x}" if isinstance(x, str) and x.startswith("c_") else x
    calls = [[Call(name, [arg(x) for x in args]), f":f_{name}"] for name, (args, _) in _CALLS.items()]
    return relational_query(catalog(spark, sf, "customer"), {":select": [":c_custkey", *calls], ":from": [":customer"]})


@query("select o_orderpriority, year(o_orderdate)::int as y, month(o_orderdate)::int as m, count(*) as n, count(distinct o_custkey) as customers, round(stddev(o_totalprice), 2) as sd, round(var_pop(o_totalprice), 0) as var, round(median(o_totalprice), 3) as med from orders group by 1, 2, 3")
def sql_aggregates(spark, sf):
    """Dates and aggregates of the allow-list."""
    by = [":o_orderpriority", Call("year", [":o_orderdate"]), Call("month", [":o_orderdate"])]
    agg = lambda f, digits: Call("round", [Call(f, [":o_totalprice"]), digits])
    q = {
        ":select": [by[0], [by[1], ":y"], [by[2], ":m"], [":%count.*", ":n"], [Call("count-distinct", [":o_custkey"]), ":customers"], [agg("stddev", 2), ":sd"], [agg("var_pop", 0), ":var"], [agg("median", 3), ":med"]],
        ":from": [":orders"], ":group-by": by,
    }
    return relational_query(catalog(spark, sf, "orders"), q)


@query("select a.r_name as one, b.r_name as two from region a, region b where a.r_regionkey < b.r_regionkey")
def join_cross(spark, sf):
    """All pairs of a table of fixed size, as a query that names no condition for its join asks for them."""
    q = {":select": [[":a.r_name", ":one"], [":b.r_name", ":two"]], ":from": [[":region", ":a"]], ":cross-join": [[":region", ":b"]], ":where": [":<", ":a.r_regionkey", ":b.r_regionkey"]}
    return relational_query(catalog(spark, sf, "region"), q)


# -- questions to the catalog ------------------------------------------------------
@query("select distinct cohort from dataset where cohort is not null")
def all_cohorts(spark, sf):
    return client.cohorts_df(table(spark, sf, "dataset"))


@query("select distinct name, type, datasubtype, probemap, status from dataset where type = 'genomicMatrix' and security = 'public'")
def datasets_in_cohort(spark, sf):
    q = {
        ":select": [":name", ":type", ":datasubtype", ":probemap", ":status"], ":modifiers": [":distinct"], ":from": [":dataset"],
        ":where": [":and", [":=", ":type", "genomicMatrix"], [":=", ":security", "public"]],
    }
    return relational_query(catalog(spark, sf, "dataset"), q)


@query("select d.name as dataset, f.name as field from (select distinct id, name from dataset) d join (select distinct * from field) f on d.id = f.dataset_id")
def dataset_fields(spark, sf):
    return client.fields_df(table(spark, sf, "dataset"), table(spark, sf, "field")).select("dataset", "field")


@query("select id, name from source where id not in (select source_id from dataset_source where source_id is not null)")
def unused_sources(spark, sf):
    q = {":select": [":source.id", ":source.name"], ":from": [":source"], ":anti-join": [":dataset-source", [":=", ":source.id", ":dataset-source.source-id"]]}
    return relational_query(catalog(spark, sf, "source", "dataset_source"), q)


@query(
    """select distinct f.id, exists (select 1 from field_position p where p.field_id = f.id) as has_position from field f"""
)
def has_position(spark, sf):
    return client.with_flags(table(spark, sf, "field"), position=table(spark, sf, "field_position"))


@query(
    """select count(*) as n, count(distinct field_id) as fields from field_position
    where chrom = 'chr7' and chromstart <= 3000000 and chromend >= 1000000 and bin is not null"""
)
def position_scan(spark, sf):
    q = {
        ":select": [[":%count.*", ":n"], [Call("count-distinct", [":field-id"]), ":fields"]], ":from": [":field-position"],
        ":where": [":and", [":=", ":chrom", "chr7"], [":<=", ":chromStart", 3000000], [":>=", ":chromEnd", 1000000], [":not", [":is", None, ":bin"]]],
    }
    return relational_query(catalog(spark, sf, "field_position"), q)


# -- scalar functions -----------------------------------------------------------------
_BINS = """case when s >> 17 = (e - 1) >> 17 then (s >> 17) + 4681 when s >> 20 = (e - 1) >> 20 then (s >> 20) + 585
  when s >> 23 = (e - 1) >> 23 then (s >> 23) + 73 when s >> 26 = (e - 1) >> 26 then (s >> 26) + 9
  when s >> 29 = (e - 1) >> 29 then s >> 29 end"""


@query(f"select l_orderkey, l_linenumber, ({_BINS})::bigint as bin from {SEGMENTS}")
def calc_bin(spark, sf):
    seg = segments(spark, sf)
    return seg.select("l_orderkey", "l_linenumber", S.calc_bin(F.col("start"), F.col("end")).cast("long").alias("bin"))


@query(
    f"""select l_orderkey, l_linenumber, u.l as level, ((s >> (17 + 3 * u.l)) + [4681, 585, 73, 9, 0][u.l + 1])::bigint as lo,
    (((e - 1) >> (17 + 3 * u.l)) + [4681, 585, 73, 9, 0][u.l + 1])::bigint as hi from {SEGMENTS}, (select unnest([0, 1, 2, 3, 4]) as l) u"""
)
def overlapping_bins(spark, sf):
    seg = segments(spark, sf)
    return seg.select("l_orderkey", "l_linenumber", F.posexplode(S.overlapping_bins(F.col("start"), F.col("end"))).alias("level", "b")).select(
        "l_orderkey", "l_linenumber", "level", F.col("b.lo").cast("long").alias("lo"), F.col("b.hi").cast("long").alias("hi")
    )


@query(
    """select event_id, round(try_cast(case when event_id % 5 = 0 then 'NA' when event_id % 5 = 1 then '' when event_id % 5 = 2 then 'x1'
    else regexp_extract(props, '([0-9.]+)', 1) end as float), 3) as x from events"""
)
def parse_float_na(spark, sf):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "NA").when(k == 1, "").when(k == 2, "x1").otherwise(F.regexp_extract("props", "([0-9.]+)", 1))
    return table(spark, sf, "events").select("event_id", F.round(S.parse_float_na(raw), 3).alias("x"))


@query(
    """select distinct chrom as raw, case when regexp_matches(lower(trim(chrom)), '^(chr)?[0-9]+$') then 'chr' || regexp_replace(lower(trim(chrom)), '^chr', '')
      when regexp_matches(lower(trim(chrom)), '^(chr)?[xym]$') then 'chr' || upper(right(trim(chrom), 1)) else trim(chrom) end as chrom from field_position"""
)
def normalize_chrom(spark, sf):
    return table(spark, sf, "field_position").select(F.col("chrom").alias("raw"), S.normalize_chrom(F.col("chrom")).alias("chrom")).distinct()


@query("select p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' ,, '), ','), lambda x: trim(x)), lambda x: x <> '') as genes from part")
def split_genes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.split_genes(F.regexp_replace("p_name", " ", " ,, ")).alias("genes"))


@query("select l_orderkey, l_linenumber, (l_partkey * 1000 + 1)::int as c from lineitem")
def parse_coordinate(spark, sf):
    """Coordinates written as ``012e3``, counted from 0."""
    raw = F.concat(F.lit(" 0"), F.col("l_partkey").cast("string"), F.lit("e3"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.parse_coordinate(raw, 1).alias("c"))


@query("select p_partkey, (p_size + 1) || ',' || (p_size * 2 + 1) as starts from part")
def shift_int_csv(spark, sf):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(", ,"), (F.col("p_size") * 2).cast("string"), F.lit(","))
    return table(spark, sf, "part").select("p_partkey", S.shift_int_csv(raw, 1).alias("starts"))


@query("select source_id, line_no, list_transform(string_split(line, chr(9)), lambda x: replace(trim(x), '\"', '')) as cells from raw_lines where line is not null")
def tab_tokens(spark, sf):
    return table(spark, sf, "raw_lines").where("line is not null").select("source_id", "line_no", tabbed(F.col("line")).alias("cells"))


@query("select vec_id, list_transform(embedding, lambda x: x::double * 2.0::double + 1.0::double) as v from embeddings")
def vector_scale(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.array_scale(F.col("embedding"), 2.0, 1.0).alias("v"))


@query("select vec_id, round(list_avg(list_transform(embedding, lambda x: x::double)), 6) as m from embeddings")
def vector_mean(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.array_mean(F.col("embedding")), 6).alias("m"))


@query("select label, i, round(avg(x), 5) as m from (select label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings) group by 1, 2")
def matrix_mean(spark, sf):
    """Mean along the first dimension of the matrix of each label."""
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return long.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(A.nan_mean(F.col("x")), 5).alias("m"))


@query("select vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: z[1]::double - z[2]::double) as v from embeddings")
def vector_minus(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.array_minus(F.col("embedding"), F.reverse("embedding")).alias("v"))


@query(
    """select c_custkey, case when x = floor(x) then x::bigint::varchar else format('{:.4g}', x::float::double) end as text
    from (select c_custkey, (c_acctbal + 20000) / 700 as x from customer)"""
)
def float_format(spark, sf):
    """Numbers with at most four significant digits."""
    return table(spark, sf, "customer").select("c_custkey", short_float_column((F.col("c_acctbal") + 20000) / 700).alias("text"))


@query("select event_type, count(*) as n, max(event_id) as last_id from events group by 1")
def stream_counts(spark, sf):
    """A folder as a stream: every micro-batch adds its partial counts, keyed by batch, to a table in the shared folder."""
    counts = FolderCounts(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema, own_dir(spark, "stream"), ["event_type"], "event_id")
    counts.update()
    return counts.read().withColumnRenamed("last", "last_id")


# -- more of the engine ------------------------------------------------------------------
@query("select p_partkey, p_size from part where p_partkey in (3, 14, 159, 265)")
def probe_lookup(spark, sf):
    """Rows by a list of names."""
    return column_query(catalog(spark, sf, "part"), {"select": ["p_partkey", "p_size"], "from": ["part"], "where": ["in", "p_partkey", [3, 14, 159, 265]]}).drop(ROW)


@query(
    """select a.l_suppkey as supp, b.l_linenumber as line, count(*) as n from (select l_orderkey, l_linenumber, l_suppkey from lineitem where l_linenumber = 1) a
    join lineitem b on b.l_orderkey = a.l_orderkey and b.l_partkey > a.l_suppkey group by 1, 2"""
)
def join_theta(spark, sf):
    """A join on one equality and one inequality."""
    first = {":select": [":l-orderkey", ":l-suppkey"], ":from": [":lineitem"], ":where": [":=", ":l-linenumber", 1]}
    q = {
        ":select": [[":a.l-suppkey", ":supp"], [":b.l-linenumber", ":line"], [":%count.*", ":n"]], ":from": [[first, ":a"]],
        ":join": [[":lineitem", ":b"], [":and", [":=", ":b.l-orderkey", ":a.l-orderkey"], [":>", ":b.l-partkey", ":a.l-suppkey"]]],
        ":group-by": [":a.l-suppkey", ":b.l-linenumber"],
    }
    return relational_query(catalog(spark, sf, "lineitem"), q)


@query("select p_partkey, row_number() over (order by p_brand, p_partkey) - 1 as row_no from part")
def numbered_rows(spark, sf):
    """Dense row numbers in a given order, without one window over all rows."""
    from strandmill.catalog import with_rows

    return with_rows(table(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey").select("p_partkey", F.col(ROW).alias("row_no"))


@query(
    """select n_regionkey, list_sort(list_distinct(list_concat(a, b))) as both, list_sort(list_filter(a, lambda x: not list_contains(b, x))) as only_a from
    (select n_regionkey, list(n_name) as a, list(n_name) filter (n_nationkey % 2 = 0) as b from nation group by 1)"""
)
def sorted_sets(spark, sf):
    """Union and difference of sorted string lists."""
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.collect_list("n_name").alias("a"), F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("b")
    )
    return g.select("n_regionkey", S.sorted_union(F.col("a"), F.col("b")).alias("both"), S.sorted_except(F.col("a"), F.col("b")).alias("only_a"))


EXPRESSIONS = {
    "(+ 5 2)": "7", "(/ 5 2)": "2.5", "(* [-1 0 1] [1 2 3] 2)": "[-2,0,6]", "(- [[1 2 3] [4 5 6]] [1 2 3])": "[[0,0,0],[3,3,3]]",
    "((fn [f x] (f x)) (fn [x] (+ 1 x)) 3)": "4", "(let [a 2 b (* a a)] [a b])": "[2,4]", "(if nil 1 2)": "2", "(quote (1 2))": "[1,2]", "(apply + (quote (1 2 3)))": "6",
    "(mean [[1 2 3] [4 nil 6]] 0)": "[[2.5,2,4.5]]", "(mean [[1 2 3] [4 nil 6]] 1)": "[[2],[5]]", "(map (fn [x] (get x :a 0)) [{:a 1} {}])": "[1,0]",
    "(count (distinct [1 1 2]))": "2", "(car (cdr [1 2 3]))": "2", "(cons 0 [1])": "[0,1]", "(assoc {:a 1} :b 2)": '{"a":1,"b":2}', "(group-by :k [{:k \"x\"} {:k \"x\"}])": '{"x":[{"k":"x"},{"k":"x"}]}',
    "(> 3 2)": "true", "(= [1 2] [1 2])": "true", "(/ 1 3)": "0.3333",
}


@query("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in EXPRESSIONS.items()) + ") t(expression, answer)")
def expressions(spark, sf):
    """The expression language, with its answers as JSON."""
    return spark.createDataFrame([(e, client.post(Catalog(spark), e)) for e in EXPRESSIONS], "expression string, answer string")


@query(
    """select c.k as pos, n_name, n_regionkey::double as value from (select unnest([0, 1, 2, 3]) k, unnest(['NATION_7', 'nowhere', 'NATION_3', 'NATION_7']) s) c
    left join nation on n_name = c.s"""
)
def expression_fetch(spark, sf):
    """A fetch through the expression language."""
    c = Catalog(spark)
    df = table(spark, sf, "nation").select(F.col("n_nationkey").alias(ROW), F.col("n_name").alias("sampleID"), F.col("n_regionkey").cast("double").alias("v"))
    c.register("nations", df)
    got = client.expression_json(c, '(fetch [{:table "nations" :columns ["v"] :samples ["NATION_7" "nowhere" "NATION_3" "NATION_7"]}])')[0]
    names = ["NATION_7", None, "NATION_3", "NATION_7"]
    return spark.createDataFrame([(i, n, None if v == "NaN" else float(v)) for i, (n, v) in enumerate(zip(names, got))], "pos int, n_name string, value double")
