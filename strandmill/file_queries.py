"""Queries that load files: every kind of file, their metadata, the loader's rules, and the tables the catalog makes of them.

The files are written by Spark from the test tables, whole, to the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import client
from strandmill.catalog import ROW, Catalog, Dataset, Field
from strandmill.plans.column_query import column_query
from strandmill.plans.fetch import long_values
from strandmill.plans.forms import Call
from strandmill.plans.relational import relational_query
from strandmill.session import own_dir, table
from strandmill.sources import metadata as md
from strandmill.sources.files import Files
from strandmill.sources.loader import Loader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Desk:
    """A folder of files of its own, and a loader and catalog for it."""

    def __init__(self, spark: SparkSession):
        at = own_dir(spark, "files").removeprefix("file://").removeprefix("file:")
        self.spark, self.files, self.root = spark, Files(spark), f"{at}/docs"
        self.catalog = Catalog(spark)
        self.loader = Loader(self.catalog, self.root, f"{at}/store")

    def text(self, file: str, text: str, **meta) -> Desk:
        self.files.write(f"{self.root}/{file}", text)
        return self.meta(file, **meta)

    def meta(self, file: str, **meta) -> Desk:
        if meta:
            self.files.write(f"{self.root}/{file}.json", json.dumps({k.replace("ref_", ":"): v for k, v in meta.items()}))
        return self

    def rows(self, file: str, head: str, rows: DataFrame, cells: list[Column], order: list[str], **meta) -> Desk:
        line = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
        keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(order)]
        self.files.write_lines(f"{self.root}/{file}", head, rows.select(line.alias("line"), *keys), *[f"__k{i}" for i in range(len(order))])
        return self.meta(file, **meta)

    def load(self, *names: str) -> Catalog:
        for n in names:
            ds = self.loader.load(n)
            if ds.meta["status"] != "loaded":
                raise ValueError(ds.meta["metadata"].get("error"))
        return self.catalog


# -- mutations, segments, gene predictions, probe maps -------------------------------
def mutations(spark: SparkSession, sf: str) -> Catalog:
    """Lines as mutations: sample, gene and effect, a missing frequency on line 7, and a column the format does not know."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    cells = [
        F.concat(F.lit("S"), F.col("l_suppkey")), F.col("l_suppkey") % 22 + 1, k * 1000, k * 1000 + n, F.concat(F.lit("G"), k % 50, F.when(n == 1, ", ,X").otherwise("")), F.lit("A"),
        F.lit("T"), F.col("l_returnflag"), F.when(n == 7, "NA").otherwise((F.col("l_quantity") / 100).cast("string")), F.concat_ws("-", "l_orderkey", "l_linenumber"),
    ]
    head = "#Sample ID\tchr\tStart\tend\tgenes\tReference\talternate\tEFFECT\tDNA_VAF\tnote"
    return Desk(spark).rows("mut", head, table(spark, sf, "lineitem"), cells, ["l_orderkey", "l_linenumber"], type="mutationVector", cohort="C").load("mut")


@query(
    """select 'S' || l_suppkey as "sampleID", 'chr' || (l_suppkey % 22 + 1) as chrom, l_partkey * 1000 as chromstart, l_partkey * 1000 + l_linenumber as chromend,
      case when l_linenumber = 1 then list_sort(['G' || (l_partkey % 50), 'X']) else ['G' || (l_partkey % 50)] end as genes, l_returnflag as effect,
      case when l_linenumber <> 7 then (l_quantity / 100)::float end as vaf, l_orderkey || '-' || l_linenumber as note
    from lineitem where l_returnflag in ('R', 'N') and (l_partkey % 50 in (7, 8))"""
)
def ingest_mutation(spark, sf):
    """A mutation file: headers in other spellings, gene lists, missing numbers, two predicates."""
    where = ["and", ["in", "effect", ["R", "N"]], ["in", "any", "genes", ["g7", "G8"]]]
    df = column_query(mutations(spark, sf), {"select": ["sampleID", "position", "genes", "effect", "dna-vaf", "note"], "from": ["mut"], "where": where})
    return df.select(
        "sampleID", "position.chrom", F.col("position.chromStart").alias("chromstart"), F.col("position.chromEnd").alias("chromend"), F.array_sort("genes").alias("genes"),
        "effect", F.col("`dna-vaf`").alias("vaf"), "note",
    )


@query(
    """select 'S' || o_custkey as "sampleID", 'chr' || (o_orderkey % 22 + 1) as chrom, o_orderkey * 10 + 1 as chromstart, o_orderkey * 10 + 100 as chromend,
      case o_orderkey % 3 when 0 then '+' when 1 then '-' else '.' end as strand, o_totalprice::float as value, o_orderpriority as priority
    from orders where (o_orderkey % 22 = 4 and o_orderkey * 10 + 1 <= 90000 and o_orderkey * 10 + 100 >= 1000) or (o_orderkey % 22 = 6 and o_orderkey * 10 + 100 >= 20000)"""
)
def ingest_segment(spark, sf):
    """A segment file that counts from 0, and a query by intervals."""
    k = F.col("o_orderkey")
    strand = F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise("")
    cells = [F.concat(F.lit("S"), F.col("o_custkey")), F.concat(F.lit(" CHR"), k % 22 + 1), k * 10, k * 10 + 100, strand, F.col("o_totalprice"), F.col("o_orderpriority")]
    desk = Desk(spark).rows("seg", "sample_name\tchrom\tstart\tend\tstrand\tvalue\tpriority", table(spark, sf, "orders"), cells, ["o_orderkey"], type="genomicSegment", start_index=0)
    where = ["in", "position", [["chr5", 1000, 90000], ["chr7", 20000, 2**31 - 1]]]
    df = column_query(desk.load("seg"), {"select": ["sampleID", "position", "value", "priority"], "from": ["seg"], "where": where})
    p = lambda x: F.col(f"position.{x}")
    return df.select("sampleID", p("chrom"), p("chromStart").alias("chromstart"), p("chromEnd").alias("chromend"), p("strand"), "value", "priority")


@query(
    """select row_number() over (order by 'chr' || (p_partkey % 22), p_partkey * 100 + 1, p_partkey) - 1 as row_no, p_name as name, 'chr' || (p_partkey % 22) as chrom,
      p_partkey * 100 + 1 as txstart, p_partkey * 100 + 90 as txend, p_partkey * 100 + 11 as cdsstart, p_partkey * 100 + 80 as cdsend,
      (p_partkey * 100 + 1) || ',' || (p_partkey * 100 + 51) as starts, p_size::float as score, string_split(p_name, ' ')[1:1] as genes from part"""
)
def ingest_genepred(spark, sf):
    """Gene predictions have two positions a row, of transcript and coding region, and starts as a list."""
    k = F.col("p_partkey")
    starts = F.concat(k * 100, F.lit(", "), k * 100 + 50, F.lit(","))
    cells = [F.col("p_name"), k % 22, F.lit("+"), k * 100, k * 100 + 90, k * 100 + 10, k * 100 + 80, F.lit(2), starts, starts, F.col("p_size"), F.split("p_name", " ")[0]]
    head = "name\tchrom\tstrand\ttxStart\ttxEnd\tcdsStart\tcdsEnd\texonCount\texonStarts\texonEnds\tscore\tname2"
    desk = Desk(spark).rows("gp", head, table(spark, sf, "part"), cells, ["p_partkey"], type="genePredExt", start_index=0)
    df = column_query(desk.load("gp"), {"select": ["name", "position", "position (2)", "exonStarts", "score", "name2"], "from": ["gp"]})
    at = lambda n, x: F.col(f"`{n}`.`{x}`")
    two = "position (2)"
    return df.select(
        F.col(ROW).alias("row_no"), "name", at("position", "chrom").alias("chrom"), at("position", "chromStart").alias("txstart"), at("position", "chromEnd").alias("txend"),
        at(two, "chromStart").alias("cdsstart"), at(two, "chromEnd").alias("cdsend"), F.col("exonStarts").alias("starts"), "score", F.col("name2").alias("genes"),
    )


@query(
    """select row_number() over (order by 'chr' || (p_partkey % 3 + 9), 1000000 - p_partkey) - 1 as row_no, p_name as name,
      'chr' || (p_partkey % 3 + 9) as chrom, 1000000 - p_partkey + 1 as chromstart, 2000000 as chromend, list_sort(['G' || p_size, 'X']) as genes from part"""
)
def ingest_probemap(spark, sf):
    """A file of positions: sorted by chromosome as text and start, starts counted from 0, genes as lists."""
    k = F.col("p_partkey")
    cells = [F.col("p_name"), F.concat(F.lit("G"), F.col("p_size"), F.lit(", ,X")), k % 3 + 9, 1000000 - k, F.lit("2e6"), F.lit("+")]
    desk = Desk(spark).rows("p", "#id\tgenes\tchr\tstart\tend\tstrand", table(spark, sf, "part"), cells, ["p_partkey"], type="probeMap", start_index=0)
    df = desk.load("p").dataset("p").df
    return df.select(
        F.col(ROW).alias("row_no"), "name", "position.chrom", F.col("position.chromStart").alias("chromstart"), F.col("position.chromEnd").alias("chromend"),
        F.array_sort("genes").alias("genes"),
    )


# -- clinical tables and matrices ------------------------------------------------------
def clinical(desk: Desk, spark: SparkSession, sf: str, file: str = "clin", where: str = "true", **meta) -> Desk:
    missing = F.col("c_nationkey") % 5 == 2
    cells = [F.col("c_name"), F.when(missing, "NA").otherwise(F.col("c_acctbal").cast("string")), F.col("c_nationkey"), F.when(~missing, F.col("c_mktsegment"))]
    return desk.rows(file, "id\tbalance\tnation\tsegment", table(spark, sf, "customer").where(where), cells, ["c_custkey"], type="clinicalMatrix", **meta)


@query(
    """select c_name as "sampleID", case when c_nationkey % 5 <> 2 then c_acctbal::float end as balance, case when c_nationkey % 5 <> 2 then c_mktsegment end as segment
    from customer where c_nationkey in (0, 2, 3)"""
)
def ingest_clinical(spark, sf):
    """A clinical table: a float field, a category with missing cells, and a predicate on the float."""
    c = clinical(Desk(spark), spark, sf).load("clin")
    return column_query(c, {"select": ["sampleID", "balance", "segment"], "from": ["clin"], "where": ["in", "nation", [0, 2, 3, None]]}).drop(ROW)


_SEGMENTS = ["MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD", "BUILDING"]


@query(
    "select 'segment' as field, 'Market segment' as longtitle, s.v as value, s.o::int as ordering from (values "
    + ", ".join(f"('{v}', {i})" for i, v in enumerate(_SEGMENTS))
    + ") s(v, o)"
)
def ingest_features(spark, sf):
    """Features with a declared order of states: the states keep it, whatever order the table has them in."""
    order = ",".join(f'"{v}"' for v in _SEGMENTS)
    features = f"segment\tvalueType\tcategory\nsegment\tlongTitle\tMarket segment\nsegment\tstateOrder\t{order}\nbalance\tvalueType\tfloat\n"
    desk = clinical(Desk(spark).text("feat", features, type="clinicalFeature"), spark, sf, ref_clinicalFeature="feat")
    q = {
        ":select": [[":field.name", ":field"], ":feature.longtitle", ":code.value", ":code.ordering"], ":from": [":field"],
        ":join": [":feature", [":=", ":feature.field-id", ":field.id"], ":code", [":=", ":code.field-id", ":field.id"]], ":where": [":=", ":field.name", "segment"],
    }
    return relational_query(desk.load("clin"), q)


_CELL = "case when (c_custkey + n_nationkey) % 7 = 0 then null else (c_custkey * 31 + n_nationkey * 17) % 1000 / 8.0 end"


@query(
    f"""select n_name as "sampleID", max(case when c_custkey = 3 then {_CELL} end)::float as a, max(case when c_custkey = 8 then {_CELL} end)::float as b
    from customer, nation where c_custkey in (3, 8) group by 1 having max(case when c_custkey = 8 then {_CELL} end) is not null
      and max(case when c_custkey = 3 then {_CELL} end) in (11.625, 13.75, 62.625, 22.25)"""
)
def ingest_matrix(spark, sf):
    """A matrix of customers by nations from its file, asked like a table."""
    names = [r[0] for r in table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]  # a table of fixed size
    k = F.col("c_custkey")
    cell = lambda n: F.when((k + n) % 7 == 0, "NA").otherwise(((k * 31 + n * 17) % 1000 / 8).cast("string"))
    cells = [F.col("c_name"), *[cell(i) for i in range(len(names))]]
    desk = Desk(spark).rows("m", "\t".join(["probe", *names]), table(spark, sf, "customer"), cells, ["c_custkey"])
    a, b = (f"Customer#{i:09d}" for i in (3, 8))
    df = column_query(desk.load("m"), {"select": ["sampleID", a, b], "from": ["m"], "where": ["in", a, [11.625, 13.75, 62.625, 22.25]]})
    return df.select("sampleID", F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).where("b is not null")


_PROBES, _SAMPLES = 30, 500


@query(
    f"""with r as (select unnest(range(0, {_PROBES})) as col), s as (select unnest(range(0, {_SAMPLES})) as pos)
    select col::int as col, pos::int as pos, case when k is not null and (k + i) % 11 <> 0 then ((k * 31 + i * 17) % 1000 / 8.0)::float::double end as value
    from (select col, pos, {_SAMPLES} - 1 - pos as i, p_partkey as k from r join s on true left join part on p_partkey = col * 50 + 1) x"""
)
def fetch_probes(spark, sf):
    """The shape of a viewer's request: 30 probes by 500 samples of a matrix of all parts; probes that don't exist are missing."""
    i = F.sequence(F.lit(0), F.lit(_SAMPLES - 1))
    k = F.col("p_partkey")
    cells = F.transform(i, lambda x: F.when((k + x) % 11 != 0, (k * 31 + x * 17) % 1000 / 8).cast("float"))
    parts = table(spark, sf, "part")
    values = parts.select(F.concat(F.lit("P"), k).alias("field"), cells.alias("values"), F.transform(i, lambda x: F.lit(None).cast("string")).alias("codes"))
    samples = spark.range(_SAMPLES).select(F.col("id").alias(ROW), F.concat(F.lit("s"), "id").alias("sample"))
    names = [f"P{r[0]}" for r in parts.select("p_partkey").toLocalIterator()]  # the fields of a dataset are known to the catalog
    c = Catalog(spark)
    c.add(Dataset("m", {n: Field(n, "float") for n in ["sampleID", *names]}, values=values, samples=samples))
    out = long_values(c, "m", [f"P{j * 50 + 1}" for j in range(_PROBES)], [f"s{_SAMPLES - 1 - j}" for j in range(_SAMPLES)])
    return out.select("col", "pos", F.when(~F.isnan("value"), F.col("value")).alias("value"))


# -- the loader's rules ------------------------------------------------------------------
@query(
    """select * from (values (1, 'first', 'loaded', 2, true), (2, 'again', 'loaded', 2, false), (3, 'forced', 'loaded', 2, true), (4, 'changed', 'loaded', 3, true),
      (5, 'feature file changed', 'loaded', 3, true), (6, 'undeclared state', 'error', null, true), (7, 'mended', 'loaded', 3, true), (8, 'metadata only', 'loaded', 3, false),
      (9, 'empty', 'error', null, true), (10, 'deleted', 'gone', null, false)) t(step, what, status, n_rows, loaded_anew)"""
)
def load_rules(spark, sf):
    """What a load does: unchanged files are skipped, changed or forced ones read again, failures leave a status, deletion leaves nothing."""
    desk, out = Desk(spark), []
    feature = lambda states: f"state\tvalueType\tcategory\nstate\tstateOrder\t{states}\n"
    two, three = "id\tstate\nn1\ta\nn2\tb\n", "id\tstate\nn1\ta\nn2\tb\nn3\ta\n"
    desk.text("feat", feature('"b","a"'), type="clinicalFeature").text("clin", two, type="clinicalMatrix", ref_clinicalFeature="feat")
    before = None

    def step(what: str, always: bool = False) -> None:
        nonlocal before
        ds = desk.loader.load("clin", always)
        data = ds.meta.get("data")
        out.append((len(out) + 1, what, ds.meta["status"], ds.meta.get("rows") if data else None, data is None or data != before))
        before = data

    step("first")
    step("again")
    step("forced", always=True)
    desk.text("clin", three)
    step("changed")
    desk.text("feat", feature('"a","b"'))
    step("feature file changed")
    desk.text("feat", feature('"a"'))
    step("undeclared state")
    desk.text("feat", feature('"b","a"'))
    step("mended")
    desk.meta("clin", type="clinicalMatrix", ref_clinicalFeature="feat", shortTitle="new")
    step("metadata only")
    desk.text("clin", "")
    step("empty")
    desk.loader.delete("clin")
    left = relational_query(desk.catalog, {":select": [":name"], ":from": [":dataset"]}).count()
    out.append((len(out) + 1, "deleted", "gone" if not left else "left", None, False))
    return spark.createDataFrame(out, "step int, what string, status string, n_rows int, loaded_anew boolean")


@query(
    """select * from (values ('d/m1', ':probeMap', '/pm'), ('m2', ':probeMap', 'pm'), ('m2', ':other', 'map1'), ('pm', ':assembly', 'hg18'), ('pm', 'shortTitle', 'short'),
      ('d/m1', 'dataSubType', 'expr'), ('m3', ':probeMap', 'nowhere')) t(file, key, value)"""
)
def sidecar_references(spark, sf):
    """Sidecars with abstract names: references become paths, keys get their own spelling, names of another kind or of nothing stay."""
    desk = Desk(spark)
    desk.meta("pm", type="probeMap", name="map1", group="grp", ref_assembly="hg18", SHORTTITLE="short").meta("d/m1", type="genomicMatrix", name="one", ref_probeMap="grp", DataSubType="expr")
    desk.meta("m2", type="genomicMatrix", name="two", ref_probeMap="map1", ref_other="map1").meta("m3", type="genomicMatrix", name="three", ref_probeMap="nowhere")
    got = md.rewrite_references(desk.files, desk.root)
    rows = [
        (md.relative(desk.root, f), k if k.startswith(":") else md.canonical_key(k), v) for f, m in got.items() for k, v in m.items() if k not in ("type", "name", "group")
    ]
    return spark.createDataFrame(rows, "file string, key string, value string")


# -- the tables the catalog makes --------------------------------------------------------
_BIN = """case when s >> 17 = (e - 1) >> 17 then (s >> 17) + 4681 when s >> 20 = (e - 1) >> 20 then (s >> 20) + 585 when s >> 23 = (e - 1) >> 23 then (s >> 23) + 73
  when s >> 26 = (e - 1) >> 26 then (s >> 26) + 9 when s >> 29 = (e - 1) >> 29 then s >> 29 end"""


@query(
    f"""with l as (select l_partkey * 1000 s, l_partkey * 1000 + l_linenumber e, * from lineitem),
    p as (select 'position' as kind, 'chr' || (l_suppkey % 22 + 1) as k, count(*) n, sum({_BIN})::bigint as total from l group by 2),
    g as (select 'genes', g, count(*), 0::bigint from (select unnest(case when l_linenumber = 1 then ['G' || (l_partkey % 50), 'X'] else ['G' || (l_partkey % 50)] end) g from l) group by 2),
    c as (select 'code', name, count(*), sum(o)::bigint from (select name, row_number() over (partition by name, v) - 1 as one, dense_rank() over (partition by name order by f) - 1 as o, v
      from (select 'effect' as name, l_returnflag v, min(row(chrom, s, l_orderkey, l_linenumber)) f from (select *, 'chr' || (l_suppkey % 22 + 1) as chrom from l) group by 2
        union all select 'sampleID', 'S' || l_suppkey, min(row(chrom, s, l_orderkey, l_linenumber)) from (select *, 'chr' || (l_suppkey % 22 + 1) as chrom from l) group by 2)) group by 2)
    select * from p union all select * from g union all select * from c"""
)
def system_tables(spark, sf):
    """Positions with their bins, genes and codes of a loaded file, from the catalog's own tables through relational queries."""
    c = mutations(spark, sf)
    pos = {":select": [[":chrom", ":k"], [":%count.*", ":n"], [":%sum.bin", ":total"]], ":from": [":field-position"], ":group-by": [":chrom"]}
    gene = {":select": [[":gene", ":k"], [":%count.*", ":n"], [0, ":total"]], ":from": [":field-gene"], ":group-by": [":gene"]}
    code = {
        ":select": [[":field.name", ":k"], [":%count.*", ":n"], [":%sum.code.ordering", ":total"]], ":from": [":code"], ":join": [":field", [":=", ":field.id", ":code.field-id"]],
        ":where": [":in", ":field.name", ["effect", "sampleID"]], ":group-by": [":field.name"],
    }
    parts = [relational_query(c, q).select(F.lit(kind).alias("kind"), "k", "n", F.col("total").cast("long").alias("total")) for kind, q in (("position", pos), ("genes", gene), ("code", code))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- questions to the catalog --------------------------------------------------------------
def cohort(spark: SparkSession, sf: str) -> Catalog:
    desk = clinical(Desk(spark), spark, sf, "one", "c_nationkey < 13", cohort="C")
    return clinical(clinical(desk, spark, sf, "two", "c_nationkey > 10", cohort="C"), spark, sf, "other", "c_nationkey = 4", cohort="D").load("one", "two", "other")


@query("select c_name as sample from customer")
def cohort_samples(spark, sf):
    """The samples of a cohort, over its datasets."""
    c = cohort(spark, sf)
    field, code = c.system("field"), c.system("code")
    return client.field_values_df(c.system("dataset").where("cohort = 'C'"), field, code, "sampleID").select(F.col("value").alias("sample")).distinct()


@query("select c_name as sample, (row_number() over (order by c_custkey) - 1)::int as ordering from customer where c_nationkey = 4")
def dataset_samples(spark, sf):
    """The samples of one dataset with their codes, in the order of the file."""
    c = cohort(spark, sf)
    return client.field_values_df(c.system("dataset").where("name = 'other'"), c.system("field"), c.system("code"), "sampleID").withColumnRenamed("value", "sample")


@query(
    """select 'one' as dataset, c_name as sample from customer where c_nationkey < 13 and c_nationkey % 5 <> 2 and c_mktsegment in ('BUILDING', 'FURNITURE')
    union all select 'two', c_name from customer where c_nationkey > 10 and c_nationkey % 5 <> 2 and c_mktsegment in ('BUILDING', 'FURNITURE')"""
)
def samples_by_field(spark, sf):
    """The samples of a cohort's datasets that have one of some values in a field, in one plan."""
    found = client.samples_by_field_df(cohort(spark, sf), ["one", "two"], "segment", ["BUILDING", "FURNITURE"])
    return found.withColumnRenamed("sampleID", "sample")


@query(
    "select * from (values ('other', 'clinicalMatrix', 'D', 'loaded', 'sampleID,balance,nation,segment'), ('one', 'clinicalMatrix', 'C', 'loaded', 'sampleID,balance,nation,segment'), "
    "('two', 'clinicalMatrix', 'C', 'loaded', 'sampleID,balance,nation,segment')) t(name, type, cohort, status, fields)"
)
def dataset_cards(spark, sf):
    """Each dataset with its type and its fields: a key is grouped, other columns are taken along."""
    q = {
        ":select": [":dataset.name", ":dataset.type", ":dataset.cohort", ":dataset.status", [Call("group_concat", [":field.name", ":order", ":field.id"]), ":fields"]],
        ":from": [":dataset"], ":join": [":field", [":=", ":field.dataset-id", ":dataset.id"]], ":group-by": [":dataset.id"],
    }
    return relational_query(cohort(spark, sf), q)


@query(
    """select * from (values ('clin', 'loaded', '{"duplicate-keys": {"sampleID": ["n1"]}, "duplicate-probes": ["age"]}', 'sampleID,age,age (2)', 2),
      ('mat', 'loaded', '{"duplicate-keys": {"sampleID": ["s1"]}, "duplicate-probes": ["p (2)"]}', 'p,p (2),sampleID', 2)) t(name, status, warnings, fields, n_rows)"""
)
def load_warnings(spark, sf):
    """Repeated headers are numbered, of repeated samples the first counts, and both are told."""
    desk = Desk(spark).text("clin", "id\tage\tage\nn1\t1\t2\nn2\t3\t4\nn1\t5\t6\n", type="clinicalMatrix").text("mat", "x\ts1\ts2\ts1\np\t1\t2\t9\np\t3\t4\t9\n")
    out = []
    for name in ("clin", "mat"):
        ds = desk.load(name).dataset(name)
        warn = dict(sorted(ds.meta["metadata"]["loader"].items()))
        out.append((name, ds.meta["status"], json.dumps(warn), ",".join(sorted(ds.fields) if ds.is_matrix else ds.fields), ds.meta["rows"]))
    return spark.createDataFrame(out, "name string, status string, warnings string, fields string, n_rows int")


@query(
    "select * from (values ('a_matrix', 'loaded', 'after watch'), ('probes', 'loaded', 'after watch'), ('broken', 'error', 'after watch'), "
    "('broken', 'error', 'after deletion')) t(name, status, moment)"
)
def watch_folder(spark, sf):
    """A watched folder: its files are loaded one after the other, features only with what names them; a deleted probe map takes along what refers to it."""
    from strandmill.streaming.queue import LoadQueue, watch

    desk = Desk(spark).text("probes", "#id\tgenes\tchrom\tstart\tend\tstrand\na\tG\t1\t1\t2\t+\n", type="probeMap")
    desk.text("a_matrix", "p\ts1\na\t1\n", type="genomicMatrix", ref_probeMap="probes").text("broken", "id\tx\tstart\nq\t1\t2\n", type="mutationVector").text("notes", "no table\n")
    loads = LoadQueue(desk.loader)
    watch(loads, desk.root, own_dir(spark, "watched"), once=True).awaitTermination()
    loads.join()
    cards = lambda: [(r["name"], r["status"]) for r in desk.catalog.system("dataset").collect()]
    out = [(*x, "after watch") for x in cards()]
    loads.put("probes", delete=True)
    loads.join()
    loads.close()
    desk.loader.drop_dangling()
    return spark.createDataFrame(out + [(*x, "after deletion") for x in cards()], "name string, status string, moment string")


@query(
    """select * from (values ('(map :n_name (query {:select [:n_name] :from [:nation] :where [:= :n_nationkey 7]}))', 'json', '["NATION_7"]'),
      ('(count (query {:select [:*] :from [:nation] :where [:< :n_regionkey 2]}))', 'json', (select count(*)::varchar from nation where n_regionkey < 2)),
      ('(column-query {:select ["v"] :from ["nations"] :where [:in "name" ["NATION_3" "NATION_9"]]})', 'json', (select '{"v":[' || string_agg(n_regionkey::varchar, ',' order by n_nationkey) || ']}' from nation where n_name in ('NATION_3', 'NATION_9'))),
      ('(map (fn [r] (+ 1 (get r :n_nationkey))) (query {:select [:n_nationkey] :from [:nation] :where [:in :n_nationkey [4 5]] :order-by [:n_nationkey]}))', 'edn', '[5.0 6.0]'),
      ('{:a [1 nil true] "b" #{:c}}', 'edn', '{:a [1.0 nil true], "b" #{:c}}'), ('(:z {:z "x"})', 'edn', '"x"')) t(expression, format, answer)"""
)
def expression_queries(spark, sf):
    """Expressions that ask for data, and answers in both formats."""
    df = table(spark, sf, "nation")
    c = Catalog(spark)
    c.use_tables(nation=df)
    c.register("nations", df.select(F.col("n_nationkey").alias(ROW), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("v")))
    asked = [
        ("(map :n_name (query {:select [:n_name] :from [:nation] :where [:= :n_nationkey 7]}))", "json"),
        ("(count (query {:select [:*] :from [:nation] :where [:< :n_regionkey 2]}))", "json"),
        ('(column-query {:select ["v"] :from ["nations"] :where [:in "name" ["NATION_3" "NATION_9"]]})', "json"),
        ("(map (fn [r] (+ 1 (get r :n_nationkey))) (query {:select [:n_nationkey] :from [:nation] :where [:in :n_nationkey [4 5]] :order-by [:n_nationkey]}))", "edn"),
        ('{:a [1 nil true] "b" #{:c}}', "edn"), ('(:z {:z "x"})', "edn"),
    ]
    return spark.createDataFrame([(e, f, client.post(c, e, f"application/{f}")) for e, f in asked], "expression string, format string, answer string")
