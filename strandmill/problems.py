"""The data-processing problems over the catalog tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.scalars import normalize_chrom
from strandmill.operators import cover, manifests, orphans, row_patterns, schema_drift
from strandmill.operators.versioned import VersionedTable
from strandmill.session import own_dir, table

#: fixed values: the fields of a dataset's metadata that are followed through its versions
SIDECAR_RULES = schema_drift.Rules(("type", "datasubtype", "probemap"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pos = table(spark, sf, "field_position").select(
        "field_id", normalize_chrom(F.col("chrom")).alias("chrom"), "chromstart", "chromend"
    )
    out = cover.cover(pos, ["field_id", "chrom"], "chromstart", "chromend")
    return out.select(
        "kind", "field_id", "chrom", F.col("range_start").cast("int").alias("range_start"), F.col("range_end").cast("int").alias("range_end")
    )


P1_FOUND = """
with iv as (
  select distinct field_id, case
      when regexp_matches(lower(trim(chrom)), '^(chr)?[0-9]+$') then 'chr' || regexp_replace(lower(trim(chrom)), '^chr', '')
      when regexp_matches(lower(trim(chrom)), '^(chr)?[xym]$') then 'chr' || upper(right(trim(chrom), 1))
      else trim(chrom) end as chrom, chromstart::bigint s, chromend::bigint e
  from field_position where chromend >= chromstart),
m as (select *, max(e) over (partition by field_id, chrom order by s, e rows between unbounded preceding and 1 preceding) pe from iv),
g as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by field_id, chrom order by s, e rows unbounded preceding) k from m),
p as (select field_id, chrom, k, min(s) a, max(e) b from g group by 1, 2, 3),
n as (select *, lead(a) over (partition by field_id, chrom order by k) na from p)
select 'period' as kind, field_id, chrom, a::int as range_start, b::int as range_end from n
union all
select 'gap', field_id, chrom, (b + 1)::int, (na - 1)::int from n where na is not null
"""


def p2_parsed(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "raw_lines")
    return row_patterns.distinct_records(row_patterns.parse_rows(lines))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "raw_lines")
    bad = row_patterns.parse_rows(lines).where(F.col("reason").isNotNull())
    return bad.select("source_id", "line_no", "reason").distinct()


def p2_valid(spark: SparkSession, sf: str) -> DataFrame:
    good = p2_parsed(spark, sf).where(F.col("reason").isNull())
    return good.select("source_id", "line_no", "name", "chrom", "chromstart", "chromend", "genes", "strand")


_P2 = """
with l as (select distinct source_id, line_no, line from raw_lines where line is not null and regexp_replace(line, '\\s', '', 'g') <> ''),
h as (select source_id, line_no, line from (select *, row_number() over (partition by source_id order by line_no, line) r from l) where r = 1),
r as (select l.source_id, l.line_no, l.line, h.line as head from l join h using (source_id) where l.line_no > h.line_no and l.line not like '#%'),
c as (select source_id, line_no, list_transform(string_split(line, chr(9)), lambda x: trim(x, ' ' || chr(13))) cells,
        list_transform(string_split(regexp_replace(head, '^\\s*#', ''), chr(9)), lambda x: lower(trim(x, ' ' || chr(13)))) hs from r),
q as (select *, list_transform(cells, lambda x: length(x) >= 2 and starts_with(x, '"') and ends_with(x, '"')
          and not contains(replace(x[2:-2], '""', ''), '"')) quoted from c),
u as (select *, len(cells) <> len(hs) as wrong_count,
        len(list_filter(list_zip(cells, quoted), lambda z: contains(z[1], '"') and not z[2])) > 0 as wrong_quote,
        list_transform(list_zip(cells, quoted), lambda z: case when z[2] then replace(z[1][2:-2], '""', '"') else z[1] end) vals from q),
v as (select *, vals[list_position(list_transform(hs, lambda x: x in ('name', 'id')), true)] as vname,
        vals[list_position(list_transform(hs, lambda x: x in ('start', 'chromstart')), true)] as vstart,
        vals[list_position(list_transform(hs, lambda x: x in ('end', 'chromend')), true)] as vend from u),
w as (select *, case when regexp_full_match(vstart, '([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(vstart as double) end as s,
        case when regexp_full_match(vend, '([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(vend as double) end as e from v),
x as (select *, case when wrong_count then 'column_count' when wrong_quote then 'quoting'
        when coalesce(vname, '') = '' or s is null or e is null or s <> floor(s) or e <> floor(e)
          or s > 2147483647 or e > 2147483647 or s > e then 'invalid_value' end as reason from w)
"""
P2_FOUND = _P2 + "select distinct source_id, line_no, reason from x where reason is not null"


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """The states listed for each run, with their file and content."""
    scan = table(spark, sf, "source_scan").select("run_id", "source_id")
    state = table(spark, sf, "source").select(F.col("id").alias("source_id"), "name", "hash").distinct()
    return scan.join(state, "source_id")


def p3_planned(spark: SparkSession, sf: str) -> tuple[VersionedTable, VersionedTable]:
    """Every listing as a version of one table, and the table of what each run has to do, both in the shared folder."""
    at = own_dir(spark, "runs")
    listed, work = VersionedTable(spark, f"{at}/listed"), VersionedTable(spark, f"{at}/work")
    manifests.publish(listed, listing(spark, sf), "run_id", "name", "hash", "source_id")
    manifests.plan_runs(listed, work, table(spark, sf, "load_run"))
    return listed, work


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    todo = manifests.to_process(p3_planned(spark, sf)[1].read())
    return todo.select(F.col("version").cast("int").alias("run_id"), F.col("rec").cast("int").alias("source_id"))


P3_FOUND = """
with st as (select distinct c.run_id, s.name, lower(s.hash) h, s.id from source_scan c join source s on s.id = c.source_id),
e as (select run_id, name, h, min(id) id from st where run_id in (select run_id from load_run) and name is not null group by 1, 2, 3),
ok as (select distinct run_id from load_run where status = 'ok'),
b as (select e.run_id, e.name, max(p.run_id) base from (select distinct run_id, name from e) e
      join (select distinct e2.run_id, e2.name from e e2 join ok using (run_id)) p on p.name = e.name and p.run_id < e.run_id group by 1, 2)
select e.run_id, e.id as source_id from e left join b using (run_id, name)
left join e o on o.run_id = b.base and o.name = e.name and o.h is not distinct from e.h
where b.base is null or o.id is null
"""


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Per run: how many files are added, changed, removed, unchanged, and how many records its deletion vector masks."""
    listed, work = p3_planned(spark, sf)
    records = listed.read()
    count = lambda df, what: df.groupBy(F.col("version").alias("run_id"), what.alias("change")).agg(F.count("*").alias("n"))
    done = count(work.read(), F.col("change"))
    masked = count(manifests.deletion_vectors(records), F.lit("masked"))
    runs = table(spark, sf, "load_run").select(F.col("run_id").cast("long").alias("version")).distinct()
    files = count(records.where("not dead").join(runs, "version", "left_semi"), F.lit("unchanged"))
    new = done.where("change <> 'removed'").select("run_id", F.lit("unchanged").alias("change"), (-F.col("n")).alias("n"))
    same = files.unionByName(new).groupBy("run_id", "change").agg(F.sum("n").alias("n")).where("n > 0")
    return done.unionByName(masked).unionByName(same).withColumn("run_id", F.col("run_id").cast("int"))


def catalog_references(spark: SparkSession, sf: str) -> list[orphans.Reference]:
    """The foreign keys of the catalog: probeMap by name, the source link and the fields by dataset id."""
    src = table(spark, sf, "source").groupBy(F.col("id").alias("source_id")).agg(F.min("time").alias("time"))
    link = table(spark, sf, "dataset_source").select("dataset_id", "source_id").distinct()
    timed = link.join(src, "source_id", "left")
    when = timed.where("dataset_id is not null").groupBy("dataset_id").agg(F.min("time").alias("time"))
    rows = table(spark, sf, "dataset").select("id", "name", "probemap", "status").distinct()
    ds = rows.join(when, rows["id"] == when["dataset_id"], "left")
    stripped = F.regexp_replace("probemap", r"^\s+|\s+$", "")
    ref = F.when(stripped != "", F.regexp_replace(stripped, r"^(\./|/)+", ""))
    live = F.coalesce(F.col("status") != "deleting", F.lit(True))
    child = ds.select(F.col("id").alias("row_id"), ref.alias("ref"), F.col("probemap").alias("ref_shown"), F.col("name").alias("key"), "time")
    by_name = ds.select(F.col("name").alias("key"), live.alias("live"), "time")
    by_id = rows.select(F.col("id").alias("key"), F.lit(True).alias("live"), F.lit(None).cast("timestamp").alias("time"))
    links = timed.select(
        F.col("source_id").alias("row_id"), F.col("dataset_id").alias("ref"), F.lit(None).cast("string").alias("key"), "time"
    )
    return [
        orphans.Reference("dataset", child, "dataset", by_name, timed=True),
        orphans.Reference("dataset_source", links, "dataset", by_id, by="row_id"),
    ]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The direct orphans of the cascade over the catalog's own references."""
    found = orphans.cascade(catalog_references(spark, sf)).where("depth = 0")
    return found.select("table_name", F.col("row_id").cast("int").alias("row_id"), "ref", "period", "kind").distinct()


P4_FOUND = """
with t as (select l.dataset_id, min(s.time) as tm from dataset_source l join source s on s.id = l.source_id group by 1),
d as (select distinct id, name, probemap, status, tm from dataset left join t on t.dataset_id = id),
tg as (select name, bool_or(status is null or status <> 'deleting') lv, min(case when status is null or status <> 'deleting' then tm end) lt from d group by 1),
r as (select *, regexp_replace(regexp_replace(probemap, '^\\s+|\\s+$', '', 'g'), '^(\\./|/)+', '') nm from d
      where regexp_replace(probemap, '\\s', '', 'g') <> '')
select distinct 'dataset' as table_name, r.id as row_id, r.probemap as ref, strftime(r.tm at time zone 'UTC', '%Y-%m') as period,
  case when tg.name is null then 'missing' when not tg.lv then 'deleted' when tg.lt > r.tm then 'late' end as kind
from r left join tg on tg.name = r.nm where tg.name is null or not tg.lv or tg.lt > r.tm
union all
select distinct 'dataset_source', l.source_id, l.dataset_id::varchar, strftime(s.time at time zone 'UTC', '%Y-%m'), 'missing'
from dataset_source l left join source s on s.id = l.source_id
where l.dataset_id is not null and l.dataset_id not in (select id from dataset where id is not null)
"""


def field_references(spark: SparkSession, sf: str) -> list[orphans.Reference]:
    """Further down the graph: fields to datasets, and the fields that positions belong to.

    The fields of a dataset that is being deleted go with it, so they count as
    references to a deleted one, like names do. Only the source link, which
    TESTDATA.md defines, asks for any dataset with the id. Neither table has times.
    """
    none = F.lit(None).cast("timestamp").alias("time")
    no_key = F.lit(None).cast("string").alias("key")
    fields = table(spark, sf, "field").select(F.col("id").alias("row_id"), F.col("dataset_id").alias("ref"), no_key, none)
    live = F.coalesce(F.col("status") != "deleting", F.lit(True)).alias("live")
    datasets = table(spark, sf, "dataset").select(F.col("id").alias("key"), live, none)
    of_positions = table(spark, sf, "field_position").select("field_id").distinct()
    positions = of_positions.select(F.col("field_id").alias("row_id"), F.col("field_id").alias("ref"), no_key, none)
    known = fields.select(F.col("row_id").alias("key"), F.lit(True).alias("live"), none)
    return [
        orphans.Reference("field", fields, "dataset", datasets, by="row_id"),
        orphans.Reference("field_position", positions, "field", known, by="row_id"),
    ]


def all_orphans(spark: SparkSession, sf: str) -> DataFrame:
    found = orphans.cascade(catalog_references(spark, sf) + field_references(spark, sf))
    return found.select("table_name", "row_id", "ref", "period", "kind", "depth").distinct()


def p4_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphans with their depth, down to the fields that positions belong to."""
    return all_orphans(spark, sf)


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many direct and inherited orphans each table has in each month."""
    inherited = F.col("kind") == "inherited"
    count = lambda c: F.count(F.when(c, 1))
    return all_orphans(spark, sf).groupBy("table_name", "period").agg(count(~inherited).alias("direct"), count(inherited).alias("inherited"), F.max("depth").alias("deepest"))


_P4_CASCADE = """
with recursive t as (select l.dataset_id, min(s.time) as tm from dataset_source l join source s on s.id = l.source_id group by 1),
d as (select distinct id, name, probemap, status, tm from dataset left join t on t.dataset_id = id),
e as (
  select 'name' fk, 'dataset' table_name, id row_id, regexp_replace(regexp_replace(probemap, '^\\s+|\\s+$', '', 'g'), '^(\\./|/)+', '') ref, probemap shown, name as key, tm from d
    where regexp_replace(probemap, '\\s', '', 'g') <> ''
  union select 'link', 'dataset_source', l.source_id, l.dataset_id::varchar, l.dataset_id::varchar, null, s.tm
    from dataset_source l left join (select id, min(time) tm from source group by 1) s on s.id = l.source_id where l.dataset_id is not null
  union select 'field', 'field', id, dataset_id::varchar, dataset_id::varchar, null, null from field where dataset_id is not null
  union select 'position', 'field_position', field_id, field_id::varchar, field_id::varchar, null, null from field_position where field_id is not null),
tg as (
  select 'name' fk, name as key, bool_or(status is null or status <> 'deleting') lv, min(case when status is null or status <> 'deleting' then tm end) lt from d where name is not null group by 2
  union all select 'link', id::varchar, true, null from d where id is not null group by 2
  union all select 'field', id::varchar, bool_or(status is null or status <> 'deleting'), null from d where id is not null group by 2
  union all select 'position', id::varchar, true, null from field where id is not null group by 2),
j as (select e.*, case when tg.key is null then 'missing' when not tg.lv then 'deleted' when tg.lt > e.tm then 'late' end kind from e left join tg on tg.fk = e.fk and tg.key = e.ref),
k as (select * from (values ('name', 'dataset', true), ('link', 'dataset', false), ('field', 'dataset', false), ('position', 'field', false)) v(fk, parent, by_key)),
c as (select fk, table_name, row_id, ref, shown, key, tm, 0 as depth from j where kind in ('missing', 'deleted')
  union select e.*, c.depth + 1 from c join k on k.parent = c.table_name join e on e.fk = k.fk and e.ref = case when k.by_key then c.key else c.row_id::varchar end where c.depth < 40),
h as (select fk, table_name, row_id, ref, shown, key, tm, min(depth) depth from c group by all),
o as (select table_name, row_id, shown, tm, kind, 0 as depth from j where kind is not null
  union all select table_name, row_id, shown, tm, 'inherited', depth from h where depth > 0),
r as (select distinct table_name, row_id::bigint as row_id, shown as ref, strftime(tm at time zone 'UTC', '%Y-%m') as period, kind, depth::int as depth from o)
"""
P4_CASCADE = _P4_CASCADE + "select * from r"
P4_REPORT = (
    _P4_CASCADE
    + "select table_name, period, count(*) filter (kind <> 'inherited') as direct, count(*) filter (kind = 'inherited') as inherited, max(depth) as deepest from r group by 1, 2"
)


def p5_conformed(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "sidecar")
    return schema_drift.conform(df, SIDECAR_RULES, newest=("received", "sidecar_id"))


def p5_table(spark: SparkSession, sf: str) -> DataFrame:
    return p5_conformed(spark, sf).select("name", F.col("version").cast("int").alias("version"), "fingerprint", "type", "datasubtype", "probemap")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    c = schema_drift.changes(p5_conformed(spark, sf))
    return c.select("name", F.col("version").cast("int").alias("version"), "field", "change").distinct()


_CHROM = """case when regexp_matches(lower(trim({0})), '^(chr)?[0-9]+$') then 'chr' || regexp_replace(lower(trim({0})), '^chr', '')
  when regexp_matches(lower(trim({0})), '^(chr)?[xym]$') then 'chr' || upper(right(trim({0}), 1)) else trim({0}) end"""
_CELL = "vals[list_position(list_transform(hs, lambda x: x in ({0})), true)]"
P2_VALID = (
    _P2
    + f"""select distinct source_id, line_no, vname as name, {_CHROM.format(_CELL.format("'chrom', 'chr'"))} as chrom, s::int as chromstart, e::int as chromend,
  case when len(g) > 0 then g end as genes, {_CELL.format("'strand'")} as strand
from (select *, list_filter(list_transform(string_split({_CELL.format("'gene', 'genes'")}, ','), lambda x: trim(x)), lambda x: x <> '') as g from x where reason is null)"""
)

P3_RUNS = """
with st as (select distinct c.run_id, s.name, lower(s.hash) h, s.id from source_scan c join source s on s.id = c.source_id where s.name is not null),
all_e as (select run_id, name, h, min(id) id from st group by 1, 2, 3),
e as (select * from all_e where run_id in (select run_id from load_run)),
ok as (select distinct run_id from load_run where status = 'ok'),
p as (select distinct run_id, name from e),
b as (select p.run_id, p.name, (select max(q.run_id) from p q join ok using (run_id) where q.name = p.name and q.run_id < p.run_id) as base from p),
now as (select e.run_id, case when b.base is null then 'added' when o.id is null then 'changed' else 'unchanged' end as change
  from e join b using (run_id, name) left join e o on o.run_id = b.base and o.name = e.name and o.h is not distinct from e.h),
gone as (select b.run_id, 'removed' as change from b join e o on o.run_id = b.base and o.name = b.name
  where not exists (select 1 from e where e.run_id = b.run_id and e.name = b.name and e.h is not distinct from o.h)),
masked as (select st.run_id, 'masked' as change from st join all_e a on a.run_id = st.run_id and a.name = st.name and a.h is not distinct from st.h where st.id <> a.id)
select run_id, change, count(*) as n from (select * from now union all select * from gone union all select * from masked) group by 1, 2
"""

_P5 = """
with recursive s as (select name, version, arg_max(content, (received, sidecar_id, content)) as content from sidecar where name is not null and version is not null group by 1, 2),
v as (select *, row_number() over (partition by name order by version) as n from s),
k as (select name, version, n, content, unnest(json_keys(content)) as key from v where json_valid(content) and json_type(content) = 'OBJECT'),
e as (select name, n, key, val, case when t in ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') then 'number' when t = 'VARCHAR' then 'string' else lower(t) end as t from
  (select name, n, key, json_extract(content, '$."' || key || '"') as val, json_type(json_extract(content, '$."' || key || '"')) as t from k) where t <> 'NULL'),
f as (select unnest(['type', 'datasubtype', 'probemap']) as field),
own as (select name, n, field, min(key) as own from e join f on regexp_replace(lower(key), '[:_. -]', '', 'g') = field group by 1, 2, 3),
-- the only key of a version that is new and has the value of a key that is gone
heir as (select a.name, a.n, a.key as old, min(b.key) as heir from e a join e b on b.name = a.name and b.n = a.n + 1 and b.t = a.t and b.val::varchar = a.val::varchar
  where not exists (select 1 from e p where p.name = a.name and p.n = a.n and p.key = b.key)
    and not exists (select 1 from e q where q.name = a.name and q.n = a.n + 1 and q.key = a.key) group by 1, 2, 3 having count(*) = 1),
-- what each key of a version turns into, for each field ('' stands for no key)
keys as (select name, n, key from e union all select name, n, '' from v),
step as (select keys.name, keys.n, f.field, keys.key as old, case when same.key is not null then same.key when own.own is not null then own.own else heir.heir end as new
  from keys cross join f join v on v.name = keys.name and v.n = keys.n + 1
  left join e same on same.name = keys.name and same.n = keys.n + 1 and same.key = keys.key
  left join own on own.name = keys.name and own.n = keys.n + 1 and own.field = f.field
  left join heir on heir.name = keys.name and heir.n = keys.n and heir.old = keys.key),
r as (select v.name, v.n, f.field, null::varchar as prev, own.own as held from v cross join f left join own on own.name = v.name and own.n = 1 and own.field = f.field where v.n = 1
  union all
  select r.name, r.n + 1, r.field, r.held, step.new from r join step on step.name = r.name and step.n = r.n and step.field = r.field and step.old = coalesce(r.held, '')),
h as (select r.name, v.version, r.n, r.field, r.prev, r.held, a.t as t0, b.t as t1, b.val as val from r join v on v.name = r.name and v.n = r.n
  left join e a on a.name = r.name and a.n = r.n - 1 and a.key = r.prev left join e b on b.name = r.name and b.n = r.n and b.key = r.held)
"""
P5_FOUND = (
    _P5
    + """select name, version, field, change from h, (select unnest(['added', 'removed', 'renamed', 'retyped']) as change) c where n > 1 and case change
  when 'added' then prev is null and held is not null when 'removed' then prev is not null and held is null
  when 'renamed' then prev is not null and held is not null and prev <> held else prev is not null and held is not null and t0 <> t1 end"""
)

def p5_migrations(spark: SparkSession, sf: str) -> DataFrame:
    """The steps from schema to schema, and how many versions took each."""
    return schema_drift.migrations(p5_conformed(spark, sf))


# strings as they are, all else as JSON text; the fingerprint is of the sorted keys and types
_P5_VALUES = """,
fp as (select name, n, md5(string_agg(key || chr(31) || t, chr(30) order by key)) as fingerprint from e group by 1, 2),
tv as (select r.name, r.n, r.field, r.prev, r.held, a.t as t0, b.t as t1, case when b.t = 'string' then b.val ->> '$' else b.val::varchar end as val
  from r left join e a on a.name = r.name and a.n = r.n - 1 and a.key = r.prev left join e b on b.name = r.name and b.n = r.n and b.key = r.held)
"""
P5_TABLE = (
    _P5.rstrip()
    + _P5_VALUES
    + """select v.name, v.version::int as version, coalesce(fp.fingerprint, md5('')) as fingerprint, max(val) filter (field = 'type') as type,
  max(val) filter (field = 'datasubtype') as datasubtype, max(val) filter (field = 'probemap') as probemap
from v left join fp on fp.name = v.name and fp.n = v.n left join tv on tv.name = v.name and tv.n = v.n group by 1, 2, 3"""
)
P5_MIGRATIONS = (
    _P5.rstrip()
    + _P5_VALUES
    + """select coalesce(p.fingerprint, md5('')) as from_fingerprint, coalesce(q.fingerprint, md5('')) as to_fingerprint, field, change,
  prev as from_key, held as to_key, t0 as from_type, t1 as to_type, count(*) as n
from tv left join fp p on p.name = tv.name and p.n = tv.n - 1 left join fp q on q.name = tv.name and q.n = tv.n,
  (select unnest(['added', 'removed', 'renamed', 'retyped']) as change) c
where tv.n > 1 and case change when 'added' then prev is null and held is not null when 'removed' then prev is not null and held is null
  when 'renamed' then prev is not null and held is not null and prev <> held else prev is not null and held is not null and t0 <> t1 end
group by 1, 2, 3, 4, 5, 6, 7, 8"""
)

QUERIES = {
    f.__name__: f for f in (p1_found, p2_found, p2_valid, p3_found, p3_runs, p4_found, p4_cascade, p4_report, p5_found, p5_table, p5_migrations)
}

SQL = {
    "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_valid": P2_VALID, "p3_found": P3_FOUND, "p3_runs": P3_RUNS, "p4_found": P4_FOUND, "p4_cascade": P4_CASCADE, "p4_report": P4_REPORT, "p5_found": P5_FOUND, "p5_table": P5_TABLE, "p5_migrations": P5_MIGRATIONS,
}
