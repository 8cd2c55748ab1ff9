import json
import math

import pytest

from strandmill import client
from strandmill.catalog import Catalog
from strandmill.plans.column_query import column_query, columnar
from strandmill.plans.fetch import fetch
from strandmill.sources import metadata as md
from strandmill.sources import readers
from strandmill.sources.files import Files
from strandmill.sources.loader import Loader
from strandmill.streaming.queue import LoadQueue, watch

MATRIX = "probe\ts1\ts2\ts1\ts3\np1\t1.5\t2\t9\tNA\np2\tred\t\"blue\"\tx\tred\np1\t7\t\t9\nq" + "x" * 300 + "\t1\t1\t1\t1\n"
PROBES = "#id\tgenes\tchrom\tstart\tend\tstrand\nb\tG2, G1\tchr2\t5\t9\t-\n\n# note\na\tG1\t1\t1e1\t012e1\t+\nd\t\tchr10\t3\t4\t\nc\tg1\tx\t1\t2\t.\n"
MUTATION = "thing\tchr\tstart\tend\tgene\treference\talternate\teffect\tDNA_VAF\tnote\ns2\t2\t4\t4\tG1\tA\tT\tmissense\tNA\tw\ns1\tchr1\t7\t7\tG1,G2\tC\tG\tnonsense\t0.25\t\ns1\t1\t3\t3\t\tC\tG\tmissense\t0.5\tw\n"
CLINICAL = "id\tage\tstate\tage\ns1\t10\tsick\t1\ns2\tNA\twell\t2\ns1\t99\tsick\t3\ns3\t\t\t4\n"
FEATURES = "age\tlongTitle\tAge in years\nstate\tvalueType\tcategory\nstate\tstateOrder\t\"well\",\"sick\"\n"
GENEPRED = "#bin\tname\tchrom\tstrand\ttxStart\ttxEnd\tcdsStart\tcdsEnd\texonCount\texonStarts\texonEnds\tscore\tname2\n5\tN1\tchr1\t+\t10\t90\t20\t80\t2\t10,50,\t30,90,\t0\tGX\n"


@pytest.fixture
def lab(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)

    def put(name, text, **meta):
        (root / name).write_text(text)
        if meta:
            (root / f"{name}.json").write_text(json.dumps({k.replace("ref_", ":"): v for k, v in meta.items()}))

    put("matrix", MATRIX)
    put("sub/probes", PROBES, type="probeMap")
    put("mut", MUTATION, type="mutationVector", cohort="C", ref_probeMap="/sub/probes")
    put("clin", CLINICAL, type="clinicalMatrix", cohort="C", ref_clinicalFeature="feat", SHORTTITLE="short")
    put("feat", FEATURES, type="clinicalFeature")
    put("expr", "p\ts1\ts2\na\t1\t3\nb\t3\t5\nc\tNA\t7\n", type="genomicMatrix", ref_probeMap="sub/probes", cohort="C")
    put("gp", GENEPRED, type="genePredExt", start_index=0)
    c = Catalog(spark)
    return c, Loader(c, str(root), str(tmp_path / "store")), root, put


def same(a, b):
    return len(a) == len(b) and all((x != x and y != y) or abs(x - y) < 1e-6 for x, y in zip(a, b))


def test_matrix(lab):
    c, loader, root, _ = lab
    ds = loader.load("matrix")
    assert ds.meta["status"] == "loaded" and ds.meta["rows"] == 3
    long = "q" + "x" * 249
    assert list(ds.fields) == ["sampleID", *[n for n in ds.fields if n != "sampleID"]] and set(ds.fields) == {"sampleID", "p1", "p1 (2)", "p2", long}
    assert ds.fields["p1"].type == "float" and ds.fields["p2"].type == "category"
    warn = ds.meta["metadata"]["loader"]
    assert warn == {"duplicate-keys": {"sampleID": ["s1"]}, "too-long-probes": [long], "duplicate-probes": ["p1 (2)"]}
    got = fetch(c, [{"table": "matrix", "columns": ["p1", "p2", "nope", "p1 (2)"], "samples": ["s2", "zz", "s1", "s3"]}])
    nan = math.nan
    assert same(got[0], [2, nan, 1.5, nan]) and same(got[1], [1, nan, 0, 0]) and same(got[2], [nan] * 4) and same(got[3], [nan, nan, 7, nan])
    q = {"select": ["sampleID", "p1", "p2"], "from": ["matrix"], "where": ["in", "p2", ["red"]]}
    assert columnar(column_query(c, q)) == {"sampleID": ["s1", "s3"], "p1": [1.5, None], "p2": ["red", "red"]}


def test_probe_map_is_sorted_and_typed(lab):
    c, loader, *_ = lab
    ds = loader.load("sub/probes")
    assert ds.name == "sub/probes" and list(ds.fields) == ["position", "name", "genes"]
    got = columnar(column_query(c, {"select": ["name", "position", "genes"], "from": ["sub/probes"]}))
    assert got["name"] == ["a", "d", "b", "c"]
    assert got["position"][0] == {"chrom": "chr1", "chromstart": 10, "chromend": 120, "strand": "+"} and got["position"][1]["strand"] == "."
    assert got["genes"] == [["G1"], None, ["G2", "G1"], ["g1"]]
    assert c.system("field_gene").count() == 4
    assert sorted((r["chrom"], r["bin"]) for r in c.system("field_position").collect()) == [("chr1", 4681), ("chr10", 4681), ("chr2", 4681), ("chrX", 4681)]


def test_mutations(lab):
    c, loader, root, put = lab
    ds = loader.load("mut")
    assert list(ds.fields) == ["position", "sampleID", "genes", "ref", "alt", "effect", "dna-vaf", "note"]
    got = columnar(column_query(c, {"select": ["sampleID", "effect", "dna-vaf", "note"], "from": ["mut"]}))
    assert got == {"sampleID": ["s1", "s1", "s2"], "effect": ["missense", "nonsense", "missense"], "dna-vaf": [0.5, 0.25, None], "note": ["w", "", "w"]}
    assert same(fetch(c, [{"table": "mut", "columns": ["effect"], "samples": ["s1", "s2"]}])[0], [0, 1, 0])
    put("bad", "x\tchr\tstart\tend\ts\n", type="mutationVector")
    assert loader.load("bad").meta["status"] == "error" and "Missing fields" in c.dataset("bad").meta["metadata"]["error"]


def test_clinical_with_features(lab):
    c, loader, *_ = lab
    ds = loader.load("clin")
    assert list(ds.fields) == ["sampleID", "age", "state", "age (2)"] and ds.meta["metadata"]["shortTitle"] == "short"
    got = columnar(column_query(c, {"select": ["sampleID", "age", "state"], "from": ["clin"]}))
    assert got == {"sampleID": ["s1", "s2", "s3"], "age": [10.0, None, None], "state": ["sick", "well", None]}
    assert same(fetch(c, [{"table": "clin", "columns": ["state"], "samples": ["s1", "s2", "s3"]}])[0], [1, 0, math.nan])
    assert client.codes_in_order(c, "clin", "state") == "well\tsick"
    titles = {r["longtitle"] for r in c.system("feature").collect()}
    assert "Age in years" in titles


def test_undeclared_state_is_an_error(lab):
    c, loader, root, put = lab
    put("feat", FEATURES.replace('"well","sick"', '"well"'), type="clinicalFeature")
    ds = loader.load("clin")
    assert ds.meta["status"] == "error" and "Invalid state sick" in ds.meta["metadata"]["error"]
    put("matf", "p\ts1\na\tx\n", type="genomicMatrix", ref_clinicalFeature="feat2")
    put("feat2", "a\tvalueType\tfloat\n")
    assert loader.load("matf").meta["status"] == "error"


def test_gene_prediction_has_two_positions(lab):
    c, loader, *_ = lab
    ds = loader.load("gp")
    assert list(ds.fields)[:2] == ["position", "position (2)"] and ds.fields["name2"].type == "genes"
    got = columnar(column_query(c, {"select": ["position", "position (2)", "exonStarts", "exonEnds", "bin"], "from": ["gp"]}))
    assert (got["position"][0]["chromstart"], got["position"][0]["chromend"], got["position (2)"][0]["chromstart"]) == (11, 90, 21)
    assert got["exonStarts"] == ["11,51"] and got["exonEnds"] == ["30,90,"] and got["bin"] == [5.0]


def test_reload_delete_and_reopen(lab, spark, tmp_path):
    c, loader, root, put = lab
    first = loader.load("expr")
    ids = [f.id for f in first.fields.values()]
    assert loader.load("expr") is first
    again = loader.load("expr", always=True)
    assert again is not first and again.meta["id"] == first.meta["id"] and [f.id for f in again.fields.values()] != ids
    put("expr", "p\ts1\ts2\na\t2\t4\n", type="genomicMatrix")
    assert list(loader.load("expr").fields) == ["sampleID", "a"]
    other = Catalog(spark)
    Loader(other, str(root), str(tmp_path / "store")).reopen()
    assert same(fetch(other, [{"table": "expr", "columns": ["a"], "samples": ["s2", "s1"]}])[0], [4, 2])
    assert loader.delete("expr") and not loader.delete("expr") and "expr" not in c.datasets
    assert loader.load("feat") is None and c.system("dataset").count() == 0


def test_client(lab):
    c, loader, *_ = lab
    for f in ("sub/probes", "expr", "clin", "mut"):
        loader.load(f)
    assert client.all_cohorts(c) == ["C"] and sorted(client.datasets_list_in_cohort(c, "C")) == ["clin", "expr", "mut"]
    assert sorted(client.all_samples(c, "C")) == ["s1", "s2", "s3"] and client.dataset_samples(c, "expr") == ["s1", "s2"]
    assert client.dataset_type(c, "mut") == ["mutationVector"] and client.dataset_field(c, "clin") == ["sampleID", "age", "state", "age (2)"]
    assert client.dataset_probe_values(c, "expr", ["s2", "s1"], ["b", "a"]) == [[5, 3], [3, 1]]
    names, values = client.dataset_gene_probes_values(c, "expr", ["s1", "s2"], "g1")
    assert names == ["a", "b", "c"] and same(values[0], [1, 3]) and same(values[2], [math.nan, 7])
    got = client.dataset_gene_values(c, "expr", ["s1", "s2"], ["G1", "none", "G2"])
    assert got == [{"gene": "G1", "scores": [[2.0, 5.0]]}, {"gene": "none", "scores": [[]]}, {"gene": "G2", "scores": [[3.0, 5.0]]}]
    assert client.find_samples_by_field(c, "C", "state", ["sick"]) == {"C": ["s1"]}
    assert client.expression_json(c, '(fetch [{:table "expr" :columns ["a"] :samples ["s1" "zz"]}])') == [[1, "NaN"]]
    assert loader.drop_dangling() == []
    loader.delete("sub/probes")
    assert sorted(loader.drop_dangling()) == ["expr", "mut"]


def test_queue_and_watch(lab, tmp_path):
    c, loader, root, put = lab
    seen = []
    q = LoadQueue(loader, seen.append)
    q.put("expr")
    q.put("nothing")
    q.put("expr", delete=True)
    q.join()
    assert q.waiting == [] and max(map(len, seen)) >= 1 and "expr" not in c.datasets
    stream = watch(q, str(root), str(tmp_path / "cp"), once=True)
    stream.awaitTermination()
    q.join()
    assert set(c.datasets) == {"matrix", "sub/probes", "mut", "clin", "expr", "gp"}
    q.close()


def test_detection_and_references(lab, spark):
    c, loader, root, put = lab
    files = Files(spark)
    kinds = {n: md.detect(files, str(root / n)) for n in ("matrix", "mut", "clin", "feat", "sub/probes")}
    assert kinds == {"matrix": "tsv", "mut": "mutation", "clin": "clinical", "feat": "feature", "sub/probes": "probemap"}
    put("plain", "no tabs\nhere\n")
    put("odd", "a\tb\nc\td\n", type="somethingElse")
    put("bare", "a\tb\n", cohort="x")
    assert [md.detect(files, str(root / n)) for n in ("plain", "odd", "bare")] == [None, "tsv", "genomic"]
    assert md.references("/r", "a/b/file", {":x": "../c", ":y": "/top/z", ":n": None, "k": "v"}) == {":x": "a/c", ":y": "top/z", ":n": None}
    with pytest.raises(md.LoadError):
        md.references("/r", "file", {":x": "../../etc"})


def test_rewriting_of_abstract_names(spark, tmp_path):
    put = lambda n, **m: (tmp_path / f"{n}.json").write_text(json.dumps({k.replace("ref_", ":"): v for k, v in m.items()}))
    (tmp_path / "d").mkdir()
    put("pm", type="probeMap", name="map1", group="grp", ref_assembly="hg18")
    put("d/m1", type="genomicMatrix", name="one", ref_probeMap="grp")
    put("m2", type="genomicMatrix", name="two", ref_probeMap="map1", ref_other="map1")
    got = md.rewrite_references(Files(spark), str(tmp_path))
    assert got[str(tmp_path / "d/m1")][":probeMap"] == "/pm" and got[str(tmp_path / "m2")][":probeMap"] == "pm"
    assert json.loads((tmp_path / "d/m1.json").read_text())[":probeMap"] == "/pm" and got[str(tmp_path / "m2")][":other"] == "map1"


def test_headers_and_positions():
    assert readers.canonical_header(["Sample ID", "CHR", "Start", "ALT", "dna vaf", "Amino_Acid_Change", "zzz"], readers.MUTATION) == [
        "sampleID", "chrom", "chromStart", "alt", "dna-vaf", "amino-acid", "zzz",
    ]
    pos, rest = readers.collate_positions(["chrom", "chromStart", "x", "chromEnd", "chromStart", "chromEnd", "strand"])
    assert pos == [{"chromStart": 1, "chromEnd": 3, "chrom": 0, "strand": 6}, {"chromStart": 4, "chromEnd": 5, "chrom": 0, "strand": 6}] and rest == [2]
    assert readers.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a (2)", "a (3)"]
    assert md.parse_features("f\tstate\tb\nf\tstate\ta\ng\tx\ty\n") == {"f": {"state": ["b", "a"], "order": {"b": 0, "a": 1}}, "g": {"x": "y"}}


def test_matrix_round_trip(spark, tmp_path):
    import random

    rnd = random.Random(6)
    root = tmp_path / "r"
    root.mkdir()
    c = Catalog(spark)
    loader = Loader(c, str(root), str(tmp_path / "s"))
    for n in range(2):
        samples = [f"s{i}" for i in range(rnd.randrange(1, 7))]
        data = {f"p{i}": [math.nan if rnd.random() < 0.1 else rnd.randrange(-999, 999) for _ in samples] for i in range(rnd.randrange(1, 6))}
        cell = lambda v: "NA" if v != v else str(v)
        (root / f"g{n}").write_text("\n".join(["\t".join(["x", *samples]), *["\t".join([p, *map(cell, v)]) for p, v in data.items()]]) + "\n")
        (root / f"g{n}.json").write_text('{"type": "genomicMatrix"}')
        (root / f"c{n}").write_text("\n".join(["\t".join(["x", *data]), *["\t".join([s, *[cell(v[i]) for v in data.values()]]) for i, s in enumerate(samples)]]) + "\n")
        (root / f"c{n}.json").write_text('{"type": "clinicalMatrix"}')
        for kind in "gc":
            assert loader.load(f"{kind}{n}").meta["status"] == "loaded", c.dataset(f"{kind}{n}").meta
            order = rnd.sample(samples, len(samples))
            got = fetch(c, [{"table": f"{kind}{n}", "columns": list(data), "samples": order}])
            for g, v in zip(got, data.values()):
                assert same(g, [v[samples.index(s)] for s in order])


def test_loading_leaves_no_scratch_tables(spark, lab):
    from strandmill.session import scratch, shared_dir, written

    c, loader, *_ = lab
    files = Files(spark)
    before = set(files.names(shared_dir(spark)))
    loader.load("clin")
    assert set(files.names(shared_dir(spark))) == before
    with scratch(spark):
        df = written(spark.range(3), "x")
        assert df.count() == 3 and len(files.names(shared_dir(spark))) == len(before) + 1
    assert set(files.names(shared_dir(spark))) == before
