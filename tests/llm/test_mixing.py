import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandmill.llm import mixing as M

TOK = Path(M.TOKENIZER).exists()


def target(source, share, repeats=1, plan=1, ratio=1.0):
    return {"plan_id": plan, "source": source, "target_share": share, "max_repeats": repeats, "size_ratio": ratio}


def sums(leaves):
    out = {}
    for x in leaves:
        out[x["source"]] = out.get(x["source"], 0) + x["budget"]
    return {k: round(v, 6) for k, v in out.items()}


def test_shares_are_met_where_there_is_enough():
    sizes = {("a_x", "en"): 600, ("a_x", "de"): 400, ("b_y", "en"): 1000}
    leaves = M.budgets([target("a_x", 0.3), target("b_y", 0.7)], sizes, M.domain_of, 1000)
    assert sums(leaves) == {"a_x": 300, "b_y": 700}
    assert {(x["source"], x["lang"]): round(x["budget"], 6) for x in leaves}["a_x", "de"] == 120


def test_a_shortage_goes_to_siblings_before_ancestors():
    sizes = {("a_1", "en"): 50, ("a_2", "en"): 1000, ("b_1", "en"): 1000, ("a_3", "de"): 1000}
    got = sums(M.budgets([target("a_1", 0.25), target("a_2", 0.25), target("a_3", 0.25), target("b_1", 0.25)], sizes, M.domain_of, 1000))
    assert got == {"a_1": 50, "a_2": 450, "a_3": 250, "b_1": 250}  # same domain and language
    sizes["a_2", "en"] = 60
    got = sums(M.budgets([target("a_1", 0.25), target("a_2", 0.25), target("a_3", 0.25), target("b_1", 0.25)], sizes, M.domain_of, 1000))
    assert got == {"a_1": 50, "a_2": 60, "a_3": 640, "b_1": 250}  # then the domain's other language


def test_repeats_cap_and_missing_source():
    leaves = M.budgets([target("a", 0.9, 3), target("none", 0.1)], {("a", "en"): 100}, M.domain_of, 1000)
    assert [(x["budget"], x["epochs"], x["rest"]) for x in leaves] == [(300, 3, 0)]
    assert M.budgets([target("none", 1.0)], {}, M.domain_of, 0) == []


def frame(spark, sizes, source="s"):
    return spark.createDataFrame([(i, source, "en", n) for i, n in enumerate(sizes)], "doc_id long, source string, lang string, n_tokens long")


def leaf(spark, epochs, rest, source="s"):
    return spark.createDataFrame([(1, source, "en", 0.0, epochs, float(rest))], "plan_id int, source string, lang string, budget double, epochs int, rest double")


@pytest.mark.parametrize("blocks", [2, 16, 4096])
def test_prefix_is_the_prefix_of_the_seeded_order(spark, blocks):
    rnd = random.Random(blocks)
    sizes = [rnd.randrange(0, 50) for _ in range(400)]
    df = frame(spark, sizes)
    for rest in (0.0, 1.0, 777.0, sum(sizes) - 3.0):
        got = {r["doc_id"]: r["repeats"] for r in M.pick(df, leaf(spark, 1, rest), 5, blocks).collect()}
        h = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(1), F.lit(1), F.lit(5)).alias("h")).collect()}
        mask = blocks - 1
        shift = 64 - (blocks.bit_length() - 1)
        order = sorted((i for i in range(400) if sizes[i]), key=lambda i: ((h[i] >> shift) & mask, h[i], i))
        want, run = {}, 0
        for i in order:
            run += sizes[i]
            want[i] = 2 if run - sizes[i] / 2 <= rest else 1
        assert got == {i: (want[i] if rest > 0 else 1) for i in order}


def test_budget_is_met_within_half_a_document(spark):
    sizes = [7] * 1000
    got = M.pick(frame(spark, sizes), leaf(spark, 0, 3001.0)).agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0]
    assert abs(got - 3001) <= 3.5


def test_nulls_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "en", 5, 1), (2, "s", None, 5, 1), (3, "s", "en", None, 1), (4, "s", "en", 0, 1), (5, "s", "en", 5, 1)], "doc_id long, source string, lang string, n_tokens long, extra int")
    assert [(r["doc_id"], r["repeats"]) for r in M.pick(df, leaf(spark, 2, 0)).collect()] == [(5, 2)]
    assert M.pick(df.where("false"), leaf(spark, 1, 1)).count() == 0
    names = spark.createDataFrame([(" Gazette Full",), (None,)], "s string").select(M.spelling(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in names] == ["gazettefull", None]


@pytest.mark.skipif(not TOK, reason="no tokenizer files")
def test_token_counts(spark):
    texts = ["Hello world, it's 5 o'clock.", "", None, "  Ünïcode 漢字\n\n x ", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["n_tokens"] for r in M.count_tokens(df).orderBy("doc_id").collect()]
    enc = M._encoder(M.TOKENIZER, M.SPLIT)
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts] and got[0] > 5


@pytest.mark.skipif(not TOK, reason="no tokenizer files")
def test_long_texts_are_counted_whole(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["word ", "Wort, ", "12 ", "\n\n", "x", "  ", "它 "]) for _ in range(20_000))
    enc = M._encoder(M.TOKENIZER, M.SPLIT)
    for size in (100, 1000, 10**6):
        parts = list(M.pieces(text, size))
        assert "".join(parts) == text and sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
    assert list(M.pieces("", 5)) == []


def test_an_empty_source_leaves_its_share_to_its_siblings():
    plan = [target("a_x", 0.5), target("a_y", 0.25), target("b_z", 0.25)]
    sizes = {("a_y", "en"): 5000, ("b_z", "en"): 5000}
    assert sums(M.budgets(plan, sizes, M.domain_of, 2000)) == {"a_y": 1500, "b_z": 500}
    near = sums(M.budgets(plan, sizes | {("a_x", "en"): 1}, M.domain_of, 2000))
    assert near == {"a_x": 1, "a_y": 1499, "b_z": 500}
    # domains by a stated table
    table = {"a_x": "q", "b_z": "q"}
    assert sums(M.budgets(plan, sizes, lambda s: M.domain_of(s, table), 2000)) == {"a_y": 500, "b_z": 1500}


def test_stretches_follow_the_size_of_the_leaf(spark):
    bits = lambda n: M.budgets([target("a", 0.5)], {("a", "en"): 10**9}, M.domain_of, 100, {("a", "en"): n})[0]["bits"]
    assert [bits(n) for n in (1, 100, 10**6, 10**9)] == [1, 3, 10, 15]
    sizes = [5] * 3000
    for b in (1, 5, 9):
        got = M.pick(frame(spark, sizes), leaf(spark, 0, 7501.0).withColumn("bits", F.lit(b))).agg(F.sum("n_tokens")).first()[0]
        assert abs(got - 7501) <= 2.5
