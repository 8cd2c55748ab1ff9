"""Queries over the text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import language, leaks, mixing
from strandmill.operators.cover import cover
from strandmill.session import spread, table, written


def leaked(spark: SparkSession, sf: str, places: bool = True) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return leaks.find(spread(docs), table(spark, sf, "eval_items"), places=places)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items that share a passage."""
    return leaked(spark, sf, places=False).select("item_id", "doc_id").distinct()


def p6_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches to remove from each document, overlapping passages merged."""
    spans = cover(leaked(spark, sf), ["doc_id"], "first_char", "last_char")
    return spans.where("kind = 'period'").select("doc_id", F.col("range_start").alias("first_char"), F.col("range_end").alias("last_char"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the passages they share with an item: id and number of characters left."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return leaks.remove(docs, p6_spans(spark, sf)).select("doc_id", F.length("text").alias("n_chars"))


def sized_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Source, language and tokens of every document, counted once and kept in the shared folder."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        mixing.spelling(F.col("source")).alias("source"),
        F.coalesce(language.label_language(F.col("lang")), F.lit("und")).alias("lang"),
        "text",
    )
    return written(mixing.count_tokens(spread(docs)), "tokens")


def mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Chosen documents of every plan, and the targets."""
    sized = sized_documents(spark, sf)
    targets = table(spark, sf, "mix_targets").where("target_share > 0 and source is not null").withColumn("source", mixing.spelling(F.col("source")))
    rows = [r.asDict() for r in targets.distinct().collect()]  # the stated plans
    # the sums of the stated sources only; the planner broadcasts their names after a check of the size
    names = spark.createDataFrame([(x,) for x in sorted({r["source"] for r in rows})], "source string")
    sums = sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    found = sums.join(names, "source", "left_semi").collect()
    sizes, docs = ({(r["source"], r["lang"]): r[x] for r in found} for x in ("n", "docs"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    leaves = mixing.budgets(rows, sizes, mixing.domain_of, total, docs)
    schema = "plan_id int, source string, lang string, budget double, epochs int, rest double, bits int"
    plan = spark.createDataFrame([tuple(x[k.split()[0]] for k in schema.split(", ")) for x in leaves], schema)
    return mixing.pick(sized, plan), targets


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents of each plan with their repeats."""
    return mixture(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Per plan and source: target share, share reached, documents and tokens with repeats."""
    chosen, targets = mixture(spark, sf)
    by = chosen.groupBy("plan_id", "source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    whole = by.groupBy("plan_id").agg(F.sum("n_tokens").alias("plan_tokens"))
    reached = by.join(whole, "plan_id").withColumn("reached_share", F.col("n_tokens") / F.col("plan_tokens"))
    return (
        targets.select("plan_id", "source", "target_share", "max_repeats")
        .distinct()
        .join(reached, ["plan_id", "source"], "left")
        .na.fill(0, ["n_docs", "n_tokens", "most_repeats", "reached_share"])
        .drop("plan_tokens")
    )


def identified(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return language.identify(spread(docs), language.fit(docs), label_col="lang")


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every document, and of every paragraph of the mixed ones."""
    return language.segments(identified(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a missing or wrong label, and the paragraphs of mixed documents."""
    found = identified(spark, sf)
    wrong = ~F.coalesce(F.col("label") == F.col("lang"), F.lit(False))
    mixed = F.size(F.array_distinct("langs")) > 1
    row = lambda no, lang: F.struct(no.alias("seg_no"), lang.alias("lang"))
    cases = F.concat(
        F.array(F.when(wrong, row(F.lit(0), F.col("lang")))),
        F.transform("langs", lambda x, i: F.when(mixed, row((i + 1).cast("int"), x))),
    )
    rows = found.select("doc_id", F.explode(cases).alias("c")).where(F.col("c.lang").isin(*language.LANGS))
    return rows.select("doc_id", "c.seg_no", "c.lang").distinct()


QUERIES = {f.__name__: f for f in (p6_found, p6_spans, p6_clean, p7_mix, p7_shares, p8_found, p8_languages)}
SQL: dict[str, str] = {}
