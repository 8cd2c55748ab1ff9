import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandmill.llm import language as L

# one or two plain sentences a language are enough to build small training texts
SENTENCES = {
    "en": "the wheel turns when the small motor pulls the belt and the water flows through the filter of this device because it is open",
    "de": "das Rad dreht sich wenn der kleine Motor den Riemen zieht und das Wasser fließt durch den Filter dieser Vorrichtung weil sie offen ist",
    "fr": "la roue tourne quand le petit moteur tire la courroie et que l'eau coule à travers le filtre de ce dispositif parce qu'il est ouvert",
    "es": "la rueda gira cuando el pequeño motor tira de la correa y el agua fluye a través del filtro de este dispositivo porque está abierto",
    "pt": "a roda gira quando o pequeno motor puxa a correia e a água flui através do filtro deste dispositivo porque não está fechado",
    "nl": "het wiel draait wanneer de kleine motor de riem trekt en het water stroomt door het filter van deze inrichting omdat het open is",
    "it": "la ruota gira quando il piccolo motore tira la cinghia e l'acqua scorre attraverso il filtro di questo dispositivo perché è aperto",
    "ru": "колесо вращается когда маленький двигатель тянет ремень и вода течёт через фильтр этого устройства потому что он открыт",
    "ja": "小さなモータがベルトを引くと車輪が回転し、装置のフィルタを通って水が流れる。",
    "zh": "当小电机拉动皮带时车轮旋转，水通过该装置的过滤器流动，因为它是打开的。",
}


def say(lang, n, rnd):
    s = SENTENCES[lang]
    if lang in ("ja", "zh"):
        return s * max(1, n // 25)
    ws = s.split()
    return " ".join(rnd.choice(ws) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        lang = rnd.choice(L.LANGS)
        label = rnd.choice(L.LANGS) if rnd.random() < 0.1 else lang
        rows.append((i, rnd.choice([label, label.upper(), f"{label}-XX"]), say(lang, 40, rnd)))
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.parquet(path)
    return L.fit(spark.read.parquet(path))


def ask(spark, model, texts, label=None):
    df = spark.createDataFrame([(i, label, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    return {r["doc_id"]: r for r in L.identify(df, model, label_col="lang").collect()}


def test_labels(spark):
    cases = {
        "en": "en", "EN": "en", "en-US": "en", "en_GB": "en", " German ": "de", "français": "fr", "zh-Hant-TW": "zh", "日本語": "ja", "jpn": "ja", "Portuguese (Brazil)": "pt",
        "mul": None, "und": None, "": None, " ": None, None: None, "en/de": None, "en, de": None, "xx": None, "n/a": None, "pl": None, "русский": "ru", "spa": "es",
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", L.label_language(F.col("l")).alias("x"))
    assert {r["l"]: r["x"] for r in df.collect()} == cases


def test_each_language(spark, model):
    rnd = random.Random(2)
    texts = [say(x, 15, rnd) for x in L.LANGS for _ in range(5)]
    got = ask(spark, model, texts)
    assert [got[i]["lang"] for i in range(len(texts))] == [x for x in L.LANGS for _ in range(5)]
    assert all(0.9 < r["confidence"] <= 1 for r in got.values())


def test_paragraphs_and_foreign_phrases(spark, model):
    rnd = random.Random(3)
    mixed = "\n\n".join([say("en", 60, rnd), say("de", 25, rnd), "12 + 3 = 15", say("zh", 30, rnd)])
    phrase = say("fr", 40, rnd) + " (" + say("de", 4, rnd) + ") " + say("fr", 40, rnd)
    got = ask(spark, model, [mixed, phrase])
    assert got[0]["lang"] == "en" and got[0]["langs"] == ["en", "de", "en", "zh"] and got[0]["confidences"][2] == 0
    assert got[0]["confidence"] < got[1]["confidence"] and got[1]["langs"] == ["fr"]
    rows = L.segments(L.identify(spark.createDataFrame([(0, None, mixed), (1, None, phrase)], "doc_id long, lang string, text string"), model))
    assert sorted((r["doc_id"], r["seg_no"], r["lang"]) for r in rows.collect()) == [(0, 0, "en"), (0, 1, "en"), (0, 2, "de"), (0, 3, "en"), (0, 4, "zh"), (1, 0, "fr")]


def test_noise(spark, model):
    rnd = random.Random(4)
    upper = say("de", 30, rnd).upper()
    look = say("en", 30, rnd).replace("a", "а").replace("o", "о")
    unknown = say("en", 30, rnd).replace("wheel", "wheeling").replace("motor", "m0tor")
    got = ask(spark, model, [upper, look, unknown])
    assert [got[i]["lang"] for i in range(3)] == ["de", "en", "en"]


def test_nulls_empty_long_and_clashing_columns(spark, model):
    rnd = random.Random(5)
    long = say("it", 120_000, rnd)
    df = spark.createDataFrame(
        [(1, None, None, "x", 1), (2, "en", "", "x", 1), (3, "en", "123 !!", "x", 1), (4, "it", long, "x", 1), (4, "it", long, "x", 1), (None, "en", say("en", 9, rnd), "x", 1)],
        "doc_id long, lang string, text string, langs string, confidence int",
    )
    got = L.identify(df, model, label_col="lang").collect()
    assert sorted([(r["doc_id"] or 0, r["label"], r["lang"]) for r in got], key=repr) == [(0, "en", "en"), (1, None, None), (2, "en", None), (3, "en", None), (4, "it", "it"), (4, "it", "it")]
    assert L.identify(df.where("false"), model).count() == 0


def test_empty_sample(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([(1, None, "x")], "doc_id long, lang string, text string").write.parquet(path)
    m = L.fit(spark.read.parquet(path))
    assert m.ids == {} and ask(spark, m, ["これはペンです"])[0]["lang"] == "ja"


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/documents.parquet").exists(), reason="no test tables")
def test_agreement_with_labels_of_the_test_tables(spark):
    """Labels are right for most rows; where they are, so must be the languages found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, L.fit(docs.select("doc_id", "lang", "text")), label_col="lang").where("label is not null")
    share = got.agg(F.avg((F.col("label") == F.col("lang")).cast("int"))).first()[0]
    assert share > 0.9


def test_sample_is_of_all_files(spark, tmp_path):
    """One language lies in the last of many files, wherever that ranks."""
    rnd = random.Random(4)
    langs = [x for x in L.LANGS if x != "pt"]
    for f in range(24):
        rows = [(f * 40 + i, langs[i % 9] if f else "pt", say(langs[i % 9] if f else "pt", 40, rnd)) for i in range(40)]
        spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d.parquet"))
    counts = {r["lang"]: r["count"] for r in L.sample(docs, "doc_id", 30).groupBy("lang").count().collect()}
    assert counts == dict.fromkeys(L.LANGS, 30)


@pytest.mark.parametrize("few", [0, 1])
def test_a_language_without_rows_takes_no_others(few):
    """Smoothing is relative to a language's rows: without any, it outscores no other; with one wrong one, hardly ever."""
    rnd = random.Random(5)
    counts, totals = {}, [0] * len(L.LANGS)
    for i, lang in enumerate(L.LANGS):
        for k in range(few if lang == "pt" else 200):
            totals[i] += 1
            for w in set(L.units(say("en" if lang == "pt" else lang, 12, rnd))):
                by = counts.setdefault(w, {})
                by[i] = by.get(i, 0) + 1
    model = L.Model({w: by for w, by in counts.items() if sum(by.values()) > 1}, {}, totals)
    texts = {x: say(x, 40, rnd) for x in L.LANGS if x != "pt"}
    got = L.label_texts(L.Cache(model), list(texts.values()))
    assert [r[0] for r in got] == list(texts)
    pt = L.LANGS.index("pt")
    assert all(s[pt] < s.max() for s in model.scores)


def test_scripts_of_no_language(spark, model):
    rnd = random.Random(8)
    foreign = ["작은 전동기가 벨트를 당기면 바퀴가 회전한다", "όταν ο μικρός κινητήρας τραβά τον ιμάντα", "عندما يسحب المحرك الصغير الحزام تدور العجلة", "เมื่อมอเตอร์ขนาดเล็กดึงสายพาน", "כאשר המנוע הקטן מושך"]
    formula = say("en", 30, rnd) + " α = β + μ and Δ γ " + say("en", 30, rnd)
    got = ask(spark, model, [*foreign, formula, say("en", 40, rnd) + "\n\n" + foreign[0] * 3])
    assert [got[i]["lang"] for i in range(len(foreign))] == ["und"] * len(foreign) and got[5]["langs"] == ["en"]
    assert got[6]["langs"] == ["en", "und"] and got[6]["confidences"][1] > 0.9


def test_short_foreign_paragraphs(spark, model):
    rnd = random.Random(9)
    for lang, short in (("de", SENTENCES["de"].split()[:6]), ("zh", [SENTENCES["zh"][:8]]), ("ja", [SENTENCES["ja"][:9]])):
        text = "\n\n".join([say("en", 40, rnd), " ".join(short), say("en", 40, rnd)])
        assert ask(spark, model, [text])[0]["langs"] == ["en", lang, "en"]
    inside = say("en", 40, rnd) + " " + SENTENCES["zh"][:8] + " " + say("en", 40, rnd)
    assert ask(spark, model, [inside])[0]["langs"] == ["en"]


def test_words_of_one_row_still_tell_by_their_trigrams(spark, tmp_path):
    # every word of the two languages is in one row only
    rnd = random.Random(10)
    word = lambda ends: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) + rnd.choice(ends)
    ends = {"de": ["schung", "keit"], "fr": ["eaux", "tion"]}
    rows = [(i, lang, " ".join(word(ends[lang]) for _ in range(12))) for i, lang in enumerate(["de", "fr"] * 30)]
    m = L.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    got = ask(spark, m, [" ".join(word(ends[lang]) for _ in range(12)) for lang in ("de", "fr", "de")])
    assert [got[i]["lang"] for i in range(3)] == ["de", "fr", "de"]
