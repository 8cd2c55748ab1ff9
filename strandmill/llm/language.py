"""Language of documents and of their paragraphs.

Script ranges narrow the candidates of every word, words have scores per
language from a model that is fitted on a bounded sample of labelled rows, and
a Viterbi pass with a penalty for every switch labels the spans of a text. A
paragraph has the language of most of its characters, and so has a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es", "pt", "nl", "it", "ru", "ja", "zh")
#: states of the Viterbi pass: the languages, and ``und`` for words in a script that none of them uses
STATES = (*LANGS, "und")
LATIN = tuple(i for i, x in enumerate(LANGS) if x not in ("ru", "ja", "zh"))
RU, JA, ZH = (LANGS.index(x) for x in ("ru", "ja", "zh"))
UND = len(LANGS)

# Codes and names of the languages (ISO 639-1, 639-2 B and T, English and own names).
LABELS = {
    "en": ("en", "eng", "english", "anglais", "englisch"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "it": ("it", "ita", "italian", "italiano"),
    "ru": ("ru", "rus", "russian", "русский", "russkij"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語"),
    "zh": ("zh", "zho", "chi", "cn", "cmn", "chinese", "中文", "汉语", "漢語"),
}

#: bounds of the fit: labelled rows per language; rows below which a language's own counts have less say
SAMPLE_ROWS, FEW_ROWS = 400, 20
#: cost of changing the language between two words and between two paragraphs, and the most one word can say for a language, in nats
SWITCH, BORDER, WORD_MOST = 9.0, 6.0, 4.0
GROUP_UNITS = 300_000  # words, padding included, that are labelled at once; a longer text is labelled by itself

WORD = re.compile(r"[^\W\d_]+")
PARAGRAPH = re.compile(r"\n[ \t\r\f\v]*\n\s*")
WIDE = re.compile("[぀-ヿㇰ-ㇿｦ-ﾟ㐀-鿿豈-﫿]+")
KANA = re.compile("[぀-ヿㇰ-ㇿｦ-ﾟ]")
CYRILLIC = re.compile("[Ѐ-ԯ]")
LATIN_LETTER = re.compile("[a-zªºß-öø-ɏᴀ-ỿﬀ-ﬆａ-ｚ]")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]+")
# Ranges of the alphabets from Armenian to Georgian, Ethiopic, Khmer, Mongolian and Hangul, with their presentation forms.
FOREIGN = re.compile("[԰-ჿ\u1100-\u11ffሀ-᎟ក-\u18af\u3130-\u318f가-\ud7af\ufb13-\ufdff\ufe70-\ufefc]")
# Cyrillic letters that look like Latin ones; words of only these say little.
LOOKALIKE = frozenset("асеорхукмнтвзіјѕ")


def label_language(c: Column) -> Column:
    """The language a label names, as one of ``LANGS``; NULL if it names none or not exactly one.

    Codes may carry a region or script (``en-US``, ``zh_TW``), names a remark in brackets.
    """
    low = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    base = F.regexp_replace(F.regexp_replace(low, r"\s*\(.*\)$", ""), r"^(\p{L}{2,3})[-_][a-z0-9_-]+$", "$1")
    pairs = [F.lit(x) for lang, names in LABELS.items() for n in names for x in (n, lang)]
    return F.try_element_at(F.create_map(*pairs), base)


# -- model -----------------------------------------------------------------
def grams(word: str) -> list[str]:
    """Pieces of a word that carry over to words the model has not seen."""
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def units(text: str) -> list[str]:
    """Words in lower case; of scripts without spaces, each character."""
    out = []
    for w in WORD.findall(text.lower()):
        if w.isascii() or not WIDE.search(w):
            out.append(w)
        else:
            out.extend(w)
    return out


class Model:
    """Log scores of words and of trigrams per language."""

    def __init__(self, counts: dict[str, dict[int, int]], grams_: dict[str, dict[int, int]], totals: list[int]):
        n = len(LANGS)
        total = np.asarray(totals, float)
        whole = max(1.0, total.sum())
        sure = np.minimum(1, total / min(FEW_ROWS, max(1.0, total.max())))

        def table(entries: dict[str, dict[int, int]], scale: float) -> tuple[dict, np.ndarray]:
            m = np.zeros((len(entries), n))
            ids = {}
            for i, (k, by) in enumerate(entries.items()):
                ids[k] = i
                for lang, c in by.items():
                    m[i, lang] = c
            # smoothing keeps wrong labels of the sample from counting as evidence; it is relative to a
            # language's rows, and one with few or none has about the mean of all, which is never the most
            every = m.sum(1, keepdims=True)
            p = (m + 0.002 * every) / np.maximum(total + 0.002 * whole, 1e-9)
            p = sure * p + (1 - sure) * every / whole + 0.05 / (total.max() + 0.002 * whole)
            p = np.log(p / p.max(1, keepdims=True)) if len(p) else p
            und = np.full((len(p), 1), -WORD_MOST)
            return ids, np.concatenate([np.maximum(p * scale, -WORD_MOST), und], 1).astype(np.float32)

        self.ids, self.scores = table(counts, 1.0)
        self.gram_ids, self.gram_scores = table(grams_, 0.5)

    def unknown(self, w: str) -> np.ndarray:
        """Scores of a word that the sample does not have, from its script and its trigrams."""
        s = np.full(len(STATES), -WORD_MOST, np.float32)
        if KANA.search(w):
            s[JA] = 0
        elif WIDE.search(w):
            s[[JA, ZH]] = 0
        elif CYRILLIC.search(w):
            if set(w) <= LOOKALIKE or not all("Ѐ" <= c <= "ԯ" for c in w):
                s[:] = 0  # may stand for a Latin word
            else:
                s[RU] = 0
        elif not LATIN_LETTER.search(w):
            if FOREIGN.search(w) or (len(w) > 2 and GREEK.fullmatch(w)):
                s[UND] = 0
            else:
                s[:] = 0  # letters of formulas say nothing
        elif len(w) < 3:
            s[list(LATIN)] = 0
        else:
            rows = [self.gram_ids[g] for g in grams(w) if g in self.gram_ids]
            t = self.gram_scores[rows].sum(0) if rows else np.zeros(len(STATES), np.float32)
            s[list(LATIN)] = np.maximum((t - t[list(LATIN)].max())[list(LATIN)], -WORD_MOST)
        return s


class Cache:
    """Scores of the words met so far, as rows of one growing array."""

    def __init__(self, model: Model):
        self.model, self.ids = model, dict(model.ids)
        self.n = len(model.ids)
        self.table = np.zeros((max(1024, 2 * self.n), len(STATES)), np.float32)
        self.table[: self.n] = model.scores

    def zero(self) -> int:
        """The number of a row of zeros, for padding."""
        return self.ids[""] if "" in self.ids else self._row("", np.zeros(len(STATES), np.float32))

    def add(self, w: str) -> int:
        if WIDE.search(w) and len(w) > 1:
            rows = [self.ids[c] if c in self.ids else self.add(c) for c in w]
            row = self.table[rows].sum(0)
            # the script is sure, and the more so the longer the run; which of its languages it is, is not
            row[[JA, ZH]] = np.maximum(row[[JA, ZH]], -3 * WORD_MOST)
        else:
            row = self.model.unknown(w)
        return self._row(w, row)

    def _row(self, w: str, row: np.ndarray) -> int:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = row
        self.ids[w] = self.n
        self.n += 1
        return self.n - 1


def sample(docs: DataFrame, id_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled rows for the fit: ``lang``, ``text``; at most ``rows`` a language, out of all rows.

    Rows are chosen by hash, so the choice is the same in every run and
    doesn't follow the order of the table or its files. A first pass over
    labels and ids finds the highest hash of each language that is chosen, so
    the second has only the texts of the chosen rows to rank. Both ranks are
    limited per partition before they shuffle.
    """
    lang, h = label_language(F.col("lang")), F.xxhash64(F.col(id_col), F.lit(7))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    labelled = docs.where(lang.isNotNull() & F.col("text").isNotNull())
    first = labelled.select(lang.alias("lang"), h.alias("h")).withColumn("r", rank).where(F.col("r") <= rows)
    most = {r["lang"]: r["h"] for r in first.groupBy("lang").agg(F.max("h").alias("h")).collect()}  # one row a language
    near = F.lit(False)
    for x, top in sorted(most.items()):
        near = near | ((lang == x) & (h <= top))
    chosen = labelled.where(near).select(lang.alias("lang"), "text", h.alias("h"))
    return chosen.withColumn("r", rank).where(F.col("r") <= rows).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Word and trigram counts per language of the sample, counted by the executors.

    The driver gets the words of the sample, at most ``rows`` texts a language,
    with their counts. A word of one row only has no score of its own, but its
    trigrams count like those of all words.
    """
    langs = LANGS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((w, lang) for w in set(units(text)))
                seen[("", lang)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())],
            ["w", "lang", "n"],
        )

    table = (
        sample(docs, id_col, rows)
        .mapInArrow(count, "w string, lang string, n long")
        .groupBy("w")
        .agg(F.collect_list(F.struct("lang", "n")).alias("m"), F.sum("n").alias("n"))
    )
    counts: dict[str, dict[int, int]] = {}
    totals = [0] * len(langs)
    pieces: dict[str, dict[int, int]] = {}
    for r in table.toLocalIterator():
        by: dict[int, int] = {}
        for x in r["m"]:
            i = langs.index(x["lang"])
            by[i] = by.get(i, 0) + x["n"]
        if r["w"] == "":
            for i, n in by.items():
                totals[i] = n
            continue
        if r["n"] > 1:
            counts[r["w"]] = by
        if len(r["w"]) > 2 and not WIDE.search(r["w"]):
            top = max(by, key=by.get)
            for g in grams(r["w"]):
                slot = pieces.setdefault(g, {})
                slot[top] = slot.get(top, 0) + 1
    return Model(counts, pieces, totals)


# -- labelling ---------------------------------------------------------------
def viterbi(table: np.ndarray, ids: np.ndarray, switch: float | np.ndarray = SWITCH) -> np.ndarray:
    """Best labels of several sequences at once.

    ``ids`` is (sequences, steps) of rows of ``table``, the scores by language;
    ``switch`` the cost of a change, one for all or for each step of each sequence. Padding points to a row of zeros: it has no say, and the last real label
    carries through it.
    """
    b, steps = ids.shape
    score = table[ids[:, 0]]
    stay = np.ones((steps, b, table.shape[1]), bool)
    best = np.zeros((steps, b), np.int8)
    rows = np.arange(b)
    cost = np.broadcast_to(np.asarray(switch, np.float32), (b, steps))
    for t in range(1, steps):
        top = score.argmax(1)
        best[t - 1] = top
        jump = (score[rows, top] - cost[:, t])[:, None]
        keep = score >= jump
        stay[t] = keep
        score = np.where(keep, score, jump) + table[ids[:, t]]
    labels = np.zeros((b, steps), np.int8)
    at = score.argmax(1)
    labels[:, steps - 1] = at
    for t in range(steps - 1, 0, -1):
        at = np.where(stay[t, rows, at], at, best[t - 1])
        labels[:, t - 1] = at
    return labels


def label_texts(cache: Cache, texts: list[str]) -> list[tuple]:
    """Per text: main language, its confidence, and for every paragraph language and confidence."""
    get = cache.ids.get
    seqs, weights, ends = [], [], []
    for text in texts:
        words: list[str] = []
        end = []
        for part in PARAGRAPH.split(text.strip("\n\r\t ")):
            words += WORD.findall(part.lower())
            end.append(len(words))
        seq = [get(w) for w in words]
        if None in seq:
            for n, i in enumerate(seq):
                if i is None:
                    known = get(words[n])
                    seq[n] = cache.add(words[n]) if known is None else known
        seqs.append(np.array(seq, np.int32))
        weights.append(np.fromiter(map(len, words), np.int32, len(words)))
        ends.append(end)
    zero = cache.zero()
    table = cache.table
    out: list[tuple | None] = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(seqs[i]))
    k = len(STATES)
    at = 0
    while at < len(order):
        n = len(seqs[order[at]])
        group = [order[at]]
        at += 1
        while (
            at < len(order)
            and len(seqs[order[at]]) <= max(1.3 * n, n + 20)
            and (len(group) + 1) * len(seqs[order[at]]) <= GROUP_UNITS
        ):
            group.append(order[at])
            at += 1
        steps = max(1, len(seqs[group[-1]]))
        ids = np.full((len(group), steps), zero, np.int32)
        cost = np.full((len(group), steps), SWITCH, np.float32)
        for g, i in enumerate(group):
            ids[g, : len(seqs[i])] = seqs[i]
            cost[g, [e for e in ends[i] if e < len(seqs[i])]] = BORDER
        labels = viterbi(table, ids, cost)
        for g, i in enumerate(group):
            size = len(seqs[i])
            end = np.array(ends[i])
            slot = np.repeat(np.arange(len(end)), np.diff(end, prepend=0)) * k + labels[g, :size]
            lead = np.zeros(len(end) * k)
            for a in range(0, size, GROUP_UNITS):
                score = table[seqs[i][a : a + GROUP_UNITS]]
                mine = labels[g, a : min(a + GROUP_UNITS, size)]
                row = np.arange(len(score))
                own = score[row, mine]
                score[row, mine] = -np.inf
                lead += np.bincount(slot[a : a + GROUP_UNITS], own - score.max(1), minlength=len(lead))
            chars = np.bincount(slot, weights[i], minlength=len(lead)).reshape(-1, k)
            out[i] = decide(chars, lead.reshape(-1, k))
    return out


def decide(chars: np.ndarray, lead: np.ndarray) -> tuple:
    """Main language and paragraph languages with confidences.

    ``chars`` has the characters of each paragraph by label, ``lead`` by how
    much the words of that label speak for it rather than for another language.
    The confidence is the share of characters in the language, times how surely
    its words set it apart (0.5: not at all, 1: surely). A paragraph without
    letters follows the document.
    """

    def sure(c: np.ndarray, s: np.ndarray, lang: int) -> float:
        return float(c[lang] / c.sum() / (1 + np.exp(-np.clip(s[lang], -30, 30))))

    whole = chars.sum(0)
    if not whole.sum():
        return None, 0.0, [None] * len(chars), [0.0] * len(chars)
    main = int(whole.argmax())
    langs, conf = [], []
    for c, s in zip(chars, lead):
        some = c.sum() > 0
        lang = int(c.argmax()) if some else main
        langs.append(STATES[lang])
        conf.append(sure(c, s, lang) if some else 0.0)
    return STATES[main], sure(whole, lead.sum(0), main), langs, conf


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = None
) -> DataFrame:
    """``doc_id``, ``label``, ``lang``, ``confidence``, ``langs``, ``confidences`` (per paragraph) for every row.

    ``label`` is the language that ``label_col`` names, if it names one.

    Defined cases: NULL, empty and letterless texts have a NULL language with
    confidence 0; texts in a script that none of the languages uses have the
    language ``und``; paragraphs are split at blank lines and counted from 1;
    repeated rows give repeated results; an empty table an empty result; other
    columns are dropped. Only the id, the text and the label are read. The
    model is sent to the executors; the rows of its sample bound its size.
    """
    handle = docs.sparkSession.sparkContext.broadcast((model.ids, model.scores, model.gram_ids, model.gram_scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.ids, m.scores, m.gram_ids, m.gram_scores = handle.value
        cache = Cache(m)
        for b in batches:
            if cache.n > len(m.ids) + 300_000:  # words met once don't pile up
                cache = Cache(m)
            texts = [t or "" for t in b.column(2).to_pylist()]
            rows = []
            for i in range(0, len(texts), 2048):
                rows += label_texts(cache, texts[i : i + 2048])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([r[3] for r in rows], pa.list_(pa.float64())),
                ],
                ["doc_id", "label", "lang", "confidence", "langs", "confidences"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    label = label_language(F.col(label_col)) if label_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), label.alias("label"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, label string, lang string, confidence double, langs array<string>, confidences array<double>"
    )


def segments(found: DataFrame) -> DataFrame:
    """One row per document (``seg_no`` 0) and per paragraph of the documents in several languages."""
    mixed = F.size(F.array_distinct("langs")) > 1
    rows = F.arrays_zip(F.col("langs").alias("lang"), F.col("confidences").alias("confidence"))
    whole = F.array(F.struct(F.col("lang"), F.col("confidence")))
    return found.select(
        "doc_id", F.posexplode(F.concat(whole, F.when(mixed, rows).otherwise(F.slice(rows, 1, 0)))).alias("seg_no", "s")
    ).select("doc_id", "seg_no", "s.lang", "s.confidence")
