import random
from collections import Counter

import numpy as np
import pytest

from strandmill.llm import leaks as K


def test_what_makes_no_difference():
    plain = K.words("the ﬁbre of said rotor")
    assert plain == ["the", "fibre", "of", "said", "rotor"]
    for t in (
        "THE, fi-\nbre; of 123 said rotor!", "<b>the</b> fibre<br/>of &nbsp; said rotor 9", "t\u00adhe fi\u200bbre of sаid rоtor", "the  fibré “of” said r0tor",
        "&lt;i&gt;the&lt;/i&gt; fibre of\tsaid\nrotor", "the fibre of said\u00a0ｒｏｔｏｒ", "the fi­\nbre of said rot0r",
    ):
        assert K.words(t) == plain, t
    assert K.words(None) == K.words("") == K.words("12 34 。") == K.words("7o3 1l 10 4th C6H12") == []
    assert K.words("b1ade c0ntroller l0 x") == ["blade", "controller", "x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def run_of(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else 0
            best = max(best, row[j])
    return best


def test_bit_vectors_against_tables():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 25))] for _ in "ab")
        items = K.Items([(1, [str(x) for x in a])])
        seq = [items.vocab.get(str(x), 1) for x in b]
        assert K.common(items.mask(0), len(a), seq) == lcs(a, b)
        assert K.longest_run(items.mask(0), seq)[0] == run_of(a, b)


@pytest.mark.parametrize("table", [1, 500, 1 << 22])
def test_many_sequences_at_once(monkeypatch, table):
    rnd = random.Random(table)
    monkeypatch.setattr(K, "TABLE", table)
    items = K.Items([(i, [f"w{chr(97 + rnd.randrange(20))}" for _ in range(rnd.choice([1, 9, 63, 64, 65, 130, 200]))]) for i in range(9)])
    which = np.array([rnd.randrange(9) for _ in range(200)])
    seqs = [np.array([rnd.choice([0, 1, *range(2, 22)]) if rnd.random() < 0.3 else items.seqs[i][k % len(items.seqs[i])] for k in range(rnd.randrange(0, 230))], np.int64) for i in which]
    want = [K.common(items.mask(i), int(items.size[i]), s.tolist()) for i, s in zip(which, seqs)]
    assert K.common_of_many(items, which, seqs).tolist() == want
    assert K.common_of_many(items, which[:0], []).tolist() == []


def make(seed=7):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(180)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, say(rnd.randrange(48, 90))) for i in range(12)]
    docs, want = [], set()
    for d in range(80):
        text = say(rnd.randrange(0, 250))
        if d % 2 == 0:
            i, ws = rnd.choice(items)
            kind = d // 2 % 6
            if kind == 0:
                bit, hit = ws, True
            elif kind == 1:
                at = rnd.randrange(len(ws) - 18)
                bit, hit = ws[at : at + 18], True
            elif kind == 2:
                at = rnd.randrange(len(ws) - 16)
                bit, hit = ws[at : at + 14], False  # a short quotation
            elif kind == 3:
                bit, hit = [w if rnd.random() < 0.85 else "zz" for w in ws], True
            elif kind == 4:
                bit, hit = [x for w in ws for x in ([w, "extra"] if rnd.random() < 0.12 else [w])], True
            else:
                bit, hit = rnd.sample(ws, len(ws)), False  # other order
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + bit + text[at:]
            if hit:
                want.add((i, d))
        docs.append((d, " ".join(text)))
    return items, docs, want


def test_planted_passages(spark, rows):
    items, docs, want = make()
    got = K.find(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"),
    )
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == want


def test_brute_force_agrees():
    """Every pair that the rule makes a case is found, and no other."""
    items, docs, _ = make(11)
    block = K.Items(items)
    seqs = [np.array([block.vocab.get(w, 1) for w in K.words(t)], np.int64) for _, t in docs]
    found = {(block.ids[i], docs[d][0]) for i, d, *_ in K.search_shard(block, seqs)}
    want = set()
    for k, (i, ws) in enumerate(items):
        for d, t in docs:
            b = t.split()
            width = int(np.ceil(K.STRETCH * len(ws)))
            if run_of(ws, b) >= K.RUN or (lcs(ws, b) >= K.SHARE * len(ws) and any(lcs(ws, b[s : s + width]) >= K.SHARE * len(ws) for s in range(len(b)))):
                want.add((i, d))
    assert found == want


def test_nulls_empty_repeats_and_clashing_columns(spark):
    items, docs, _ = make()
    text = " ".join(items[0][1])
    i_schema, d_schema = "item_id long, text string, doc_id long, run int", "doc_id long, text string, item_id long, share int"
    one = spark.createDataFrame([(1, text, 5, 5), (1, text, 5, 5), (2, None, 5, 5), (3, "", 5, 5), (None, text, 5, 5)], i_schema)
    two = spark.createDataFrame([(1, text, 5, 5), (1, text, 5, 5), (2, None, 5, 5), (3, "", 5, 5)], d_schema)
    assert [(r["item_id"], r["doc_id"], r["run"]) for r in K.find(two, one).collect()] == [(1, 1, len(items[0][1]))]
    assert K.find(two, one.where("false")).count() == 0 and K.find(two.where("false"), one).count() == 0
    assert K.find(two, one.where("item_id > 1")).count() == 0


def test_blocks_of_items_and_shards(spark, monkeypatch):
    items, docs, want = make()
    monkeypatch.setattr(K, "BLOCK_WORDS", 150)
    monkeypatch.setattr(K, "SHARD_WORDS", 700)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert len(list(K.item_blocks(frame))) > 4
    got = K.find(spark.createDataFrame(docs, "doc_id long, text string"), frame)
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == want


def test_very_long_text(spark, monkeypatch):
    items, docs, _ = make()
    monkeypatch.setattr(K, "SHARD_WORDS", 1 << 16)
    filler = "lorem ipsum " * 300_000
    df = spark.createDataFrame([(1, filler + " ".join(items[3][1]) + " " + filler)], "doc_id long, text string")
    got = K.find(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert [(r["item_id"], r["share"], r["first_char"] <= len(filler) < r["last_char"]) for r in got] == [(3, 1.0, True)]


def test_places_of_words():
    rnd = random.Random(8)
    bits = ["rotor", "ﬁbre", "<b>", "</i x=1>", "&amp;", "&lt;i&gt;", "&nbsp", "fi-\nbre", "so\u00adft", "c0ntrol", "7o3", "12", "оне", "İx", "é", " ", "\n\n", "—", "漢字", "&#65;", "e\u0301a", "-\n", "x1", "<", "&"]
    for _ in range(400):
        t = "".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(12)))
        ws, spans = K.word_spans(t)
        assert ws == K.words(t), t
        assert all(0 <= a < b <= len(t) for a, b in spans) and all(x[0] < y[1] for x, y in zip(spans, spans[1:]))
    ws, spans = K.word_spans("The <b>ﬁbre</b> of ro-\ntor")
    assert ["The <b>ﬁbre</b> of ro-\ntor"[a:b] for a, b in spans] == ["The", "ﬁbre", "of", "ro-\ntor"]


def test_passages_are_removed(spark):
    items, _, _ = make()
    leak = " ".join(items[2][1])
    docs = spark.createDataFrame([(1, f"Before {leak.upper()} after.", 1), (2, f"{leak} {'filler ' * 200}{leak}", 2), (3, "nothing", 3), (4, None, 4)], "doc_id long, text string, extra int")
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = K.find(docs, frame)
    got = {r["doc_id"]: r["text"] for r in K.remove(docs, found).collect()}
    assert got == {1: "Before  after.", 2: " " + "filler " * 200, 3: "nothing", 4: None}


def damaged(ws, every, keep, other):
    """The words with only the first ``keep`` of every ``every`` kept."""
    return [w if k % every < keep else other(k) for k, w in enumerate(ws)]


def test_copies_of_a_damaged_passage():
    """No run of 18 words, and every stretch as often in the shard as the document has copies."""
    items, _, _ = make()
    bit = " ".join(damaged(items[4][1], 6, 5, lambda k: f"zz{'abcdefghij'[k % 10]}"))
    docs = [f"{'filler ' * (d % 7)}{bit} end" for d in range(40)]
    block = K.Items(items)
    seqs = [np.array([block.vocab.get(w, 1) for w in K.words(t)], np.int64) for t in docs]
    assert {(block.ids[i], d) for i, d, *_ in K.search_shard(block, seqs)} == {(4, d) for d in range(40)}


def test_stretches_of_one_or_two_words():
    """67 % of the words in order, never three in a row."""
    items, _, _ = make()
    docs = [" ".join(["filler"] * 30 + damaged(ws, 3, 2, lambda k: "zz") + ["filler"] * 30) for _, ws in items]
    block = K.Items(items)
    seqs = [np.array([block.vocab.get(w, 1) for w in K.words(t)], np.int64) for t in docs]
    assert {(block.ids[i], d) for i, d, *_ in K.search_shard(block, seqs)} == {(i, i) for i in range(12)}


def test_every_run_of_a_group():
    """52 of 96 words with one of them damaged: two runs on one diagonal; and a run beside a whole passage."""
    words_ = ["".join("abcdefghij"[int(c)] for c in f"{k:03}") for k in range(96)]
    block = K.Items([(1, words_)])
    ids = [block.vocab[w] for w in words_]
    half = [1] * 9 + ids[:26] + [1] + ids[27:53] + [1] * 9
    both = [1] * 9 + ids[:20] + [1] * 12 + ids + [1] * 9
    got = list(K.search_shard(block, [np.array(half, np.int64), np.array(both, np.int64)]))
    assert {(d, run, a, b) for _, d, run, _, a, b in got} == {(0, 26, 9, 35), (0, 26, 36, 62), (1, 20, 9, 29), (1, 96, 41, 137)}


def test_windows_with_enough_words_against_all_windows():
    """Every window of an item's width that holds enough of its words lies in a stretch, and every stretch of a text holds one."""
    rnd = random.Random(11)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    for _ in range(12):
        items = K.Items([(i, rnd.choices(vocab[: rnd.choice([8, 30, 60])], k=rnd.choice([8, 12, 13, 40, 90]))) for i in range(5)])
        other = [w for w in vocab if w not in items.vocab]
        texts = []
        for _ in range(6):
            ws = rnd.choices(vocab + other * 3, k=rnd.randrange(0, 300))
            if rnd.random() < 0.6:
                k = rnd.randrange(5)
                part = [w for w, n in items.vocab.items() if n in items.seqs[k]] if rnd.random() < 0.3 else [w for n in items.seqs[k] for w, x in items.vocab.items() if x == n]
                rnd.shuffle(part)
                at = rnd.randrange(len(ws) + 1)
                ws[at:at] = part
            texts.append(np.array([items.vocab.get(w, 1) for w in ws], np.int64))
        got = list(K.crowded(items, texts))
        for i, seq in enumerate(items.seqs):
            need, width = max(int(np.ceil(K.SHARE * len(seq))), K.COVER), int(np.ceil(K.STRETCH * len(seq)))
            bag = Counter(seq)
            for d, t in enumerate(texts):
                mine = [(a, b) for j, e, a, b in got if (j, e) == (i, d)]
                exact = list(K.windows(bag, need, width, t.tolist()))
                hits = set()
                for end in range(1, len(t) + 1):
                    a = max(0, end - width)
                    if sum((Counter(t[a:end].tolist()) & bag).values()) >= need:
                        hits.add(end)
                        assert all(any(x <= a and end <= y for x, y in them) for them in (mine, exact))
                assert all(any(x < h <= y for h in hits) for x, y in exact)


@pytest.mark.parametrize("copies", [1, 12, 13, 50, 1000])
def test_copies_in_one_shard_or_many(spark, rows, copies):
    """A partly changed passage is found in all its copies, whatever their number and however they are spread."""
    rnd = random.Random(copies)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    item = [word() for _ in range(60)]
    text = " ".join([*(word() for _ in range(30)), *(word() if k % 10 == 9 else w for k, w in enumerate(item)), *(word() for _ in range(30))])
    docs = spark.createDataFrame([(i, text) for i in range(copies)] + [(10**6, " ".join(word() for _ in range(90)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for parts in (1, 4, 64) if copies == 50 else (1,):
        got = K.find(docs.repartition(parts), items).select("item_id", "doc_id").distinct()
        assert rows(got) == sorted([(1, i) for i in range(copies)], key=repr)
