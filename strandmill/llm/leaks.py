"""Passages of evaluation items inside a training corpus.

The corpus is cut into shards of whole texts. For each shard an FM-index over
its normalised words is built, the items' phrases are searched backward through
the wavelet-matrix ranks, and every place of a phrase as long as a run is located
by sampled positions. Hits of one item and text that lie on about the same
diagonal are merged into spans and checked exactly. So is, whatever its phrases,
every window that holds as many words of the item, in any order, as its share needs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.fm_index import END, FMIndex

#: words of a run that is a case by itself; share of an item's words, in order, within a passage of its length
RUN, SHARE, STRETCH = 18, 0.6, 1.2
#: words of a shard; words of the items searched at once
SHARD_WORDS, BLOCK_WORDS = 1 << 20, 200_000
#: least words of an item that a passage must hold: fewer are a short quotation, even of a very short item
COVER = 7
#: words of a block, in bits, by which windows with enough words are looked for
BLOCK_BITS = 3
#: masks of words that are in memory at once, which bounds nothing but that
TABLE = 1 << 22

TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
HYPHEN = re.compile(r"[-­‐‑][^\S\n]*\n\s*(?=\w)")
UNSEEN = re.compile("[­​-‏ -‮⁠-⁤﻿̀-ͯ]")
WORD = re.compile(r"[a-z]+")
BESIDE = re.compile(r"[0-9][a-z]|[a-z][0-9]")
MIXED = re.compile(r"(?<![a-z0-9])(?:[a-z]++[0-9]|[0-9]++[a-z])[a-z0-9]*+")
# Cyrillic and Greek letters and the Latin letters they look like.
LOOKALIKE = tuple(
    zip(
        "АВЕЅІЈКМНОРСТХУԁԌһавеѕіјкмнорстхуѵԝԛɑαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıℓ",
        "ABESIJKMHOPCTXYdGhabesijkmhopctxyvwqaabeikvoptuxABEZHIKMNOPTYXil",
        strict=True,
    )
)


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared: letters only, numerals left out.

    Letter case, punctuation, spacing, markup and entities, hyphens at line
    breaks, ligatures, accents, invisible characters and letters that look
    like Latin ones make no difference.
    """
    if not text:
        return []
    t = text
    for _ in range(2):
        if "&" in t:
            t = html.unescape(t)
    if "<" in t:
        t = TAG.sub(" ", t)
    if "\n" in t:
        t = HYPHEN.sub("", t)
    if not t.isascii():
        t = UNSEEN.sub("", unicodedata.normalize("NFKD", t))
        if not t.isascii():
            for other, latin in LOOKALIKE:
                t = t.replace(other, latin)
    t = t.lower()
    if BESIDE.search(t):
        t = MIXED.sub(_letters, t)
    return WORD.findall(t)


def _letters(m: re.Match) -> str:
    """A word with digits in it: digits that look like letters are letters if that makes it a word, else it is a numeral."""
    w = m.group()
    letters = w.replace("0", "o").replace("1", "l")
    return letters if letters.isalpha() and sum(c in "01" for c in w) * 2 < len(w) else " "


# -- where the words of a text are ---------------------------------------------
ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _traced(pattern: re.Pattern, new, text: str, at: list[int]) -> tuple[str, list[int]]:
    """Replace matches by ``new(match)`` and keep, for every character, its place in the original."""
    out, places, last = [], [], 0
    for m in pattern.finditer(text):
        piece = new(m)
        out += [text[last : m.start()], piece]
        places += at[last : m.start()]
        # equal lengths keep their places, anything else stands where the match began
        places += at[m.start() : m.end()] if len(piece) == m.end() - m.start() else [at[m.start()]] * len(piece)
        last = m.end()
    return "".join([*out, text[last:]]), places + at[last:]


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words as :func:`words`, and where each begins and ends in the text.

    For the few texts that have a passage; :func:`words` is the fast way.
    """
    t, at = text, list(range(len(text)))
    for _ in range(2):
        t, at = _traced(ENTITY, lambda m: html.unescape(m.group()), t, at)
    t, at = _traced(TAG, lambda m: " ", t, at)
    t, at = _traced(HYPHEN, lambda m: "", t, at)
    look = dict(LOOKALIKE)
    chars, places = [], []
    for c, p in zip(t, at):
        for x in UNSEEN.sub("", unicodedata.normalize("NFKD", c)):
            low = look.get(x, x).lower()
            chars.append(low)
            places += [p] * len(low)
    t, at = _traced(MIXED, _letters, "".join(chars), places)
    found = list(WORD.finditer(t))
    return [m.group() for m in found], [(at[m.start()], at[m.end() - 1] + 1) for m in found]


class Items:
    """A block of items: their words as numbers, laid end to end."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.seqs = [], []
        for item, ws in rows:
            if ws:
                self.ids.append(item)
                # 0 ends a text, 1 is any word that no item has
                self.seqs.append([self.vocab.setdefault(w, len(self.vocab) + 2) for w in ws])
        size = np.array([len(s) for s in self.seqs], np.int64)
        self.size = size
        self.offset = np.concatenate([[0], np.cumsum(size)])
        self.phrase = np.concatenate([np.array(s, np.int64) for s in self.seqs]) if self.seqs else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(size)), size)
        self.start = self.offset[self.owner]
        self.masks: dict[int, dict[int, int]] = {}

    def mask(self, i: int) -> dict[int, int]:
        """Word -> bits of its places in item ``i``."""
        m = self.masks.get(i)
        if m is None:
            m = defaultdict(int)
            for k, w in enumerate(self.seqs[i]):
                m[w] |= 1 << k
            m = self.masks[i] = dict(m)
        return m


def common(mask: dict[int, int], size: int, seq: list[int]) -> int:
    """Length of the longest common subsequence of an item and ``seq``, by bit vectors."""
    full = (1 << size) - 1
    v = full
    for w in seq:
        m = mask.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def common_of_many(items: Items, which: np.ndarray, seqs: list[np.ndarray]) -> np.ndarray:
    """:func:`common` of many sequences at once: all take a step together, the shorter ones end earlier."""
    out = np.zeros(len(seqs), np.int64)
    cells = -(-int(items.size.max()) // 64) if len(items.size) else 1
    base = len(items.vocab) + 2
    group = max(1, TABLE // (base * cells))  # items whose masks are in memory at once
    block = which // group
    for g in np.unique(block):
        own = np.flatnonzero(block == g)
        own = own[np.argsort([-len(seqs[x]) for x in own], kind="stable")]
        low, high = int(g) * group, min(len(items.size), (int(g) + 1) * group)
        masks = np.zeros((high - low, base, cells), np.uint64)
        a, b = items.offset[low], items.offset[high]
        at = np.arange(a, b) - items.start[a:b]
        np.bitwise_or.at(masks, (items.owner[a:b] - low, items.phrase[a:b], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        length = np.array([len(seqs[x]) for x in own])
        words = np.ones((len(own), int(length.max()) if len(own) else 0), np.int64)
        for k, x in enumerate(own):
            words[k, : len(seqs[x])] = seqs[x]
        item = which[own] - low
        v = np.full((len(own), cells), ~np.uint64(0))
        active = len(own) - np.searchsorted(length[::-1], np.arange(words.shape[1]), side="right")
        for t, n in enumerate(active.tolist()):
            m = masks[item[:n], words[:n, t]]
            u = v[:n] & m
            total = v[:n] + u
            carry = total[:, 0] < u[:, 0]
            for c in range(1, cells):
                total[:, c] += carry
                carry = (total[:, c] < u[:, c]) | (carry & (total[:, c] == u[:, c]))
            v[:n] = total | (v[:n] & ~m)
        out[own] = 64 * cells - np.bitwise_count(v).sum(1)
    return out


def longest_run(mask: dict[int, int], seq: list[int]) -> tuple[int, int]:
    """Most consecutive words of an item that ``seq`` has consecutively, and where they end in ``seq``."""
    layers: list[int] = []  # layers[k]: places of the item where a common run of at least k + 1 words ends
    best = end = 0
    for at, w in enumerate(seq, 1):
        m = mask.get(w, 0)
        new = [m] if m else []
        for bits in layers:
            bits = m & (bits << 1)
            if not bits:
                break
            new.append(bits)
        layers = new
        if len(new) > best:
            best, end = len(new), at
    return best, end


def judge(items: Items, i: int, seq: list[int]) -> tuple[int, float, int, int] | None:
    """Exact check of item ``i`` within ``seq``: run, share, and the passage without what can be spared at its ends; None if it is no case."""
    size, mask = int(items.size[i]), items.mask(i)
    run, run_end = longest_run(mask, seq)
    need = SHARE * size
    width = int(np.ceil(STRETCH * size))
    best = a = 0
    if common(mask, size, seq) >= need:
        stops = max(1, len(seq) - width + 1)
        stride = max(1, size // 16)
        starts = [*range(0, stops, stride), stops - 1]
        got = {x: common(mask, size, seq[x : x + width]) for x in starts}
        best, a = max((n, -x) for x, n in got.items())
        a = -a
        # a window a stride further has at most so many words more
        near = {y for x, n in got.items() if best < need <= n + stride for y in range(max(0, x - stride), min(stops, x + stride + 1))}
        if near:
            best, a = max((common(mask, size, seq[x : x + width]), -x) for x in near)
            a = -a
    if best >= need:
        b = min(len(seq), a + width)
        while common(mask, size, seq[a + 1 : b]) == best:
            a += 1
        while common(mask, size, seq[a : b - 1]) == best:
            b -= 1
        return run, best / size, a, b
    return (run, max(best, run) / size, run_end - run, run_end) if run >= RUN else None


def runs(mask: dict[int, int], seq: list[int]) -> Iterator[tuple[int, int, int]]:
    """Every common run of at least ``RUN`` words that can't be extended and lies in no longer one: words, first and end in ``seq``."""
    tail: dict[int, int] = {}  # place of the item where a common run ends -> its words
    longest = []  # most words of a run that ends at each word of seq
    for w in seq:
        m, new = mask.get(w, 0), {}
        while m:
            k = (m & -m).bit_length()
            new[k] = tail.get(k - 1, 0) + 1
            m &= m - 1
        tail = new
        longest.append(max(new.values(), default=0))
    for at, n in enumerate(longest):
        # the run goes on at the next word if that has one more
        if n >= RUN and (at + 1 == len(longest) or longest[at + 1] <= n):
            yield n, at + 1 - n, at + 1


def passages(items: Items, i: int, seq: list[int]) -> Iterator[tuple[int, float, int, int]]:
    """All cases of item ``i`` within ``seq``, like :func:`judge`: share passages beside each other, and every run outside of them."""
    size, mask = int(items.size[i]), items.mask(i)
    todo, whole = [(0, len(seq))], []
    while todo:
        a, b = todo.pop()
        case = judge(items, i, seq[a:b]) if common(mask, size, seq[a:b]) >= SHARE * size else None
        if case and case[1] >= SHARE:
            x, y = a + case[2], a + case[3]
            whole.append((x, y))
            yield case[0], case[1], x, y
            todo += [(a, x), (y, b)]
    for n, x, y in runs(mask, seq):
        if not any(p <= x and y <= q for p, q in whole):
            yield n, n / size, x, y


def merge_spans(item: np.ndarray, doc: np.ndarray, ipos: np.ndarray, dpos: np.ndarray, length: np.ndarray, size: np.ndarray):
    """Hits -> (item, doc, low and high diagonal) of the groups whose spans cover enough of the item.

    Hits of an item and text are sorted by diagonal and split where it jumps.
    """
    diag = dpos - ipos
    order = np.lexsort((ipos, diag, item, doc))
    item, doc, ipos, dpos, length, diag = (x[order] for x in (item, doc, ipos, dpos, length, diag))
    gap = np.maximum(8, size[item] // 6)
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (diag[1:] - diag[:-1] > gap[1:])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(item))
    total = np.add.reduceat(length, start) if len(start) else np.zeros(0, int)
    for a, b in zip(start[total >= COVER], end[total >= COVER]):
        # union of the covered places of the item
        spans = sorted(zip(ipos[a:b].tolist(), length[a:b].tolist()))
        covered, reach = 0, -1
        for s, n in spans:
            if s + n > reach:
                covered += s + n - max(s, reach)
                reach = s + n
        if covered >= COVER:
            yield int(item[a]), int(doc[a]), int(diag[a]), int(diag[b - 1])


def crowded(items: Items, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """Item, text and stretch of all windows that hold as many words of the item, in any order, as its share needs.

    That is necessary for a share case, so none is left out. Windows are whole
    blocks of ``2**BLOCK_BITS`` words, as many as any window of the item's width
    can touch. An occurrence of a word that the item has m times counts in the
    windows that end before the block of the m-th next one; a sum over starts
    and ends of these gives all windows. Those that follow each other closely
    are one stretch, which is cut at the ends of texts.
    """
    if not texts:
        return
    size = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(size)])
    s = np.concatenate([x for t in texts for x in (t, [END])])
    at = np.flatnonzero(s > 1)
    at = at[np.argsort(s[at], kind="stable")] >> BLOCK_BITS
    begin = np.concatenate([[0, 0, 0], np.cumsum(np.bincount(s, minlength=len(items.vocab) + 2)[2:])])
    blocks = (len(s) - 1 >> BLOCK_BITS) + 1
    for i, seq in enumerate(items.seqs):
        need = max(int(np.ceil(SHARE * len(seq))), COVER)
        reach = (int(np.ceil(STRETCH * len(seq))) + (1 << BLOCK_BITS) - 2 >> BLOCK_BITS) + 1
        begun, ended = [], []
        for w, m in Counter(seq).items():
            p = at[begin[w] : begin[w + 1]]
            end = p + reach
            np.minimum(end[:-m], p[m:], out=end[:-m])
            begun.append(p)
            ended.append(end)
        steps = np.bincount(np.concatenate(begun), minlength=blocks) - np.bincount(np.concatenate(ended), minlength=blocks)[:blocks]
        full = np.flatnonzero(np.cumsum(steps) >= need)
        if not len(full):
            continue
        new = np.flatnonzero(np.diff(full, prepend=-reach) > reach // 2)
        for first, last in zip(full[new].tolist(), full[np.append(new[1:], len(full)) - 1].tolist()):
            x, y = max(0, first - reach + 1) << BLOCK_BITS, min(last + 1 << BLOCK_BITS, len(s))
            for d in range(int(np.searchsorted(starts, x, side="right")) - 1, int(np.searchsorted(starts, y, side="left"))):
                a, b = max(x - int(starts[d]), 0), min(y - int(starts[d]), int(size[d]) - 1)
                if b - a >= need:
                    yield i, d, a, b


def windows(bag: Counter, need: int, width: int, seq: list[int]) -> Iterator[tuple[int, int]]:
    """The stretches of one text that windows with at least ``need`` words of a bag make up, each word at most as often as the bag has it."""
    held: dict[int, int] = defaultdict(int)
    have, first, last = 0, None, 0
    for k, w in enumerate(seq):
        if w in bag:
            held[w] += 1
            have += held[w] <= bag[w]
        if k >= width and (w := seq[k - width]) in bag:
            held[w] -= 1
            have -= held[w] < bag[w]
        if have >= need:
            if first is not None and k - last > width:
                yield max(0, first - width + 1), last + 1
                first = None
            first = k if first is None else first
            last = k
    if first is not None:
        yield max(0, first - width + 1), last + 1


def search_shard(items: Items, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, float, int, int]]:
    """Cases in one shard: item, text, run, share, first and last word of the passage."""
    # words that no item has can't match: runs of them shrink to one
    keep_parts, sym_parts, doc_start = [], [], [0]
    for t in texts:
        dull = t == 1
        keep = np.flatnonzero(~(dull & np.concatenate([[False], dull[:-1]])))
        keep_parts.append(np.append(keep, len(t)))
        sym_parts.append(np.append(t[keep], END))
        doc_start.append(doc_start[-1] + len(keep) + 1)
    place = np.concatenate(keep_parts)
    index = FMIndex(np.concatenate(sym_parts), len(items.vocab) + 2)
    ends, length, lo, hi = index.shortest_rare(items.phrase, items.start, 0, RUN, RUN)
    count = hi - lo
    rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = index.locate(rows)
    ends, length = np.repeat(ends, count), np.repeat(length, count)
    starts = np.array(doc_start)
    doc = np.searchsorted(starts, at, side="right") - 1
    item = items.owner[ends]
    ipos = ends - length + 1 - items.offset[item]
    groups = merge_spans(item, doc, ipos, place[at], length, items.size)
    stretches = [(i, d, low - int(items.size[i]) // 4 - 4, high + int(items.size[i]) * 5 // 4 + 4) for i, d, low, high in groups]
    found: dict[tuple[int, int], set[tuple[int, float, int, int]]] = defaultdict(set)
    # runs are in the stretches of the index, so of the others only those with a share matter
    many = list(crowded(items, texts))
    which = np.array([i for i, *_ in many], np.int64)
    in_order = common_of_many(items, which, [texts[d][a:b] for _, d, a, b in many])
    # the few texts that are left are looked at word by word
    for i, d in sorted({many[k][:2] for k in np.flatnonzero(in_order >= SHARE * items.size[which])}):
        size, seq = int(items.size[i]), texts[d].tolist()
        for a, b in windows(Counter(items.seqs[i]), max(int(np.ceil(SHARE * size)), COVER), int(np.ceil(STRETCH * size)), seq):
            if common(items.mask(i), size, seq[a:b]) >= SHARE * size:
                stretches.append((i, d, a, b))
    for i, d, a, b in stretches:
        a, seq = max(0, a), texts[d]
        for run, share, x, y in passages(items, i, seq[a:b].tolist()):
            found[i, d].add((run, share, a + x, a + y))
    for (i, d), cases in found.items():
        last = -1
        # one that lies within another is not told again
        for run, share, a, b in sorted(cases, key=lambda c: (c[2], -c[3], -c[1])):
            if b > last:
                last = b
                yield i, d, run, share, a, b


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: bool = True) -> DataFrame:
    """Every passage that a document and an item share; those of one item can overlap, but none lies within another.

    ``item_id``, ``doc_id``, ``run`` (longest common run of words), ``share``
    (of the item's words found in order), and the passage as ``first_char``
    and ``last_char``, counted from 0 in the original text, both included.
    Without ``places`` these two are NULL, which saves tracing the words back.

    The items are the query set. They are read in blocks of at most
    ``BLOCK_WORDS`` words, one pass over the corpus each, so what is sent to
    the executors is bounded whatever the number of items.

    Defined cases: NULL and empty texts share nothing; repeated items or
    documents give one row each passage; items without words are skipped; empty
    tables give an empty result; other columns are dropped. A text of any
    length is searched whole: a large one is a shard of its own, a very large
    one several shards that overlap by more than any passage.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    corpus = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in item_blocks(items):
        part = corpus.mapInArrow(
            _searcher(block, places), f"item_id long, doc_id {kind}, run int, share double, first_char long, last_char long"
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], f"item_id long, doc_id {kind}, run int, share double, first_char long, last_char long"
        )
    return out.distinct()


def item_blocks(items: DataFrame) -> Iterator[Items]:
    rows, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null").distinct().toLocalIterator():
        ws = words(r["text"])
        if rows and size + len(ws) > BLOCK_WORDS:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r["item_id"], ws))
        size += len(ws)
    if rows:
        block = Items(rows)
        if block.ids:
            yield block


def _searcher(items: Items, places: bool):
    # a text longer than two shards is cut; the parts share enough for any passage to lie in one
    shared = 4 * int(items.size.max()) + 64

    def parts(seq: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        at = 0
        while len(seq) - at > 2 * SHARD_WORDS:
            yield at, seq[at : at + SHARD_WORDS + shared]
            at += SHARD_WORDS
        yield at, seq[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.vocab.get

        def flush(shard: list[tuple]) -> pa.RecordBatch:
            rows = []
            spans: dict[int, list[tuple[int, int]]] = {}
            for i, d, run, share, a, b in search_shard(items, [s for _, _, s, _ in shard]):
                doc, base, _, text = shard[d]
                if places and d not in spans:
                    spans[d] = word_spans(text)[1]
                at = (spans[d][base + a][0], spans[d][base + b - 1][1] - 1) if places else (None, None)
                rows.append((items.ids[i], doc, run, share, *at))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), key, pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["item_id", "doc_id", "run", "share", "first_char", "last_char"]
            )

        shard: list[tuple] = []
        size = 0
        key = pa.int64()
        for b in batches:
            key = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seq = np.array([get(w, 1) for w in words(text)], np.int64)
                for at, part in parts(seq):
                    shard.append((doc, at, part, text))
                    size += len(part)
                    if size >= SHARD_WORDS:
                        yield flush(shard)
                        shard, size = [], 0
        if shard:
            yield flush(shard)

    return run


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the passages of ``spans`` (``doc_id``, ``first_char``, ``last_char``, not overlapping).

    Documents without a passage stay as they are. The spans of a document are
    gathered into one array; there is at most one for each item.
    """
    cuts = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("first_char", "last_char"))).alias("__cuts"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def cut(acc, c):
        kept = F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (c["first_char"] - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["text"], kept).alias("text"), (c["last_char"] + 1).alias("at"))

    def rest(acc):
        return F.concat(acc["text"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.length(text_col)))

    clean = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.aggregate("__cuts", start, cut, rest))
    joined = docs.join(cuts, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn(text_col, clean).drop("__id", "__cuts")
