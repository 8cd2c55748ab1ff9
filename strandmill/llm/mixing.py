"""Mixtures of sources by target weights, sized in tokens.

The targets hang on a tree of domains, languages and sources. Weights go down
the tree as token budgets; what a leaf can't fill, even with the repeats it is
allowed, goes first to its siblings and only then to the next ancestor's other
branches. A leaf then takes whole epochs of its documents and a token-prefix of
the next epoch's seeded order.

The tree is small (targets times languages) and is solved on the driver; the
documents never leave the executors. A leaf's prefix is found without sorting
the leaf: its documents fall into equal stretches of the hash range that orders
them, about as many as the root of their number, token sums per stretch tell the
one that holds the cut, and only that stretch is ordered. So a leaf of a billion
documents has windows of some 32,000 rows.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: stretches of a leaf whose number of documents is not told
BLOCKS = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the byte-level vocabulary splits texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: texts are encoded in pieces of about this many characters, cut before a blank that follows a letter
PIECE = 100_000


def vocabulary(path: str) -> bytes:
    """The vocabulary file, as the driver has it; it is sent to the executors, which need no such file."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(path: str, pattern: str, ranks_file: bytes | None = None):
    """The tokenizer, made once per Python worker."""
    import sys
    import types

    kept = sys.modules.setdefault("_strandmill_tokenizers", types.ModuleType("_strandmill_tokenizers"))
    if path not in kept.__dict__:
        import tiktoken

        lines = (vocabulary(path) if ranks_file is None else ranks_file).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept.__dict__[path] = tiktoken.Encoding("mill", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept.__dict__[path]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut a long text where the token count does not depend on what follows: before a single blank after a letter."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        yield text[at:cut] if cut < len(text) - 1 else text[at:]
        at = cut if cut < len(text) - 1 else len(text)
    if at < len(text):
        yield text[at:]


def count_tokens(df: DataFrame, text: str = "text", path: str = TOKENIZER, pattern: str = SPLIT) -> DataFrame:
    """``df`` with ``text`` replaced by ``n_tokens``, its size in tokens; NULL texts have none."""
    at = df.columns.index(text)
    names = [c if c != text else "n_tokens" for c in df.columns]
    kinds = ", ".join(f"`{n}` {'long' if i == at else f.dataType.simpleString()}" for i, (n, f) in enumerate(zip(names, df.schema.fields)))

    handle = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # a fixed file of about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern, handle.value).encode_ordinary
        for b in batches:
            sizes = []
            for t in b.column(at).to_pylist():
                if not t:
                    sizes.append(0)
                elif len(t) <= PIECE:
                    sizes.append(len(encode(t)))
                else:
                    sizes.append(sum(len(encode(p)) for p in pieces(t)))
            cols = [pa.array(sizes, pa.int64()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, kinds)


# -- budgets -----------------------------------------------------------------
@dataclass
class Node:
    """A node of the tree; leaves have a weight and a capacity in tokens."""

    weight: float = 0.0
    capacity: float = 0.0
    kids: dict = field(default_factory=dict)
    budget: float = 0.0

    def total(self) -> None:
        if self.kids:
            for k in self.kids.values():
                k.total()
            self.weight = sum(k.weight for k in self.kids.values())
            self.capacity = sum(k.capacity for k in self.kids.values())


def share_out(amount: float, kids: list[Node]) -> list[float]:
    """Split ``amount`` by weight; what exceeds a capacity goes to the others by weight, until all are full."""
    got = [0.0] * len(kids)
    open_ = [i for i, k in enumerate(kids) if k.capacity > 0 and k.weight > 0]
    left = amount
    while open_ and left > 1e-9:
        total = sum(kids[i].weight for i in open_)
        over = [i for i in open_ if got[i] + left * kids[i].weight / total >= kids[i].capacity]
        if not over:
            for i in open_:
                got[i] += left * kids[i].weight / total
            break
        for i in over:
            left -= kids[i].capacity - got[i]
            got[i] = kids[i].capacity
        open_ = [i for i in open_ if i not in set(over)]
    return got


def allot(node: Node, amount: float) -> None:
    """Budgets from the root down. A branch gets no more than its leaves can fill, so a
    shortage below a node is spread among that node's own branches before it reaches its parent."""
    node.budget = min(amount, node.capacity)
    kids = list(node.kids.values())
    for k, b in zip(kids, share_out(node.budget, kids)):
        allot(k, b)


def budgets(
    targets: list[dict], sizes: dict[tuple[str, str], int], domain_of, total: int, documents: dict[tuple[str, str], int] | None = None
) -> list[dict]:
    """Token budgets of the leaves of every plan.

    ``targets``: ``plan_id source target_share max_repeats size_ratio``;
    ``sizes``: tokens by (source, language); ``domain_of``: source -> domain.
    A source's weight is split over its languages in proportion to their
    tokens. A source without documents keeps its weight in its domain, as a
    leaf that can fill nothing, so its siblings take over its share; it has no
    row in the result. With ``documents``, their numbers, the leaves tell into
    how many stretches they are cut (``bits``).
    """
    plans = defaultdict(list)
    for t in targets:
        plans[t["plan_id"]].append(t)
    out = []
    for plan, rows in sorted(plans.items()):
        root = Node()
        leaves = []
        for t in rows:
            langs = {lang: n for (s, lang), n in sizes.items() if s == t["source"] and n > 0}
            have = sum(langs.values())
            domain = root.kids.setdefault(domain_of(t["source"]), Node())
            if not langs:
                domain.kids.setdefault("", Node()).kids[t["source"]] = Node(t["target_share"], 0.0)
            for lang, n in sorted(langs.items()):
                leaf = Node(t["target_share"] * n / have, float(n) * t["max_repeats"])
                domain.kids.setdefault(lang, Node()).kids[t["source"]] = leaf
                leaves.append((t, lang, n, leaf))
        root.total()
        allot(root, max(t["size_ratio"] for t in rows) * total)
        for t, lang, n, leaf in leaves:
            epochs = min(int(leaf.budget // n), t["max_repeats"])
            docs = (documents or {}).get((t["source"], lang), BLOCKS**2)
            out.append(
                {
                    "plan_id": plan, "source": t["source"], "lang": lang, "budget": leaf.budget, "epochs": epochs,
                    "rest": max(0.0, leaf.budget - epochs * n) if epochs < t["max_repeats"] else 0.0, "bits": max(1, docs.bit_length() // 2),
                }
            )
    return out


# -- selection ---------------------------------------------------------------
def pick(sized: DataFrame, leaves: DataFrame, seed: int = 0, blocks: int | None = None) -> DataFrame:
    """Chosen documents with ``repeats``: whole epochs, and one more within the token-prefix.

    ``sized``: ``doc_id source lang n_tokens``; ``leaves``: the rows of
    :func:`budgets`, which the planner broadcasts, as their number is that of
    the targets times languages and their size is known. A document is within the
    prefix while the larger part of it fits the rest of the budget, so a leaf
    misses its budget by less than half a document. A leaf is cut into ``2**bits``
    stretches, or ``blocks`` (a power of two).
    """
    if blocks is not None or "bits" not in leaves.columns:
        leaves = leaves.withColumn("bits", F.lit((blocks or BLOCKS).bit_length() - 1))
    order = F.xxhash64("doc_id", "plan_id", "epochs", F.lit(seed))
    docs = (
        sized.where("n_tokens > 0")
        .join(leaves, ["source", "lang"])
        .withColumn("__h", order)
        .withColumn("__b", F.expr("pmod(shiftright(__h, 64 - bits), shiftleft(1L, bits))"))
    )
    leaf = ["plan_id", "source", "lang"]
    sums = docs.where("rest > 0").groupBy(*leaf, "__b").agg(F.sum("n_tokens").alias("__n"), F.first("rest").alias("__rest"))
    upto = F.sum("__n").over(Window.partitionBy(*leaf).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    # one row per leaf: the stretch with the cut, and the tokens before it
    cut = (
        sums.withColumn("__to", upto)
        .where(F.col("__to") - F.col("__n") <= F.col("__rest"))
        .groupBy(*leaf)
        .agg(F.max_by("__b", "__b").alias("__cut"), F.max_by(F.col("__to") - F.col("__n"), "__b").alias("__before"))
    )
    cuts = sized.sparkSession.createDataFrame([tuple(r) for r in cut.collect()], cut.schema)
    placed = docs.join(cuts, leaf, "left")
    whole = (F.col("__b") < F.col("__cut")) & (F.col("rest") > 0)
    at_cut = (F.col("__b") == F.col("__cut")) & (F.col("rest") > 0)
    # only the stretch with the cut is ordered; all other rows stay where they are
    sure = placed.where(~F.coalesce(at_cut, F.lit(False))).withColumn("__more", F.coalesce(whole, F.lit(False)).cast("int"))
    run = F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    close = placed.where(at_cut).withColumn("__run", run)
    fits = F.col("__before") + F.col("__run") - F.col("n_tokens") / 2 <= F.col("rest")
    close = close.withColumn("__more", fits.cast("int")).drop("__run")
    both = sure.unionByName(close)
    return both.select(*leaf, "doc_id", "n_tokens", (F.col("epochs") + F.col("__more")).alias("repeats")).where("repeats > 0")


def spelling(c: Column) -> Column:
    """A source's name without regard to case and blanks."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def domain_of(source: str, domains: dict[str, str] | None = None) -> str:
    """The domain of a source: as a table of domains states it, else its name up to the first underscore."""
    return (domains or {}).get(source) or source.split("_", 1)[0]
