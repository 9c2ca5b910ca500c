"""Spelling variant grouping: a frequency-vector trie, searched with a budget of one surplus and one deficit.

A word is the vector of its letter-group counts (one group for each of a-z, four for all other letters). The
vectors form a trie: one level a group, one edge a count. One inserted, deleted or replaced letter
changes a vector by at most one more in one group and one less in another, so near words end in
leaves whose paths differ by no more than that. The trie is joined with itself depth first: a
pair of nodes spawns the pairs of their children with equal counts and with counts that differ by one, spends the surplus
or the deficit for the latter, and is dropped when one of them is used up. The words of a pair of leaves are
verified letter by letter.

The upper part of the trie is walked as a DataFrame, ``STEP`` groups a round, until both nodes of a pair hold
at most ``leaf`` words; the lower part of each pair of nodes is walked in a task of its own, over
slices of bounded length. A task returns per word the number of near words it met and the most frequent one, no pairs;
every pair is met once, so these add up.

Before that the words are counted: one aggregate with partial sums, so a word that a third of the texts hold is no
hot key. Forms are followed to their roots by doubling; frequencies grow along a chain at least ``ratio`` times a step, so chains
are short and have no circles.

Defined results: a null text has no words; a null id is empty before the colon; an id's text is its cast to string; repeated
rows count as often as they stand; words below the least length or count are in no result; of
near words with the same count the least in code-point order is the form; an empty table gives an empty
result; other columns are ignored. Words of any length are verified whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import spread
from .common import ascii_lower, pinned

LETTERS = "A-Za-zÀ-ÿ"
DIVISOR = 199  # one occurrence in so many loses a letter
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
GROUPS = "etaoinshrdlucmfwypvbgkjqxz"  # one level each, frequent letters first; then OTHERS levels for all other letters
OTHERS = 4
DEPTH = len(GROUPS) + OTHERS
STEP = 2
LEAF = 16_384  # words of a trie node that a task walks by itself
SLICE = 1 << 18  # node pairs or word pairs handled at once


# ------------------------------------------------------------------ words and their counts
def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """(word, n): the runs of letters, where the checksum of id and run says so without one of its letters."""
    thin = spread(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                              ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")))
    runs = thin.select("id", F.explode(F.split("text", f"[^{LETTERS}]+")).alias("run")).filter("run <> ''")
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequency_vector(word: str = "word"):
    """The counts of the letter groups in the order of the trie's levels, as a string of one code point a level."""
    w = F.col(word)
    n = F.char_length(w)
    counts = [n - F.char_length(F.replace(w, F.lit(c))) for c in GROUPS]
    rest = F.regexp_replace(w, "[a-z]+", "")
    others = [F.char_length(rest) - F.char_length(F.regexp_replace(rest, f"[{_class(k)}]+", "")) for k in range(OTHERS)]
    return F.array(*counts, *others)


def _class(k: int) -> str:
    return "".join(chr(c) for c in range(0xC0, 0x100) if c % OTHERS == k)


# ------------------------------------------------------------------ inside a task
class Trie:
    """Nodes of the sorted, distinct vectors: per level the first child of every node, and children by (parent, count)."""

    def __init__(self, vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1]) if vectors.shape[1] else np.arange(len(vectors))
        self.order, v = order, vectors[order]
        node = np.zeros(len(v), np.int64)
        self.levels = []
        self.most = int(v.max(initial=0)) + 2
        for d in range(v.shape[1]):
            key = node * self.most + v[:, d]
            kids, node = np.unique(key, return_inverse=True)  # sorted by parent, then count
            parents = int(kids[-1] // self.most) + 1 if len(kids) else 0
            self.levels.append((kids, np.searchsorted(kids, np.arange(parents + 1) * self.most)))
        self.leaf_start = np.searchsorted(node, np.arange(int(node.max(initial=-1)) + 2))


def leaf_pairs(a: Trie, b: Trie, same: bool, surplus: int = 0, deficit: int = 0,
               slice_len: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves whose vectors differ by at most one more and one less, of which ``surplus`` and
    ``deficit`` are spent; with ``same`` (one trie) each pair once."""
    zero = np.zeros(1, np.int64)
    stack = [(0, (zero, zero, zero + surplus, zero + deficit))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > slice_len:
            half = len(pairs[0]) // 2
            stack += [(depth, tuple(x[half:] for x in pairs)), (depth, tuple(x[:half] for x in pairs))]
            continue
        left, right, more, less = pairs
        if depth == len(a.levels):
            yield left, right
            continue
        (akids, afirst), (bkids, _) = a.levels[depth], b.levels[depth]
        n = afirst[left + 1] - afirst[left]
        of = np.repeat(np.arange(len(left)), n)
        kid = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + afirst[left][of]
        count = akids[kid] % a.most
        out = []
        for step in (0, 1, -1):
            want = right[of] * b.most + count + step
            ok = (count + step >= 0) & (count + step < b.most)
            if step == 1:
                ok &= more[of] == 0
            elif step == -1:
                ok &= less[of] == 0
            at = np.minimum(np.searchsorted(bkids, want), len(bkids) - 1)
            ok &= bkids[at] == want
            if same:
                ok &= kid <= at  # the mirror pair is walked instead
            out.append((kid[ok], at[ok], more[of][ok] + (step == 1), less[of][ok] + (step == -1)))
        pairs = tuple(np.concatenate(x) for x in zip(*out))
        if len(pairs[0]):
            stack.append((depth + 1, pairs))


class Words:
    """Words as flat code points."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)


def _one_apart(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """True where the words differ by exactly one inserted, deleted or replaced letter."""
    la, lb = a.size[i], b.size[j]
    near = np.zeros(len(i), bool)
    todo = np.flatnonzero(np.abs(la - lb) <= 1)
    for size in np.unique(np.minimum(la, lb)[todo]).tolist():
        every = todo[np.minimum(la, lb)[todo] == size]
        for at in range(0, len(every), max(1, SLICE * 16 // (size + 1))):
            some = every[at:at + max(1, SLICE * 16 // (size + 1))]
            step = np.arange(size)
            sa, sb = a.start[i[some]], b.start[j[some]]
            ahead = a.flat[sa[:, None] + step] == b.flat[sb[:, None] + step]
            back = a.flat[(sa + la[some])[:, None] - 1 - step] == b.flat[(sb + lb[some])[:, None] - 1 - step]
            same = la[some] == lb[some]
            first = np.logical_and.accumulate(ahead, axis=1).sum(1)
            last = np.logical_and.accumulate(back, axis=1).sum(1)
            near[some] = np.where(same, ahead.sum(1) == size - 1, first + last >= size)
    return near


def _near(group: pd.DataFrame) -> pd.DataFrame:
    """Near words between the two nodes of a pair (side 0, 1; a node paired with itself has side 0 only): per word
    their number and the most frequent."""
    sides = []
    for s in (0, 1):
        part = group[group["side"] == s].sort_values("word")  # the order of code points
        depth = int(group["depth"].iloc[0])
        vectors = np.array(part["vec"].tolist(), np.int64).reshape(len(part), DEPTH)[:, depth:]
        trie = Trie(vectors)
        word = part["word"].to_numpy()[trie.order]
        sides.append((trie, word, part["n"].to_numpy()[trie.order], Words(word.tolist())))
    same = not len(sides[1][1])
    if same:
        sides[1] = sides[0]
    (a, aword, an, aflat), (b, bword, bn, bflat) = sides
    found = [[], []]
    spent = group.iloc[0]
    for left, right in leaf_pairs(a, b, same, int(spent["more"]), int(spent["less"])):
        # the words of the two leaves, in slices
        na, nb = np.diff(a.leaf_start)[left], np.diff(b.leaf_start)[right]
        ends = np.cumsum(na * nb)
        at, total = 0, int(ends[-1]) if len(ends) else 0
        while at < total:
            k = np.arange(at, min(total, at + SLICE))
            p = np.searchsorted(ends, k, side="right")
            inner = k - (ends[p] - na[p] * nb[p])
            i, j = a.leaf_start[left[p]] + inner // nb[p], b.leaf_start[right[p]] + inner % nb[p]
            if same:
                once = i < j
                i, j = i[once], j[once]
            ok = _one_apart(aflat, i, bflat, j)
            found[0].append(i[ok])
            found[1].append(j[ok])
            at += SLICE
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    word = np.concatenate([aword[i], bword[j]])
    other = np.concatenate([bword[j], aword[i]])
    n = np.concatenate([bn[j], an[i]])
    pairs = pd.DataFrame({"word": word, "other": other, "n": n}).sort_values(["word", "n", "other"], ascending=[True, False, True])
    out = pairs.groupby("word", sort=False).agg(n_near=("other", "size"), best=("other", "first"), best_n=("n", "first"))
    return out.reset_index()


# ------------------------------------------------------------------ the upper trie, as DataFrames
def _node(depth: int):
    return F.slice("vec", 1, depth) if depth else F.array().cast("array<int>")


def near_words(words: DataFrame, leaf: int = LEAF, step: int = STEP) -> DataFrame:
    """(word, n_near, best, best_n) for every word with a near word, from (word, n) with distinct words."""
    points = pinned(words.select("word", "n", frequency_vector().alias("vec")))
    zero = F.lit(0)
    front = points.groupBy().agg(F.count(F.lit(1)).alias("na")).select(
        _node(0).alias("pa"), _node(0).alias("pb"), zero.alias("more"), zero.alias("less"), "na", F.col("na").alias("nb"))
    front, depth, done = pinned(front.filter("na > 0")), 0, []
    while True:
        small = (F.col("na") <= leaf) & (F.col("nb") <= leaf) if depth < DEPTH else F.lit(True)
        done.append(front.filter(small).select(F.lit(depth).alias("depth"), "pa", "pb", "more", "less"))
        front = front.filter(~small)
        if depth >= DEPTH or front.isEmpty():
            break
        deeper = min(DEPTH, depth + step)
        kids = points.groupBy(_node(deeper).alias("kid")).agg(F.count(F.lit(1)).alias("n"))
        kids = pinned(kids.withColumn("parent", F.slice("kid", 1, depth) if depth else _node(0)))
        left = kids.select(F.col("parent").alias("pa"), F.col("kid").alias("ka"), F.col("n").alias("na"))
        right = kids.select(F.col("parent").alias("pb"), F.col("kid").alias("kb"), F.col("n").alias("nb"))
        change = F.zip_with(F.slice("kb", depth + 1, step), F.slice("ka", depth + 1, step), lambda y, x: y - x)
        front = (front.select("pa", "pb", "more", "less").join(left, "pa").join(right, "pb")
                 .withColumn("more", F.col("more") + F.aggregate(change, F.lit(0), lambda s, c: s + F.greatest(c, F.lit(0))))
                 .withColumn("less", F.col("less") + F.aggregate(change, F.lit(0), lambda s, c: s + F.greatest(-c, F.lit(0))))
                 .filter("more <= 1 and less <= 1 and (pa < pb or (pa = pb and ka <= kb))")
                 .select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), "more", "less", "na", "nb"))
        front, depth = pinned(front), deeper
    pairs = done[0]
    for others in done[1:]:
        pairs = pairs.unionByName(others)
    pairs = pinned(pairs.withColumn("pair", F.monotonically_increasing_id()))
    ends = pairs.select("pair", "depth", "more", "less", F.col("pa").alias("node"), zero.alias("side")).unionByName(
        pairs.filter("pa <> pb").select("pair", "depth", "more", "less", F.col("pb").alias("node"), F.lit(1).alias("side")))
    placed = points.withColumn("depth", F.explode(F.lit(sorted({*range(0, depth, step), depth}))))
    placed = placed.withColumn("node", F.when(F.col("depth") == 0, _node(0)).otherwise(F.slice("vec", F.lit(1), F.col("depth"))))
    return (placed.join(ends, ["depth", "node"]).select("pair", "depth", "more", "less", "side", "word", "n", "vec")
            .groupBy("pair").applyInPandas(_near, "word string, n_near bigint, best string, best_n bigint")
            .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
            .select("word", "n_near", "b.best", (-F.col("b.less")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms lead to, from (word, form), by doubling."""
    at = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = pinned(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")))
        at = after.drop("moved")
        if after.filter("moved").isEmpty():
            return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                    least_count: int = LEAST_COUNT, ratio: int = RATIO, divisor: int = DIVISOR, leaf: int = LEAF,
                    step: int = STEP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts that is long and frequent enough."""
    words = pinned(word_counts(docs, id_col, text_col, divisor)
                   .filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count)))
    near = pinned(near_words(words, leaf, step))
    known = words.join(near, "word", "left")
    formed = F.col("best_n") >= ratio * F.col("n")
    known = known.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(formed, F.col("best_n")).alias("form_n"))
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
