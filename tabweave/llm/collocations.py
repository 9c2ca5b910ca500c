"""Phrase collocation mining: multikey three-way quicksort of suffix pointers.

Every word of a piece begins a suffix: that word and those after it, up to the depth
(``most`` words), to the end of the piece, and before the first word that is too rare
to stand in any result. Suffixes are routed to tasks by their leading words: ranges of
word sequences, cut where a sample of the suffixes says, so that those with the same
beginning are neighbours, and a beginning that a third of all rows share spans many
ranges; so does a single suffix that fills several (its rows are dealt over them). In a task
the suffixes lie as rows of word codes and a multikey quicksort moves pointers to
them: three-way split at one word, the equal part goes on with the next word, and its
size is the count of the phrase. A part smaller than ``least`` is abandoned with all it
holds. Only the beginnings of a task's least and greatest suffix can go on in another
task; their counts leave the task whatever their size and are added up. The sample
decides where suffixes meet, never what is counted.

Before that, one pass counts the words of each language. The frequent ones are
marked in a bitmap of ``2 ** FILTER_BITS`` bits by their hash: its size is fixed, and a
word that shares a bit with a frequent one costs time, not correctness. In a map
task the suffixes of some megabytes of text are sorted and combined, and leave it as one
row a range: a list of words and a matrix of their codes.

Scores are exact: products in ``decimal(38)``, cut off by integral division.

Defined results: a null text is empty; a null language is ``und``; pieces and words
are those of the contract (white space other than space and tab belongs to words or
ends pieces); a repeated row counts as often as it stands there; languages without
a candidate have no rows; an empty table gives an empty result; other columns are
ignored. Ties in score and count go by the phrase in UTF-8 byte order.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import spread
from .common import map_batches, pinned, utf8
from .suffix_dedup import _stored

MOST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2_000  # phrases a language
FILTER_BITS = 26
PIECE = 1 << 23  # bytes of text that a map task combines at once
ROWS = 1_000_000  # suffixes of one sorting task
SAMPLED = 64  # suffixes a range that place the cuts
SALTS = 64  # tasks that pick the first phrases of one language

_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c for c in range(256))

_PIECE_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


# ------------------------------------------------------------------ words of a batch
def _escaped(word: bytes) -> bytes:
    """A word without zero bytes, which separate the words of a key."""
    return word.replace(b"\1", b"\1\2").replace(b"\0", b"\1\3") if b"\0" in word or b"\1" in word else word


def _coded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Word codes of the texts, -1 between pieces, and the escaped words they stand for."""
    joined = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    tokens = pa.array(joined.split(b" "), pa.large_binary()).dictionary_encode()
    words = tokens.dictionary.to_pylist()
    codes = tokens.indices.to_numpy()
    of = {w: i for i, w in enumerate(words)}
    if b"" in of:
        codes = codes[codes != of[b""]]
    if b"\n" in of:
        codes = np.where(codes == of[b"\n"], -1, codes)
    return codes, [_escaped(w) for w in words]


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``PIECE`` bytes, cut where a piece ends."""
    at = 0
    while len(text) - at > PIECE and (end := _PIECE_END.search(text, at + PIECE)):
        yield text[at:end.start()]
        at = end.end()
    yield text[at:]


def _shares(texts: list[bytes], langs: list[str | None]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts of one language, some ``PIECE`` bytes at a time."""
    held: dict[bytes, list] = {}
    for text, lang in zip(texts, langs):
        key = _escaped((lang if lang is not None else "und").encode())
        for chunk in _chunks(text):
            part = held.setdefault(key, [0])
            part.append(chunk)
            part[0] += len(chunk)
            if part[0] >= PIECE:
                yield key, held.pop(key)[1:]
    for key, part in held.items():
        yield key, part[1:]


def _thin(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return spread(docs.select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(key, a): the count of every word of every language; a key is the language and the words of a phrase, with
    a zero byte between them."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, counts = [], []
            for lang, texts in _shares(utf8(batch.column("_text")), batch.column("_lang").to_pylist()):
                codes, words = _coded(texts)
                n = np.bincount(codes[codes >= 0], minlength=len(words))
                on = np.flatnonzero(n)
                keys += [lang + b"\0" + words[i] for i in on.tolist()]
                counts += n[on].tolist()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["key", "a"])

        return turn

    return map_batches(_thin(docs, text_col, lang_col), make, "key binary, a bigint").groupBy("key").agg(F.sum("a").alias("a"))


def frequent_bits(counts: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for every slot that the key of a frequent word falls into: ``2 ** bits / 8`` bytes, whatever the vocabulary."""
    slot = (F.xxhash64("key").bitwiseAND((1 << bits) - 1) + 1).alias("slot")
    parts = (counts.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("nth"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("part")).collect())  # 4 KB a row
    out = np.zeros(1 << bits, np.uint8)
    for row in parts:
        at = (row["nth"] - 1) * 32_768
        part = np.unpackbits(np.frombuffer(bytes(row["part"]), np.uint8), bitorder="little")
        out[at:at + 32_768] = part[:len(out) - at]
    return np.packbits(out)


def _codes_of(lang: bytes, texts: list[bytes], bits: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Word codes of the texts in the byte order of their words, -1 between pieces and for words that are not frequent."""
    codes, words = _coded(texts)
    mask = len(bits) * 8 - 1
    slots = np.array([xxhash.xxh64_intdigest(lang + b"\0" + w, 42) & mask for w in words] or [0], np.int64)
    often = np.flatnonzero((bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1) if words else np.zeros(0, np.int64)
    kept = sorted((words[i], i) for i in often.tolist())
    rank = np.full(len(words) + 1, -1, np.int64)  # the last one is for -1
    rank[[i for _, i in kept]] = np.arange(len(kept))
    return rank[codes], [w for w, _ in kept]


def _distinct(codes: np.ndarray, most: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of two or more words in order, as rows of codes filled up with -1, and their counts."""
    n = len(codes)
    padded = np.concatenate([codes, np.full(most, -1, codes.dtype)])
    starts = np.flatnonzero((padded[:n] >= 0) & (padded[1:n + 1] >= 0))
    rows = np.empty((len(starts), most), np.int32)
    ended = np.zeros(len(starts), bool)
    for d in range(most):
        word = padded[starts + d]
        ended |= word < 0
        rows[:, d] = np.where(ended, -1, word)
    # as many columns as fit become one key
    each, base = max(1, int(62 // np.log2(n_words + 2))), n_words + 1
    keys = []
    for at in range(0, most, each):
        key = np.zeros(len(rows), np.int64)
        for d in range(at, min(at + each, most)):
            key = key * base + rows[:, d] + 1
        keys.append(key)
    rows = rows[np.lexsort(keys[::-1])]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    return rows[first], np.diff(np.append(first, len(rows)))


def cuts_of(docs: DataFrame, bitmap: np.ndarray, total: int, parts: int, most: int = MOST, text_col: str = "text",
            lang_col: str = "lang", seed: int = 7) -> list[tuple[bytes, tuple[bytes, ...]]]:
    """At most ``parts - 1`` ascending (language, words), from about ``SAMPLED * parts`` suffixes of some documents."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    share = min(1.0, 8 * SAMPLED * parts / max(1, total))  # of the documents; of their suffixes every eighth or fewer
    every = max(1, int(total * share) // (SAMPLED * parts))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, keys = [], []
            for lang, texts in _shares(utf8(batch.column("_text")), batch.column("_lang").to_pylist()):
                codes, words = _codes_of(lang, texts, sent.value)
                # cut as often as they occur: combined suffixes count once a piece, as they do when shuffled
                rows, _ = _distinct(codes, most, len(words))
                for row in rows[every // 2::every].tolist():
                    langs.append(lang)
                    keys.append([words[i] for i in row if i >= 0])
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()), pa.array(keys, pa.list_(pa.binary()))], names=["lang", "key"])

        return turn

    some = _thin(docs.sample(share, seed) if share < 1 else docs, text_col, lang_col)
    got = map_batches(some, make, "lang binary, key array<binary>").collect()  # some SAMPLED * parts keys
    keys = sorted((bytes(r["lang"]), tuple(bytes(w) for w in r["key"])) for r in got)
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def suffixes(docs: DataFrame, bitmap: np.ndarray, cuts: list[tuple[bytes, tuple[bytes, ...]]], most: int = MOST,
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(part, lang, words, codes, n): the suffixes of two or more words that may be frequent, one row for each
    piece and range. ``codes`` is a matrix of ``most`` columns, one column after the other, of places in ``words``."""
    sent = docs.sparkSession.sparkContext.broadcast((bitmap, cuts))  # 2 ** FILTER_BITS bits, and a key a range

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        (bits, cuts), salt = sent.value, TaskContext.get().partitionId() * 1009

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal salt
            out = []
            for lang, texts in _shares(utf8(batch.column("_text")), batch.column("_lang").to_pylist()):
                codes, words = _codes_of(lang, texts, bits)
                rows, n = _distinct(codes, most, len(words))
                salt += 1
                for part, lo, hi in _ranges(lang, rows, words, cuts, salt):
                    some = rows[lo:hi]
                    used = np.flatnonzero(np.bincount(some[some >= 0], minlength=len(words)))
                    place = np.searchsorted(used, some) + 1
                    place[some < 0] = 0
                    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                    out.append((part, lang, b"\0".join([words[i] for i in used.tolist()]), place.T.astype(kind).tobytes(),
                                n[lo:hi].astype(np.uint32).tobytes()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "lang", "words", "codes", "n"])

        return turn

    return map_batches(_thin(docs, text_col, lang_col), make, "part int, lang binary, words binary, codes binary, n binary")


def _ranges(lang: bytes, rows: np.ndarray, words: list[bytes], cuts: list, salt: int) -> Iterator[tuple[int, int, int]]:
    """(range, first row, row after the last) of the sorted rows; rows equal to several cuts go to one of the ranges between."""

    def key(i: int) -> tuple[bytes, tuple[bytes, ...]]:
        return lang, tuple(words[c] for c in rows[i].tolist() if c >= 0)

    at, end = 0, len(rows)
    part = bisect_left(cuts, key(0)) if end else 0
    while at < end:
        if part < len(cuts) and cuts[part] == key(at):  # one row, and as many ranges as cuts like it and the next
            last = bisect_right(cuts, cuts[part])
            yield part + salt % (last - part + 1), at, at + 1
            at, part = at + 1, last
            continue
        upto = bisect_left(range(end), cuts[part], lo=at, key=key) if part < len(cuts) else end
        if upto > at:
            yield part, at, upto
        at = upto
        if at < end and key(at) != cuts[part]:
            part = bisect_left(cuts, key(at))


# ------------------------------------------------------------------ inside a sorting task
def sorted_counts(codes: np.ndarray, weight: np.ndarray, least: int, shared: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(a row, words, count) of every beginning of two or more words whose rows weigh ``least`` or more.

    ``codes`` has one row a suffix, -1 beyond its end. Beginnings of the rows in ``shared`` are left to the caller.
    """
    width = codes.shape[1]
    stack = [(np.arange(len(codes)), 0)]
    while stack:
        at, depth = stack.pop()
        if weight[at].sum() < least:
            continue  # nothing in it can be frequent
        word = codes[at, depth]
        pivot = word[len(word) // 2]
        equal = at[word == pivot]
        if len(equal) < len(at):
            stack += [(at[word < pivot], depth), (at[word > pivot], depth)]
        if pivot < 0:
            continue  # suffixes that end here
        size = int(weight[equal].sum())
        if size < least:
            continue
        if depth and not any((codes[equal[0], :depth + 1] == row[:depth + 1]).all() for row in shared):
            yield int(equal[0]), depth + 1, size
        if depth + 1 < width:
            stack.append((equal, depth + 1))


def _mine(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the beginnings in one range of suffixes; those that other ranges may share have no bound."""
    held: dict[bytes, list] = {}
    for batch in batches:
        for lang, words, codes, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "codes", "n"))):
            held.setdefault(lang, []).append((words, codes, n))
    for lang, rows in held.items():
        parts = [w.split(b"\0") for w, _, _ in rows]
        every = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
        words, of = every.dictionary.to_pylist(), every.indices.to_numpy()
        weight = np.concatenate([np.frombuffer(n, np.uint32) for _, _, n in rows]).astype(np.int64)
        codes = np.full((len(weight), most), -1, np.int32)
        at = first = 0
        for p, (_, raw, n) in zip(parts, rows):
            m = len(n) // 4
            place = np.frombuffer(raw, f"u{len(raw) // (m * most)}").reshape(most, m).T
            codes[at:at + m] = np.append(-1, of[first:first + len(p)])[place]
            at, first = at + m, first + len(p)
        shared = [codes[i] for i in _least_and_greatest(codes, words)]
        out: dict[bytes, int] = {}

        def named(of: np.ndarray) -> bytes:
            return b"\0".join([lang, *[words[i] for i in of.tolist()]])

        for row in shared:
            for d in range(2, most + 1):
                if row[d - 1] >= 0:
                    out[named(row[:d])] = int(weight[(codes[:, :d] == row[:d]).all(axis=1)].sum())
        for at, d, n in sorted_counts(codes, weight, least, shared):
            out[named(codes[at, :d])] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())], names=["key", "a"])


def _least_and_greatest(codes: np.ndarray, words: list[bytes]) -> tuple[int, int]:
    """The rows of the first and the last suffix in byte order."""
    ends = []
    for pick in (min, max):
        rows = np.arange(len(codes))
        for d in range(codes.shape[1]):
            here = np.unique(codes[rows, d]).tolist()
            best = pick(here, key=lambda c: (c >= 0, words[c] if c >= 0 else b""))
            rows = rows[codes[rows, d] == best]
        ends.append(int(rows[0]))
    return ends[0], ends[1]


# ------------------------------------------------------------------ phrases and scores
def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang",
                  rows: int = ROWS, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase array<string>, a) of all phrases of 1 to ``most`` words with at least ``least`` occurrences, and
    (lang, n), the words of each language."""
    if most < 2:
        raise ValueError("a phrase has two words or more")
    words = _stored(word_counts(docs, text_col, lang_col))
    often = words.filter(F.col("a") >= least)
    kept = often.agg(F.sum("a")).first()[0] or 0  # no more suffixes than that
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept // rows))
    bitmap = frequent_bits(often, bits)
    cuts = cuts_of(docs, bitmap, kept, parts, most, text_col, lang_col)
    routed = suffixes(docs, bitmap, cuts, most, text_col, lang_col).repartitionById(parts, "part")
    mined = (routed.select("lang", "words", "codes", "n").mapInArrow(lambda b: _mine(b, most, least), "key binary, a bigint")
             .groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))
    both = mined.unionByName(often).select(F.split(F.col("key").cast("string"), "\\x00").alias("w"), "a")
    whole = F.transform("w", lambda w: F.replace(F.replace(w, F.lit("\1\3"), F.lit("\0")), F.lit("\1\2"), F.lit("\1")))
    found = _stored(both.select(whole.alias("w"), "a").select(
        F.get("w", F.lit(0)).alias("lang"), F.slice("w", 2, most).alias("phrase"), "a"))
    lang = F.split(F.col("key").cast("string"), "\\x00")[0]
    lang = F.replace(F.replace(lang, F.lit("\1\3"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))
    return found, words.groupBy(lang.alias("lang")).agg(F.sum("a").alias("n"))


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int | None = TOP, text_col: str = "text",
                 lang_col: str = "lang", **kw) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language that their weakest cut binds most.

    A phrase that a longer one of the same count contains is left out. ``top`` None gives all, with rank null.
    """
    counts, totals = phrase_counts(docs, most, least, text_col, lang_col, **kw)
    longer = counts.filter(F.size("phrase") > 2)
    m = F.size("phrase")
    # a longer phrase of equal count implies one that is longer by one word
    inner = longer.select("lang", "a", F.explode(F.array(F.slice("phrase", F.lit(1), m - 1), F.slice("phrase", F.lit(2), m - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    alone = (counts.filter(F.size("phrase") > 1).join(inner, ["lang", "phrase"], "left")
             .filter(F.col("within").isNull() | (F.col("within") < F.col("a"))).drop("within"))
    cuts = alone.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")).withColumns({
        "left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, F.lit(most))})
    part = [counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(n)) for side, n in (("left", "l"), ("right", "r"))]
    # the languages are few rows; whether they are broadcast is decided by their measured size
    cuts = cuts.join(part[0], ["lang", "left"]).join(part[1], ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(a * 1000 as decimal(18,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(19,0)))")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("c"))
    scored = weakest.select("lang", F.array_join("phrase", " ").alias("phrase"), "c.a", "c.l", "c.r", "c.n", "c.score")
    if top is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
             .filter(F.col("rank") <= top))  # at most SALTS * top rows of a language go on
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, phrase, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
inside AS (
  SELECT lang, a, list_slice(phrase, i, j) AS phrase
  FROM counts, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j)
  WHERE i < j AND j <= len(phrase) AND j - i + 1 < len(phrase)),
candidates AS (
  SELECT * FROM counts c WHERE len(phrase) >= 2 AND NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, k,
    ((1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = list_slice(c.phrase, 1, k)
  JOIN counts r ON r.lang = c.lang AND r.phrase = list_slice(c.phrase, k + 1, len(c.phrase))
  JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(phrase, ' '))) AS rank,
    array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM weakest)
SELECT * FROM ranked WHERE rank <= 2000
"""
