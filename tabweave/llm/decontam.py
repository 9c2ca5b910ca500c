"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The
automaton accepts every word sequence that lies inside one item. Training words
are streamed through it and the longest matching length is tracked; a length of
``window`` or more, or a whole item that is shorter than that, marks its words as
hit. Spans of hit words that reach the coverage limit make a document
contaminated.

The items are cut into automata of at most ``words_per_automaton`` words (a
longer item into overlapping pieces, which keeps every window whole), each
built in a task of its own and broadcast: its size is bounded by that
parameter, whatever the number of items. More automata are more map steps over
the same rows; documents are never shuffled or joined.

Defined results: a null or wordless text has no words, no hits and is not
contaminated; wordless items match nothing; repeated items share their id;
an item without id has the id ``''``; repeated documents are judged alike; empty
tables give empty results; further columns are ignored by ``match_items`` and
carried by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

WINDOW = 13
COVERAGE = 20  # contaminated when COVERAGE * n_hit >= n_words
WORDS_PER_AUTOMATON = 400_000
CHUNK_WORDS = 1 << 18

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class _Vocabulary(dict):
    """Word to id; -1 for a word that no item has."""

    def __missing__(self, word: bytes) -> int:
        return -1


class SuffixAutomaton:
    """Generalised suffix automaton over the words of ``pieces``: (item, whole, words).

    ``windows[s]`` are the items that hold the window ending in state ``s``;
    ``wholes[s]`` are (length, item) of whole items shorter than a window that end there.
    """

    def __init__(self, pieces: list[tuple[str, bool, list[bytes]]], window: int):
        self.window, self.vocabulary = window, _Vocabulary()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded, pairs = [], set()
        for item, whole, words in pieces:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, whole, ids))
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n = len(self.vocabulary)
        self.pairs = np.sort(np.fromiter((a * n + b for a, b in pairs), np.int64, len(pairs)))
        self.shortest = min([window, *(len(ids) for _, whole, ids in coded if whole)])
        self.windows: dict[int, set[str]] = {}
        self.wholes: dict[int, list[tuple[int, str]]] = {}
        for item, whole, ids in coded:
            state = length = 0
            for c in ids:
                state, length = self.step(state, length, c)
                if length >= window:
                    self.windows.setdefault(self.trimmed(state), set()).add(item)
            if whole:
                self.wholes.setdefault(state, []).append((len(ids), item))
        # nearest state with a whole short item, along the suffix links and including itself
        self.up = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.wholes else self.up[self.link[s]] if s else -1

    def _extend(self, last: int, c: int) -> int:
        """Append ``c`` after the state ``last``; an existing transition is reused."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and the longest matching length after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def trimmed(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, items) of each occurrence, by its last word."""
        state = length = 0
        for i, c in enumerate(ids):
            state, length = self.step(state, length, c)
            if length >= self.window:
                yield i + 1 - self.window, i + 1, self.windows[self.trimmed(state)]
            s = self.up[state]
            while s > 0:
                for m, item in self.wholes[s]:
                    if m <= length:
                        yield i + 1 - m, i + 1, {item}
                s = self.up[self.link[s]]

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges that can hold a match: each next word follows its predecessor
        in some item (the first two transitions, for all words at once)."""
        known = ids >= 0
        joint = np.zeros(len(ids), bool)  # word i follows word i - 1 in an item
        if len(self.pairs):
            at = np.flatnonzero(known[1:] & known[:-1]) + 1
            code = ids[at - 1].astype(np.int64) * len(self.vocabulary) + ids[at]
            slot = np.searchsorted(self.pairs, code)
            slot[slot == len(self.pairs)] = 0
            joint[at[self.pairs[slot] == code]] = True
        starts = np.flatnonzero(known & ~joint)
        ends = np.append(starts[1:], len(ids))
        if not len(starts):
            return []
        gaps = np.flatnonzero(~known)
        upto = np.searchsorted(gaps, starts)
        ends = np.minimum(ends, np.append(gaps, len(ids))[upto])
        keep = ends - starts >= self.shortest
        return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> DataFrame:
    """(item, whole, words, n): items cut into pieces that overlap by ``window - 1`` words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"]):
                words = words_of((text or "").encode())
                for at in range(0, max(1, len(words) - window + 1), most):
                    part = words[at:at + most + window - 1]
                    if part:
                        out.append((item or "", len(words) < window, b" ".join(part), len(part)))
            yield pd.DataFrame(out, columns=["item", "whole", "words", "n"])

    thin = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInPandas(cut, "item string, whole boolean, words binary, n bigint")


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
             words_per_automaton: int = WORDS_PER_AUTOMATON) -> Iterator[bytes]:
    """Packed automata, one after another; each is built in a task."""
    pieces = _pieces(items, id_col, text_col, window, max(window, words_per_automaton // 8))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-2 * total // words_per_automaton)) if total > words_per_automaton else 1

    def build(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["item", "words"])
        made = SuffixAutomaton([(i, w, bytes(t).split()) for i, w, t in
                                zip(order["item"], order["whole"], order["words"])], window)
        return pd.DataFrame({"blob": [zlib.compress(pickle.dumps(made), 1)]})

    built = (pieces.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)))
             .groupBy("part").applyInPandas(build, "blob binary"))
    none = True
    for row in built.toLocalIterator():
        none = False
        yield bytes(row["blob"])
    if none:
        yield zlib.compress(pickle.dumps(SuffixAutomaton([], window)))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut_words(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


_STATE = "n_words bigint, spans array<array<bigint>>, items array<string>"


def _scan(rows: DataFrame, blob: bytes) -> DataFrame:
    """One map step: adds what one automaton finds to ``spans`` and ``items``."""
    packed = rows.sparkSession.sparkContext.broadcast(blob)
    schema = rows.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam: SuffixAutomaton = pickle.loads(zlib.decompress(packed.value))
        get = sam.vocabulary.__getitem__
        for batch in batches:
            texts = utf8(batch.column("_text"))
            n_words = [0] * len(texts)
            spans = [[tuple(s) for s in x] for x in batch.column("spans").to_pylist()]
            items = [set(x) for x in batch.column("items").to_pylist()]
            ids: list[np.ndarray] = []
            owners: list[tuple[int, int]] = []  # where a document's words begin among those of this chunk
            have = 0

            def search() -> None:
                nonlocal ids, owners, have
                if not have:
                    return
                flat = np.concatenate(ids)
                begin = np.array([b for b, _ in owners])
                for a, b in sam.stretches(flat):
                    base, doc = owners[int(np.searchsorted(begin, a, "right")) - 1]
                    for x, y, found in sam.matches(flat[a:b].tolist()):
                        spans[doc].append((a - base + x, a - base + y))
                        items[doc] |= found
                ids, owners, have = [], [], 0

            stop = np.array([-1], np.int32)
            for doc, text in enumerate(texts):
                words = words_of(text)
                n_words[doc] = len(words)
                if words:
                    owners.append((have, doc))
                    ids += [np.fromiter(map(get, words), np.int32, len(words)), stop]
                    have += len(words) + 1
                    if have >= CHUNK_WORDS:
                        search()
            search()
            found = {"n_words": n_words, "spans": [_merged(x) for x in spans], "items": [sorted(x) for x in items]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[f.name], f.type) if f.name in found else batch.column(f.name) for f in batch.schema],
                schema=batch.schema)

    return rows.mapInArrow(scan, schema)


def match_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                coverage: int = COVERAGE, words_per_automaton: int = WORDS_PER_AUTOMATON,
                cut: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``n_hit``, ``spans`` (word ranges
    that are hit), ``longest`` (longest such range), ``items`` (ids of the items
    that occur), ``items_sha256`` and ``contaminated``; with ``cut`` also
    ``clean_text``, the text without its hit spans."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), F.lit(0).cast("bigint").alias("n_words"),
                       F.array().cast("array<array<bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for blob in automata(items, item_id_col, item_text_col, window, words_per_automaton):
        rows = _scan(rows, blob)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    longest = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: F.greatest(s, x[1] - x[0]))
    out = rows.withColumns({"n_hit": hit, "longest": longest})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))
    out = out.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
    if cut:
        @F.pandas_udf("string")
        def cut_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([t if not len(s) else _cut_words((t or "").encode(), [list(map(int, x)) for x in s]).decode()
                              for t, s in zip(text, spans)], dtype=object)

        out = out.withColumn("clean_text", F.when(F.size("spans") == 0, F.col("_text")).otherwise(cut_spans("_text", "spans")))
    return out.drop("_text")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; hit
    spans below the coverage limit are cut out of their texts. A text without
    hits stays as it is. A column ``n_chars`` follows the text."""
    # one struct carries the other columns through the map steps, whatever their names
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
                         F.col(text_col).alias("text"))
    out = match_items(packed, items, id_col="row", text_col="text", cut=True, **kw).filter(~F.col("contaminated"))
    columns = {c: F.col("clean_text") if c == text_col else F.col("row")[c] for c in docs.columns}
    dirty = F.size("spans") > 0
    if "n_chars" in columns:
        columns["n_chars"] = F.when(dirty, F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select([v.alias(c) for c, v in columns.items()])


ORACLE = r"""WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
      FROM (SELECT item, w, least(len(w), 13) AS n FROM it WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rn, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
l AS (SELECT rn, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) AS grams
      FROM d, (SELECT DISTINCT n FROM g) s WHERE len(w) >= n),
m AS (SELECT p.rn, p.n, p.i, g.item FROM (SELECT rn, n, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM l) p JOIN g ON g.n = p.n AND g.gram = p.gram),
h AS (SELECT rn, count(DISTINCT x) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS x FROM m) GROUP BY rn),
k AS (SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY rn)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items, sha256(coalesce(k.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (rn) LEFT JOIN k USING (rn)"""
