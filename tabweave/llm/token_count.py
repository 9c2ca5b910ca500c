"""Token counts by the whole-token shortcut, for byte-level BPE vocabularies.

Offline, the tokenizer's own merge procedure is run on every vocabulary string
alone; those that come out as one token are *whole*. A pre-token of a text that
is whole counts one, without merging; only the rest is merged.

Texts are cut at single spaces between two characters that are not white space.
A pre-token never reaches across such a cut and never depends on what lies
beyond it, so the count of a piece (its leading space included) is the same
wherever it stands; each task keeps the counts of up to ``CACHE`` pieces.

The pattern of the pre-tokens is that of the tokenizer. Where the two regex
libraries disagree about a character (letters of newer Unicode versions), the
text is pre-tokenised by the tokenizer itself; each new character is tried once.

Defined results: null and empty texts have no tokens; special strings inside a
text are one token each, as the tokenizer does by default; repeated rows are
counted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_batches

LIMIT = 512
CACHE = 400_000
_APART = -(1 << 60)  # marks a piece that must not be counted by itself


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: the
    printable Latin-1 characters stand for themselves, the other bytes get
    letters from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WholeTokenCounter:
    """Counts the tokens of a text as ``Tokenizer.encode`` without special tokens does."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge, self.pre = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer
        self.letters = _byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = regex.compile("|".join(regex.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))
                                      ) if added else None
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.whole = self.whole_tokens()
        self.tried: dict[str, bool] = {}

        counter = self

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= CACHE:
                    self.clear()
                self[piece] = n = _APART if not piece or piece[0].isspace() or piece[-1].isspace() else counter.count_pieces(" " + piece)
                return n

        self.counts = Counts()

    def whole_tokens(self) -> set[str]:
        """The vocabulary strings that the merge procedure turns into one token."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        out = set()
        for s in self.tokenizer.get_vocab(with_added_tokens=False):
            if all(c in byte_of for c in s) and len(self.merge(s)) == 1:
                try:
                    out.add(bytes(byte_of[c] for c in s).decode())
                except UnicodeDecodeError:
                    pass  # a part of a character: no pre-token is one
        return out

    def count_pieces(self, part: str) -> int:
        """Tokens of a part of a text that begins and ends at a cut."""
        total, whole = 0, self.whole
        for token in self.pattern.findall(part):
            if token in whole:
                total += 1
            else:
                total += len(self.merge("".join([self.letters[b] for b in token.encode()])))
        return total

    def agreed(self, text: str) -> bool:
        """Whether pattern and tokenizer see the same in every character of the text."""
        for c in set(text):
            ok = self.tried.get(c)
            if ok is None:
                ok = ord(c) < 128 or all(
                    [s[a:b] for _, (a, b) in self.pre.pre_tokenize_str(s)] == self.pattern.findall(s)
                    for s in (f"a{c}b", f" {c}{c} 1", f"x {c} y", f"1{c}2", f"{c}!", f"!{c}"))
                self.tried[c] = ok
            if not ok:
                return False
        return True

    def count_plain(self, text: str) -> int:
        if not text.isascii() and not self.agreed(text):
            return sum(len(self.merge(t)) for t, _ in self.pre.pre_tokenize_str(text))
        first, *rest = text.split(" ")
        total = sum(map(self.counts.__getitem__, rest))
        if total >= 0 and first and not first[-1].isspace():
            return total + self.count_pieces(first)
        # runs of white space: only cuts with no white space on either side hold
        total, part = 0, first
        for piece in rest:
            if part and not part[-1].isspace() and piece and not piece[0].isspace():
                total += self.count_pieces(part)
                part = " " + piece
            else:
                part += " " + piece
        return total + self.count_pieces(part)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is None or not self.specials.search(text):
            return self.count_plain(text)
        pieces = self.specials.split(text)
        return len(pieces) - 1 + sum(self.count_plain(p) for p in pieces if p)


def tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``. ``path`` is the
    tokenizer's .json on the driver; its text (a few MB, a fixed file) is broadcast."""
    packed = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counter = WholeTokenCounter(packed.value)

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [counter.count(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                              names=["id", "n_bytes", "n_tokens"])

        return turn

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    out = map_batches(thin, make, f"id {thin.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
