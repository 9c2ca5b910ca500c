"""Personal data: fixed patterns, and spans added by a character BiLSTM with a CRF.

The patterns (email, ip, card, phone) give the *base* spans, which always stay.
A bidirectional LSTM over characters scores a BIO tag per character and kind; a
linear-chain CRF holds the transitions. It is trained in numpy from labelled
spans: windows around base spans of the corpus, their spellings varied by rule
(other separators, ``(at)``, no country code, ...), and of texts without a span windows
around the first digit or ``@`` and windows from anywhere. The sample is bounded
(``TRAIN_WINDOWS`` of each, least hashes of the id first) and training is one task.

Every character of every text is tagged. Texts are cut into windows of up to ``LONGEST``
characters that share ``STRIDE``; a character takes its tag from the window in which it
lies further from an edge. Spans are read from the joined tags of the whole text, so one
span may cross windows, and added unless they overlap a base span.

Defined results: null and empty texts have no spans; repeated rows get equal
results; a corpus without base spans has nothing to learn from and adds no
spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pinned

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96  # characters of a training window
LONGEST, STRIDE = 960, 48  # characters of a tagged window at most, and those that two of them share
AT_ONCE = 1 << 20  # characters that one step of tagging holds
TRAIN_WINDOWS = 1_200  # with a base span, around a digit or @, and from anywhere
HIDDEN, EMBED, EPOCHS, BATCH, RATE = 16, 12, 8, 64, 0.02
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_LEAST = {"email": 6, "ip": 7, "card": 12, "phone": 9}  # shortest added span

# ------------------------------------------------------------------ base patterns
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAYBE = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found
    from each ``@`` outwards: the part before it can only be the whole run of its
    characters, so long runs without an ``@`` cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    if not _MAYBE.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ------------------------------------------------------------------ the network
def _codes(text: str) -> np.ndarray:
    """ASCII characters by code, all others as 127."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(u, 127).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLstmCrf:
    """Character BiLSTM (input, forget, output, cell gates) with CRF transitions."""

    def __init__(self, seed: int = 0, hidden: int = HIDDEN, embed: int = EMBED):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": small(128, embed) * 3, "out": small(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32),
                  "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": small(embed, 4 * hidden), f"h{d}": small(hidden, 4 * hidden),
                       f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden:2 * hidden] = 1  # remember at first

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time of one direction; x is (time, batch, embed)."""
        n, H = x.shape[1], self.hidden
        h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out = np.empty((x.shape[0], n, H), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            z = pre[t] + h @ self.p[f"h{d}"]
            gates = _sigmoid(z[:, :3 * H])
            i, f, o, g = gates[:, :H], gates[:, H:2 * H], gates[:, 2 * H:], np.tanh(z[:, 3 * H:])
            before, hb = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, th, hb))
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, batch, tags) scores of (batch, time) character codes."""
        x = self.p["emb"][codes.T]
        kf, kb = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(x, "f", kf), self._run(x, "b", kb)], axis=2)
        if keep is not None:
            keep |= {"x": x, "f": kf, "b": kb, "both": both}
        return both @ self.p["out"] + self.p["bias"]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """What ``emissions`` gives, as (time, tags, batch) and without what training keeps: the
        windows stand side by side in memory, a character's share of the gates is looked up, and a step is one
        product and one ``tanh``, which is a gate's sigmoid at twice its argument."""
        n, T = codes.shape
        H, turned = self.hidden, np.ascontiguousarray(codes.T)
        e = np.empty((T, TAGS, n), np.float32)
        e[:] = self.p["bias"][:, None]
        half = np.repeat(np.array([0.5, 1], np.float32), [3 * H, H])  # sigmoid(z) = tanh(z / 2) / 2 + 1 / 2
        z, th, pre = np.empty((4 * H, n), np.float32), np.empty((H, n), np.float32), np.empty((4 * H, n), np.float32)
        gates, i, f, o, g = z[:3 * H], z[:H], z[H:2 * H], z[2 * H:3 * H], z[3 * H:]
        for nth, d in enumerate("fb"):
            weights = np.ascontiguousarray((self.p[f"h{d}"] * half).T)
            given = np.ascontiguousarray(((self.p["emb"] @ self.p[f"x{d}"] + self.p[f"c{d}"]) * half).T)  # of every character
            out = np.ascontiguousarray(self.p["out"][nth * H:(nth + 1) * H].T)
            h, c = np.zeros((H, n), np.float32), np.zeros((H, n), np.float32)
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                np.take(given, turned[t], axis=1, out=pre, mode="clip")
                np.matmul(weights, h, out=z)
                z += pre
                np.tanh(z, out=z)
                gates *= 0.5
                gates += 0.5
                c *= f
                i *= g
                c += i
                np.tanh(c, out=th)
                np.multiply(o, th, out=h)
                e[t] += out @ h
        return e

    def _may_tag(self, e: np.ndarray) -> np.ndarray:
        """Which characters (time, batch) the best path for scores (time, tags, batch) may tag.
        What a tagged stretch gains over O is a sum over its characters, each at most its lead
        over O in emission, plus the best transition into its tag, plus the best one back to O.
        A stretch that loses is not on the best path, so the characters in no stretch of a
        bound of zero or more are O."""
        trans = self.p["trans"]
        into = (trans[:, 1:].max(0) - trans[0, 0])[:, None]
        back = max(0.0, float(trans[1:, 0].max() - trans[0, 0]))
        lead = (e[:, 1:] + into).max(1) - e[:, 0] + back
        lead[0] = np.maximum(lead[0], e[0, 1:].max(0) - e[0, 0] + back)  # nothing leads into the first
        ends, starts = lead.copy(), lead.copy()  # the best bound of a stretch that ends, or starts, here
        for t in range(1, len(lead)):
            ends[t] += np.maximum(ends[t - 1], 0)
        for t in range(len(lead) - 2, -1, -1):
            starts[t] += np.maximum(starts[t + 1], 0)
        return ends + starts - lead >= -1e-3  # sums of floats: in doubt Viterbi decides

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) by Viterbi, run where a tag is possible: what lies between
        characters that are O for certain does not depend on what is beyond them."""
        e = self.scores(codes)
        n, T = codes.shape
        tags = np.zeros((n, T), np.int8)
        may = np.zeros((n, T + 2), np.int8)
        may[:, 1:-1] = self._may_tag(e).T
        step = np.diff(may, axis=1)
        row, first = np.nonzero(step == 1)
        end = np.nonzero(step == -1)[1]
        size = end - first
        edge = (first == 0) + 2 * (end == T)
        # between two O's a stretch may be filled up with further O's; at an edge of the window it has its own length
        room = np.where(edge == 0, 1 << np.ceil(np.log2(np.maximum(size, 4))).astype(np.int64), size)
        for kind, width in np.unique(np.stack([edge, room], 1), axis=0).tolist():
            pick = np.flatnonzero((edge == kind) & (room == width))
            steps = np.arange(0 if kind & 1 else -1, width if kind & 2 else width + 1)
            for part in np.array_split(pick, 1 + (len(pick) * width >> 16)):
                at = first[part, None] + steps
                inside = (at >= first[part, None]) & (at < end[part, None])
                some = e[at.clip(0, T - 1), :, row[part, None]]
                some[~inside] = -1e9
                some[~inside, 0] = 0
                best = self._viterbi(np.ascontiguousarray(some.transpose(1, 0, 2)))
                tags[np.repeat(row[part], inside.sum(1)), at[inside]] = best[inside]
        return tags

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) for scores (time, batch, tags)."""
        score, back = e[0], []
        for t in range(1, len(e)):
            step = score[:, :, None] + self.p["trans"]
            back.append(step.argmax(1).astype(np.int8))
            score = step.max(1) + e[t]
        tags = np.empty((e.shape[1], len(e)), np.int8)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 2, -1, -1):
            tags[:, t] = back[t][rows, tags[:, t + 1]]
        return tags

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags (batch, time) and its gradient."""
        keep: dict = {}
        e = self.emissions(codes, keep)
        T, n, _ = e.shape
        trans, rows = self.p["trans"], np.arange(n)
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, T):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(T - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        logz = lse(alpha[-1], 1)
        g = gold.T
        score = sum(e[t][rows, g[t]] for t in range(T)) + sum(trans[g[t - 1], g[t]] for t in range(1, T))
        de = np.exp(alpha + beta - logz[None, :, None])
        for t in range(T):
            de[t][rows, g[t]] -= 1
        dtrans = np.zeros_like(trans)
        for t in range(1, T):
            pair = alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - logz[:, None, None]
            dtrans += np.exp(pair).sum(0)
            np.add.at(dtrans, (g[t - 1], g[t]), -1)
        grad = {"trans": dtrans / n, "out": np.tensordot(keep["both"], de, ([0, 1], [0, 1])) / n, "bias": de.sum((0, 1)) / n}
        dboth = de @ self.p["out"].T / n
        dx = np.zeros_like(keep["x"])
        H = self.hidden
        for d, dh_all in (("f", dboth[:, :, :H]), ("b", dboth[:, :, H:])):
            dh, dc = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
            gx, gh, gc = (np.zeros_like(self.p[k + d]) for k in "xhc")
            for t, i, f, o, gg, before, th, hb in reversed(keep[d]):
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o),
                                     dc * i * (1 - gg * gg)], axis=1)
                gx += keep["x"][t].T @ dz
                gh += hb.T @ dz
                gc += dz.sum(0)
                dx[t] += dz @ self.p["x" + d].T
                dh, dc = dz @ self.p["h" + d].T, dc * f
            grad |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], codes.T, dx)
        return float((logz - score).mean()), grad

    def fit(self, codes: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE,
            seed: int = 0) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for epoch in range(epochs):
            total, order = 0.0, rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                loss, grad = self.gradients(codes[pick], gold[pick])
                total += loss * len(pick)
                step += 1
                lr = rate * (1 - epoch / epochs)
                for k, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
            losses.append(total / len(order))
        return losses


# ------------------------------------------------------------------ labelled windows
def _varied(kind: int, text: str, rng: np.random.Generator) -> str:
    """Another spelling of a span of this kind; often the same."""
    pick = int(rng.integers(4))
    if kind == 0:
        return (text, text.replace("@", " @ "), text.replace("@", "(at)"), text.replace("@", " [at] "))[pick]
    if kind == 2:
        digits = _NOT_DIGIT.sub("", text)
        sep = ("", "-", " ", ".")[pick]
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        digits = _NOT_DIGIT.sub("", text)[-10:]
        return (text, f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}",
                f"{digits[:3]}.{digits[3:6]}.{digits[6:]}")[pick]
    return text


def _window_of(text: str, span: tuple[int, int, int] | None, at: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One training window: around a span that is respelled, or around position ``at``."""
    gold = np.zeros(WINDOW, np.int64)
    shift = int(rng.integers(8, WINDOW // 2))
    if span is None:
        piece = text[max(0, at - shift):max(0, at - shift) + WINDOW]
    else:
        a, kind, b = span
        said = _varied(kind, text[a:b], rng)
        left = text[max(0, a - shift):a]
        piece = (left + said + text[b:b + WINDOW])[:WINDOW]
        end = min(WINDOW, len(left) + len(said))
        gold[len(left):end] = 2 + 2 * kind
        gold[len(left):len(left) + 1] = 1 + 2 * kind
    return _codes(piece.ljust(WINDOW)), gold


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: int = TRAIN_WINDOWS) -> dict | None:
    """The parameters of a model fitted on texts of ``docs``, at most ``windows`` per label:
    one with a base span, and without: around its first digit or ``@``, and anywhere. None
    where there is no base span."""

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, label, texts, starts, kinds, ends = [], [], [], [], [], []
            for nth, text in zip(batch.column("nth").to_pylist(), batch.column("text").to_pylist()):
                spans = base_spans(text)
                if spans:
                    picks = [(1, *spans[nth % len(spans)])]
                else:
                    m = _MAYBE.search(text)
                    picks = [(2, nth % len(text), -1, 0)] + ([(0, m.start(), -1, 0)] if m else [])
                for kind_of, a, kind, b in picks:
                    cut = max(0, a - WINDOW)
                    order.append(nth)
                    label.append(kind_of)
                    texts.append(text[cut:max(a + 2 * WINDOW, b + WINDOW)])
                    starts.append(a - cut)
                    kinds.append(kind)
                    ends.append(b - cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in ((order, pa.int64()), (label, pa.int32()), (texts, pa.string()),
                                             (starts, pa.int64()), (kinds, pa.int32()), (ends, pa.int64()))],
                names=["nth", "label", "text", "a", "kind", "b"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, examples = np.random.default_rng(1), []
        for batch in batches:
            for row in batch.to_pylist():
                span = (row["a"], row["kind"], row["b"]) if row["kind"] >= 0 else None
                for _ in range(1 if span is None else 2):
                    examples.append(_window_of(row["text"], span, row["a"], rng))
        if not examples or not any(g.any() for _, g in examples):
            return
        model = BiLstmCrf()
        model.fit(np.stack([c for c, _ in examples]), np.stack([g for _, g in examples]))
        names = sorted(model.p)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([list(model.p[k].shape) for k in names], pa.list_(pa.int64())),
             pa.array([model.p[k].astype(np.float32).ravel().tolist() for k in names], pa.list_(pa.float32()))],
            names=["name", "shape", "data"])

    text = F.col(text_col).cast("string")
    thin = (docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("nth"), text.alias("text"))
            .filter(F.coalesce(F.octet_length("text"), F.lit(0)) > 0))
    # one pass for all three labels
    cut = pinned(thin.mapInArrow(windows_of, "nth bigint, label int, text string, a bigint, kind int, b bigint"))
    sample = reduce(DataFrame.union, [cut.filter(F.col("label") == k).orderBy("nth", "text").limit(windows) for k in (1, 0, 2)])
    rows = (sample.repartition(1).sortWithinPartitions("nth", "label", "text")
            .mapInArrow(train, "name string, shape array<bigint>, data array<float>").collect())  # one small model
    if not rows:
        return None
    return {r["name"]: np.array(r["data"], np.float32).reshape([int(x) for x in r["shape"]]) for r in rows}


# ------------------------------------------------------------------ tagging whole texts
def _pieces(n: int) -> Iterator[tuple[int, int, int]]:
    """(start, first own character, end of the own ones) of the windows of a text of ``n`` characters."""
    at, last = 0, max(1, -(-(n - STRIDE) // (LONGEST - STRIDE))) - 1
    for j in range(last + 1):
        yield at, at + STRIDE // 2 if j else 0, at + LONGEST - STRIDE // 2 if j < last else n
        at += LONGEST - STRIDE


def tag_texts(model: BiLstmCrf, texts: list[str], most: int = AT_ONCE) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) that the model sees in each text; every character of every
    text goes through the network, about ``most`` of them at once."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tags: dict[int, np.ndarray] = {}  # of texts with a tagged character
    todo: dict[int, list[tuple[int, int, int, int, np.ndarray]]] = {}  # by padded length

    def run(size: int) -> None:
        batch = todo.pop(size)
        codes = np.full((len(batch), size), 32, np.uint8)
        for row, (*_, piece) in zip(codes, batch):
            row[:len(piece)] = piece
        # windows with the same characters have the same tags
        first: dict[bytes, int] = {}
        same = [first.setdefault(row.tobytes(), len(first)) for row in codes]
        best = model.decode(np.frombuffer(b"".join(first), np.uint8).reshape(len(first), size))
        tagged = best.any(1)
        for n, (k, at, a, b, _) in zip(same, batch):
            if tagged[n]:
                if k not in tags:
                    tags[k] = np.zeros(len(texts[k]), np.int8)
                tags[k][a:b] = best[n, a - at:b - at]

    def read(k: int) -> None:
        seq, text = tags[k], texts[k]
        on = np.flatnonzero(seq)
        start, kind, last = -1, -1, -2
        for i in [*on.tolist(), len(text) + 1]:
            t = int(seq[i]) if i < len(seq) else 0
            if start >= 0 and (i != last + 1 or t % 2 == 1 or (t - 1) // 2 != kind):
                a, b = start, last + 1
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                if b - a >= _LEAST[KINDS[kind]]:
                    out[k].append((a, kind, b))
                start = -1
            if t and start < 0:
                start, kind = i, (t - 1) // 2
            last = i

    for k, text in enumerate(texts):
        codes = _codes(text).astype(np.uint8)
        for at, a, b in _pieces(len(text)) if text else ():
            piece = codes[at:at + LONGEST]
            size = -(-len(piece) // WINDOW) * WINDOW
            todo.setdefault(size, []).append((k, at, a, b, piece))
            if len(todo[size]) * size >= most:
                run(size)
    for size in list(todo):
        run(size)
    for k in tags:
        read(k)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)])


def find_spans(docs: DataFrame, params: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the number of base spans of each kind, ``base_sha256``,
    ``spans`` (base and added, as kind:start:end) and ``n_added``."""
    packed = docs.sparkSession.sparkContext.broadcast(params)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        model = None
        if packed.value is not None:
            model = BiLstmCrf()
            model.p = packed.value

        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            if model is None:
                added = [[] for _ in texts]
            else:
                found = tag_texts(model, texts)
                added = [[s for s in new if all(s[2] <= a or s[0] >= b for a, _, b in old)] if new else new
                         for new, old in zip(found, base)]
            counts = [pa.array([sum(k == j for _, k, _ in spans) for spans in base], pa.int64()) for j in range(len(KINDS))]
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), *counts,
                 pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base]),
                 pa.array([written(s + n) for s, n in zip(base, added)]), pa.array([len(n) for n in added], pa.int64())],
                names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

        return turn

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(thin, make, f"id {thin.schema['id'].dataType.simpleString()}, "
                      + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")
    return out.withColumnRenamed("id", id_col)
