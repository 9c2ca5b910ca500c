"""Plain versions of the operators, written from their contracts."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def suffix_dedup(rows, size=200):
    """{row number: (id, bytes, removed, spans, sha of the rest)}"""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        hit = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                hit[i:i + size] = b"\1" * size
        runs = re.findall(rb"\x01+", bytes(hit))
        rest = bytes(c for c, h in zip(t, hit) if not h)
        out.append((doc, len(t), sum(hit), len(runs), sha(rest)))
    return out


def exact_groups(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for norm, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), sha(norm)) for i in ids]
    return out


def _joined(kinds, found):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))


def secrets(text):
    text = text or ""
    found = []
    rule = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(rule, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    n = [sum(k == j for _, k, _ in found) for j in range(3)]
    return (*n, sha(_joined(("assign", "access", "hex"), found)))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(docs, items, window=13):
    grams = defaultdict(set)
    for item, text in items:
        w = tuple(WORD.findall((text or "").translate(LOWER)))
        if w:
            for i in range(max(1, len(w) - window + 1)):
                grams[w[i:i + window]].add(item or "")
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := grams.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    ids |= found
        names = sorted(str(i) for i in ids)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(digits(m[0])) <= 15]
    n = [sum(k == j for _, k, _ in found) for j in range(4)]
    return (*n, sha(_joined(("email", "ip", "card", "phone"), found)))


def fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simhash_classes(rows, bits=2):
    """[(id, hex, component)]"""
    fps = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i] = up[up[i]]
        return i

    first = {}
    for i, f in enumerate(fps):
        up[root(i)] = root(first.setdefault(f, i))
    distinct = list(first.items())
    for x, (f, i) in enumerate(distinct):
        for g, j in distinct[x + 1:]:
            if (f ^ g).bit_count() <= bits:
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{f:016x}", least.get(root(i))) for i, ((doc, _), f) in enumerate(zip(rows, fps))]


def spelling_groups(rows, least_length=6, least_count=5, ratio=5, divisor=199):
    """{word: (form, root, n, n_near, form_n)}"""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % divisor == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = defaultdict(set)
    shorter = defaultdict(set)  # a word without one letter -> (word, place)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1:]].add((w, i))
    for cut, ws in shorter.items():
        for w, i in ws:
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
            for v, j in ws:
                if i == j and v != w:
                    near[w].add(v)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, w, n, len(near[w]), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def collocations(rows, most=5, least=100, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least}
    within = Counter()
    for (lang, p), a in often.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    within[lang, p[i:j]] = max(within[lang, p[i:j]], a)
    by_lang = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) > 1 and within[lang, p] < a:
            cuts = []
            for k in range(1, len(p)):
                l, r = f[lang, p[:k]], f[lang, p[k:]]
                cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            by_lang[lang].append((" ".join(p), a, l, r, total[lang], score))
    out = []
    for lang, found in by_lang.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, rank, *x) for rank, x in enumerate(found[:top], 1)]
    return out


def ftrl_scores(rows, labels, held_out, bits=20, epochs=6, l1=5.0):
    """{row number: score}: FTRL-proximal (alpha and beta 1) over dictionaries. ``labels``: {id: 0 or 1}."""
    mask = (1 << 64) - 1
    pair = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0x165667B19E3779F9}

    def slots(text):
        words = [w.encode() for w in WORD.findall((text or "").translate(LOWER))]
        own = [xxhash.xxh64_intdigest(w, 1) for w in words]
        out = own + [xxhash.xxh64_intdigest(w[:p], 2 + p) for w in words for p in range(3, 9)]
        out += [(own[i] * 3 + own[i + d]) * pair[d] & mask for d in pair for i in range(len(own) - d)]
        return {h >> (64 - bits) for h in out} | {1 << bits}

    texts = {doc: max(t or "" for d, t in rows if d == doc) for doc, _ in rows if doc in labels and not held_out(doc)}
    order = sorted(texts, key=lambda doc: (int.from_bytes(xxhash.xxh64_digest(struct.pack("<q", doc), 42), "big", signed=True), doc))
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        limit = 0.0 if k == 1 << bits else l1
        return 0.0 if abs(z[k]) <= limit else -(z[k] - math.copysign(limit, z[k])) / (1 + math.sqrt(n[k]))

    features = {doc: slots(texts[doc]) for doc in order}
    for _ in range(epochs):
        for doc in order:
            w = {k: weight(k) for k in features[doc]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - labels[doc]
            for k in w:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) * w[k]
                n[k] += g * g
    return {i: 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weight(k) for k in slots(t)))))) for i, (_, t) in enumerate(rows)}
