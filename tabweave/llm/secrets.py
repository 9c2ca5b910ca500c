"""Secret scan with a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: a
text that matches must satisfy it. Of all trigrams only those in some query are
indexed: each block of documents has one posting list (an array of ids) per
trigram. A rule's candidates are the intersections and unions of the posting
lists of its query, block by block; candidates are verified with the regular
expression itself. A rule without mandatory trigrams (a run of hex digits) is
verified on every text.

The index ignores case (it is built on the lower-cased text); verification does not.
Blocks are hashes of the id, ``BLOCK`` documents on average, so posting lists stay
short whatever the size of the table, and a trigram that a third of all rows hold
is spread over all blocks.

Matches are leftmost and not overlapping within a rule; ``least`` drops matches
whose value is too short, without a retry. Positions are in code points.

Defined results: null and empty texts have no matches; repeated rows, or rows
that share an id, are each verified; a null id is indexed like any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
_MOST = 64  # strings that a literal part of a rule may stand for


@dataclass(frozen=True)
class Rule:
    """``regex`` may have one capturing group, the value; without one the value is
    the match. ``least``: shortest value."""

    kind: str
    regex: str
    least: int = 1

    @property
    def has_value(self) -> bool:
        return rp.parse(self.regex).state.groups > 1


BASE = (
    Rule("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("api_id", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:@/]{1,64}:[^\s:@/]{1,64}@"),
)
RULES = BASE + ADDED

# ------------------------------------------------------------------ from regex to trigram query
# A query is None (every text), a trigram, ("and", {queries}) or ("or", {queries}).
Query = None | str | tuple


def _and(parts) -> Query:
    flat: set = set()
    for p in parts:
        if isinstance(p, tuple) and p[0] == "and":
            flat |= p[1]
        elif p is not None:
            flat.add(p)
    return None if not flat else flat.pop() if len(flat) == 1 else ("and", frozenset(flat))


def _or(parts) -> Query:
    parts = set(parts)
    if None in parts or not parts:
        return None
    terms = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts}
    least = {p for p in parts if not any(q != p and terms[q] < terms[p] for q in parts)}  # "abcd or abc" is "abc"
    return least.pop() if len(least) == 1 else ("or", frozenset(least))


def _of_strings(strings: set[str]) -> Query:
    """All trigrams of one of the strings."""
    return _or(_and(s[i:i + 3] for i in range(len(s) - 2)) if len(s) > 2 else None for s in strings)


def _strings(op, arg) -> set[str] | None:
    """The few lower-case strings that one regex element stands for, or None."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is rc.BRANCH:
        found = [_sequence_strings(x) for x in arg[1]]
        return None if None in found else set().union(*found)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 4:
        one, out, now = _sequence_strings(arg[2]), set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out |= now
            if one is None or len(out) > _MOST:
                return None
            now = {a + b for a in now for b in one}
        return out
    if op is rc.AT:
        return {""}
    return None


def _sequence_strings(seq) -> set[str] | None:
    now = {""}
    for op, arg in seq:
        one = _strings(op, arg)
        if one is None or len(now) * len(one) > _MOST:
            return None
        now = {a + b for a in now for b in one}
    return now


def _sequence_query(seq) -> Query:
    parts, run = [], {""}
    for op, arg in seq:
        one = _strings(op, arg)
        if one is not None and len(run) * len(one) <= _MOST:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_of_strings(run))
        run = one if one is not None else {""}
        if one is None:
            if op is rc.SUBPATTERN:
                parts.append(_sequence_query(arg[-1]))
            elif op is rc.BRANCH:
                parts.append(_or(_sequence_query(x) for x in arg[1]))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                parts.append(_sequence_query(arg[2]))
    return _and([*parts, _of_strings(run)])


def trigram_query(regex: str) -> Query:
    """The trigrams (lower case) that every match of the regex must hold."""
    return _sequence_query(rp.parse(regex))


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# ------------------------------------------------------------------ index
def posting_lists(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """One row per block of documents: ``t0``, ``t1``, ...: the keys of its documents
    that hold the trigram of that number. The key is a hash of the id: ids that
    share one only give each other candidates, which verification settles."""
    blocks = max(1, -(-docs.count() // block))
    low = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.xxhash64(id_col).alias("key"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"),
                       low.alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]), F.isnotnull)
    postings = (rows.select("key", "block", F.explode(held).alias("t")).groupBy("block", "t")
                .agg(F.collect_set("key").alias("keys")))
    return postings.groupBy("block").agg(
        *[F.coalesce(F.first(F.when(F.col("t") == i, F.col("keys")), ignorenulls=True), F.array().cast("array<bigint>")).alias(f"t{i}")
          for i in range(len(trigrams))])


def _answer(query: Query, number: dict[str, int]) -> Column:
    """The keys that satisfy the query, from the posting lists of a block."""
    if isinstance(query, str):
        return F.col(f"t{number[query]}")
    parts = [_answer(q, number) for q in sorted(query[1], key=repr)]
    combine = F.array_intersect if query[0] == "and" else F.array_union
    out = parts[0]
    for p in parts[1:]:
        out = combine(out, p)
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(key, kinds): the rules with mandatory trigrams whose query a document satisfies."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    trigrams = sorted(set().union(*map(trigrams_of, queries.values())))
    number = {t: i for i, t in enumerate(trigrams)}
    index = posting_lists(docs, trigrams, id_col, text_col, block)

    def named(kind: str, query: Query) -> Column:
        return F.transform(_answer(query, number), lambda key: F.struct(key.alias("key"), F.lit(kind).alias("kind")))

    hits = F.concat(*[named(kind, q) for kind, q in queries.items() if q is not None])
    return (index.select(F.explode(hits).alias("hit")).select("hit.key", "hit.kind")
            .groupBy("key").agg(F.collect_set("kind").alias("kinds")))


# ------------------------------------------------------------------ verification
def _spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, rank, kind, end>> of the rule's matches in ``text``.

    ``\\G(.*?)(regex)`` splits a text into gaps and matches: a match begins where the
    one before ended plus its gap. ``\\G`` keeps the search from starting again
    inside a gap, so it takes one pass."""
    # the value is group 3; the regex has one group at most
    pieces = r"(?s)\G(.*?)(" + rule.regex + ")"
    every = lambda g: F.regexp_extract_all(text, F.lit(pieces), F.lit(g))
    parts = F.arrays_zip(every(1).alias("gap"), every(2).alias("hit"), every(3 if rule.has_value else 2).alias("value"))
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.char_length(x["gap"])
        b = a + F.char_length(x["hit"])
        span = F.struct(a.cast("bigint").alias("start"), F.lit(number).alias("rank"), F.lit(rule.kind).alias("kind"),
                        b.cast("bigint").alias("end"))
        more = F.when(F.char_length(x["value"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(b.cast("bigint").alias("at"), more.alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE,
                 added: tuple[Rule, ...] = ADDED, block: int = BLOCK) -> DataFrame:
    """Per row: the id, ``n_<kind>`` of each base rule, ``base_sha256``, ``spans``
    (kind:start:end of all rules, by start) and ``matches`` (start, rank, kind, end)."""
    rules = base + added
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    found = candidates(docs, rules, id_col, text_col, block)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col).alias("key"), text.alias("text")).join(found, "key", "left")
    columns = {}
    for i, rule in enumerate(rules):
        if trigram_query(rule.regex) is not None:
            maybe = F.array_contains("kinds", rule.kind)
        elif rule.kind == "hex":  # runs of the class are maximal, so a long enough one is what must be there
            maybe = F.col("text").rlike(f"[0-9a-f]{{{rule.least}}}")
        else:
            maybe = F.col("text").rlike(rule.regex)
        columns[f"s_{rule.kind}"] = F.when(maybe, _spans(F.col("text"), rule, i)).otherwise(F.array().cast(kind))
    rows = rows.select("doc", *[c.alias(n) for n, c in columns.items()])
    first = F.concat(*[F.col(f"s_{r.kind}") for r in base])
    rows = rows.withColumns({"base_spans": F.array_sort(first),
                             "matches": F.array_sort(F.concat(*[F.col(f"s_{r.kind}") for r in rules]))})
    return rows.select(F.col("doc").alias(id_col),
                       *[F.size(f"s_{r.kind}").cast("bigint").alias(f"n_{r.kind}") for r in base],
                       F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
                       _written(F.col("matches")).alias("spans"), "matches")
