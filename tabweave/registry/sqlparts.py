"""Reusable DuckDB oracle fragments (plain SQL text)."""

from __future__ import annotations


def seeded_md5(seed: int, col: str) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({col} AS VARCHAR)))"


def seeded_uint(seed: int, col: str) -> str:
    return f"('0x' || substr({seeded_md5(seed, col)}, 1, 15))::BIGINT"


def ratio(m: str, r: float) -> str:
    """int(m * r) with the double product truncated."""
    return f"CAST(floor(({m})::DOUBLE * {float(r)}::DOUBLE) AS BIGINT)"


WORD_TOKENS = "unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'))"
CHAR3_TOKENS = ("unnest(CASE WHEN length(' ' || lower(coalesce(text, '')) || ' ') >= 3 THEN "
                "list_transform(range(1, length(' ' || lower(coalesce(text, '')) || ' ') - 1), "
                "lambda i: substr(' ' || lower(coalesce(text, '')) || ' ', i, 3)) ELSE [] END)")


def tfidf_top1(t1_sql: str, t2_sql: str, analyzer: str = "word") -> str:
    """CTE chain ending in ``best(t1_id, t2_id, sim)``: TF-IDF cosine 1-NN.
    ``t1_sql`` / ``t2_sql`` select ``id, text``."""
    toks = WORD_TOKENS if analyzer == "word" else CHAR3_TOKENS
    return f"""
corpus AS (SELECT 1 AS side, CAST(id AS BIGINT) AS id, text FROM ({t1_sql})
           UNION ALL SELECT 2, CAST(id AS BIGINT), text FROM ({t2_sql})),
tok AS (SELECT side, id, t AS tok FROM (
          SELECT side, id, {toks} AS t
          FROM corpus) WHERE t <> ''),
tf AS (SELECT side, id, tok, count(*) AS tf FROM tok GROUP BY side, id, tok),
dfreq AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
nd AS (SELECT count(*) AS n FROM corpus),
w AS (SELECT tf.side, tf.id, tf.tok,
             tf.tf * (ln((nd.n + 1)::DOUBLE / (dfreq.df + 1)::DOUBLE) + 1) AS w
      FROM tf JOIN dfreq USING (tok) CROSS JOIN nd),
nrm AS (SELECT side, id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY side, id),
wn AS (SELECT w.side, w.id, w.tok, w.w / nrm.nrm AS w FROM w JOIN nrm USING (side, id)),
pairs AS (SELECT a.id AS t1_id, b.id AS t2_id, sum(a.w * b.w) AS sim
          FROM wn a JOIN wn b ON a.tok = b.tok AND a.side = 1 AND b.side = 2
          GROUP BY a.id, b.id),
cand AS (SELECT t1_id, t2_id, sim FROM pairs
         UNION ALL SELECT id, (SELECT min(id) FROM corpus WHERE side = 2), 0.0 FROM corpus WHERE side = 1),
best AS (SELECT t1_id, t2_id, sim FROM (
           SELECT *, row_number() OVER (PARTITION BY t1_id ORDER BY sim DESC, t2_id) AS rn FROM cand)
         WHERE rn = 1)"""


def vector_topk(vec_sql: str, k: int, exclude_self: bool = True) -> str:
    """CTE chain ending in ``knn(t1_id, t2_id, sim, rank)`` over ``vec_sql`` (id, e)."""
    cond = "a.id <> b.id" if exclude_self else "TRUE"
    return f"""
v AS (SELECT CAST(id AS BIGINT) AS id, CAST(e AS DOUBLE[]) AS e FROM ({vec_sql})),
vn AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS nrm FROM v),
pairs AS (SELECT a.id AS t1_id, b.id AS t2_id,
                 CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0
                      ELSE list_dot_product(a.e, b.e) / (a.nrm * b.nrm) END AS sim
          FROM vn a JOIN vn b ON {cond}),
knn AS (SELECT * FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY t1_id ORDER BY sim DESC, t2_id) AS INTEGER) AS rank
          FROM pairs) WHERE rank <= {k})"""
