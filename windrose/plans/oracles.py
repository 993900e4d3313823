"""DuckDB SQL for the registered queries, written from their definitions and without the engine's code."""

from __future__ import annotations

_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"

_BASE = f"""
q AS (SELECT item_id AS query_id, text AS query, {_TOKENS.format('text')} AS qt FROM benchmark),
d AS (SELECT doc_id, text, {_TOKENS.format('text')} AS dt FROM documents),
qx AS (SELECT query_id, unnest(qt) AS token FROM q),
dx AS (SELECT doc_id, unnest(dt) AS token FROM d),
shared AS (SELECT query_id, doc_id, CAST(count(*) AS INTEGER) AS shared FROM qx JOIN dx USING (token) GROUP BY ALL),
stage AS (
  SELECT query_id, doc_id, shared, CAST(rn - 1 AS INTEGER) AS original_index
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rn FROM shared) WHERE rn <= 50
),
cand AS (
  SELECT s.query_id, q.query, s.doc_id, d.text, s.original_index,
    CAST((1000000 * CAST(s.shared AS BIGINT)) // (len(d.dt) + len(q.qt) - s.shared) AS BIGINT) AS score
  FROM stage s JOIN d USING (doc_id) JOIN q USING (query_id)
),
good AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
rels AS (
  SELECT query_id, doc_id, CAST(max(rel) AS INTEGER) AS rel FROM (
    SELECT query_id, doc_id, 2 AS rel FROM q JOIN d ON contains(d.text, q.query) WHERE len(q.qt) > 0
    UNION ALL SELECT query_id, doc_id, 1 FROM stage JOIN good USING (doc_id) WHERE quality = 1
  ) GROUP BY ALL
)
"""


def _listwise(w: int, s: int, depth: int = 50, name: str = "ranked") -> str:
    """CTEs that end in ``name``(query_id, rank, original_index, doc_id, score)."""
    return f"""
{name}_p AS (
  SELECT query_id, list({{'k': -score, 'i': original_index, 'doc_id': doc_id}} ORDER BY original_index) AS docs, CAST(count(*) AS INTEGER) AS n
  FROM cand WHERE original_index < {depth} GROUP BY query_id
),
{name}_r AS (
  SELECT query_id, docs, n, greatest(n - {w}, 0) AS st, false AS done FROM {name}_p
  UNION ALL
  SELECT query_id, docs[1:st] || list_sort(docs[st + 1:st + {w}]) || docs[st + {w} + 1:n], n, greatest(st - {s}, 0), st = 0
  FROM {name}_r WHERE NOT done
),
{name} AS (
  SELECT query_id, CAST(u AS INTEGER) AS rank, docs[u].i AS original_index, docs[u].doc_id AS doc_id, -docs[u].k AS score
  FROM {name}_r, LATERAL (SELECT unnest(range(1, n + 1)) AS u) WHERE done
)"""


def _pairwise(passes: int, name: str = "ranked") -> str:
    return f"""
{name}_p AS (
  SELECT query_id, list({{'k': -score, 'i': original_index, 'doc_id': doc_id}} ORDER BY original_index) AS docs, CAST(count(*) AS INTEGER) AS n
  FROM cand GROUP BY query_id
),
{name}_r AS (
  SELECT query_id, docs, n, 1 AS pass, n AS place FROM {name}_p
  UNION ALL
  SELECT query_id,
    CASE WHEN place >= 2 AND docs[place].k < docs[place - 1].k
      THEN docs[1:place - 2] || [docs[place], docs[place - 1]] || docs[place + 1:n] ELSE docs END,
    n, CASE WHEN place <= 2 THEN pass + 1 ELSE pass END, CASE WHEN place <= 2 THEN n ELSE place - 1 END
  FROM {name}_r WHERE pass <= {passes}
),
{name} AS (
  SELECT query_id, CAST(u AS INTEGER) AS rank, docs[u].i AS original_index, docs[u].doc_id AS doc_id, -docs[u].k AS score
  FROM {name}_r, LATERAL (SELECT unnest(range(1, n + 1)) AS u) WHERE pass = {passes + 1}
)"""


def _original(name: str = "ranked") -> str:
    return f"{name} AS (SELECT query_id, CAST(original_index + 1 AS INTEGER) AS rank, original_index, doc_id, score FROM cand)"


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join([_BASE, *ctes]) + "\n" + select


def _scores(ranked: str = "ranked", name: str = "scores") -> str:
    return f"""
{name}_j AS (
  SELECT r.query_id, r.rank, coalesce(rels.rel, 0) AS rel, sum(CASE WHEN coalesce(rels.rel, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS seen
  FROM {ranked} r LEFT JOIN rels USING (query_id, doc_id)
),
{name}_i AS (
  SELECT query_id, count(*) AS relevant, sum(CASE WHEN rn <= 10 THEN rel / log2(rn + 1) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS rn FROM rels) GROUP BY query_id
),
{name} AS (
  SELECT j.query_id,
    coalesce(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / any_value(idcg), 0) AS ndcg,
    coalesce(1.0 / min(CASE WHEN rank <= 10 AND rel > 0 THEN rank END), 0) AS mrr,
    coalesce(count(CASE WHEN rank <= 10 AND rel > 0 THEN 1 END) / any_value(relevant), 0) AS recall,
    coalesce(sum(CASE WHEN rel > 0 THEN seen / rank ELSE 0 END) / any_value(relevant), 0) AS map
  FROM {name}_j j LEFT JOIN {name}_i i USING (query_id) GROUP BY j.query_id
)"""


_LIST20 = _listwise(20, 10)
_ROWS = "SELECT query_id, rank, original_index, doc_id, CAST(score AS BIGINT) AS score FROM ranked"

_RESULTS = [
    _original("ro"), _listwise(20, 10, name="rl"), _pairwise(10, name="rp"), _scores("ro", "so"), _scores("rl", "sl"), _scores("rp", "sp"),
    """
all_scores AS (
  SELECT 'original' AS method, * FROM so UNION ALL SELECT 'rankgpt_sliding_window@50', * FROM sl UNION ALL SELECT 'prp_sliding_k@50', * FROM sp
),
flagged AS (SELECT *, method <> 'original' AS called, method = 'original' OR query_id % 7 <> 0 AS valid FROM all_scores),
results AS (
  SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, query_id, method, valid,
    CASE WHEN valid THEN ndcg ELSE 0 END AS ndcg_at_10, CASE WHEN valid THEN mrr ELSE 0 END AS mrr_at_10,
    CASE WHEN valid THEN map ELSE 0 END AS map, CASE WHEN valid THEN recall ELSE 0 END AS recall_at_10,
    CASE WHEN valid THEN NULL WHEN query_id % 2 = 0 THEN 'llm_output_invalid' ELSE 'provider_error' END AS failure_type,
    CASE WHEN called THEN CAST(query_id * 37 % 101 AS DOUBLE) ELSE 0.0 END AS latency_ms,
    CASE WHEN called AND valid THEN query_id * 10 END AS prompt_tokens, CASE WHEN called AND valid THEN query_id END AS completion_tokens,
    CASE WHEN called THEN query_id % 9 + 1 ELSE 0 END AS llm_calls,
    CASE WHEN called AND valid THEN (query_id * 10 * 2.5 + query_id * 10.0) / 1e6 END AS cost
  FROM flagged
)""",
]

_METRICS = ["ndcg_at_10", "mrr_at_10", "map", "recall_at_10"]
_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in _METRICS)
_VALID_MEANS = ", ".join(f"round(coalesce(avg(CASE WHEN valid THEN {m} END), 0), 9) AS {m}_valid_only" for m in _METRICS)

_SUMMARY = f"""
SELECT method, task, CASE WHEN grouping(task) = 1 THEN 'overall' ELSE 'task' END AS level, count(*) AS query_count,
  count(CASE WHEN valid THEN 1 END) AS valid_count, round(avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END), 9) AS invalid_rate, {_MEANS}, {_VALID_MEANS},
  quantile_disc(latency_ms, 0.5) AS latency_p50_ms, quantile_disc(latency_ms, 0.95) AS latency_p95_ms,
  round(coalesce(avg(prompt_tokens), 0), 9) AS prompt_tokens_mean, round(coalesce(avg(completion_tokens), 0), 9) AS completion_tokens_mean,
  round(avg(llm_calls), 9) AS llm_calls_mean, CAST(sum(llm_calls) AS BIGINT) AS llm_calls_total, round(coalesce(sum(cost), 0), 9) AS cost_total,
  round(coalesce(avg(cost), 0), 9) AS cost_mean_costed, round(avg(coalesce(cost, 0)), 9) AS cost_mean_all
FROM results GROUP BY GROUPING SETS ((method), (method, task))"""

_SIZES = "WITH s AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey)\n"

ORACLES: dict[str, str] = {
    "first_stage": _with(select="SELECT * FROM stage"),
    "rerank_listwise_window": _with(_LIST20, select=_ROWS),
    "rerank_listwise_single": _with(
        "ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_index) AS INTEGER) AS rank, original_index, doc_id, score FROM cand)",
        select=_ROWS,
    ),
    "rerank_original": _with(_original(), select=_ROWS),
    "rerank_prp_k1": _with(_pairwise(1), select=_ROWS),
    "rerank_prp_k10": _with(_pairwise(10), select=_ROWS),
    "rerank_top_k": _with(_LIST20, select=_ROWS + " WHERE rank <= 5"),
    "candidate_scope_at_n": _with(_listwise(20, 10, 20), select=_ROWS),
    "provider_listwise": _with(_LIST20, select=_ROWS),
    "provider_pairwise": _with(_pairwise(10), select=_ROWS),
    **{
        f"metric_{query}": _with(_LIST20, _scores(), select=f"SELECT query_id, round({short}, 6) AS {name} FROM scores")
        for query, short, name in (("ndcg10", "ndcg", "ndcg_at_k"), ("mrr10", "mrr", "mrr_at_k"), ("recall10", "recall", "recall_at_k"), ("map", "map", "map"))
    },
    "metric_zero_on_invalid": _with(*_RESULTS, select="SELECT query_id, method, valid, " + ", ".join(f"round({m}, 9) AS {m}" for m in _METRICS) + " FROM results"),
    "summary_by_method": _with(*_RESULTS, select=f"SELECT method, count(*) AS case_count, {_MEANS} FROM results GROUP BY method"),
    "summary_by_task_method": _with(*_RESULTS, select=_SUMMARY),
    "failure_histogram": _with(*_RESULTS, select="SELECT method, failure_type, count(*) AS failures FROM results WHERE failure_type IS NOT NULL GROUP BY ALL"),
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "call_estimates": _SIZES + "SELECT l_orderkey, n, CAST(CASE WHEN n <= 3 THEN 1 ELSE ceil((n - 3) / 2.0) + 1 END AS INTEGER) AS listwise, CAST(20 * greatest(n - 1, 0) AS INTEGER) AS pairwise FROM s",
    "window_plan": _SIZES.replace("WITH", "WITH RECURSIVE", 1).rstrip()
    + """, r AS (
  SELECT l_orderkey, n, CAST(0 AS INTEGER) AS call, greatest(n - 3, 0) AS start FROM s
  UNION ALL SELECT l_orderkey, n, call + 1, greatest(start - 2, 0) FROM r WHERE start > 0
) SELECT l_orderkey, call, CAST(start AS INTEGER) AS start, CAST(least(start + 3, n) AS INTEGER) AS upto FROM r""",
    "cost_estimate": """WITH good AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT doc_id, CASE WHEN quality IS NOT NULL THEN round((n_chars * 2.5 + (n_chars // 10) * 10.0) / 1e6, 9) END AS cost
FROM documents LEFT JOIN good USING (doc_id)""",
    "stable_seed": "SELECT item_id AS query_id, CAST('0x' || substr(sha256('13:Task:' || item_id), 1, 8) AS BIGINT) AS seed FROM benchmark",
    "prompt_listwise": _with(
        """prompts AS (
  SELECT query_id, 'Search query:' || chr(10) || any_value(query) || chr(10) || chr(10) || 'Passages:' || chr(10)
    || string_agg('[' || (original_index + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY original_index) AS p
  FROM cand GROUP BY query_id)""",
        select="SELECT query_id, md5(p) AS digest, length(p) AS chars FROM prompts",
    ),
    "prompt_pairwise": _with(
        """prompts AS (
  SELECT a.query_id, a.original_index, 'Search query:' || chr(10) || a.query || chr(10) || chr(10) || 'Passage A:' || chr(10) || a.text
    || chr(10) || chr(10) || 'Passage B:' || chr(10) || b.text AS p
  FROM cand a JOIN cand b ON a.query_id = b.query_id AND b.original_index = a.original_index + 1)""",
        select="SELECT query_id, original_index, md5(p) AS digest, length(p) AS chars FROM prompts",
    ),
    "parse_ranking_failures": """WITH s AS (
  SELECT l_orderkey AS k, CAST(count(*) AS INTEGER) AS n, list(l_linenumber ORDER BY l_linenumber) AS r FROM lineitem GROUP BY l_orderkey
), b AS (
  SELECT k, n, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN r || [CAST(NULL AS INTEGER)] WHEN 2 THEN r || [1] WHEN 3 THEN list_transform(r, lambda x: x + 1)
    WHEN 4 THEN list_transform(r, lambda x: 1) ELSE list_reverse(r) END AS r FROM s
), f AS (
  SELECT k, CASE WHEN r IS NULL THEN 'missing_ranking' WHEN len(list_filter(r, lambda x: x IS NULL)) > 0 THEN 'non_integer_rank'
    WHEN len(r) <> n THEN 'length_mismatch' WHEN len(list_filter(r, lambda x: x < 1 OR x > n)) > 0 THEN 'out_of_range_rank'
    WHEN len(list_distinct(r)) <> len(r) THEN 'duplicate_rank' END AS failure_type FROM b
) SELECT k AS l_orderkey, failure_type, failure_type IS NULL AS valid FROM f""",
    "parse_winner": """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS winner FROM conversations""",
    "qrels_join_default0": _with(select="SELECT query_id, doc_id, CAST(coalesce(rel, 0) AS INTEGER) AS rel FROM cand LEFT JOIN rels USING (query_id, doc_id)"),
    "method_cross_join": "SELECT item_id AS query_id, method FROM benchmark, (VALUES ('original'), ('rankgpt_sliding_window@50'), ('prp_sliding_k@50')) m(method)",
    "pending_anti_join": _with(
        select="""SELECT query_id, 'rankgpt_sliding_window@50' AS method FROM q WHERE query_id NOT IN (SELECT query_id FROM rels)
UNION ALL SELECT query_id, 'prp_sliding_k@50' FROM q"""
    ),
    "dup_candidates": "SELECT md5(text) AS digest, count(*) AS count FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "length_guard": "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CASE WHEN length(text) > 4000 THEN 'document_too_long' END AS failure_type FROM documents",
    "oracle_plus_hash_candidates": _with(
        """n AS (SELECT query_id, count(*) AS n FROM rels GROUP BY query_id),
picked AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS i, true AS relevant FROM rels
  UNION ALL
  SELECT query_id, doc_id, i + n - 1, false FROM (
    SELECT n.query_id, n, d.doc_id, row_number() OVER (PARTITION BY n.query_id ORDER BY sha256('13:' || d.doc_id), d.doc_id) AS i
    FROM n, d WHERE NOT EXISTS (SELECT 1 FROM rels WHERE rels.query_id = n.query_id AND rels.doc_id = d.doc_id)
  ) WHERE i <= 1000 - n
)""",
        select="SELECT query_id, doc_id, CAST(i AS INTEGER) AS original_index, relevant FROM picked",
    ),
    "hash_shuffle": _with(
        select="""SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sha256('13:' || query_id || ':' || doc_id), doc_id) - 1 AS INTEGER) AS original_index
FROM cand"""
    ),
}
