"""DuckDB SQL for ``more_queries``, from the tables themselves: no loader, run or stream has a part in it."""

from __future__ import annotations

from windrose.plans.oracles import _LIST20, _ROWS, _SIZES, _listwise, _original, _pairwise, _scores, _with

_CASES = """
ids AS (SELECT query_id FROM (SELECT DISTINCT CAST(query_id AS VARCHAR) AS query_id FROM cand JOIN rels USING (query_id)) ORDER BY query_id LIMIT 25)"""

_LOG = """
good_rels AS (SELECT query_id, doc_id, coalesce(quality, 0) AS rel FROM cand LEFT JOIN good USING (doc_id)),
every AS (
  SELECT 'original' AS method, * FROM ro UNION ALL SELECT 'rankgpt_sliding_window@50', * FROM rl UNION ALL SELECT 'rankgpt_sliding_window@20', * FROM rs
),
seen AS (
  SELECT e.method, e.query_id, rank, coalesce(rel, 0) AS rel, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY method, e.query_id ORDER BY rank) AS seen
  FROM every e LEFT JOIN good_rels g USING (query_id, doc_id)
),
wanted AS (SELECT query_id, count(CASE WHEN rel > 0 THEN 1 END) AS relevant, count(*) AS n FROM good_rels GROUP BY query_id)"""

ORACLES: dict[str, str] = {
    "load_corpus": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, md5(text) AS digest FROM documents WHERE text <> ''",
    "load_beir": _with(
        _CASES,
        select="""SELECT 'beir-scifact-test-' || cand.query_id AS case_id, CAST(cand.query_id AS VARCHAR) AS query_id, CAST(cand.doc_id AS VARCHAR) AS doc_id, original_index,
  md5(source || chr(10) || chr(10) || cand.text) AS digest, md5(query) AS asked
FROM cand JOIN documents USING (doc_id) WHERE CAST(cand.query_id AS VARCHAR) IN (SELECT query_id FROM ids)""",
    ),
    "load_qrels": "SELECT DISTINCT 'q' AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, quality AS rel FROM labels WHERE quality > 0 AND toxic IS NOT NULL",
    "load_fixture": _with(
        select="""SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, original_index, md5('t' || chr(10) || chr(10) || text) AS digest, CAST(coalesce(rel, 0) AS INTEGER) AS rel
FROM cand LEFT JOIN rels USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM rels)"""
    ),
    "load_tasks": _with(
        """firsts AS (
  SELECT query_id FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id % 2 ORDER BY CAST(query_id AS VARCHAR)) AS nth FROM (SELECT DISTINCT query_id FROM cand)) WHERE nth <= 10
)""",
        select="""SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, 'test' AS split, CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, original_index,
  md5(regexp_replace(CASE WHEN doc_id % 2 = 0 AND source <> '' THEN source || chr(10) || chr(10) || cand.text ELSE cand.text END, '^\\s+|\\s+$', '', 'g')) AS digest,
  CAST(coalesce(quality, 0) AS INTEGER) AS label
FROM cand JOIN documents USING (doc_id) LEFT JOIN good USING (doc_id) WHERE query_id IN (SELECT query_id FROM firsts)""",
    ),
    "resume_after_crash": _with(
        _original("ro"), _listwise(20, 10, name="rl"), _listwise(20, 10, 20, "rs"), _LOG,
        select="""SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, CAST(query_id AS VARCHAR) AS query_id, method, true AS valid,
  CAST(CASE method WHEN 'original' THEN 0 WHEN 'rankgpt_sliding_window@20' THEN 1 ELSE CASE WHEN any_value(n) <= 20 THEN 1 ELSE ceil((any_value(n) - 20) / 10.0) + 1 END END AS INTEGER) AS llm_calls,
  round(coalesce(1.0 / min(CASE WHEN rank <= 10 AND rel > 0 THEN rank END), 0), 9) AS mrr_at_10,
  round(CASE WHEN any_value(relevant) > 0 THEN sum(CASE WHEN rel > 0 THEN seen / rank ELSE 0 END) / any_value(relevant) ELSE 0 END, 9) AS map,
  round(CASE WHEN any_value(relevant) > 0 THEN count(CASE WHEN rank <= 10 AND rel > 0 THEN 1 END) / any_value(relevant) ELSE 0 END, 9) AS recall_at_10
FROM seen JOIN wanted USING (query_id) GROUP BY query_id, method""",
    ),
    "compare_algorithms": _with(
        _listwise(20, 10, name="rl"), _pairwise(10, name="rp"), _scores("rl", "sl"), _scores("rp", "sp"),
        "n AS (SELECT query_id, count(*) AS n FROM cand GROUP BY query_id)",
        """joint AS (SELECT 'rankgpt_sliding_window' AS algorithm, * FROM sl UNION ALL SELECT 'prp_sliding_k', * FROM sp)""",
        select="""SELECT algorithm, count(*) AS case_count, round(avg(ndcg), 9) AS ndcg_at_k, round(avg(mrr), 9) AS mrr_at_k, round(avg(recall), 9) AS recall_at_k, round(avg(map), 9) AS map,
  CAST(sum(CASE WHEN algorithm = 'prp_sliding_k' THEN 20 * (n - 1) WHEN n <= 20 THEN 1 ELSE ceil((n - 20) / 10.0) + 1 END) AS BIGINT) AS calls
FROM joint JOIN n USING (query_id) GROUP BY algorithm""",
    ),
    "aggregate_by_algorithm": _with(
        _original("ro"),
        "rs AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_index) AS INTEGER) AS rank, original_index, doc_id, score FROM cand)",
        _scores("ro", "so"), _scores("rs", "ss"),
        """joint AS (SELECT 'first_stage' AS algorithm, * FROM so UNION ALL SELECT 'single', * FROM ss)""",
        select="SELECT algorithm, count(*) AS case_count, round(avg(ndcg), 9) AS ndcg_at_k, round(avg(mrr), 9) AS mrr_at_k, round(avg(recall), 9) AS recall_at_k, round(avg(map), 9) AS map FROM joint GROUP BY algorithm",
    ),
    "call_totals": _SIZES
    + """SELECT 'listwise' AS algorithm, CAST(sum(CASE WHEN n <= 3 THEN 1 ELSE ceil((n - 3) / 2.0) + 1 END) AS BIGINT) AS calls FROM s
UNION ALL SELECT 'pairwise', CAST(sum(20 * (n - 1)) AS BIGINT) FROM s""",
    "window_ranges": _SIZES.replace("WITH", "WITH RECURSIVE", 1).rstrip()
    + """, r AS (
  SELECT l_orderkey, CAST(0 AS INTEGER) AS call, n AS upto FROM s
  UNION ALL SELECT l_orderkey, call + 1, upto - 2 FROM r WHERE upto > 3
) SELECT l_orderkey, call, CAST(greatest(upto - 3, 0) AS INTEGER) AS start, CAST(upto AS INTEGER) AS upto FROM r""",
    "compose_titles": """WITH t AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source END AS title FROM documents)
SELECT doc_id, md5(coalesce(title, '') || chr(10) || chr(10) || text) AS always,
  md5(regexp_replace(CASE WHEN coalesce(title, '') <> '' THEN title || chr(10) || chr(10) || text ELSE text END, '^\\s+|\\s+$', '', 'g')) AS optional FROM t""",
    "apply_permutation": """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) - 1 AS INTEGER) AS pos, l_partkey FROM lineitem""",
    "strict_rankings": _SIZES
    + """SELECT l_orderkey, CASE l_orderkey % 8 WHEN 0 THEN 'json_parse_failure' WHEN 1 THEN 'json_parse_failure' WHEN 2 THEN 'missing_ranking' WHEN 3 THEN 'non_integer_rank'
  WHEN 4 THEN 'length_mismatch' WHEN 5 THEN 'out_of_range_rank' END AS failure_type, CASE WHEN l_orderkey % 8 > 5 THEN n END AS best FROM s""",
    "usage_totals": _with(
        """n AS (SELECT query_id, count(*) AS n FROM cand GROUP BY query_id), c AS (SELECT *, CASE WHEN n <= 20 THEN 1 ELSE ceil((n - 20) / 10.0) + 1 END AS calls FROM n)""",
        select="""SELECT query_id, true AS valid, CAST(calls AS INTEGER) AS llm_calls, CAST(calls AS INTEGER) AS usage_reports, CAST(calls * least(n, 20) AS BIGINT) AS prompt_tokens,
  CAST(calls AS BIGINT) AS completion_tokens FROM c""",
    ),
    "custom_strategy": _with(
        select="""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_index) AS INTEGER) AS rank, original_index, doc_id, score, 'custom' AS strategy FROM cand"""
    ),
    "stream_rerank": _with(_LIST20, select="SELECT query_id, rank, original_index, doc_id FROM ranked"),
    "duplicate_pairs": "SELECT o_custkey, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1",
    "provider_listwise_async": _with(_LIST20, select=_ROWS),
    "provider_pairwise_async": _with(_pairwise(2), select=_ROWS),
}
