"""Explicit schemas: nothing here is ever inferred from data."""

DOCUMENT = "struct<id:string,title:string,text:string>"
CASE = (
    "schema_version int, fixture_id string, dataset string, source string, license string, query_id string, query string, "
    f"documents array<{DOCUMENT}>, qrels map<string,int>"
)
CANDIDATES = "query_id string, query string, original_index int, doc_id string, text string, metadata map<string,string>"
QRELS = "query_id string, doc_id string, rel int"
SAMPLE = "task string, split string, query_id string, query string, original_index int, doc_id string, text string, label double"
QUERY_RESULTS = (
    "task string, split string, query_id string, method string, ndcg_at_10 double, mrr_at_10 double, map double, recall_at_10 double, "
    "valid boolean, failure_type string, error string, latency_ms double, prompt_tokens bigint, completion_tokens bigint, "
    "llm_calls int, cost double, ranked_doc_ids array<string>"
)
OUTCOME = (
    "order array<int>, valid boolean, failure_type string, error string, raw_response string, latency_ms double, prompt_tokens bigint, "
    "completion_tokens bigint, usage_reports int, llm_calls int"
)
RESULT_KEY = ["task", "split", "query_id", "method"]
