"""Benchmark loaders: fixture cases, BEIR-style caches and retrieval-task tables, as DataFrames with explicit schemas.

Wrong input is an error that names file and line; nothing is skipped but blank lines.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.errors import DocumentTooLongError
from windrose.functions.scalar import compose_optional_title, compose_title
from windrose.operators.candidates import duplicates, must_match, oracle_plus_hash, seeded_shuffle, with_defaults
from windrose.schemas import CASE
from windrose.sources.lines import fail_on_first, numbered_lines, require_file

_BLANK = r"(?U)^\s*$"
_HEADER = ["query-id", "query_id", "corpus-id", "score"]


def _json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line_no, value, kind, row): every line that is not blank, parsed by ``schema``."""
    lines = numbered_lines(spark, require_file(path)).where(~F.col("value").rlike(_BLANK))
    variant = F.try_parse_json("value")
    kind = F.when(variant.isNull(), "not JSON").when(~F.schema_of_variant(variant).startswith("OBJECT"), "not a JSON object")
    return lines.select("path", "line_no", "value", kind.alias("kind"), F.from_json("value", schema, {"allowSingleQuotes": "false"}).alias("row"))


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line_no, row) of a JSONL file, one object a line; the first line that is none is an error that names it."""
    rows = _json_rows(spark, path, schema)
    fail_on_first(rows.where("kind is not null").select("path", "line_no", F.col("kind").alias("reason")))
    return rows.select("line_no", "row")


def case_id(dataset: str, split: str, query_id: Column) -> Column:
    return F.concat(F.lit(f"{dataset}-{split}-"), query_id.cast("string"))


def _text_reason(row: Column, fields: list[str]) -> list[tuple[Column, str]]:
    return [(F.coalesce(row[f], F.lit("")) == "", f"{f} must be a string that is not empty") for f in fields]


def _reason(kind: Column, rules: list[tuple[Column, str]]) -> Column:
    reason = F.when(kind.isNotNull(), kind)
    for test, message in rules:
        reason = reason.when(test, message)
    return reason


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Nested fixture cases (JSONL), all fields checked; an empty file is an error."""
    rows, row = _json_rows(spark, path, CASE), F.col("row")
    bad_document = F.exists(row["documents"], lambda d: (F.coalesce(d["id"], F.lit("")) == "") | (F.coalesce(d["title"], F.lit("")) == "") | (F.coalesce(d["text"], F.lit("")) == ""))
    rules = [
        (F.coalesce(row["schema_version"] != 1, F.lit(True)), "schema_version must be 1"),
        *_text_reason(row, ["fixture_id", "dataset", "source", "license", "query_id", "query"]),
        (F.coalesce(F.size(row["documents"]), F.lit(0)) < 1, "documents must be a list that is not empty"),
        (F.coalesce(bad_document, F.lit(True)), "a document needs id, title and text"),
        (row["qrels"].isNull(), "qrels must be an object"),
        (F.exists(F.map_values(row["qrels"]), lambda v: v.isNull()), "qrels must be whole numbers"),
    ]
    fail_on_first(rows.select("path", "line_no", _reason(F.col("kind"), rules).alias("reason")).where("reason is not null"))
    if rows.isEmpty():
        raise ValueError(f"{path}: no cases")
    return rows.select("line_no", "row.*")


def case_tables(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, qrels) in the long form: text is title, blank line, text."""
    exploded = cases.select("query_id", "query", F.posexplode("documents").alias("original_index", "d"))
    candidates = exploded.select("query_id", "query", "original_index", F.col("d.id").alias("doc_id"), compose_title(F.col("d.title"), F.col("d.text")).alias("text"))
    return candidates, cases.select("query_id", F.explode("qrels").alias("doc_id", "rel"))


def _unique(rows: DataFrame, key: str, path: str) -> None:
    twice = duplicates(rows, [key]).orderBy(key).limit(1).collect()
    if twice:
        raise ValueError(f"{path}: {key} {twice[0][key]!r} comes {twice[0]['count']} times")


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) from JSONL with _id, title (may be missing) and text."""
    rows, row = _json_rows(spark, path, "_id string, title string, text string"), F.col("row")
    fail_on_first(rows.select("path", "line_no", _reason(F.col("kind"), _text_reason(row, ["_id", "text"])).alias("reason")).where("reason is not null"))
    out = rows.select(row["_id"].alias("doc_id"), F.coalesce(row["title"], F.lit("")).alias("title"), row["text"].alias("text"))
    if out.isEmpty():
        raise ValueError(f"{path}: no documents")
    _unique(out, "doc_id", path)
    return out


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) from JSONL with _id and text."""
    rows, row = _json_rows(spark, path, "_id string, text string"), F.col("row")
    fail_on_first(rows.select("path", "line_no", _reason(F.col("kind"), _text_reason(row, ["_id", "text"])).alias("reason")).where("reason is not null"))
    out = rows.select(row["_id"].alias("query_id"), row["text"].alias("query"))
    if out.isEmpty():
        raise ValueError(f"{path}: no queries")
    _unique(out, "query_id", path)
    return out


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, f): lines split at white space, without blank lines and a header on line 1."""
    lines = numbered_lines(spark, require_file(path)).where(~F.col("value").rlike(_BLANK))
    fields = F.split(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    header = (F.col("line_no") == 1) & F.exists(fields, lambda x: F.lower(x).isin(_HEADER))
    return lines.where(~header).select("path", "line_no", fields.alias("f"))


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel): positive judgments, the last of several; a later 0 takes nothing back."""
    rows = _fields(spark, path)
    score = F.get("f", F.lit(2)).try_cast("int")
    reason = F.when(F.size("f") < 3, "three columns are needed").when(score.isNull(), "the score must be a whole number")
    fail_on_first(rows.select("path", "line_no", reason.alias("reason")).where("reason is not null"))
    positive = rows.select(F.get("f", F.lit(0)).alias("query_id"), F.get("f", F.lit(1)).alias("doc_id"), score.alias("rel"), "line_no").where("rel > 0")
    return positive.groupBy("query_id", "doc_id").agg(F.max_by("rel", "line_no").alias("rel"))


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, original_index): the file's order counts, a rank column doesn't."""
    rows = _fields(spark, path)
    fail_on_first(rows.select("path", "line_no", F.when(F.size("f") < 2, "two columns are needed").alias("reason")).where("reason is not null"))
    pairs = rows.select("path", "line_no", F.get("f", F.lit(0)).alias("query_id"), F.get("f", F.lit(1)).alias("doc_id"))
    again = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("line_no"))
    fail_on_first(pairs.withColumn("nth", again).where("nth > 1").select("path", "line_no", F.lit("the candidate was given before").alias("reason")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("line_no")) - 1
    return pairs.select("query_id", "doc_id", place.cast("int").alias("original_index"))


def load_beir(
    spark: SparkSession, cache_dir: str, *, split: str = "test", candidates_path: str | None = None, candidate_strategy: str = "candidate_file",
    candidate_count: int = 20, max_cases: int | None = None, seed: int = 13, dataset: str = "beir-scifact",
) -> tuple[DataFrame, DataFrame]:
    """(candidates, qrels) of a cache with corpus.jsonl, queries.jsonl and qrels/<split>.tsv; queries in string order up to ``max_cases``.

    Candidates bear a ``case_id`` of dataset, split and query.
    """
    corpus = load_corpus(spark, os.path.join(cache_dir, "corpus.jsonl"))
    queries = load_queries(spark, os.path.join(cache_dir, "queries.jsonl"))
    qrels = load_qrels(spark, os.path.join(cache_dir, "qrels", f"{split}.tsv"))
    if candidate_strategy == "candidate_file":
        if candidates_path is None:
            raise ValueError("candidate_file needs candidates_path")
        pairs = load_candidates(spark, candidates_path)
    elif candidate_strategy == "oracle_plus_random":
        pairs = oracle_plus_hash(corpus, qrels, candidate_count, seed).drop("relevant")
    else:
        raise ValueError(f"no such candidate strategy: {candidate_strategy!r}")
    if max_cases is not None:
        if max_cases < 1:
            raise ValueError("max_cases must be 1 or more")
        pairs = pairs.join(pairs.select("query_id").distinct().orderBy("query_id").limit(max_cases), "query_id", "left_semi")
    judged = qrels.select("query_id").distinct()
    rows = must_match(must_match(pairs, judged, ["query_id"], "judgments"), queries, ["query_id"], "query")
    rows = must_match(rows, corpus, ["doc_id"], "document")
    text = compose_title(F.col("title"), F.col("text")).alias("text")
    return rows.select("query_id", "query", "original_index", "doc_id", text, case_id(dataset, split, F.col("query_id")).alias("case_id")), qrels


def task_samples(
    corpus: DataFrame, queries: DataFrame, relevant: DataFrame, top_ranked: DataFrame | None, *, task: str, split: str = "test", max_queries: int | None = None,
    max_document_chars: int | None = None, shuffle_seed: int | None = None,
) -> DataFrame:
    """Long samples of a retrieval task: corpus (doc_id, title, text), queries (query_id, query), relevant (query_id, doc_id, label), top_ranked (query_id, doc_id, original_index).

    Without ``top_ranked`` the judged documents are the candidates, provided that every query has one that is not relevant.
    A candidate longer than ``max_document_chars`` is an error that names it, before anything is asked. ``shuffle_seed``: candidates in a seeded order.
    """
    if top_ranked is None:
        lacking = relevant.groupBy("query_id").agg(F.bool_or(F.col("label") <= 0).alias("some")).where("not some")
        if not lacking.isEmpty():
            raise ValueError(f"{task}: without ranked candidates every query needs a judged document that is not relevant")
        place = F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")) - 1
        top_ranked = relevant.select("query_id", "doc_id", place.cast("int").alias("original_index"))
    if max_queries is not None:
        top_ranked = top_ranked.join(top_ranked.select("query_id").distinct().orderBy("query_id").limit(max_queries), "query_id", "left_semi")
    texts = corpus.select("doc_id", compose_optional_title(F.col("title"), F.col("text")).alias("text"))
    joined = with_defaults(top_ranked, texts, queries, relevant)
    rows = joined.select(F.lit(task).alias("task"), F.lit(split).alias("split"), "query_id", "query", "original_index", "doc_id", "text", "label")
    if max_document_chars is not None:
        long = rows.where(F.length("text") > max_document_chars).select("query_id", "doc_id", F.length("text").alias("n")).orderBy("query_id", "doc_id").limit(1).collect()
        if long:
            raise DocumentTooLongError(f"{task}: query {long[0]['query_id']} document {long[0]['doc_id']} has {long[0]['n']} characters; the limit is {max_document_chars}")
    return rows if shuffle_seed is None else seeded_shuffle(rows, shuffle_seed)


#: Tables of a stored task: a folder <root>/<task>/<split>/ with <name>.parquet or <name>.jsonl each.
TASK_TABLES = {
    "corpus": "doc_id string, title string, text string", "queries": "query_id string, query string",
    "relevant_docs": "query_id string, doc_id string, label double", "top_ranked": "query_id string, doc_id string, original_index int",
}


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def split_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of a stored task's split; None where it has none."""
    there = _children(spark, folder)
    if f"{name}.parquet" in there:
        read = spark.read.parquet(f"{folder}/{name}.parquet")
        fields = [x.split() for x in TASK_TABLES[name].split(", ")]
        return read.select(*(F.col(n).cast(k).alias(n) if n in read.columns else F.lit(None).cast(k).alias(n) for n, k in fields))
    if f"{name}.jsonl" in there:
        return json_objects(spark, f"{folder}/{name}.jsonl", TASK_TABLES[name]).select("row.*")
    return None


def list_tasks(spark: SparkSession, root: str) -> list[dict[str, object]]:
    """{"name", "splits"} of every stored task, by name."""
    found = [{"name": t, "splits": [s for s in _children(spark, f"{root}/{t}") if split_table(spark, f"{root}/{t}/{s}", "corpus") is not None]} for t in _children(spark, root)]
    return [t for t in found if t["splits"]]


def inspect_task(spark: SparkSession, root: str, name: str) -> dict[str, dict[str, object]]:
    """By split and table the fields of a stored task, or null for a table that isn't there."""
    splits = next((t["splits"] for t in list_tasks(spark, root) if t["name"] == name), None)
    if splits is None:
        raise ValueError(f"{root} holds no task {name!r}")
    tables = {s: {t: split_table(spark, f"{root}/{name}/{s}", t) for t in TASK_TABLES} for s in splits}
    return {s: {t: None if df is None else dict(df.dtypes) for t, df in own.items()} for s, own in tables.items()}


def load_tasks(spark: SparkSession, root: str, names: Sequence[str] | None = None, *, split: str = "test", **options: Any) -> DataFrame:
    """Long samples of the named stored tasks, of all that have the split where none is named; ``options`` as for ``task_samples``."""
    stored = {t["name"]: t["splits"] for t in list_tasks(spark, root)}
    wanted = [n for n, s in stored.items() if split in s] if names is None else list(names)
    if not wanted:
        raise ValueError(f"{root} holds no task with a split {split!r}")
    out = None
    for name in wanted:
        if split not in stored.get(name, []):
            raise ValueError(f"{root} holds no task {name!r} with a split {split!r}")
        tables = {t: split_table(spark, f"{root}/{name}/{split}", t) for t in TASK_TABLES}
        if lacking := [t for t, df in tables.items() if df is None and t != "top_ranked"]:
            raise ValueError(f"{name}/{split} has no {', '.join(lacking)}")
        own = task_samples(tables["corpus"], tables["queries"], tables["relevant_docs"], tables["top_ranked"], task=name, split=split, **options)
        out = own if out is None else out.unionByName(own)
    return out
