from __future__ import annotations

import asyncio
import json
import time

import pytest

from windrose import Document, Listwise, Pairwise, Reranker, RerankInputError, RerankParseError, RerankProviderError, Usage
from windrose.functions.parsing import classify_ranking, parse_ranking, parse_winner
from windrose.operators.providers import AsyncChatProvider, ChatProvider, FunctionProvider, JudgedProvider, KeywordProvider, ScriptedProvider, answer, answer_all

NO_LIMIT = 4000


def ranking(*r: int) -> str:
    return json.dumps({"ranking": list(r)})


def winner(w: str) -> str:
    return json.dumps({"winner": w})


def run(provider, texts, strategy):
    return asyncio.run(answer(provider, "q", list(texts), strategy))


def test_listwise_windows():
    p = ScriptedProvider([ranking(3, 1, 2)])
    assert run(p, ["alpha", "beta", "gamma"], Listwise()).order == [2, 0, 1]
    p = ScriptedProvider([ranking(3, 1, 2), ranking(3, 1, 2)])
    assert [("abcde")[i] for i in run(p, "abcde", Listwise(3, 2)).order] == ["e", "a", "b", "c", "d"]
    assert [a[1] for a in p.asked] == [("c", "d", "e"), ("a", "b", "e")]
    p = ScriptedProvider([ranking(1)])
    assert run(p, ["one"], Listwise()).llm_calls == 1
    assert run(ScriptedProvider([]), [], Listwise()).order == []


@pytest.mark.parametrize("together", [1, 2])
def test_pairwise_passes(together):
    p = ScriptedProvider([winner(x) for x in "BABA"])
    out = run(p, "abc", Pairwise(1, pair_order_parallelism=together))
    assert [("abc")[i] for i in out.order] == ["c", "a", "b"]
    assert [a[1:] for a in p.asked] == [("b", "c"), ("c", "b"), ("a", "c"), ("c", "a")]
    assert run(ScriptedProvider([winner("A"), winner("A")]), "ab", Pairwise(1)).order == [0, 1]
    assert run(ScriptedProvider([winner("B"), winner("B")]), "ab", Pairwise(1)).order == [0, 1]
    assert run(ScriptedProvider([]), "a", Pairwise()).llm_calls == 0


@pytest.mark.parametrize(
    ("raw", "why"),
    [("not json", "json_parse_failure"), ('{"ranking":[1,2]} x', "json_parse_failure"), ("{'ranking':[1]}", "json_parse_failure"), ("[1,2]", "missing_ranking"), ("{}", "missing_ranking"),
     ('{"ranking":["1","2"]}', "non_integer_rank"), ('{"ranking":[1,2.0]}', "non_integer_rank"), ('{"ranking":[true,2]}', "non_integer_rank"), ('{"ranking":[1]}', "length_mismatch"),
     ('{"ranking":[1,3]}', "out_of_range_rank"), ('{"ranking":[1,1]}', "duplicate_rank")],
)
def test_bad_rankings(raw, why):
    assert classify_ranking(raw, 2).failure_type == why
    with pytest.raises(RerankParseError) as e:
        parse_ranking(raw, 2)
    assert e.value.raw_response == raw
    out = run(ScriptedProvider([raw]), "ab", Listwise())
    assert (out.order, out.valid, out.failure_type) == (None, False, "llm_output_invalid")


@pytest.mark.parametrize("raw", ["not json", "{}", '{"winner":"C"}', '{"winner":"a"}', '{"winner":1}', '{"winner":["A"]}'])
def test_bad_winners(raw):
    with pytest.raises(RerankParseError):
        parse_winner(raw)


def test_too_long_makes_no_call():
    p = ScriptedProvider([])
    out = run(p, ["abc", "abcd"], Listwise(max_document_chars=3))
    assert (out.failure_type, out.llm_calls, p.asked) == ("document_too_long", 0, [])
    assert "document 1" in out.error and "3" in out.error


class Async:
    def __init__(self):
        self.now = self.most = 0

    async def compare(self, query, a, b):
        self.now += 1
        self.most = max(self.most, self.now)
        await asyncio.sleep(0.001)
        self.now -= 1
        return winner("A"), (10, 1)


def test_async_usage_and_concurrency():
    for together in (1, 2):
        p = Async()
        out = run(p, "abc", Pairwise(2, pair_order_parallelism=together))
        assert p.most == together and (out.llm_calls, out.usage_reports, out.prompt_tokens, out.completion_tokens) == (8, 8, 80, 8)
    p = Async()
    asyncio.run(answer_all(lambda: p, [("q", ["a", "b"])] * 6, Pairwise(1, pair_order_parallelism=1), 3))
    assert p.most == 3


def test_provider_failures():
    class Broken:
        def rank(self, query, documents):
            raise OSError("down")

    class Silent:
        def rank(self, query, documents):
            return ""

    for p in (Broken(), Silent()):
        out = run(p, "ab", Listwise())
        assert out.failure_type == "provider_error" and out.llm_calls == 1


def test_chat_provider_request():
    seen = {}

    class Reply:
        class usage:
            prompt_tokens, completion_tokens = 7, 3

        choices = [type("C", (), {"message": type("M", (), {"content": ranking(2, 1)})})]

    class Client:
        class chat:
            class completions:
                @staticmethod
                def create(**request):
                    seen.update(request)
                    return Reply

    out = run(ChatProvider(Client, "m"), ["x", "y"], Listwise())
    assert out.order == [1, 0] and out.prompt_tokens == 7
    assert seen["temperature"] == 0 and seen["response_format"] == {"type": "json_object"} and "[2]\ny" in seen["messages"][1]["content"]


def test_async_chat_provider_and_usage():
    now = most = 0

    class Completions:
        @staticmethod
        async def create(**request):
            nonlocal now, most
            now, most = now + 1, max(most, now + 1)
            await asyncio.sleep(0.001)
            now -= 1
            text = winner("B") if "Passage A:\nx" in request["messages"][1]["content"] else winner("A")
            message = type("M", (), {"content": text})
            return type("R", (), {"usage": type("U", (), {"prompt_tokens": 5, "completion_tokens": 2}), "choices": [type("C", (), {"message": message})]})

    client = type("Client", (), {"chat": type("Chat", (), {"completions": Completions})})
    told = []

    async def on_usage(usage):
        told.append(usage)

    out = asyncio.run(answer(AsyncChatProvider(client, "m"), "q", ["x", "y"], Pairwise(1), on_usage))
    assert (out.order, most, out.prompt_tokens) == ([1, 0], 2, 10) and told == [Usage(5, 2, 7)] * 2


def test_a_plain_provider_is_never_in_two_threads():
    busy, clashes, built = {}, [], []

    def factory():
        class Plain:
            def rank(self, query, documents):
                if busy.get(id(self)):
                    clashes.append(1)
                busy[id(self)] = True
                time.sleep(0.002)
                busy[id(self)] = False
                return ranking(*range(1, len(documents) + 1))

        built.append(Plain())
        return built[-1]

    out = asyncio.run(answer_all(factory, [("q", ["a", "b"])] * 30, Listwise(), 4))
    assert len(out) == 30 and not clashes and 1 < len(built) <= 4


class Backwards:
    """A strategy of one's own: asks for each text alone and turns the list round."""

    algorithm, max_document_chars, needs = "backwards", 100, ("rank",)

    async def walk(self, ask, query, texts):
        for t in texts:
            await ask("rank", query, [t])
        return list(range(len(texts)))[::-1]


class Nonsense(Backwards):
    async def walk(self, ask, query, texts):
        return [0] * len(texts)


def test_custom_strategy(spark):
    out = Reranker(Backwards(), provider=by_length).rerank(spark, "q", ["a", Document("b", "id", {"k": 1}), "c"])
    assert [(r.document.text, r.rank, r.original_index, r.metadata["strategy"]) for r in out] == [("c", 1, 2, "custom"), ("b", 2, 1, "custom"), ("a", 3, 0, "custom")]
    assert out[1].document == Document("b", "id", {"k": 1}) and Reranker(Listwise(), provider=by_length).rerank(spark, "q", []) == []
    with pytest.raises(TypeError):
        Reranker(Listwise(), provider=by_length).rerank(spark, "q", [1])
    with pytest.raises(RerankParseError):
        Reranker(Nonsense(), provider=by_length).rerank(spark, "q", ["a", "b"])
    with pytest.raises(RerankInputError):
        Reranker(Backwards(), provider=lambda: object())
    with pytest.raises(RerankInputError):
        Reranker(Backwards(), score="s")


def test_offline_providers():
    judged = JudgedProvider({"q": {"b": 2, "c": 1}})
    assert run(judged, "abc", Listwise()).order == run(judged, "abc", Pairwise(2)).order == [1, 2, 0]
    words = KeywordProvider(["Fever", "rash"], {"not": -4})
    assert run(words, ["a rash, not fever, no", "FEVER and a rash", "fever", "a fever"], Listwise(max_document_chars=99)).order == [1, 2, 3, 0]


def counted(log):
    def factory():
        class P(FunctionProvider):
            def rank(self, query, documents):
                with open(log, "a") as f:
                    f.write(query + "\n")
                return "no" if query == "0" else super().rank(query, documents)

        return P(length)

    return factory


def test_fail_fast_begins_no_other_query(spark, tmp_path):
    df = spark.createDataFrame([(str(i), str(i), j, "d", "x" * j) for i in range(200) for j in range(2)], CANDIDATES).coalesce(1)
    for mode, least in (("fail_fast", 1), ("record", 200)):
        log = tmp_path / mode
        reranker = Reranker(Listwise(), provider=counted(str(log)), mode=mode, partitions=1)
        if mode == "record":
            assert reranker.transform(df).count() == 398
        else:
            with pytest.raises(RerankParseError):
                reranker.transform(df)
            asked = {*log.read_text().split()}
            assert reranker.outcomes.where("failure_type = 'not_asked'").count() == 200 - len(asked)
        calls = len(log.read_text().split())
        assert least <= calls <= 200


def length(query: str, text: str) -> int:
    return len(text)


def by_length():
    return FunctionProvider(length)


def broken_for_q2():
    class P(FunctionProvider):
        def rank(self, query, documents):
            return "no" if query == "two" else super().rank(query, documents)

    return P(length)


def raising():
    class P:
        def rank(self, query, documents):
            raise OSError("down")

    return P()


CANDIDATES = "query_id string, query string, original_index int, doc_id string, text string"


def test_in_spark(spark):
    rows = [("1", "one", 0, "a", "x"), ("1", "one", 1, None, "xxx"), ("1", "one", 2, "c", "xx"), ("2", "two", 0, "d", None), ("2", "two", 1, "e", "y")]
    df = spark.createDataFrame(rows, CANDIDATES)
    for strategy in (Listwise(3, 2), Pairwise(3)):
        out = Reranker(strategy, provider=by_length, max_concurrency=2, partitions=2).transform(df)
        assert [(r["query_id"], r["original_index"]) for r in out.orderBy("query_id", "rank").collect()] == [("1", 1), ("1", 2), ("1", 0), ("2", 1), ("2", 0)]
    assert Reranker(Listwise(), provider=by_length).transform(df, top_k=1).count() == 2
    with pytest.raises(RerankParseError):
        Reranker(Listwise(), provider=broken_for_q2).transform(df)
    recorded = Reranker(Listwise(), provider=broken_for_q2, mode="record")
    assert {r["query_id"] for r in recorded.transform(df).collect()} == {"1"}
    assert recorded.outcomes.where("not valid").first()["failure_type"] == "llm_output_invalid"
    with pytest.raises(RerankProviderError):
        Reranker(Listwise(), provider=raising).transform(df)
    with pytest.raises(RerankInputError):
        Reranker(Pairwise(), provider=raising)
    assert Reranker(Listwise(), provider=by_length).transform(spark.createDataFrame([], CANDIDATES)).count() == 0


def test_registered_queries_take_texts_of_any_length(spark, tmp_path):
    from windrose.plans import queries

    docs = [(i, "alpha beta " + "x" * i) for i in range(3)] + [(9, "alpha beta gamma " + "y" * 1_000_001)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for query in (queries.provider_listwise, queries.provider_pairwise):
        assert {r["doc_id"] for r in query(spark, str(tmp_path)).collect()} == {0, 1, 2, 9}
