from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm._data import awkward, frame, row, sentence, text
from windrose.llm import _text, line_dedup
from windrose.llm.line_dedup import remove_repeats

LEAST, WIDE = 24, 13


def parts_of(t: str, line: list) -> list[list]:
    """A line, cut before the last word of the smallest hash of every 13 words in a row that follow its first."""
    hashes = [word_hash(t[a:b]) for a, b in line]
    cuts = {min(range(i, i + WIDE), key=lambda j: (hashes[j], -j)) for i in range(1, len(line) - WIDE + 1)}
    edges = [0, *sorted(cuts), len(line)]
    return [line[a:b] for a, b in zip(edges[:-1], edges[1:])]


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_text.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def brute(rows: list[tuple]) -> dict[tuple, str | None]:
    """(doc_id, text) -> what stays, from the definition: whole lines, long ones cut, shortest windows, earliest place wins."""
    docs = sorted({(d, t) for d, t, *_ in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    found: dict[tuple, list] = {}
    for at, (_, t) in enumerate(docs):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\s.!?]+", t)]
        lines: list[list] = []
        for j, w in enumerate(words):
            if j and not re.search(r"[.!?\n]", t[words[j - 1][1] : w[0]]):
                lines[-1].append(w)
            else:
                lines.append([w])
        lines = [part for line in lines for part in parts_of(t, line)]
        starts = [line[0][0] for line in lines] + [len(t)]
        windows = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(map(len, lines[i : j + 1])) >= LEAST:
                    windows.add((i, j))
                    break
            for j in range(i, -1, -1):
                if sum(map(len, lines[j : i + 1])) >= LEAST:
                    windows.add((j, i))
                    break
        for i, j in windows:
            key = tuple(t[line[0][0] : line[-1][1]] for line in lines[i : j + 1])
            found.setdefault(key, []).append((at, starts[i], starts[j + 1]))
    gone: dict[int, set[int]] = {}
    for places in found.values():
        for at, a, b in sorted(places)[1:]:
            gone.setdefault(at, set()).update(range(a, b))
    return {d: "".join(c for i, c in enumerate(d[1]) if i not in gone.get(at, ())) for at, d in enumerate(docs)}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    passages = [" ".join(sentence(rng) for _ in range(7)) for _ in range(4)]
    rows = [row(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else sentence(rng) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    rows += [row(100, rows[5][1]), row(101, rows[5][1] + "\n" + sentence(rng)), row(102, " ".join([sentence(rng, 26)] * 3))]
    want = brute(rows)
    got = {(r["doc_id"], r["text"]) for r in remove_repeats(frame(spark, rows)).collect()}
    assert got == {(d, t) for (d, _), t in want.items()}
    assert any(len(t) < len(o) for (_, o), t in want.items())


def test_passages_inside_paragraphs_go_and_clean_texts_stay(spark):
    rng = random.Random(2)
    shared = " ".join(sentence(rng, 10) for _ in range(6))
    rows = [row(i, text(rng, 4) + " " + shared + " " + text(rng, 4)) for i in range(5)] + [row(50 + i, text(rng, 20)) for i in range(5)]
    got = {r["doc_id"]: r for r in remove_repeats(frame(spark, rows)).collect()}
    assert shared in got[0]["text"] and not any(shared in got[i]["text"] for i in range(1, 5))
    assert all(got[i]["chars_removed"] >= len(shared) and got[i]["stretches_removed"] == 1 for i in range(1, 5))
    assert all(got[50 + i]["text"] == rows[5 + i][1] and got[50 + i]["chars_removed"] == 0 for i in range(5))


def test_passages_inside_sentences_go(spark):
    rng = random.Random(4)
    passages = [sentence(rng, n)[:-1].lower().split() for n in (50, 50, 55, 60, 70, 80, 90)]
    for p in passages[1:]:  # whole lines of fewer than 24 words between the first and the last
        p[14] += "."
        p[-14] += "."
    rows = [row(10 * i + j, text(rng, 3) + " " + sentence(rng, 7)[:-1] + " " + " ".join(p) + " " + sentence(rng, 7).lower() + " " + text(rng, 3)) for i, p in enumerate(passages) for j in range(3)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(frame(spark, rows)).collect()}
    for i, p in enumerate(passages):
        assert got[10 * i] == rows[3 * i][1]
        for j in (1, 2):
            assert not any(" ".join(p[k : k + 14]) in got[10 * i + j] for k in range(len(p) - 13))
            assert all(w in got[10 * i + j] for w in (rows[3 * i + j][1][:20], rows[3 * i + j][1][-20:]))


def test_awkward_rows(spark):
    rows = awkward(random.Random(3))
    got = remove_repeats(frame(spark, rows, extra=True))
    assert sorted(got.columns) == sorted(frame(spark, rows, extra=True).columns)
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == sorted(repr(r[:2]) for r in rows)
    assert remove_repeats(frame(spark, [])).count() == 0


def test_repeats_across_tasks_and_flushes(spark):
    """Many small tasks, and a task that sends its windows on in many pieces, give the same as the definition."""
    rng = random.Random(5)
    passages = [" ".join(sentence(rng) for _ in range(5)) for _ in range(6)]
    rows = [row(None if i == 13 else i, " ".join(rng.choice(passages) if rng.random() < 0.6 else sentence(rng) for _ in range(rng.randrange(0, 9)))) for i in range(80)]
    rows += rows[:20] + [row(7, rows[3][1]), row(-(1 << 63), rows[4][1])]
    want = {(d, t) for (d, _), t in brute(rows).items()}
    docs = frame(spark, rows)
    for n in (1, 17):
        assert {(r["doc_id"], r["text"]) for r in remove_repeats(docs.repartition(n)).collect()} == want
    texts = [r[1].encode() for r in rows]
    of = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    keys = np.array([hash(r[:2]) for r in rows])
    ids = np.array([line_dedup._NO_ID if r[0] is None else r[0] for r in rows])

    def spans(pieces):
        marks = []
        for a, b in pieces:
            part = line_dedup._windows_of(np.frombuffer(b"".join(texts[a:b]), np.uint8), of[a : b + 1] - of[a], ids[a:b], keys[a:b], LEAST)
            if len(part.fp):
                marks += line_dedup._sent(part, 1)
        return [b.to_pydict() for b in line_dedup._united(line_dedup._joined(1)(iter(marks)))]

    whole = spans([(0, len(rows))])
    assert whole and whole == spans([(i, i + 1) for i in range(len(rows))]) == spans([(0, 50), (50, len(rows))])


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
