from __future__ import annotations

import random
from collections import Counter

from tests.llm._data import awkward, frame, row
from windrose.llm.language_id import gram_text, identify, profiles

STEMS = {"en": "the of and ing tion water house", "de": "der die und ung schaft wasser größe", "fr": "les des et ment eau maison été", "ru": "это как вода дом ение"}


def sample(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang].split()) + rng.choice(["", "s", "e"]) for _ in range(n))


def grams(text: str) -> Counter:
    folded = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    folded = " " + " ".join(folded.split()) + " "
    out: Counter = Counter()
    for i in range(len(folded)):
        for n in (1, 2, 3):
            g = folded[i : i + n]
            if len(g) == n and g.strip() and " " not in g[1:-1]:
                out[g] += 1
    return out


def ranked(c: Counter) -> list[str]:
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], [ord(y) for y in x[0]] + [0] * (3 - len(x[0]))))][:300]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [row(i, sample(rng, lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(list(STEMS) * 15)]
    own = {lang: ranked(sum((grams(r[1]) for r in rows if r[2] == lang), Counter())) for lang in STEMS}
    trained = profiles(frame(spark, rows))
    for lang in STEMS:
        assert [gram_text(r["gram"]) for r in trained.where(f"lang = '{lang}'").orderBy("rank").collect()] == own[lang]
    tests = rows + [row(1000 + i, sample(rng, lang, 4)) for i, lang in enumerate(list(STEMS) * 5)]
    for r in identify(frame(spark, tests), trained).collect():
        mine = ranked(grams(tests[r["doc_id"]][1] if r["doc_id"] < 1000 else next(t[1] for t in tests if t[0] == r["doc_id"])))
        far = {lang: sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(mine)) for lang, p in own.items()}
        assert (r["distance"], r["language"]) == min((d, lang) for lang, d in far.items())


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    train = [row(i, sample(rng, lang, 80), lang) for i, lang in enumerate(list(STEMS) * 10)]
    held = [row(i, sample(rng, lang, 25), lang) for i, lang in enumerate(list(STEMS) * 25)]
    got = identify(frame(spark, held), profiles(frame(spark, train))).collect()
    assert sum(r["language"] == held[r["doc_id"]][2] for r in got) >= 0.95 * len(held)


def test_awkward_rows(spark):
    rows = awkward(random.Random(3))
    df = frame(spark, rows, extra=True)
    got = identify(df, profiles(df)).collect()
    assert len(got) == len(rows)
    assert all((r["language"], r["distance"]) == (None, 0) for r in got if r["doc_id"] in (901, 902, 903, 907))
    assert all(r["language"] == "en" for r in got if r["doc_id"] in (900, 904))
    nothing = identify(df, profiles(frame(spark, [])))
    assert nothing.where("language is not null").count() == 0 and identify(frame(spark, []), profiles(df)).count() == 0
