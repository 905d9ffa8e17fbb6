"""The block screen and its ratios against brute force."""

import random
from difflib import SequenceMatcher

from tallyloom.operators import screen, similarity


def test_ratios():
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abc不🙂") for _ in range(n))
    pairs = [(word(draw.randrange(30)), word(draw.randrange(30))) for _ in range(300)] + [("", ""), ("a", ""), (word(300), word(290)), ("ab" * 200, "ba" * 190)]
    pairs += [(w, w[:9] + "x" + w[10:]) for w in (word(40) for _ in range(50))]
    got = screen.ratios(*map(list, zip(*pairs)))
    assert list(got) == [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]


def test_common_openings_are_met_once(spark, monkeypatch):
    """Texts with a hot segment, short texts, rare ones and copies: no pair is lost, and the two ways share none."""
    monkeypatch.setattr(similarity, "_FEW", 0)
    monkeypatch.setattr(similarity, "_HOT", 5)
    draw = random.Random(4)
    texts = [f"http://m.{draw.choice(['than', 'thst', 'tion'])}.example.org/en/{draw.randrange(300)}" for _ in range(80)]
    texts += ["".join(draw.choice("ab不") for _ in range(draw.randrange(12))) for _ in range(40)] + ["x" * 70, "x" * 71, "y" + "x" * 69]
    rare = ["".join(draw.choice("abcdefghijklmnopqrstuvw") for _ in range(40)) for _ in range(20)]
    texts += rare + [t[:20] + "#" + t[21:] for t in rare] + texts[:5]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, "p", t) for i, t in rows], "id long, platform string, text string")
    got = [(r.a, r.b) for r in similarity.near_pairs(df).collect()]
    want = {(i, j) for i, t in rows for j, u in rows if i < j and SequenceMatcher(None, u, t, autojunk=False).ratio() >= 0.9}
    assert len(got) == len(set(got)) and set(got) == want
