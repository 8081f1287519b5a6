"""Hand-worked scores of the valence rules, and a plain second version on random texts."""

import math
import random

import pytest

from tidemark.operators import valence
from tidemark.operators.valence import compound

LEX = {"good": 2.0, "great": 3.0, "bad": -2.5, "fraud": -3.0, "profit": 1.5}


def bound(s):
    return s / math.sqrt(s * s + 15)


@pytest.mark.parametrize(("text", "sum_"), [
    ("good", 2.0), ("Good.", 2.0), ("plain words", 0.0), ("", 0.0), (None, 0.0), ("bad", -2.5), ("GOOD results", 2.733), ("GOOD RESULTS", 2.0), ("BAD results", -3.233),
    ("very good", 2.293), ("very bad", -2.793), ("slightly good", 1.707), ("slightly bad", -2.207), ("VERY good", 2 + 0.293 + 0.733), ("very truly good", 2 + 0.95 * 0.293), ("very a b good", 2 + 0.9 * 0.293), ("very a b c good", 2.0),
    ("not good", 2 * -0.74), ("isn't good", 2 * -0.74), ("not very good", (2 + 0.293) * -0.74), ("not a b good", 2 * -0.74), ("not a b c good", 2.0), ("never not good", 2 * 0.74**2), ("not bad", 2.5 * 0.74),
    ("good but bad", 0.5 * 2 - 1.5 * 2.5), ("good but nothing else", 1.0), ("bad but not good", -0.5 * 2.5 - 1.5 * 2 * 0.74), ("good profit", 3.5), ("very good bad", 2.293 - (2.5 + 0.95 * 0.293)),
    ("good!", 2.292), ("good!!!!!!", 2 + 4 * 0.292), ("bad!!", -2.5 - 2 * 0.292), ("good?", 2.0), ("good??", 2.36), ("good???", 2.54), ("bad?????", -3.46), ("least good", 2 * -0.74), ("at least good", 2.0), ("a least good", 2 * -0.74), ("no sign of fraud", 3 * 0.74),
])
def test_hand_cases(text, sum_):
    assert compound(text, LEX) == pytest.approx(bound(sum_), abs=1e-12)


def slow(text):
    words = [w.strip('!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~') if len(w.strip('!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~')) > 2 else w for w in text.split()]
    low, up = [w.lower() for w in words], [w.isupper() for w in words]
    mixed = 0 < sum(up) < len(up)
    boosts = {w: 0.293 for w in valence.MORE.split()} | {w: -0.293 for w in valence.LESS.split()}
    total = 0.0
    for i, w in enumerate(low):
        if w not in LEX:
            continue
        s = LEX[w] + (0.733 if LEX[w] > 0 else -0.733) * (up[i] and mixed)
        for k in (1, 2, 3):
            if i - k < 0 or low[i - k] in LEX:
                continue
            b = boosts.get(low[i - k], 0)
            if b:
                s += (1 if s > 0 else -1) * (b + 0.733 * (up[i - k] and mixed)) * (1, 0.95, 0.9)[k - 1]
            if low[i - k] in valence.NOT.split() or low[i - k].endswith("n't"):
                s *= -0.74
        if "but" in low:
            s *= 0.5 if i < low.index("but") else 1.5
        total += s
    n, q = min(4, text.count("!")), text.count("?")
    marks = 0.292 * n + (0 if q < 2 else 0.18 * q if q < 4 else 0.96)
    return bound(total + (0 if total == 0 else math.copysign(marks, total)))


def test_random_texts_equal_the_plain_version(spark):
    rnd = random.Random(1)
    some = ["good", "BAD", "great", "Fraud", "profit", "very", "VERY", "hardly", "not", "don't", "but", "a", "plain", "WORD", "!", "??", "so"]
    texts = [" ".join(rnd.choice(some) for _ in range(rnd.randint(0, 12))) + rnd.choice(["", "!", "?!", "???"]) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i long, t string")
    got = {r.i: r.s for r in df.select("i", valence.valence(df["t"], LEX).alias("s")).collect()}
    assert got == {i: pytest.approx(slow(t), abs=1e-12) for i, t in enumerate(texts)} | {400: 0.0, 401: 0.0}
