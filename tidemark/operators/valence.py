"""Sentiment of short texts by valence rules over their tokens, after the published rule set for social-media text (Hutto and Gilbert, 2014).

A fold over the tokens keeps the last three of them. A word's valence, from a lexicon, grows by CAPITALS where it is in capitals in a text that is not
all capitals; each of the three tokens before it that is no lexicon word boosts or dampens it (less with distance) and, if it negates, turns and
weakens it. What stands before a "but" counts half and what follows half as much again; "least" negates unless "at" or "very" stands before
it. Exclamation and question marks strengthen the sum, which is bounded to -1 .. 1 by s / sqrt(s^2 + 15).

The lexicon is a parameter: a word list of any size costs one lookup a token, since the fold runs in Arrow batches.
"""

from __future__ import annotations

import math
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a booster adds, what capitals add, what a negation multiplies by, the share of a booster two and three tokens away, what
#: exclamation and question marks add (4 and 3 of them at most counted one by one), and the bound's constant.
BOOST, CAPITALS, NEGATED = 0.293, 0.733, -0.74
FAR = (1.0, 0.95, 0.9)
EXCLAMATION, QUESTION, MANY_QUESTIONS, BOUND = 0.292, 0.18, 0.96, 15.0
#: Words that strengthen, that weaken and that negate what follows.
MORE = "absolutely amazingly completely considerably decidedly deeply enormously entirely especially exceptionally extremely fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very"
LESS = "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta"
NOT = "aint arent cannot cant couldnt despite didnt doesnt dont hadnt hasnt havent isnt neither never no nobody none nope nor not nothing nowhere rarely seldom shouldnt uhuh wasnt werent without wont wouldnt"
_BOOSTERS = dict.fromkeys(MORE.split(), BOOST) | dict.fromkeys(LESS.split(), -BOOST)
_NOT = frozenset(NOT.split())


def tokens(text: str) -> list[str]:
    """Words without the punctuation around them; what would keep two characters or fewer stays whole."""
    out = []
    for w in text.split():
        bare = w.strip(string.punctuation)
        out.append(bare if len(bare) > 2 else w)
    return out


def compound(text: str | None, lexicon: dict[str, float]) -> float:
    """The bounded score of one text; 0 for a missing text or one without lexicon words."""
    words = tokens(text) if text else []
    capitals = [w.isupper() for w in words]
    mixed = any(capitals) and not all(capitals)
    before = after = 0.0
    turned = False
    last: list[tuple[str, bool]] = []  # the tokens before, nearest first: lower case, in capitals
    for w, upper in zip(words, capitals, strict=True):
        low = w.lower()
        turned = turned or low == "but"
        s = 0.0 if low in _BOOSTERS else lexicon.get(low, 0.0)
        if s:
            s += math.copysign(CAPITALS, s) if upper and mixed else 0.0
            for (other, other_upper), share in zip(last, FAR, strict=False):
                if other in lexicon:
                    continue
                if boost := _BOOSTERS.get(other):
                    s += share * math.copysign(1, s) * (boost + (CAPITALS if other_upper and mixed else 0.0))
                if other in _NOT or other.endswith("n't"):
                    s *= NEGATED
            if last and last[0][0] == "least" and "least" not in lexicon and not (len(last) > 1 and last[1][0] in ("at", "very")):
                s *= NEGATED
            if turned:
                after += s
            else:
                before += s
        last = [(low, upper), *last[:2]]
    total = 0.5 * before + 1.5 * after if turned else before
    if not total:
        return 0.0
    asked = text.count("?")
    marks = EXCLAMATION * min(text.count("!"), 4) + (0.0 if asked < 2 else QUESTION * asked if asked <= 3 else MANY_QUESTIONS)
    total += math.copysign(marks, total)
    return total / math.sqrt(total * total + BOUND)


def valence(text: Column, lexicon: dict[str, float]) -> Column:
    """The column of compound scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        seen: dict[str | None, float] = {}  # of one batch
        return texts.map(lambda t: seen[t] if t in seen else seen.setdefault(t, compound(t, lexicon)), na_action=None)

    return score(text)
