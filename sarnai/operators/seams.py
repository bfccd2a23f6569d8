"""Joining words that a reader broke: a walk along each line over its gaps.

At a gap the end of what is on the left and the beginning of what is on the right are looked up, alone and joined. A join makes the
left side longer, so the gaps of a line depend on each other and are walked in order; lines are independent rows. The word list is a
model file of bounded size (checked: ``MOST_WORDS``) and travels with the plan. Null lines stay null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarnai.functions import text as T
from sarnai.operators.lexicon import ORDER, PEN_LIFT_GAIN, RARE
from sarnai.ship import ship

# The narrow blank, the long mark, letters, and the larger gain for gaps with an empty stripe.
NARROW, LONG, LETTERS = " ", "ᡃ", "ᠠ-ᢪ"
PEN_LIFT_GAIN_LOOSE = 14.0
MOST_WORDS = 200_000
_TAIL, _HEAD, _GAP = re.compile(f"[{LETTERS}]+$"), re.compile(f"[{LETTERS}]+"), re.compile(f"[ {NARROW}]+")


def transliterated(todo: str) -> str:
    """As ``text.todo_to_translit`` does a line, for one short stretch of letters."""
    c = re.sub("ᠴ(?=ᡅ)", "j", todo)
    for letter, front, back, other in T.ASCII_BY_NEXT:
        c = re.sub(f"{letter}(?=[{T.BACK_TODO}])", back, re.sub(f"{letter}(?=[{T.FRONT_TODO}])", front, c)).replace(letter, other)
    for a, b in T.ASCII_LONG:
        c = c.replace(a, b)
    c = c.translate(str.maketrans(T.ASCII_FROM, T.ASCII_TO))
    tells = re.search("[aāoōuūeēiīöȫüǖ]", c)
    for a, b in T.REVERSE_RULES:
        c = c.replace(a, b)
    return c.replace("h", "k" if tells and tells[0] in "eēiīöȫüǖ" else "x")


class Seams:
    """Decisions at gaps, from words and how often they occur."""

    def __init__(self, freq: dict[str, int]):
        self.freq = freq

    def n(self, word: str) -> int:
        return self.freq.get(word, 0)

    def joins(self, a: str, b: str, ab: str) -> bool:
        return 0 < self.n(ab) >= min(self.n(a), self.n(b))

    @cached_property
    def grams(self) -> tuple[Counter, Counter, Counter, float]:
        """Of the word types: symbols after contexts, contexts, kinds of symbols after contexts, and the base probability."""
        after = Counter()
        for word in self.freq:
            s = "^" * (ORDER - 1) + word + "$"
            for i in range(ORDER - 1, len(s)):
                after.update((s[i - k : i], s[i]) for k in range(ORDER))
        total, kinds = Counter(), Counter()
        for (context, _), n in after.items():
            total[context] += n
            kinds[context] += 1
        return after, total, kinds, 1 / (len({c for w in self.freq for c in w}) + 1)

    def logp(self, word: str) -> float:
        after, total, kinds, base = self.grams
        s, sum_ = "^" * (ORDER - 1) + word + "$", 0.0
        for i in range(ORDER - 1, len(s)):
            p = base
            for k in range(ORDER):
                context = s[i - k : i]
                if total[context]:
                    share = total[context] / (total[context] + kinds[context])
                    p = share * after[context, s[i]] / total[context] + (1 - share) * p
            sum_ += math.log(p)
        return sum_

    def lifted(self, a: str, b: str, least: float) -> bool:
        piece = self.n(b) < RARE or (not self.n(a) and len(a) <= 2)
        return piece and self.logp(a + b) - self.logp(a) - self.logp(b) > least

    def to_the_right(self, b: str, following: str, ab: str) -> bool:
        """Whether b, no word, rather begins the word after it."""
        head = _HEAD.match(following)
        if not head:
            return False
        c, bc = transliterated(head[0]), transliterated(b + head[0])
        return self.joins(transliterated(b), c, bc) and self.n(bc) > self.n(ab)

    def kept(self, line: str, tight: list[bool] | None = None) -> list[bool]:
        """Of each symbol of the line, whether it stays; tight: whether no stripe at it is empty (null: not known)."""
        keep, gaps = [True] * len(line), list(_GAP.finditer(line))
        words = [line[a:b] for a, b in zip([0, *(g.end() for g in gaps)], [*(g.start() for g in gaps), len(line)], strict=True)]
        left = words[0]
        for gap, word, following in zip(gaps, words[1:], [*words[2:], None][: len(gaps)], strict=True):
            if self._closed(left, word, following, gap[0], tight and tight[gap.start() : gap.end()]):
                keep[gap.start() : gap.end()] = [False] * len(gap[0])
                left += word
            else:
                left = word
        return keep

    def _closed(self, left: str, word: str, following: str | None, gap: str, tight: list[bool] | None) -> bool:
        tail, head = _TAIL.search(left), _HEAD.match(word)
        if not tail or not head:
            return False
        if head[0].startswith(LONG):  # no word begins with it
            return True
        a, b, ab = (transliterated(x) for x in (tail[0], head[0], tail[0] + head[0]))
        if not self.n(b) and following is not None and head[0] == word and self.to_the_right(head[0], following, ab):
            return False
        narrow = set(gap) == {NARROW} and tight is not None
        return self.joins(a, b, ab) or (narrow and self.lifted(a, b, PEN_LIFT_GAIN if all(tight) else PEN_LIFT_GAIN_LOOSE))

    def joined(self, line: str, tight: list[bool] | None = None) -> str:
        return "".join(c for c, k in zip(line, self.kept(line, tight), strict=True) if k)


def seams_of(freq: DataFrame) -> Seams:
    """From word and n."""
    rows = freq.select("word", "n").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} words")
    return Seams(dict(map(tuple, rows)))


def join_broken_words(lines: DataFrame, text: str, seams: Seams, out: str, tight: str | None = None) -> DataFrame:
    """lines with the column ``out``: the text without the gaps inside words. tight: a column of flags, one a symbol."""
    ship(lines.sparkSession)

    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else seams.joined(t))

    def flagged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, flags in batches:
            yield pd.Series([None if t is None else seams.joined(t, None if f is None else list(f)) for t, f in zip(texts, flags, strict=True)])

    plain.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    flagged.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    made = F.pandas_udf(plain, "string")(text) if tight is None else F.pandas_udf(flagged, "string")(text, tight)
    return lines.withColumn(out, made)
