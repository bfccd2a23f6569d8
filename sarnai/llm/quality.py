"""Quality rules by tokeniser fertility.

Public vocabularies measure a text: characters per token, token entropy (bits, of the ids' own distribution) and the share of
symbol tokens under the byte-level vocabulary, and the share of the words' bytes that the piece vocabulary spells by byte fallback. A symbol
token has neither letter nor digit but a character of Unicode category S or of the symbols counted below. A text is rejected when a measure leaves the band of its script, which is that of
most of its letters. In Latin script the lower bounds fall with the share of letters and marks outside ASCII,
as the vocabularies spell those of most languages byte by byte. Entropy grows more slowly than the most it could be, log2(number of tokens), so the
band for their quotient falls with that logarithm beyond 2 ** 8 tokens and is level before, down to a single token, whose quotient is 1.

Base counts (contract): a word is a run of other than U+0020, U+0009..U+000D. Null is an empty text; it has
no word and so fails the base rules. Repeated rows get the same verdict each; rows without an id are rows like others; an empty table gives
an empty one; of other columns only their passing through matters.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from sarnai.llm.common import keep_rows, map_columns
from sarnai.llm.tokens import ByteLevel, Pieces

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # base rules: words; per cent of words in repeated windows


@dataclass(frozen=True)
class Band:
    """Rejection bands: characters per token; entropy over log2(tokens), at 2**8 tokens and its fall per
    doubling; most byte fallback; most symbol tokens."""

    chars_low: float
    chars_high: float
    entropy_low: float
    entropy_fall: float
    fallback_high: float
    symbols_high: float = 0.12

    def lowered(self, accented: float) -> Band:
        """The band of a text with this share of letters and marks outside ASCII."""
        return replace(
            self,
            chars_low=max(ACCENTED_LEAST, self.chars_low - ACCENTED_CHARS * accented),
            entropy_low=self.entropy_low - ACCENTED_ENTROPY * max(0.0, accented - ACCENTED_FREE),
        )


# Parameters. Byte-level pieces of running prose hold about 2.2 to 5 characters in Latin script; capitals,
# symbol strings and random characters stay below, long runs of one character above. In languages with many
# accented letters they hold fewer: Czech 1.84 at a share of 0.12, Azerbaijani 1.59 at 0.20, Vietnamese 1.02 at
# 0.33, Yoruba 0.97 at 0.44; in Mongolian 0.77. Prose has below 0.03 of symbol tokens, text with symbols attached to words or between them above 0.15. Entropy shares go down to 0.55 (decomposed Yoruba), 0.36 (Georgian).
BANDS = {
    "LATIN": Band(1.85, 6.5, 0.685, 0.042, 0.2),
    "CYRILLIC": Band(0.6, 5.0, 0.5, 0.05, 0.2),
    "GREEK": Band(0.55, 5.0, 0.5, 0.05, 0.3),
}
OTHER = Band(0.25, 6.5, 0.3, 0.05, 1.0)
ACCENTED_CHARS, ACCENTED_LEAST = 3.0, 0.7  # fall of chars_low per share, and its floor
ACCENTED_ENTROPY, ACCENTED_FREE = 1.0, 0.15  # fall of entropy_low per share beyond this one
COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, chars_per_token double, fallback_share double, entropy_share double, symbol_share double"
)


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows found twice or more. Exact: ranks of 1, 2, 4, then 8 words by doubling."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    for step in (1, 2, 4):
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        values, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
    again = np.flatnonzero(counts[rank] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen: set = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def script_of(text: str) -> str:
    """Script of most letters, by the first word of their Unicode names; NONE without a letter."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else "NONE"
    count: dict = {}
    for c in set(text):
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").split(" ")[0]
            count[name] = count.get(name, 0) + text.count(c)
    return max(sorted(count), key=count.get) if count else "NONE"


def accented_share(text: str) -> float:
    """Share of letters and combining marks outside ASCII among all."""
    if text.isascii():
        return 0.0
    count = {c: text.count(c) for c in set(text) if c.isalpha() or unicodedata.combining(c)}
    return sum(n for c, n in count.items() if not c.isascii()) / max(1, sum(count.values()))


def symbol_tokens(vocabulary: ByteLevel) -> np.ndarray:
    """Of each id, whether its token is one of symbols."""
    out = np.zeros(vocabulary.size, bool)
    for i, piece in vocabulary.pieces():
        text = piece.decode("utf-8", "replace")
        symbol = any(unicodedata.category(c)[0] == "S" or ord(c) < 128 and ord(c) in SYMBOLS for c in text)
        out[i] = symbol and "\ufffd" not in text and not any(map(str.isalnum, text))
    return out


class Rules:
    def __init__(self, bands: dict[str, Band] | None = None):
        self.bands = bands or BANDS
        self.bytes, self.pieces = ByteLevel(), Pieces()
        self.symbol = symbol_tokens(self.bytes)

    def base(self, raw: bytes, text: str) -> tuple[int, int, int, int, int, bool]:
        words = raw.split()
        n = len(words)
        chars = len(text) - sum(raw.count(c) for c in SPACES)
        symbols = sum(raw.count(c) for c in SYMBOLS)
        repeats = repeated_words(words)
        return n, chars, symbols, duplicate_lines(raw), repeats, n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n

    def measures(self, text: str) -> tuple[str, float, float, float, float, int]:
        """Script, characters per token, fallback share, entropy share, symbol share, tokens."""
        ids = self.bytes.ordinary_ids(text)
        n = len(ids)
        if not n:
            return "NONE", 0.0, 0.0, 0.0, 0.0, 0
        counts = np.bincount(ids)
        counts = counts[counts > 0] / n
        entropy = float(-(counts * np.log2(counts)).sum()) / math.log2(n) if n > 1 else 1.0
        size = max(1, len(text.encode()))
        fallback = self.pieces.fallback_bytes(text, "\t\n\r\x0b\x0c") / size
        return script_of(text), len(text) / n, fallback, entropy, float(self.symbol[ids].mean()), n

    def verdict(self, text: str, script: str, per_token: float, fallback: float, entropy: float, symbols: float, n: int) -> bool:
        band = self.bands.get(script, OTHER)
        if script == "LATIN":
            band = band.lowered(accented_share(text))
        if not band.chars_low <= per_token <= band.chars_high or fallback > band.fallback_high or symbols > band.symbols_high:
            return False
        return entropy >= band.entropy_low - band.entropy_fall * max(0.0, math.log2(max(1, n)) - 8)

    def row(self, raw: bytes) -> tuple:
        text = raw.decode("utf-8", "replace")
        base, measures = self.base(raw, text), self.measures(text)
        return *base, not base[-1] and self.verdict(text, *measures), *measures[:-1]

    def kept(self, raw: bytes) -> bool:
        text = raw.decode("utf-8", "replace")
        return not self.base(raw, text)[-1] and self.verdict(text, *self.measures(text))


def _raw(texts) -> list[bytes]:
    from sarnai.llm.common import as_bytes

    return as_bytes(texts)


def measure_quality(documents: DataFrame, bands: dict[str, Band] | None = None) -> DataFrame:
    """The base counts, the measures and the verdict of every row."""
    names = [c.split()[0] for c in COLUMNS.split(", ")][1:]

    def make():
        rules = Rules(bands)

        def step(ids, texts):
            rows = [rules.row(t) for t in _raw(texts)]
            return {"doc_id": ids} | dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[] for _ in names], strict=True))

        return step

    return map_columns(documents, ["doc_id", "text"], make, COLUMNS)


def keep_good(documents: DataFrame, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of documents that pass both the base rules and the bands."""

    def make():
        rules = Rules(bands)
        return lambda texts: [rules.kept(t) for t in _raw(texts)]

    return keep_rows(documents, "text", make)
