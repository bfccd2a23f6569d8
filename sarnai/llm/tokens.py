"""Token ids and coverage of public vocabularies. Encoding works on whole texts, without a memo of words:
measured on long-tailed text, looking words up costs more than encoding them again."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken

BYTE_BPE, BYTE_BPE_JSON, PIECE_BPE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


# White space as the vocabulary's pattern has it. Its rule for white space looks ahead, so its regular expression steps back
# through a run blank by blank and gives up on very long ones; runs of LONG_RUN or more are therefore cut out before it.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 4096
_LONG = re.compile(f"{BLANK}{{{LONG_RUN},}}")


class ByteLevel:
    """ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them for byte_bpe_50k.json.

    The same vocabulary is read as ranks, whose encoder is several times faster; a test holds one against
    the other. Its control strings in a text are one id each, as there; ``ordinary_ids`` takes them as plain text.
    """

    def __init__(self, path: str | None = None, description: str | None = None):
        with open(path or public_tokenizers.path(BYTE_BPE), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(description or public_tokenizers.path(BYTE_BPE_JSON), encoding="utf-8") as f:
            control = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        ranks = {piece: rank for piece, rank in ranks.items() if rank not in control.values()}
        self.ranks, self.size = ranks, len(ranks) + len(control)
        self.encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=control
        )

        self.control = re.compile("|".join(f"({re.escape(c)})" for c in control)) if control else None

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """(id, bytes) of the vocabulary but for its control strings."""
        return ((rank, piece) for piece, rank in self.ranks.items())

    def ids(self, text: str) -> np.ndarray:
        if not _LONG.search(text):
            return np.array(self.encoding.encode(text, allowed_special="all"), dtype=np.uint32)
        out, at = [], 0
        for m in self.control.finditer(text) if self.control else ():  # a control string ends the text before it
            out += [self.ordinary_ids(text[at : m.start()]), np.array([self.encoding.encode_single_token(m[0])], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self.ordinary_ids(text[at:])])

    def ordinary_ids(self, text: str) -> np.ndarray:
        parts = [self.encoding._core_bpe.encode_single_piece(p.encode()) if whole else self.encoding.encode_ordinary(p) for p, whole in _cut(text)]
        return np.array(parts[0], np.uint32) if len(parts) == 1 else np.concatenate([np.array(p, np.uint32) for p in parts])


def _cut(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order, long runs of white space apart (true: one piece of the vocabulary's pattern). The last
    blank of a run goes with the text after it, if there is any, as the pattern has it."""
    at = 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if at < m.start():
            yield text[at : m.start()], False  # ends with other than white space
        yield text[m.start() : end], True
        at = end
    if at < len(text) or not text:
        yield text[at:], False


class Pieces:
    """Which characters the sentence-piece vocabulary can only spell byte by byte: those without a piece."""

    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECE_BPE))
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
        self.known = {p for p in pieces if len(p) == 1} | {" "}

    def fallback_bytes(self, text: str, skip: str = "") -> int:
        """Bytes of the text in byte fallback, but for characters in ``skip``."""
        odd = set(text) - self.known - set(skip)
        return sum(text.count(c) * len(c.encode()) for c in odd) if len(odd) < 50 else sum(len(c.encode()) for c in text if c in odd)
