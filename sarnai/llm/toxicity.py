"""Toxicity by compression distance.

Two dictionaries are trained by zstandard (COVER) from labelled rows: the ordinary one on windows of ordinary rows, the toxic one
on stretches of toxic rows. A window is ``WINDOW`` neighbouring words, one every ``STEP`` words, so every word of every text is in one. Its
margin is its compressed length under the ordinary dictionary less that under the ordinary dictionary followed by the toxic one; a filler keeps all
distances equal, so a window that the toxic dictionary does not help costs the same under both. The shares and numbers of windows whose margin reaches each
of the ``THRESHOLDS`` are weighed by a logistic function fitted to the training rows: its value is the score.

Toxic rows are ordinary but for a few words. The stretches the toxic dictionary learns from are therefore those words, cut to the
beginnings, and those pairs of words, that toxic rows use far more often than ordinary rows do (a Poisson z of ``LEAST_Z`` and a ratio of ``LIFT``);
passages met before, as in copies, do not count. The ordinary dictionary learns from ordinary windows without such words, and then, ``ROUNDS`` times,
from those that the toxic one still helps. Text is lower-cased and the first ``START`` letters of a word are written in capitals, so that the beginning of a word
never matches the inside of one; a word longer than ``PIECE`` characters is read as several.

Null and empty texts have no window: score of no hits. With no toxic or no ordinary row to learn from nothing is a hit. Repeated rows score alike;
a repeated id is learnt from by its least text. Only a bounded sample (``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled rows, lowest hash first, ``MOST_BYTES``
in all) is brought to the driver; a row that no longer fits is passed over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarnai.llm.common import as_bytes, blocks, held_out, keep_rows, map_columns

MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 600, 2000, 16_000_000  # labelled rows to learn from, at most, and their bytes
WINDOW, STEP = 8, 7  # words; neighbours share one, so every pair of words is in a window
START, PIECE = 8, 64
ORDINARY_BYTES, TOXIC_BYTES, NEGATIVE_BYTES, ROUNDS = 32_768, 2_048, 8_192, 2
SEGMENT, TOXIC_SEGMENT, DMER = 24, 64, 6  # COVER's k and d
LEAST_STEM, SUPPORT, LIFT, LEAST_Z, MOST_IN_ROW = 3, 3, 5.0, 6.0, 4
THRESHOLDS = (1, 2, 3, 4, 5, 6)
RIDGE = 0.1
BLOCK = 4_000_000
FILLER, TAIL = b"\x00", 16  # in no text: cannot match; the last few bytes of a dictionary are never indexed
REPEATS = (1).to_bytes(4, "little") + (4).to_bytes(4, "little") + (8).to_bytes(4, "little")  # end of a trained dictionary's tables


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def marked_words(text: str) -> list[str]:
    words = text.lower().split()
    if words and max(map(len, words)) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return [w[:START].upper() + w[START:] for w in words]


def windows(texts: list[list[str]], size: int = WINDOW, step: int = STEP) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in one buffer, (offset, length) of each window with the blanks around it, and the text it is of."""
    data, spans, of, at = [], [], [], 0
    for i, ws in enumerate(texts):
        if not ws:
            continue
        body = (" " + " ".join(ws) + " ").encode()
        blanks = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
        n = len(blanks) - 1
        first = np.arange(0, max(1, n - size + step), step)
        first = first[first < n]
        begin, end = blanks[first], blanks[np.minimum(first + size, n)] + 1
        spans.append(np.stack([begin + at, end - begin], 1))
        of.append(np.full(len(first), i))
        data.append(body)
        at += len(body)
    if not spans:
        return b"", np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    return b"".join(data), np.concatenate(spans).astype(np.uint64), np.concatenate(of)


def compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_BTLAZY2, min_match=5, search_log=4, window_log=17, hash_log=14, chain_log=15,
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
    )
    used = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    used.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=used, compression_params=params)


def lengths(c: zstd.ZstdCompressor, buffer: bytes, spans: np.ndarray) -> np.ndarray:
    out = np.empty(len(spans), np.int32)
    for i in range(0, len(spans), 20_000):
        made = c.multi_compress_to_buffer(zstd.BufferWithSegments(buffer, spans[i : i + 20_000].tobytes()), threads=1)
        out[i : i + len(made)] = [len(made[k]) for k in range(len(made))]
    return out


class Scorer:
    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        self.ordinary = compressor(model.ordinary + FILLER * (len(model.toxic) + TAIL))
        self.toxic = compressor(model.ordinary + model.toxic + FILLER * TAIL)

    def margins(self, buffer: bytes, spans: np.ndarray) -> np.ndarray:
        return lengths(self.ordinary, buffer, spans) - lengths(self.toxic, buffer, spans)

    def features(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of each text, its windows and those whose margin reaches THRESHOLDS[2]."""
        buffer, spans, of = windows(texts)
        margin, n = self.margins(buffer, spans), np.bincount(of, minlength=len(texts))
        hits = [np.bincount(of, margin >= t, len(texts)) for t in THRESHOLDS]
        return np.stack([np.ones(len(texts)), *(10 * h / np.maximum(n, 1) for h in hits), *map(np.log1p, hits)], 1), n, hits[2].astype(np.int64)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, n, hits = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for part in blocks(texts, [len(t) for t in texts], BLOCK):
            x, n[part], hits[part] = self.features([marked_words(t.decode("utf-8", "replace")) for t in texts[part]])
            p[part] = _logistic(x @ self.weights)
        return p, n, hits


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; of too few, the samples themselves."""
    try:
        made = zstd.train_dictionary(size, samples, k=segment, d=DMER).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" "
    return made[made.index(REPEATS) + len(REPEATS) :]


def _stems(word: str) -> Iterator[str]:
    whole = word + " "
    return (whole[:n] for n in range(LEAST_STEM, min(START, len(whole)) + 1))


def _counts(rows: list[list[str]], wanted: set[str] | None = None) -> tuple[Counter, Counter, int]:
    """Uses of stems and word pairs (at most MOST_IN_ROW in a row), rows they are in, and words; copied passages once.
    wanted: the only ones to count, if given, as an ordinary row has very many others."""
    uses, spread, n, seen = Counter(), Counter(), 0, set()
    for ws in rows:
        around = [xxhash.xxh64_intdigest(" ".join(a)) for a in zip(["", *ws], ws, [*ws[1:], ""], strict=False)]
        fresh = [a not in seen for a in around]
        seen.update(around)
        found: Counter = Counter()
        for w, k in Counter(w for w, new in zip(ws, fresh, strict=True) if new).items():
            for s in _stems(w):
                found[s] += k
        found.update(f"{a} {b}" for a, b, new in zip(ws, ws[1:], fresh, strict=False) if new)
        for unit, k in found.items():
            if wanted is None or unit in wanted:
                uses[unit] += min(k, MOST_IN_ROW)
                spread[unit] += 1
        n += sum(fresh)
    return uses, spread, n


def toxic_samples(toxic: list[list[str]], ordinary: list[list[str]]) -> tuple[list[bytes], dict[str, str | None]]:
    """Stretches of toxic rows to train on; the stem, if any, that makes a word one of them."""
    uses, spread, n = _counts(toxic)
    met = {u for u, rows in spread.items() if rows >= SUPPORT}
    base, _, m = _counts(ordinary, met)

    def strong(unit: str) -> bool:
        expected = (base[unit] + 1) * n / max(1, m)
        return uses[unit] >= LIFT * expected and uses[unit] - expected >= LEAST_Z * (expected + 0.5) ** 0.5

    over, stem = {u for u in met if strong(u)}, {}
    out = []
    for ws in toxic:
        for w in ws:
            if w not in stem:  # the longest beginning that is used half as often as the shortest
                found = [s for s in _stems(w) if s in over]
                stem[w] = next((s for s in reversed(found) if 2 * uses[s] >= uses[found[0]]), None)
        met = [f" {stem[w]}" for w in ws if stem[w]]
        met += [f" {a} {b}" for a, b in zip(ws, ws[1:], strict=False) if not stem[a] and not stem[b] and f"{a} {b}" in over]
        if met:
            out.append("".join([*met, " " * 8]).encode())  # the trainer does not read the last 8 bytes
    for ws in ordinary:
        for w in ws:
            if w not in stem:
                stem[w] = next((s for s in _stems(w) if s in over), None)
    return out, stem


def _ordinary_runs(words: Iterable[str], stem: dict[str, str | None]) -> Iterator[bytes]:
    run: list[str] = []
    for w in [*words, None]:
        if w is None or stem.get(w):
            if run:
                yield f" {' '.join(run)} ".encode()
            run = []
        else:
            run.append(w)


def train(rows: list[tuple[bytes, int]]) -> Model:
    """From (text, label) pairs."""
    toxic = [ws for t, y in rows if y == 1 and (ws := marked_words(t.decode("utf-8", "replace")))]
    ordinary = [ws for t, y in rows if y == 0 and (ws := marked_words(t.decode("utf-8", "replace")))]
    none = Model(b" ", b" ", (-5.0, *[0.0] * (2 * len(THRESHOLDS))))
    if not toxic or not ordinary:
        return none
    samples, stem = toxic_samples(toxic, ordinary)
    if not samples:
        return none
    rng = np.random.default_rng(1)
    buffer, spans, _ = windows(ordinary, WINDOW, WINDOW)
    cut = [buffer[a : a + n] for a, n in spans.tolist()]
    plain = [r for i in rng.permutation(len(cut)) for r in _ordinary_runs(cut[i].decode().split(), stem)]
    content = trained(plain, ORDINARY_BYTES, SEGMENT)
    learnt = trained([samples[i] for i in rng.permutation(len(samples))], TOXIC_BYTES, TOXIC_SEGMENT)
    for _ in range(ROUNDS):
        helped = np.flatnonzero(Scorer(Model(content, learnt, ())).margins(buffer, spans) > 0)
        more = [r for i in helped for r in _ordinary_runs(cut[i].decode().split(), stem)]
        if len(more) < 20:
            break
        content += trained(more, NEGATIVE_BYTES, SEGMENT)
    x, _, _ = Scorer(Model(content, learnt, ())).features([*toxic, *ordinary])
    y = np.array([1] * len(toxic) + [0] * len(ordinary))
    scale = np.maximum(x.std(0), 1e-9)
    scale[0] = 1
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps, a small ridge
        p = _logistic(x @ w)
        g, h = x.T @ (p - y) + RIDGE * w, (x.T * (p * (1 - p))) @ x + RIDGE * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return Model(content, learnt, tuple(float(v) for v in w / scale))


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """A bounded sample of labelled rows that are not held out; repeated labels: the highest counts."""
    if not {"doc_id", "toxic"} <= {*labels.columns}:
        return []
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = usable.where("toxic = 1").orderBy(order, "doc_id").limit(MOST_TOXIC)
    picked = picked.unionByName(usable.where("toxic = 0").orderBy(order, "doc_id").limit(MOST_ORDINARY))
    y = {r[0]: r[1] for r in picked.collect()}
    if not y:
        return []

    def only(chosen: list[int]) -> DataFrame:  # at most the two bounds
        ids = F.broadcast(documents.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long"))
        return documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").where(F.col("text").isNotNull())

    sizes = {r[0]: r[1] for r in only(list(y)).groupBy("doc_id").agg(F.max(F.octet_length("text"))).collect()}
    chosen, total = [], 0
    for i in (i for i in y if i in sizes):
        if total + sizes[i] <= MOST_BYTES:
            chosen.append(i)
            total += sizes[i]
    if not chosen:
        return []
    rows = only(chosen).groupBy("doc_id").agg(F.min("text")).collect()
    return [(t.encode(), y[i]) for i, t in sorted(map(tuple, rows))]


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows, n_hits; a row for every row."""

    def make():
        scorer = Scorer(model)

        def step(ids, texts):
            p, n, hits = scorer.scores(as_bytes(texts))
            return {"doc_id": ids, "score": p, "predicted": (p >= 0.5).astype(np.int32), "n_windows": n, "n_hits": hits}

        return step

    out = map_columns(documents, ["doc_id", "text"], make, "doc_id long, score double, predicted int, n_windows long, n_hits long")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "n_windows", "n_hits")


def drop_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of documents that are not predicted toxic."""

    def make():
        scorer = Scorer(model)
        return lambda texts: scorer.scores(as_bytes(texts))[0] < 0.5

    return keep_rows(documents, "text", make)
