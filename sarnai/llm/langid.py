"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a segment (one word with a blank on either side; words over ``SEGMENT`` bytes are cut between
characters, without blanks at the cuts) in both directions and labels every byte position. The label probabilities of all positions of a document
are pooled: the mean of their logarithms, position by position, softened by ``SHARPNESS`` per segment, gives the
document's distribution; the score is its largest value. As a segment's labels depend on the segment alone,
each distinct one is computed once per task.

It is trained in numpy by backpropagation through time (Adam) on the driver, from a bounded sample: ``MOST_DOCUMENTS``
documents and ``MOST_BYTES`` of text, shared alike by all languages, the lowest hashes first (one of each language at least,
the shortest where none fits), and ``SEGMENTS`` segments in all, one of each language at least. No language is left out. A text that is null or has no letter
(Unicode category L) is ``und`` with score 0, as is every text when there is nothing to learn from. Of equal scores the first label in
code point order counts. Repeated rows are predicted alike; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sarnai.llm.common import Memo, as_bytes, blocks, held_out, map_columns

MOST_DOCUMENTS, MOST_BYTES = 1000, 24_000_000  # bounds of the training sample
SEGMENTS, SEGMENT = 24_000, 64
PARTS, SPARE, BROADCAST_ROWS = 1 << 20, 4, 10_000  # of hashes; rows ranked for each one wanted; languages whose counts are broadcast
EMBED, HIDDEN, BATCH, EPOCHS, RATE = 8, 10, 256, 5, 0.015
SHARPNESS = 1.0
BLOCK = 4_000_000
NAMES = ("e", "wf", "uf", "bf", "wb", "ub", "bb", "v", "c")


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: tuple[np.ndarray, ...]


def segments(word: bytes) -> list[bytes]:
    """The word with a blank on either side, cut between characters into parts of at most SEGMENT bytes."""
    whole = b" " + word + b" "
    if len(whole) <= SEGMENT:
        return [whole]
    out, begin = [], 0
    while len(whole) - begin > SEGMENT:
        end = begin + SEGMENT
        while end > begin + 1 and whole[end] & 0xC0 == 0x80:  # inside a character
            end -= 1
        out.append(whole[begin:end])
        begin = end
    return [*out, whole[begin:]]


def _keys(text: bytes) -> list[bytes]:
    """The words of a text, as memo keys: a word, or a blank and a part of a cut one (no word begins with a blank)."""
    words = text.split()
    if max(map(len, words), default=0) + 2 <= SEGMENT:
        return words
    return [k for w in words for k in ([w] if len(w) + 2 <= SEGMENT else [b" " + part for part in segments(w)])]


def _segment(key: bytes) -> bytes:
    return key[1:] if key[:1] == b" " else b" " + key + b" "


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, (time, row), and the lengths."""
    n = np.array([len(w) for w in words])
    wide = int(n.max())
    joined = b"".join(w.ljust(wide, b"\x00") for w in words)
    return np.frombuffer(joined, np.uint8).reshape(len(words), wide).T, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _pass(x, u, b, mask, keep: bool):
    """One direction. x: projected inputs (time, row, 3h) in reading order. States, and what the way back needs."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states, trail = np.empty((len(x), *h.shape), np.float32), []
    for t in range(len(x)):
        hu = h @ u + b
        rz = _sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        m = mask[t][:, None]
        if keep:
            trail.append((h, r, z, c, hu[:, 2 * HIDDEN :]))
        h = np.where(m, new, h)
        states[t] = h
    return states, trail


def _back(grad, trail, u, mask):
    """Gradients of the projected inputs, u and b from those of the states (reading order)."""
    gx = np.zeros((len(trail), grad.shape[1], 3 * HIDDEN), np.float32)
    gu, gb, gh = np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32), np.zeros(grad.shape[1:], np.float32)
    for t in range(len(trail) - 1, -1, -1):
        h, r, z, c, hu = trail[t]
        g = gh + grad[t]
        m = mask[t][:, None]
        on = np.where(m, g, 0)
        gc = on * (1 - z) * (1 - c * c)
        gz = on * (h - c) * z * (1 - z)
        gr = gc * hu * r * (1 - r)
        gx[t] = np.concatenate([gr, gz, gc], 1)
        ghu = np.concatenate([gr, gz, gc * r], 1)
        gu += h.T @ ghu
        gb += ghu.sum(0)
        gh = np.where(m, on * z + ghu @ u.T, g)
    return gx, gu, gb


def _forward(w: dict, ids: np.ndarray, n: np.ndarray, keep: bool = False):
    mask = np.arange(len(ids))[:, None] < n[None]
    e = w["e"][ids]
    xf, xb = e @ w["wf"], (e @ w["wb"])[::-1]
    sf, tf = _pass(xf, w["uf"], w["bf"], mask, keep)
    sb, tb = _pass(xb, w["ub"], w["bb"], mask[::-1], keep)
    s = np.concatenate([sf, sb[::-1]], 2)
    logits = s @ w["v"] + w["c"]
    logits -= logits.max(2, keepdims=True)
    logp = logits - np.log(np.exp(logits).sum(2, keepdims=True))
    return logp, mask, (e, s, tf, tb)


def train(texts: list[tuple[bytes, str]], seed: int = 7) -> Model:
    labels = tuple(sorted({y for _, y in texts}))
    if not labels:
        return Model((), ())
    rng, by = np.random.default_rng(seed), {y: [] for y in labels}
    for t, y in texts:
        by[y] += map(_segment, _keys(t))
    rows, each = [], max(1, SEGMENTS // len(labels))
    for k, y in enumerate(labels):
        take = rng.permutation(len(by[y]))[:each]
        rows += [(by[y][i], k) for i in take]
    if not rows:
        return Model((), ())
    L, scale = len(labels), lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {
        "e": (0.5 * rng.standard_normal((256, EMBED))).astype(np.float32), "wf": scale(EMBED, 3 * HIDDEN), "uf": scale(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32),
        "wb": scale(EMBED, 3 * HIDDEN), "ub": scale(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32), "v": scale(2 * HIDDEN, L), "c": np.zeros(L, np.float32),
    }
    m1, m2, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        order = order[np.argsort([len(rows[i][0]) // 4 for i in order], kind="stable")]
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            part = [rows[i] for i in batches[k]]
            ids, n = _matrix([p[0] for p in part])
            y = np.array([p[1] for p in part])
            logp, mask, (e, s, tf, tb) = _forward(w, ids, n, keep=True)
            g = np.exp(logp)
            g[:, np.arange(len(y)), y] -= 1
            g *= mask[:, :, None] / mask.sum()
            gs = g @ w["v"].T
            xf, uf, bf = _back(gs[:, :, :HIDDEN], tf, w["uf"], mask)
            xb, ub, bb = _back(gs[::-1, :, HIDDEN:], tb, w["ub"], mask[::-1])
            xb = xb[::-1]
            ge = np.zeros_like(w["e"])
            np.add.at(ge, ids, xf @ w["wf"].T + xb @ w["wb"].T)
            flat = lambda a: a.reshape(-1, a.shape[-1])
            grads = {"e": ge, "wf": flat(e).T @ flat(xf), "uf": uf, "bf": bf, "wb": flat(e).T @ flat(xb), "ub": ub, "bb": bb, "v": flat(s).T @ flat(g), "c": g.sum((0, 1))}
            step += 1
            rate = RATE * (1 - 0.9 * (epoch + 0.0) / EPOCHS)
            for name, x in grads.items():
                m1[name] = 0.9 * m1[name] + 0.1 * x
                m2[name] = 0.99 * m2[name] + 0.01 * x * x
                w[name] = w[name] - (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Model(labels, tuple(w[k] for k in NAMES))


class Predictor:
    def __init__(self, model: Model):
        self.labels, self.w = model.labels, dict(zip(NAMES, model.weights, strict=False))
        if model.labels:
            self.xf, self.xb = self.w["e"] @ self.w["wf"], self.w["e"] @ self.w["wb"]
        self.memo = Memo(self._evidence, 700_000)
        self.table, self.used = np.zeros((1024, len(self.labels)), np.float32), 0

    def positions(self, word: bytes) -> np.ndarray:
        """Label probabilities of every byte position of a segment."""
        return np.exp(_forward(self.w, *_matrix([word]))[0][:, 0])

    def _evidence(self, keys: list[bytes]) -> list[int]:
        """Rows of the table that hold the mean log probabilities over the positions of each segment."""
        words = list(map(_segment, keys))
        if len(self.memo.known) == 0:
            self.used = 0
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        if self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(words) + len(self.table), len(self.labels)), np.float32)])
        cuts = np.flatnonzero(np.diff([len(words[k]) for k in order])) + 1
        for same in np.split(np.array(order, np.int64), cuts):
            for i in range(0, len(same), 2048):
                at = same[i : i + 2048]
                self.table[self.used + at] = self._pooled(_matrix([words[k] for k in at])[0])
        first, self.used = self.used, self.used + len(words)
        return list(range(first, self.used))

    def _pooled(self, ids: np.ndarray) -> np.ndarray:
        """Mean log probabilities over the positions of segments of one length: _forward without masks."""
        w, h2 = self.w, 2 * HIDDEN
        logits = None
        for x, u, b, v, turn in ((self.xf, w["uf"], w["bf"], w["v"][:HIDDEN], 1), (self.xb, w["ub"], w["bb"], w["v"][HIDDEN:], -1)):
            h = np.zeros((ids.shape[1], HIDDEN), np.float32)
            states = np.empty((*ids.shape, HIDDEN), np.float32)
            for t in range(len(ids))[::turn]:
                a, hu = x[ids[t]], h @ u
                hu += b
                rz = a[:, :h2] + hu[:, :h2]
                rz *= 0.5
                np.tanh(rz, out=rz)
                rz += 1
                rz *= 0.5
                c = hu[:, h2:]
                c *= rz[:, :HIDDEN]
                c += a[:, h2:]
                np.tanh(c, out=c)
                h = h - c
                h *= rz[:, HIDDEN:]
                h += c
                states[t] = h
            part = states @ v
            logits = part + w["c"] if logits is None else logits + part
        logits -= logits.max(2, keepdims=True)
        return logits.mean(0) - np.log(np.exp(logits).sum(2)).mean(0)[:, None]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.labels:
            return names, scores
        for part in blocks(texts, [len(t) for t in texts], BLOCK):
            words = [_keys(t) for t in texts[part]]
            row = self.memo.learn(set().union(*words)).__getitem__
            for i, ws in enumerate(words, part.start):
                if not ws or not any(map(str.isalpha, texts[i].decode("utf-8", "replace"))):
                    continue
                total = self.table[np.fromiter(map(row, ws), np.int64, len(ws))].sum(0, dtype=np.float64) * SHARPNESS
                p = np.exp(total - total.max())
                k = int(p.argmax())
                names[i], scores[i] = self.labels[k], float(p[k] / p.sum())
        return names, scores


def training_rows(documents: DataFrame) -> list[tuple[bytes, str]]:
    """A bounded sample of documents with a language that are not held out, as many of each language and as many bytes."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    counts = usable.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return []
    each = max(1, MOST_DOCUMENTS // languages)
    number = F.xxhash64("doc_id", "text", F.lit("lang"))
    rows = usable.select("lang", number.alias("number"), F.octet_length("text").alias("size")).withColumn("part", F.pmod("number", F.lit(PARTS)))
    # only rows that can be among the lowest are ranked, so that a common language is not one task's work
    rows = rows.join(F.broadcast(counts) if languages <= BROADCAST_ROWS else counts, F.col("lang") == F.col("of"))
    rows = rows.where(F.col("part") < F.ceil(F.lit(SPARE * each * PARTS) / F.col("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("part", "number"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "number", "part", "size").collect()
    share, chosen = MOST_BYTES // languages, []
    for lang in {r["lang"] for r in rows}:
        total, mine = 0, sorted((r["part"], r["number"], r["size"]) for r in rows if r["lang"] == lang)
        fits = [x for x in mine if (total := total + x[2]) <= share or (total := total - x[2]) < 0]
        chosen += [x[1] for x in fits or [min(mine, key=lambda x: x[::-1])]]
    spark = documents.sparkSession
    picked = F.broadcast(spark.createDataFrame([(n,) for n in set(chosen)], "picked long"))  # at most MOST_DOCUMENTS, or one a language
    found = usable.select("text", "lang", number.alias("number")).join(picked, F.col("number") == F.col("picked"), "left_semi")
    return sorted({(r["text"].encode(), r["lang"]) for r in found.select("text", "lang").distinct().collect()})


def predict_language(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def make():
        predictor = Predictor(model)

        def step(ids, texts):
            names, scores = predictor.predict(as_bytes(texts))
            return {"doc_id": ids, "lang_pred": names, "score": scores}

        return step

    out = map_columns(documents, ["doc_id", "text"], make, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
