"""Recurrent models read from .npz files: transliteration of words and segmentation of lines.

A file holds its weights and a JSON of its vocabularies and sizes. Words of one length run as a batch; each distinct
word or line is computed once per Arrow batch. A worker reads the file itself, so nothing heavy travels with the plan;
the path must be one that all workers see. A missing file fails the query; ``optional`` gives nulls instead.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sarnai.ship import ship

# The files' names of things.
META = "meta_json"
PAD, START, END, UNKNOWN = "<pad>", "<s>", "</s>", "<unk>"
UNKNOWN_ID = 1
GRU = ("weight_ih", "weight_hh", "bias_ih", "bias_hh")
WINDOW_WORDS, WINDOW_CHARS = 2, 60


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(x / 2)


def cell(x: np.ndarray, h: np.ndarray, w: tuple) -> np.ndarray:
    """One step of a batch. Gates stand in the order reset, update, new."""
    _, recurrent, _, bias = w
    a = np.split(h @ recurrent.T + bias, 3, axis=-1)
    b = np.split(x, 3, axis=-1)
    reset, update = sigmoid(a[0] + b[0]), sigmoid(a[1] + b[1])
    new = np.tanh(b[2] + reset * a[2])
    return new + update * (h - new)


def run_gru(x: np.ndarray, w: tuple, backward: bool = False) -> np.ndarray:
    """States (time, batch, hidden) over inputs (time, batch, features)."""
    projected = x @ w[0].T + w[2]
    h = np.zeros((x.shape[1], w[1].shape[1]), np.float32)
    states = np.empty((*x.shape[:2], h.shape[1]), np.float32)
    order = range(len(x))
    for t in reversed(order) if backward else order:
        states[t] = h = cell(projected[t], h, w)
    return states


def _load(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    with np.load(path, allow_pickle=False) as f:
        meta = json.loads(bytes(f[META]))
        return meta, {k: f[k].astype(np.float32) for k in f.files if k != META}


class WordModel:
    """Bidirectional encoder, additive attention, greedy decoder."""

    def __init__(self, path: str):
        meta, w = _load(path)
        self.w, self.most = w, meta["max_len"]
        self.source = {c: i for i, c in enumerate(meta["src_vocab"])}
        self.target, self.dictionary = meta["tgt_vocab"], meta["dictionary"]
        self.begin, self.end = self.target.index(START), self.target.index(END)
        gru = lambda p, s="": tuple(w[f"{p}.gru.{n}{s}"] for n in GRU)
        self.forth, self.back, self.decoder = gru("encoder", "_l0"), gru("encoder", "_l0_reverse"), gru("decoder")

    def decode(self, words: list[str]) -> list[str]:
        """Words of one length."""
        w, unknown = self.w, self.source[UNKNOWN]
        ids = np.array([[self.source[START], *(self.source.get(c, unknown) for c in x), self.source[END]] for x in words]).T
        x = w["encoder.emb.weight"][ids]
        f, b = run_gru(x, self.forth), run_gru(x, self.back, backward=True)
        seen = np.concatenate([f, b], 2)
        h = np.tanh(np.concatenate([f[-1], b[0]], 1) @ w["encoder.fc.weight"].T + w["encoder.fc.bias"])
        attention = w["decoder.attention.attn.weight"]
        hidden = h.shape[1]
        keys = seen @ attention[:, hidden:].T + w["decoder.attention.attn.bias"]
        last, open_ = np.full(len(words), self.begin), np.ones(len(words), bool)
        out: list[list[str]] = [[] for _ in words]
        for _ in range(self.most):
            e = np.tanh(keys + h @ attention[:, :hidden].T) @ w["decoder.attention.v.weight"][0]
            share = np.exp(e - e.max(0))
            context = ((share / share.sum(0))[:, :, None] * seen).sum(0)
            embedded = w["decoder.emb.weight"][last]
            x = np.concatenate([embedded, context], 1) @ self.decoder[0].T + self.decoder[2]
            h = cell(x, h, self.decoder)
            last = (np.concatenate([h, context, embedded], 1) @ w["decoder.out.weight"].T + w["decoder.out.bias"]).argmax(1)
            open_ &= last != self.end
            if not open_.any():
                break
            for i in np.flatnonzero(open_):
                if self.target[last[i]] not in (PAD, START):
                    out[i].append(self.target[last[i]])
        return ["".join(o) for o in out]

    def translate(self, words: list[str]) -> dict[str, str]:
        by: dict[int, list[str]] = {}
        for x in set(words):
            by.setdefault(len(x), []).append(x)
        return {x: y for same in by.values() for i in range(0, len(same), 512) for x, y in zip(same[i : i + 512], self.decode(same[i : i + 512]), strict=True)}


class LineModel:
    """The probability at each symbol of a line that the blank there joins two pieces of one word."""

    def __init__(self, path: str):
        meta, w = _load(path)
        self.ids, self.threshold, self.w = {c: i for i, c in enumerate(meta["itos"])}, meta["threshold"], w
        self.layers = [[tuple(w[f"gru.{n}_l{k}{s}"] for n in GRU) for s in ("", "_reverse")] for k in range(meta["layers"])]

    def joins(self, line: str) -> list[float]:
        if not line:
            return []
        x = self.w["emb.weight"][[self.ids.get(c, UNKNOWN_ID) for c in line]][:, None]
        for f, b in self.layers:
            x = np.concatenate([run_gru(x, f), run_gru(x, b, backward=True)], 2)
        return sigmoid(x[:, 0] @ self.w["out.weight"][0] + self.w["out.bias"][0]).tolist()


@lru_cache(4)
def word_model(path: str) -> WordModel:
    return WordModel(path)


@lru_cache(4)
def line_model(path: str) -> LineModel:
    return LineModel(path)


def _usable(path: str, optional: bool) -> bool:
    return not optional or os.path.exists(path)


def translate_word(spark: SparkSession, path: str, optional: bool = False):
    """A function of a column of words, NFC."""
    ship(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            if not _usable(path, optional):
                yield pd.Series([None] * len(words), dtype=object)
                continue
            words = words.str.normalize("NFC")
            yield words.map(word_model(path).translate([x for x in words if x is not None]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")


def join_probs(spark: SparkSession, path: str):
    """A function of a column of normalised lines."""
    ship(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            known = {x: line_model(path).joins(x) for x in set(lines.dropna())}
            yield lines.map(known)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


def normalize_line(text: Column) -> Column:
    """Lower case; a run of blanks, narrow blanks and hyphens is one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s-]+", " "))


def groups(line: Column, probs: Column, threshold: Column | float) -> Column:
    """array<array<string>>: pieces between blanks; pieces whose blank joins are of one group."""
    pieces = F.split(line, " ")
    ends = F.transform(pieces, lambda p, i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(-1), lambda n, q: n + 1 + F.length(q)))
    joined = F.transform(pieces, lambda p, i: (i > 0) & F.coalesce(F.get(probs, F.get(ends, i - 1)) > threshold, F.lit(False)))

    def put(acc: Column, i: Column) -> Column:
        p = F.array(F.get(pieces, i))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), p)))
        return F.when(F.get(joined, i), grown).otherwise(F.concat(acc, F.array(p)))

    at = F.sequence(F.lit(0), F.size(pieces) - 1)
    none = F.array().cast("array<array<string>>")
    return F.when(F.length(line) == 0, none).otherwise(F.aggregate(at, none, put))


def windows(groups_: Column, words: int = WINDOW_WORDS, chars: int = WINDOW_CHARS) -> Column:
    """Consecutive groups filled into windows of few words; a mark sticks to what is before it and counts as none."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(0).alias("n"), F.lit(0).alias("chars"))

    def put(acc: Column, group: Column) -> Column:
        s = F.array_join(group, " ")
        word = s.rlike(r"^\p{L}")
        new = (F.size(acc["out"]) == 0) | (word & (acc["n"] > 0) & ((acc["n"] >= words) | (acc["chars"] + F.length(s) + 1 > chars)))
        last = F.concat(F.try_element_at(acc["out"], F.lit(-1)), F.lit(" "), s)
        kept = F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0)))
        out = F.when(new, F.concat(acc["out"], F.array(s))).otherwise(F.concat(kept, F.array(last)))
        n = F.when(new, 0).otherwise(acc["n"]) + word.cast("int")
        return F.struct(out.alias("out"), n.alias("n"), (F.when(new, 0).otherwise(acc["chars"]) + F.length(s) + 1).alias("chars"))

    return F.aggregate(groups_, start, put, lambda acc: acc["out"])


def lines_to_cyrillic(lines: DataFrame, key: str, text: str, segmenter: str, model: str, threshold: float) -> DataFrame:
    """key and cyrillic of each row: segment, window, translate each distinct window once, join in order."""
    from sarnai.functions.text import tidy

    spark = lines.sparkSession
    rows = lines.select(key, normalize_line(F.col(text)).alias("_line"))
    rows = rows.withColumn("_probs", join_probs(spark, segmenter)("_line"))
    parts = rows.select(key, F.posexplode_outer(windows(groups(F.col("_line"), F.col("_probs"), threshold))).alias("_pos", "_window"))
    kinds = parts.where("_window IS NOT NULL").select("_window").distinct()
    made = kinds.withColumn("_made", translate_word(spark, model)("_window"))
    pieces = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_made"))), lambda s: s["_made"]), lambda m: F.coalesce(m, F.lit("")) != "")
    return parts.join(made, "_window", "left").groupBy(key).agg(tidy(F.array_join(pieces, " ")).alias("cyrillic"))
