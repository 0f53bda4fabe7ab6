"""Language identification by hierarchical discrimination.

First the language family is predicted by one-versus-rest linear classifiers, then the
languages of that family are told apart by one-versus-one linear support vector machines
whose votes are weighed by their margins.  A family of one language needs no second step.

Features are hashed byte 3- and 4-grams of the whole text (A-Z folded, all but letters and
non-ASCII bytes made spaces), as unit vectors of square-rooted counts.  The models are
fitted on ``per_language`` labelled documents of each language at most, and MOST_ROWS of all
languages (about: a hash of the id draws them evenly), whose sparse features alone go to the
driver, where they take 16 KB each; every document is predicted, in one pass over the table
and without a shuffle.  A text is read SLICE bytes at a time, so its features take bounded
memory whatever its length.

Defined results: ``und`` and score 0 for a null text, a text without a letter, and for all
texts when nothing can be learned; with one learned language it is predicted for all, score
1; ties go to the first language in code-point order; null ids are predicted, with held_out
null, but do not train; repeated rows are predicted as often as they come; an empty table
gives none; columns other than id, text and language are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize
from .textops import chunks, text_buffers

PER_LANGUAGE = 800
MOST_ROWS = 16_000
SLICE = 1 << 20
BITS = 12
MOST_BROADCAST = 10_000  # languages
#: Families of languages by ISO 639-1 code; other languages are families of their own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "semitic": "ar he mt",
    "indic": "bn hi mr ne pa ur",
    "malayic": "id ms",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 0x20, np.uint32)
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _FOLD[_c] = _c | 32 if 65 <= _c <= 90 else _c


def _grams(raw: np.ndarray, most: int) -> np.ndarray:
    """Counts of the grams that start in the first ``most`` bytes."""
    own, size = _FOLD[raw], 1 << BITS
    with np.errstate(over="ignore"):
        three = own[:-2] | (own[1:-1] << np.uint32(8)) | (own[2:] << np.uint32(16)) if len(own) > 2 else own[:0]
        four = three[:-1] | (own[3:] << np.uint32(24)) if len(own) > 3 else own[:0]
        three = (three * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        four = (four * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    return np.bincount(three[:most], minlength=size) + np.bincount(four[:most], minlength=size)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """A vector of 2 ** BITS counts for each text."""
    raw, offsets = text_buffers(column)
    size = 1 << BITS
    for i, j in chunks(offsets):
        if offsets[j] - offsets[i] > SLICE:  # one long text; its slices overlap by what the grams across their borders need
            pieces = [raw[lo : min(lo + SLICE + 3, offsets[j])] for lo in range(offsets[i], offsets[j], SLICE)]
            yield sum(_grams(own, SLICE) for own in pieces)
            continue
        own = _FOLD[raw[offsets[i] : offsets[j]]]
        off = offsets[i : j + 1] - offsets[i]
        with np.errstate(over="ignore"):
            three = own[:-2] | (own[1:-1] << np.uint32(8)) | (own[2:] << np.uint32(16)) if len(own) > 2 else own[:0]
            four = three[:-1] | (own[3:] << np.uint32(24)) if len(own) > 3 else own[:0]
            three = (three * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            four = (four * np.uint32(2246822519)) >> np.uint32(32 - BITS)
        for d in range(j - i):
            a, b = off[d], off[d + 1]
            yield np.bincount(three[a : max(a, b - 2)], minlength=size) + np.bincount(four[a : max(a, b - 3)], minlength=size)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x.astype(np.float32))
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by accelerated descent."""
    part = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    at, rate = w.copy(), 0.2
    for t in range(1, steps + 1):
        gap = part * y * np.maximum(0.0, 1 - y * (x @ at[:-1] + at[-1]))
        step = at - rate * (penalty * at - 2 * np.append(x.T @ gap, gap.sum()))
        at = step + (t - 1) / (t + 2) * (step - w)
        w = step
    return w


class Model:
    """Family machines, and pairwise machines inside families."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        own = np.array(langs)
        kin = np.array([FAMILY.get(c, c) for c in langs])
        self.families = sorted(set(kin.tolist()))
        self.members = {f: [c for c in self.langs if FAMILY.get(c, c) == f] for f in self.families}
        sign = lambda b: np.where(b, 1.0, -1.0).astype(np.float32)
        self.family = np.stack([svm(x, sign(kin == f)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {(a, b): svm(x[m], sign(own[m] == a)) for f in self.families for a, b in combinations(self.members[f], 2) for m in [(own == a) | (own == b)]}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = lambda w: x @ w[:-1] + w[-1]
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        if self.family is None:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        else:
            m = np.stack([margin(w) for w in self.family], axis=1)
            e = np.exp(4 * (m - m.max(axis=1, keepdims=True)))
            e /= e.sum(axis=1, keepdims=True)
            best, score = m.argmax(axis=1), e.max(axis=1)
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows, codes = best == k, self.members[f]
            if not rows.any():
                continue
            votes = {c: np.zeros(len(x)) for c in codes}
            for a, b in combinations(codes, 2):
                p = sure(margin(self.pairs[a, b]))
                votes[a] += p
                votes[b] += 1 - p
            share = np.stack([votes[c] for c in codes], axis=1)
            share = share / max(1.0, len(codes) * (len(codes) - 1) / 2) if len(codes) > 1 else np.ones((len(x), 1))
            top = share.argmax(axis=1)
            out[rows] = np.array(codes, object)[top[rows]]
            most = 2 / len(codes) if len(codes) > 1 else 1.0  # a language that wins all its pairs
            score[rows] *= np.minimum(1.0, share.max(axis=1)[rows] / most)
        return out.tolist(), np.clip(score, 0.0, 1.0)


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of (doc_id, text, lang) rows."""
    train = train.where("lang is not null and text is not null and doc_id is not null")
    counts = materialize(train.groupBy("lang").count(), "languages")
    wanted = counts.agg(F.sum(F.least("count", F.lit(per_language)))).first()[0] or 0
    counts = counts.withColumn("share", F.least(F.lit(1.0), F.lit(per_language * min(1.0, MOST_ROWS / max(1, wanted))) / F.col("count")))
    # A row a language: broadcast, so that texts are not dealt by language; beyond the bound they are.
    counts = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < (F.col("share") * (1 << 20)).cast("long")
    chosen = train.join(counts.select("lang", "share"), "lang").where(drawn).select("lang", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for x in features(batch.column(1)):
                i = np.flatnonzero(x)
                at.append(i.astype(np.uint16).tobytes())
                n.append(np.minimum(x[i], 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "at", "n"])

    rows: pd.DataFrame = chosen.mapInArrow(each, "lang string, at binary, n binary").toPandas()
    rows = rows[rows["at"].map(len) > 0]
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "at", "n"])
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for r, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        x[r, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint16)
    return Model(unit(x), rows["lang"].tolist())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; rows whose crc32(id) mod 4 is 2 do not train."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out), per_language))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch = whole.slice(lo, 512)
                n = len(batch)
                lang, score = ["und"] * n, np.zeros(n)
                if model is not None:
                    found, sure = model.predict(unit(np.stack(list(features(batch.column(1))))))
                    for r, value in enumerate(batch.column(1)):
                        text = value.as_py()
                        if text and _LETTER.search(text):
                            lang[r], score[r] = found[r], sure[r]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
