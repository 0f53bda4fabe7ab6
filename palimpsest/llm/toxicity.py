"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned from labelled rows.  Words and word beginnings (*stems*, of
STEM_LENGTHS letters) that toxic documents hold far more often than clean ones become
terms, each with a log-likelihood ratio as its weight.  A document's words run through
the intersection of the lexicon's trie with Levenshtein automata of one edit, built
lazily as a deterministic automaton: a term is found exactly or with one letter
replaced, added or left out.  The weights of misspelled forms come from the same
labelled rows, so a form that clean text uses counts for nothing.  Each find looks at a
window of words around it; in a quotation (an opening mark before and a closing one after it,
both in the window) and with a reporting verb near, it counts QUOTED as much.  score is the logistic of the prior and the strongest find of
each term (``combined``).

``sample`` bounds the labelled rows that fit the lexicon (a hash of the id chooses them
evenly); counts of those rows alone go to the driver.  Every whole text is scored.

Defined results: null, blank and unmatched texts get the prior; with no toxic training
row there are no terms, and the score is PRIOR_MOST at most, so below one half; with no clean
training row there are none either, and all texts score PRIOR_MOST; words of one or two
letters, which an edit makes of one another, are no terms; rows with a null label or id do not
train; contradicting labels of one id count as toxic; a null
id is scored, with held_out null; repeated rows are scored as often as they come; empty
tables give none; columns other than ids, texts and labels are not read.  ``without_toxic``
judges each row by its own text, whatever its id, and drops it where it stands.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import pieces

SAMPLE = 8000
STEM_LENGTHS = range(4, 9)
EVIDENCE = 8.0  # nats by which a term's toxic share must differ from the base rate
PURITY = 0.85  # toxic share of the labelled documents that hold a term, at least
SHRINK = 6.0  # rows of prior added to each term's counts
PRIOR_MOST = 0.3
LEAST_NEAR = 1.5  # weight under which a misspelled form counts for nothing
WINDOW = 8
QUOTED = 0.25
WORD, STEM = 0, 1
#: Marks and verbs that tell a report of abuse from abuse.
MARKS = set("\"“”„«»")
REPORTS = set("said says wrote called quote quoted quoting report reported sagte schrieb nannte zitat dit écrit cita dijo escribió llamó".split())


class Lexicon:
    """Terms in a trie; ``find`` runs a word through trie and automata at once."""

    def __init__(self, terms: list[tuple[str, int]], edits: int = 1):
        self.terms, self.edits = terms, edits
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.letters = set()
        for at, (term, _) in enumerate(terms):
            node = 0
            for c in term:
                self.letters.add(c)
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                node = self.child[node][c]
            self.ends[node].append(at)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.stems: list[tuple[tuple[int, int], ...]] = []
        self.whole: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        """places: trie node -> fewest edits; closed under leaving out letters of the term."""
        todo = list(places.items())
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for to in self.child[node].values():
                    if places.get(to, 9) > e + 1:
                        places[to] = e + 1
                        todo.append((to, e + 1))
        key = frozenset(places.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(places)
            self.steps.append({})
            ends = [(t, e) for node, e in places.items() for t in self.ends[node]]
            self.stems.append(tuple(x for x in ends if self.terms[x[0]][1] == STEM))
            self.whole.append(tuple(x for x in ends if self.terms[x[0]][1] == WORD))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        if c not in self.letters:
            c = "\0"
        if (to := self.steps[state].get(c)) is None:
            places: dict[int, int] = {}
            for node, e in self.sets[state].items():
                if (n := self.child[node].get(c)) is not None and places.get(n, 9) > e:
                    places[n] = e
                if e < self.edits:
                    for n in [node, *self.child[node].values()]:  # an added letter, a replaced one
                        if places.get(n, 9) > e + 1:
                            places[n] = e + 1
            to = self.steps[state][c] = self._state(places)
        return to

    def find(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of the terms that the word is or begins with."""
        state, best = self.start, {}
        for c in word:
            state = self._step(state, c)
            if not self.sets[state]:
                return tuple(best.items())
            for t, e in self.stems[state]:
                if e < best.get(t, 9):
                    best[t] = e
        for t, e in self.whole[state]:
            if e < best.get(t, 9):
                best[t] = e
        return tuple(best.items())


def bare(token: str) -> str:
    """A lower-case token without what is no letter or digit at its ends."""
    lo, hi = 0, len(token)
    while lo < hi and not token[lo].isalnum():
        lo += 1
    while hi > lo and not token[hi - 1].isalnum():
        hi -= 1
    return token[lo:hi]


class _Finds(dict):
    """Token -> what it matches, looked up once a token; emptied when it grows."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[tuple[int, int], ...]:
        if len(self) > 300_000:
            self.clear()
        self[token] = out = self.lexicon.find(bare(token))
        return out


def quotations(tokens: list[str]) -> list[tuple[int, int]]:
    """First and last token of each quotation.

    A mark before a word opens one, a mark after a word (or after it and its punctuation) closes it; a mark that
    stands alone closes an open one, or else opens one. A quotation that opens inside another takes its place.
    """
    out, first = [], None
    for i, t in enumerate(tokens):
        opens, closes = t[0] in MARKS, t[-1] in MARKS or t[-2:-1] in MARKS
        if (opens or closes) and not bare(t):
            opens, closes = first is None, first is not None
        if opens:
            first = i
        if closes and first is not None:
            out.append((first, i))
            first = None
    return out


def context(tokens: list[str], at: int, quoted: list[tuple[int, int]]) -> float:
    """The part of a find that counts: QUOTED of it inside a quotation near a reporting verb."""
    k = bisect_right(quoted, (at, len(tokens))) - 1
    if k < 0 or not (quoted[k][0] >= at - WINDOW and at <= quoted[k][1] <= at + WINDOW):
        return 1.0
    near = [*tokens[max(0, at - WINDOW) : at], *tokens[at + 1 : at + 1 + WINDOW]]
    return QUOTED if any(bare(t) in REPORTS for t in near) else 1.0


def _found(text: str, finds: _Finds) -> dict[tuple[int, int], float]:
    """(term, edits) -> the strongest context it stands in."""
    tokens = text.lower().split()
    out: dict[tuple[int, int], float] = {}
    quoted = None
    for at, hits in enumerate(map(finds.__getitem__, tokens)):
        if hits:
            quoted = quotations(tokens) if quoted is None else quoted
            weight = context(tokens, at, quoted)
            for x in hits:
                if weight > out.get(x, 0.0):
                    out[x] = weight
    return out


def _surroundings(text: str, finds: _Finds) -> dict[tuple[int, int], str]:
    """(term, edits) -> the words before and after its first find."""
    tokens = text.lower().split()
    out: dict[tuple[int, int], str] = {}
    for at, hits in enumerate(map(finds.__getitem__, tokens)):
        for x in hits:
            if x not in out:
                out[x] = " ".join(tokens[max(0, at - 1) : at] + ["_"] + tokens[at + 1 : at + 2])
    return out


def evidence(toxic: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """Log-likelihood of a term's own toxic share against the base rate."""
    n = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(toxic > 0, toxic * np.log(toxic / (n * base)), 0.0)
        b = np.where(clean > 0, clean * np.log(clean / (n * (1 - base))), 0.0)
    return np.where(toxic > n * base, a + b, 0.0)


def ratio(toxic: float, clean: float, base: float) -> float:
    """Log-likelihood ratio of a term, shrunk to nothing for rare ones."""
    odds = (toxic + SHRINK * base) / (clean + SHRINK * (1 - base))
    return math.log(odds) - math.log(base / (1 - base))


def combined(finds: dict[tuple[int, int], float], weights: dict[tuple[int, int], float]) -> tuple[float, int]:
    """The evidence of a document's finds: terms overlap, so each further one counts half as much as the one before."""
    best: dict[int, float] = {}
    for (t, e), part in finds.items():
        if (w := weights.get((t, e), 0.0) * part) > best.get(t, 0.0):
            best[t] = w
    return sum(w / 2**i for i, w in enumerate(sorted(best.values(), reverse=True))), len(best)


def _term_counts(train: DataFrame) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                own = {bare(t) for t in (text or "").lower().split()}
                terms = {(w, WORD) for w in own if len(w) >= 3}
                terms |= {(w[:n], STEM) for w in own for n in STEM_LENGTHS if len(w) > n}
                counts[int(toxic)].update(terms)
            rows = [(t, k, n, 0) for (t, k), n in counts[1].items()] + [(t, k, 0, n) for (t, k), n in counts[0].items() if (t, k) in counts[1] or n > 0]
            yield pd.DataFrame(rows, columns=["term", "kind", "toxic", "clean"])

    sums = train.mapInPandas(each, "term string, kind int, toxic long, clean long").groupBy("term", "kind")
    return sums.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3 and toxic > clean")


def choose_terms(counts: pd.DataFrame, base: float) -> list[tuple[str, int]]:
    """The strong terms; of stems with the same support the longest, and none below a stem that says as much."""
    own = counts[evidence(counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float), base) >= EVIDENCE]
    own = own[own["toxic"] >= PURITY * (own["toxic"] + own["clean"])]
    rows = sorted(own.itertuples(index=False), key=lambda r: (-(r.toxic - 3 * r.clean), r.kind, -len(r.term), r.term))
    chosen: dict[str, int] = {}
    for r in rows:
        if any(r.term.startswith(c) if k == STEM else r.kind == WORD and r.term == c for c, k in chosen.items()):
            continue
        if r.kind == STEM and any(c.startswith(r.term) for c in chosen):
            continue
        chosen[r.term] = r.kind
    return list(chosen.items())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, dict[tuple[int, int], float], float]:
    """Lexicon, weights of (term, edits), and the log-odds of the prior, from rows (doc_id, toxic)."""
    spark = docs.sparkSession
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, bad = labels.agg(F.count("*"), F.sum("toxic")).first()
    if not bad or bad == n:
        return Lexicon([]), {}, math.log(PRIOR_MOST / (1 - PRIOR_MOST)) if bad else -6.0
    share = min(1.0, sample / n)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic").persist()
    n, bad = train.agg(F.count("*"), F.sum("toxic")).first()
    base = min(PRIOR_MOST, (bad or 0) / max(n, 1))
    if not bad or bad == n:
        train.unpersist()
        return Lexicon([]), {}, math.log(PRIOR_MOST / (1 - PRIOR_MOST)) if bad else -6.0
    lexicon = Lexicon(choose_terms(_term_counts(train).toPandas(), base))
    shared = spark.sparkContext.broadcast(lexicon)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finds = _Finds(shared.value)
        for f in batches:
            rows = [(t, e, int(y), near) for text, y in zip(f["text"], f["toxic"], strict=True) for (t, e), near in _surroundings(text or "", finds).items()]
            yield pd.DataFrame(rows, columns=["term", "edits", "toxic", "near"])

    found = train.mapInPandas(each, "term int, edits int, toxic int, near string").groupBy("term", "edits")
    seen = found.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("near"))).alias("places")).toPandas()
    train.unpersist()
    return lexicon, weigh(lexicon, {(int(r.term), int(r.edits)): (int(min(r.toxic, r.places)), int(r.n - r.toxic)) for r in seen.itertuples()}, base), math.log(base / (1 - base))


def weigh(lexicon: Lexicon, counts: dict[tuple[int, int], tuple[int, int]], base: float) -> dict[tuple[int, int], float]:
    """Weights of (term, edits) that hold up on their counts (toxic, clean).

    A term counts as toxic once for each pair of neighbour words: a passage that copies
    carry from document to document says no more than one of them.
    """
    weights = {}
    for t, (term, kind) in enumerate(lexicon.terms):
        toxic, clean = counts.get((t, 0), (0, 0))
        exact = ratio(toxic, clean, base) if evidence(np.array([toxic]), np.array([clean]), base)[0] >= EVIDENCE else 0.0
        toxic, clean = counts.get((t, 1), (0, 0))
        near = ratio(toxic, clean, base) if clean else max(ratio(toxic, 0, base), exact / 2 if len(term) >= (6 if kind == STEM else 5) else 0.0)
        if exact > 0:
            weights[t, 0] = exact
            if near >= LEAST_NEAR and toxic >= PURITY * (toxic + clean):
                weights[t, 1] = min(near, exact)
    return weights


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[Lexicon, dict[tuple[int, int], float], float]:
    """What the labels whose crc32(id) mod 5 is not 0 teach."""
    train = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where(~held_out())
    return fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), train, sample)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def scored(texts: pa.Array, model: tuple[Lexicon, dict[tuple[int, int], float], float], finds: _Finds) -> Iterator[tuple[float, int]]:
    """Score and number of terms of each text."""
    _, weights, prior = model
    for text in texts:
        proof, n = combined(_found(text.as_py() or "", finds), weights)
        yield 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + proof)))), n


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_terms) for each row; labels whose crc32(id) mod 5 is 0 do not train."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs, labels, id_col, text_col, label_col, sample))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = _Finds(shared.value[0])
        for batch in batches:
            score, terms = zip(*scored(batch.column(1), shared.value, finds), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(terms, pa.int32())], ["doc_id", "score", "n_terms"])

    found = docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_terms int")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts score below one half; no row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs, labels, id_col, text_col, label_col, sample))
    where = docs.schema.fieldNames().index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finds = _Finds(shared.value[0])
        for batch in batches:
            yield from pieces(batch.filter(pa.array([score < 0.5 for score, _ in scored(batch.column(where), shared.value, finds)], pa.bool_())))

    return docs.mapInArrow(each, docs.schema)
