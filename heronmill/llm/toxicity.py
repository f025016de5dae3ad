"""Toxicity: a Levenshtein automaton over a lexicon trie, and context-window scores.

1. A lexicon of whole words and of stems (first letters of longer words) is learned
   by log-odds from at most ``learn_rows`` labelled documents, taken by a hash of
   the id; a few fixed insults are in it from the start. It has ``terms`` entries
   at most, so every task may hold it.
2. Its trie is intersected with the Levenshtein automaton of one edit. The product
   is made deterministic as words are read, so a word costs one look-up for each
   letter and most words end at the dead state after two or three. Whole words of
   five letters or more match with one edit after the first letter; stems match
   exactly.
3. Each hit is weighed by the words around it: quotation marks close by or verbs of
   reporting say quotation, a second person says abuse.
4. Sums of these over the whole text are the features of a logistic model, fitted
   on the driver to the same bounded sample.

Defined cases: null and empty texts have features of zero and get that score;
without labels of both kinds the model is a fixed one over the fixed insults;
rows with a null id are scored and never learned from; the largest of several
labels of an id counts. Extra columns are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronmill.llm.quality import held_out
from heronmill.llm.shared import arrow_pass, stored

#: Insults that are in every lexicon.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "imbécile", "idioten", "estúpido")
#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says called calls word term quote quoted wrote nannte sagte wort mot dit appelé dijo llamó palabra".split())
SECOND_PERSON = frozenset("you your you're u du dein dich ihr tu toi te vous votre usted tú eres".split())
TOKEN = re.compile(r"[^\W_][^\s.,;:?()\[\]{}\"“”«»]*")
QUOTES = re.compile("[\"“”«»„]")
STEMS = (3, 4, 5, 6)
FEATURES = 8


class Lexicon:
    """Trie of weighted words and stems, read through a lazily built automaton."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.long: set[int] = set()
        for table, own in ((words, self.word), (stems, self.stem)):
            for term, weight in table.items():
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                own[node] = weight
                if own is self.word and len(term) >= 5:
                    self.long.add(node)
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.known: dict[str, tuple[float, int]] = {}

    def step(self, state: frozenset, c: str) -> frozenset:
        """Pairs (node, edits) after reading ``c``; edits start below the first letter."""
        out = set()
        for node, edits in state:
            below = self.children[node]
            if c in below:
                out.add((below[c], edits))
            if edits == 0 and node:
                out.add((node, 1))  # c is one too many
                for child in below.values():
                    out.add((child, 1))  # c stands for another letter
                    if c in self.children[child]:
                        out.add((self.children[child][c], 1))  # a letter is missing before c
        return frozenset(out)

    def match(self, token: str) -> tuple[float, int]:
        """Weight, and 2 for a word, 1 for a word with an edit, 3 for a stem, 0 for none."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[token] = self._match(token)
        return found

    def _match(self, token: str) -> tuple[float, int]:
        state = frozenset([(0, 0)])
        stem = 0.0
        last = len(token) - 1
        for i, c in enumerate(token):
            to = self.steps.get((state, c))
            if to is None:
                if len(self.steps) > 200_000:
                    self.steps.clear()
                to = self.steps[state, c] = self.step(state, c)
            state = to
            if not state:
                break
            if i < last:
                for node, edits in state:
                    if not edits and node in self.stem:
                        stem = self.stem[node]
        exact = [self.word[n] for n, e in state if not e and n in self.word]
        if exact:
            return exact[0], 2
        near = [self.word[n] for n, e in state if e and n in self.long]
        near += [self.word[m] for n, e in state if not e and n for m in self.children[n].values() if m in self.long]
        if near:
            return max(near), 1
        return (stem, 3) if stem else (0.0, 0)


def terms_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def features(text: str | None, lexicon: Lexicon, around: int = 5) -> np.ndarray:
    """Sums of hits over the whole text, by kind and by context."""
    out = np.zeros(FEATURES)
    tokens = terms_of(text)
    if not tokens:
        return out
    weights = [lexicon.match(t) for t in tokens]
    hits = [(i, w, kind) for i, (w, kind) in enumerate(weights) if kind]
    if hits:
        quoted_at = quoted_tokens(text) if QUOTES.search(text) else frozenset()
        mass = np.zeros(4)
        for i, w, kind in hits:
            near = tokens[max(0, i - around) : i + around + 1]
            quoted = i in quoted_at or not REPORTING.isdisjoint(near)
            directed = not SECOND_PERSON.isdisjoint(near)
            score = w * (0.3 if quoted else 1.5 if directed else 1.0)
            mass[kind] += score
            mass[0] += w * quoted
        out[0] = np.log1p(mass[2])
        out[1] = np.log1p(mass[1])
        out[2] = np.log1p(mass[3])
        out[3] = np.log1p(mass[0])
        out[4] = min(100 * (mass[1] + mass[2]) / len(tokens), 30)
        out[5] = min(100 * mass[3] / len(tokens), 60)
        out[6] = max(w for _, w, kind in hits)
    out[7] = np.log1p(len(tokens)) / 5
    return out


def quoted_tokens(text: str) -> frozenset[int]:
    """Places of the words between a quotation mark and the next one on the same line."""
    out: list[int] = []
    inside = False
    n = 0
    for line in text.lower().split("\n"):
        inside = False
        pieces = QUOTES.split(line)
        for k, piece in enumerate(pieces):
            count = len(TOKEN.findall(piece))
            inside = k % 2 == 1 and k < len(pieces) - 1
            if inside:
                out += range(n, n + count)
            n += count
    return frozenset(out)


def sample_of(labels: DataFrame, id_col: str, label_col: str, modulus: int, rest: int, rows: int) -> DataFrame:
    """(doc, y) of at most ``rows`` labelled ids that may be learned from."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col, modulus, rest))
    each = usable.groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(label_col).cast("int").alias("y"))
    return stored(each.orderBy(F.xxhash64("doc"), "doc").limit(rows), "toxicity-sample")


def learn_lexicon(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, terms: int) -> tuple[dict, dict]:
    """Words and stems that toxic documents have more of, with their log-odds."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: set[str] = set()
                for t in set(terms_of(text)):
                    if t.isalpha() and len(t) <= 40:
                        own.add(t)
                        own.update(t[:k] + "*" for k in STEMS if len(t) > k)
                own.add("")  # counts the documents
                n[1 if y else 0].update(own)
            seen = [*(n[0].keys() | n[1].keys())]
            yield {"term": seen, "clean": [n[0][t] for t in seen], "toxic": [n[1][t] for t in seen]}

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    learned = texts.join(F.broadcast(sample), "doc")
    total = (
        arrow_pass(learned.select("y", "text"), "term string, clean long, toxic long", counts)
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    total = stored(total.where("term = '' OR toxic >= 3"), "toxicity-terms")
    every = total.where("term = ''").collect()
    if not every or not every[0].clean or not every[0].toxic:
        return dict.fromkeys(INSULTS, 4.0), {}
    odds = F.log((F.col("toxic") + 0.5) / (every[0].toxic + 1)) - F.log((F.col("clean") + 0.5) / (every[0].clean + 1))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (
        total.where("term <> ''")
        .withColumn("odds", odds)
        .withColumn("z", F.col("odds") / spread)
        .where("odds > 1 AND z > 3.5")
        .orderBy(F.desc("z"), "term")
        .limit(terms)
        .collect()
    )
    words = dict.fromkeys(INSULTS, 4.0) | {r.term: r.odds for r in best if not r.term.endswith("*")}
    return words, {r.term[:-1]: r.odds for r in best if r.term.endswith("*")}


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: The model where nothing can be learned: hits of fixed insults.
FIXED = np.array([1.2, 0.6, 0, -0.5, 0.2, 0, 0.5, 0, -4.0])


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 3,
    rest: int = 1,
    threshold: float = 0.7,
    learn_rows: int = 40_000,
    terms: int = 400,
) -> DataFrame:
    """(doc, held_out, score, predicted) of every row of ``docs``."""
    sample = sample_of(labels, id_col, label_col, modulus, rest, learn_rows)
    words, stems = learn_lexicon(docs, sample, id_col, text_col, terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        lexicon = Lexicon(words, stems)
        for batch in batches:
            yield {"doc": batch.column(0), "x": [features(t, lexicon) for t in batch.column(1).to_pylist()]}

    rows = arrow_pass(docs.select(F.col(id_col).cast("long"), text_col), "doc long, x array<double>", scan)
    rows = stored(rows, "toxicity-features")
    # One row for an id, so learn_rows at most; of several texts under one id, the least features.
    learn = rows.join(F.broadcast(sample), "doc").groupBy("doc").agg(F.min("x").alias("x"), F.min("y").alias("y")).toPandas()
    if learn.y.nunique() == 2:
        weights = logistic(np.array(learn.x.tolist()), learn.y.to_numpy(float))
    else:
        weights = FIXED

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                z = np.c_[x, np.ones(len(x))] @ weights
                yield {"doc": batch.column(0), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

    return arrow_pass(rows, "doc long, score double", score).select(
        "doc",
        F.coalesce(held_out("doc", modulus, rest), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of query op6."""
    return toxicity_scores(docs, labels).withColumnRenamed("doc", "doc_id")
