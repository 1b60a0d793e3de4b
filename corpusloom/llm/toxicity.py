"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

*Lexicon.* Words and word beginnings that occur almost only in documents
labelled toxic, found by counting over labelled documents. A beginning stands
for a family of words and is used when it covers more than any longer one.

*Search.* The words of the lexicon form a trie. For a word of the text, the
Levenshtein automaton of the allowed distance runs over the trie: a state is
the row of edit distances between the word and the path to a node, and a branch
is left when all its distances exceed the bound. So ``m0ron`` is found without
comparing it to every entry. Only words that agree with an entry in its first
or its last half can be one edit away; others are not tried. For a beginning the
distance is that to the nearest beginning of a longer word.

*Context.* Every hit is weighed by the words around it: quotation marks and
verbs of reporting speak for a quotation, address in the second person,
exclamation and further hits speak for abuse. A document becomes a short vector
of hit counts and context scores, and a logistic model, fitted to the labels,
turns it into a score.

Training uses at most ``MAX_LABELLED`` labelled documents, those with the
smallest hash of the id; their word counts are made by Spark and only lexicon
candidates and vectors reach the driver. All documents are scanned whole, in
Arrow batches, without a shuffle.

Null, empty and blank texts have no hits. Repeated rows score alike. Labels
that are null are left out; of several labels of one id the largest counts.
Without labels of both kinds all scores are 0. An empty table gives an empty
result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.sources.staging import stage

# executors get the functions below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_LABELLED = 20_000
MIN_SHARE = 0.9
MAIN_WORD = 0.7
MIN_SUPPORT = 0.01
PREFIXES = range(4, 9)
FUZZY_LENGTH = 5
MAX_EDITS = 1
WINDOW = 6
MEMO = 200_000
THRESHOLD = 0.5
RIDGE = 1.0

# fixed values: marks and words that surround quotations, and words of address
QUOTES = "\"'“”„‘’‚«»"
REPORTING = frozenset(
    "said says say called calls call wrote writes quote quoted quotes word term".split()
    + "sagte sagt nannte nennt schrieb wort dit disait appelle mot dijo dice llama palabra".split()
)
ADDRESS = frozenset("you your you're u ur du dich dein ihr tu toi vous ton votre te tú eres usted".split())
EDGE = ".,;:!?()[]{}<>…-*_/\\|" + QUOTES


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    word: str | None = None
    prefix: str | None = None


class Lexicon:
    """Trie of words and beginnings, searched by Levenshtein automata."""

    def __init__(self, words: list[str], prefixes: list[str], edits: int = MAX_EDITS) -> None:
        self.edits = edits
        self.root = Node()
        for term, attribute in [(w, "word") for w in words] + [(p, "prefix") for p in prefixes]:
            node = self.root
            for letter in term:
                node = node.children.setdefault(letter, Node())
            setattr(node, attribute, term)
        long = [w for w in words if len(w) >= FUZZY_LENGTH]
        # one edit leaves the first or the last half of an entry as it is
        self.heads = {w[: len(w) // 2] for w in long}
        self.tails = {w[len(w) // 2 :] for w in long}
        # the last half of a beginning is inside the word, moved by one place at most
        families = [p for p in prefixes if len(p) >= FUZZY_LENGTH]
        self.heads |= {p[: len(p) // 2] for p in families}
        self.middles = {p[len(p) // 2 :] for p in families}
        self.middle_places = sorted({(len(p) // 2 + d, len(p) - len(p) // 2) for p in families for d in (-1, 0, 1)})
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(t) for t in self.tails})
        self.memo: dict[str, tuple[str, int] | None] = {}

    def exact(self, word: str) -> tuple[str, int] | None:
        node = self.root
        for letter in word:
            node = node.children.get(letter)
            if node is None:
                return None
            if node.prefix is not None:
                return node.prefix + "*", 0
        return (node.word, 0) if node.word is not None else None

    def plausible(self, word: str) -> bool:
        return any(word[:n] in self.heads for n in self.head_sizes) or any(
            word[-n:] in self.tails for n in self.tail_sizes
        ) or any(word[at : at + n] in self.middles for at, n in self.middle_places)

    def near(self, word: str) -> tuple[str, int] | None:
        """The closest entry within the bound (first in the alphabet on ties)."""
        best: tuple[int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for letter, child in node.children.items():
                step = [row[0] + 1]
                for i, mine in enumerate(word):
                    step.append(min(step[-1] + 1, row[i + 1] + 1, row[i] + (mine != letter)))
                if min(step) > self.edits:
                    continue
                if child.word is not None and len(child.word) >= FUZZY_LENGTH and step[-1] <= self.edits:
                    best = min(best or (99, ""), (step[-1], child.word))
                if child.prefix is not None and FUZZY_LENGTH <= len(child.prefix) < len(word):
                    best = min(best or (99, ""), (min(step), child.prefix + "*"))
                stack.append((child, step))
        return best and (best[1], best[0])

    def find(self, word: str) -> tuple[str, int] | None:
        """Entry and distance for a lower-case word, if any."""
        if word in self.memo:
            return self.memo[word]
        hit = self.exact(word)
        if hit is None and len(word) >= FUZZY_LENGTH - 1 and self.plausible(word):
            hit = self.near(word)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = hit
        return hit


FEATURES = ("hits", "density", "near", "abuse", "quoted", "only_near", "kinds")


def vector(text: str, lexicon: Lexicon) -> list[float]:
    """Hit counts and context scores of one text."""
    tokens = text.lower().split()
    found = {}
    for token in set(tokens):
        hit = lexicon.find(token.strip(EDGE))
        if hit is not None:
            found[token] = hit
    if not found:
        return [0.0] * len(FEATURES)
    places = [i for i, t in enumerate(tokens) if t in found]
    exact = near = quoted = 0
    abuse = 0.0
    for n, i in enumerate(places):
        token, (_, distance) = tokens[i], found[tokens[i]]
        around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
        marks = token[0] in QUOTES or token.rstrip(".,;:!?")[-1] in QUOTES
        quote = marks or any(w.strip(EDGE) in REPORTING for w in tokens[max(0, i - WINDOW) : i])
        close = sum(1 for j in (n - 1, n + 1) if 0 <= j < len(places) and abs(places[j] - i) <= WINDOW)
        heat = sum(w.strip(EDGE) in ADDRESS for w in around) + token.endswith("!") + close
        quoted += quote
        exact += distance == 0
        near += distance > 0
        abuse = max(abuse, (0.0 if quote else 1.0) * (1 + min(heat, 3)))
    return [
        float(np.log1p(exact)),
        min(100.0 * len(places) / len(tokens), 10.0),
        float(np.log1p(near)),
        abuse,
        quoted / len(places),
        float(exact == 0),
        float(min(len({hit[0] for hit in found.values()}), 5)),
    ]


def vectors(docs: DataFrame, key: str, text: str, lexicon: tuple[list[str], list[str]]) -> DataFrame:
    """``key, x`` per row."""
    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Lexicon(*lexicon)
        for batch in batches:
            found = [vector(t.as_py() or "", trie) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(found, pa.list_(pa.float64()))], ["key", "x"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, x array<double>")


# ---- learning ----


def choose_terms(counted: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Words and beginnings (``abcd*``) from candidates with their counts, the
    widest first. A beginning that is mostly one word gives way to that word."""
    words: list[str] = []
    chosen: set[str] = set()
    whole = {t: n for t, n in counted if not t.endswith("*")}
    main: dict[str, int] = {}
    for word, n in whole.items():
        for size in range(1, len(word) + 1):
            main[word[:size]] = max(main.get(word[:size], 0), n)
    for term, count in sorted(counted, key=lambda c: (-c[1], -len(c[0]), c[0])):
        stem = term.rstrip("*")
        if any(stem[:size] in chosen for size in range(1, len(stem) + 1)):
            continue
        if not term.endswith("*"):
            words.append(stem)
        elif main.get(stem, 0) < MAIN_WORD * count:
            chosen.add(stem)
    return sorted(words), sorted(chosen)


def learn_lexicon(texts: DataFrame) -> tuple[list[str], list[str]]:
    """Words and beginnings of words that mark toxic texts; ``texts`` has
    ``t, y``. Equal texts count once."""
    rows = texts.groupBy(F.sha2("t", 256).alias("d")).agg(F.first("t").alias("t"), F.max("y").alias("y"))
    tokens = F.transform(F.split(F.lower("t"), "[\\x20\\x09-\\x0D]+"), lambda w: F.btrim(w, F.lit(EDGE)))
    own = rows.select("y", F.array_distinct(tokens).alias("own"))
    starts = [_beginnings(n) for n in PREFIXES]
    terms = F.array_distinct(F.concat(F.filter("own", lambda w: F.length(w) >= 3), *starts))
    toxic = rows.where("y = 1").count()
    support = max(5, int(MIN_SUPPORT * toxic))
    counted = (
        own.select("y", F.explode(terms).alias("term"))
        .groupBy("term")
        .agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
        .where((F.col("toxic") >= support) & ((F.col("toxic") + 0.5) / (F.col("n") + 1) >= MIN_SHARE))
        .collect()
    )
    return choose_terms([(r["term"], r["toxic"]) for r in counted])


def _beginnings(n: int) -> Column:
    longer = F.filter("own", lambda w: F.length(w) > n)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the logistic model, the intercept last (Newton)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: tuple[list[str], list[str]]
    weight: tuple[float, ...]


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, may_learn: Column) -> Model | None:
    """Fit on the labelled documents for which ``may_learn`` (of the label's
    key) holds; None without two kinds of labels."""
    known = labels.where(may_learn & labels[label].isNotNull() & labels[key].isNotNull())
    known = known.groupBy(known[key].alias("k")).agg(F.max(label).alias("y"))
    # bounded by MAX_LABELLED, so it may be sent to every task
    sample = known.orderBy(F.xxhash64("k"), "k").limit(MAX_LABELLED)
    source = docs.select(docs[f"`{key}`"].alias("k"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("t"))
    # one text per label, however often its id occurs
    texts = stage(source.join(F.broadcast(sample), "k").groupBy("k").agg(F.max("y").alias("y"), F.min("t").alias("t")))
    lexicon = learn_lexicon(texts)
    rows = vectors(texts.select("t", F.struct("k", "y").alias("id")), "id", "t", lexicon).collect()
    rows.sort(key=lambda r: r["key"]["k"])
    y = np.array([float(r["key"]["y"] == 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return Model(lexicon, tuple(map(float, fit_logistic(np.array([r["x"] for r in rows]), y))))


def scored(docs: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """``key, score, predicted`` per row."""
    if model is None:
        rows = docs.select(docs[f"`{key}`"].alias("key"), F.lit(0.0).alias("score"))
    else:
        raw = F.lit(model.weight[-1])
        for i, w in enumerate(model.weight[:-1]):
            raw = raw + F.lit(w) * F.col("x")[i]
        rows = vectors(docs, key, text, model.lexicon).select("key", (1 / (1 + F.exp(-raw))).alias("score"))
    return rows.select(
        F.col("key").alias(key), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
