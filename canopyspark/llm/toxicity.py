"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to classes (insult, threat, target, negation, report) with weights.
Over the classes of a clause run five small transducers with weights on their arcs, composed into one table
whose arcs carry the products:

* insult: an insult counts, and more so if another stands just before it;
* target: an insult after a word that names whom it is aimed at becomes a targeted insult;
* threat: a threatening verb counts once a target follows it in the clause;
* negation: an insult or threat within ``REACH`` words after a negation is a negated one;
* report: one after a word of reported speech is a reported one.

What a clause emits is scored, not words alone: the document's score is a logistic function of the
weights of its emissions by kind and of their density. Insult words, and word beginnings for languages
that build long words, are learned from labelled training rows next to a fixed seed list, and so are the
weights of threats: all that pass a test of significance, however many. The weights of the kinds are fitted on
the same rows.

Training uses about ``sample_rows`` labelled rows, half of each class (all, if there are fewer); its share of
each class is taken out of the fitted constant. Scoring covers every row and whole texts. Edge cases: null
and empty texts score like a text without any match; labels that are null or of ids without a document are
unused; labels of one class only, or none, leave the seed list with fixed weights; repeated label rows of one id
count once (the highest label), of repeated documents of one id the smallest text teaches; repeated documents
score alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import bounded, cut

# Seed words of each class.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb imbecile bastard".split()
THREATS = "kill hurt destroy murder stab shoot strangle beat burn crush töten tuer matar".split()
TARGETS = "you your yours u he him his she her they them their these those people everyone du dich ihr euch sie tu toi vous usted ustedes tú".split()
NEGATIONS = "not no never nobody none isn aren wasn don doesn didn cannot nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = "said says say called calls wrote writes quoted quotes claimed claims reported sagte schrieb dit écrit dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Kinds of emission: plain, targeted, negated and reported insults; threats, negated and reported threats.
KINDS = ["insult", "aimed", "insult_negated", "insult_reported", "threat", "threat_negated", "threat_reported"]
REACH = 3
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n|]")
MIN_PREFIX, MAX_PREFIX = 4, 8
#: Words whose class one process remembers.
CACHE = 500_000
#: Least log-odds of a learned word, and how many standard errors it must be above zero.
LEAST_WEIGHT, ERRORS = 1.5, 4.0
#: Weight of the arc of an insult right after another. What context is worth, a target or a negation, is fitted by kind.
REPEATED = 1.25


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, weight); what has no arc keeps the state and the symbol, with weight 1."""

    start: object
    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def insult_transducer() -> Transducer:
    arcs = {(0, INSULT): (1, "insult", 1.0), (1, INSULT): (1, "insult", REPEATED)}
    return Transducer(0, arcs | {(1, s): (0, s, 1.0) for s in (OTHER, THREAT, TARGET, NEGATION, REPORT)})


def target_transducer() -> Transducer:
    return Transducer(0, {(0, TARGET): (1, TARGET, 1.0), (1, "insult"): (1, "aimed", 1.0)})


def threat_transducer() -> Transducer:
    return Transducer(0, {(0, THREAT): (1, OTHER, 1.0), (1, THREAT): (1, OTHER, 1.0), (1, TARGET): (0, "threat", 1.0)})


def negation_transducer() -> Transducer:
    arcs = {}
    for left in range(REACH + 1):
        after = max(0, left - 1)
        arcs[left, NEGATION] = (REACH, OTHER, 1.0)
        for symbol in (OTHER, TARGET, REPORT):
            arcs[left, symbol] = (after, symbol, 1.0)
        for symbol, kind in (("insult", "insult"), ("aimed", "insult"), ("threat", "threat")):
            arcs[left, symbol] = (after, f"{kind}_negated", 1.0) if left else (after, symbol, 1.0)
    return Transducer(0, arcs)


def report_transducer() -> Transducer:
    arcs = {(0, REPORT): (1, OTHER, 1.0)}
    for symbol, kind in (("insult", "insult"), ("aimed", "insult"), ("threat", "threat")):
        arcs[1, symbol] = (1, f"{kind}_reported", 1.0)
    return Transducer(0, arcs)


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[int]], list[list[float]]]:
    """The cascade of transducers as tables over state and class: the next state, the kind emitted or -1, and its weight."""
    start = tuple(p.start for p in parts)
    number, table, out, weights, todo = {start: 0}, [], [], [], [start]
    while todo:
        state = todo.pop(0)
        moves, kinds, products = [], [], []
        for symbol in range(6):
            after, x, product = [], symbol, 1.0
            for p, s in zip(parts, state, strict=True):
                s, x, w = p.step(s, x)
                after.append(s)
                product *= w
            goal = tuple(after)
            if goal not in number:
                number[goal] = len(number)
                todo.append(goal)
            moves.append(number[goal])
            kinds.append(KINDS.index(x) if x in KINDS else -1)
            products.append(product)
        table.append(moves)
        out.append(kinds)
        weights.append(products)
    return table, out, weights


GRAMMAR = compose(insult_transducer(), target_transducer(), threat_transducer(), negation_transducer(), report_transducer())


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings; both are insults. Words of the fixed classes besides."""

    words: dict[str, float]
    prefixes: dict[str, float]
    threats: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.fixed = {w: (k, self.threats.get(w, 1.0) if k == THREAT else 1.0) for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.lengths = sorted({len(p) for p in self.prefixes})
        #: Word -> class and weight, remembered.
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, w: str) -> tuple[int, float]:
        """Class and weight of a lower-case word."""
        if w in self.fixed:
            return self.fixed[w]
        best = self.words.get(w, 0.0)
        for n in self.lengths:
            if n >= len(w):
                break
            best = max(best, self.prefixes.get(w[:n], 0.0))
        return (INSULT, best) if best else (OTHER, 0.0)

    def emissions(self, text: str | None) -> np.ndarray:
        """Summed weights of each kind that the clauses emit, and at the end the number of words."""
        found = np.zeros(len(KINDS) + 1)
        text = (text or "").lower()
        found[-1] = text.count(" ") + text.count("\n") + 1
        known = self.known
        if len(known) > CACHE:
            known.clear()
        hits = set()  # the words of this text that can emit anything: no clause without one is read further
        for w in set(WORD.findall(text)):
            told = known.get(w)
            if told is None:
                told = known[w] = self.word(w)
            if told[0] in (INSULT, THREAT):
                hits.add(w)
        if not hits:
            return found
        table, out, arcs = GRAMMAR
        for clause in CLAUSE.split(text):
            words = WORD.findall(clause)
            if hits.isdisjoint(words):
                continue
            state, weight = 0, 0.0
            for w in words:
                kind, own = known[w]
                if kind == THREAT:
                    weight = own
                emitted, arc, state = out[state][kind], arcs[state][kind], table[state][kind]
                if emitted >= 0:
                    found[emitted] += arc * (own if kind == INSULT else weight)
        return found


def vector(e: np.ndarray) -> np.ndarray:
    """Features of emissions: a constant, density of all, logarithm of all, and each context's own density."""
    total, n = e[:-1].sum(), max(20.0, e[-1])
    return np.array([1.0, min(10.0, 100 * total / n), math.log1p(total), *np.minimum(5.0, 100 * e[1:-1] / n)])


#: Weights where there are no labels: any dense insults or threats count, negated and reported ones less.
DEFAULT = np.array([-4.0, 1.5, 0.8, 0.3, -1.5, -1.0, 1.0, -1.0, -0.8])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = float(self.weights @ vector(self.lexicon.emissions(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def grams(text: str | None, only: set[str] | None = None, stems: set[str] | None = None) -> set[str]:
    """The words ("w") and word beginnings ("w*") of a text.

    only: the words and beginnings that are wanted, and stems: those of them that are beginnings, without their stars.
    """
    found = set()
    for w in set(WORD.findall((text or "").lower())):
        if len(w) < 3:
            continue
        if only is None or w in only:
            found.add(w)
        for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w) - 1) + 1):
            if stems is None or w[:k] in stems:
                found.add(w[:k] + "*")
    return found


def gram_table(rows: DataFrame, only: set[str] | None = None) -> DataFrame:
    """(gram, docs): in how many texts of ``rows`` each is."""
    stems = None if only is None else {g[:-1] for g in only if g.endswith("*")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs.update(grams(text, only, stems))
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())], names=["gram", "docs"])

    return rows.select("text").mapInArrow(run, "gram string, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def log_odds(toxic: int, clean: int, n: dict[int, int]) -> tuple[float, float]:
    """How much likelier a toxic text has a word than a clean one, as a logarithm, and its standard error."""
    a, b = toxic + 0.5, clean + 0.5
    return math.log(a / (n[1] + 1) / (b / (n[0] + 1))), math.sqrt(max(1e-9, 1 / a - 1 / (n[1] + 1) + 1 / b - 1 / (n[0] + 1)))


def learn(rows: DataFrame, shares: dict[int, float]) -> Model:
    """A model from (text, toxic) rows, a bounded sample that is kept in the shared folder; shares: how much of each class it holds.

    What reaches the driver is bounded by the sample: its words, and a vector of each row.
    """
    seeds = dict.fromkeys(INSULTS, 3.0)
    n = {int(r.toxic): r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(Lexicon(seeds, {}), DEFAULT)
    # fewer toxic texts than this cannot pass the test, whatever the clean ones hold
    ones = {r.gram: r.docs for r in gram_table(rows.where("toxic = 1")).where(F.col("docs") >= 3).collect()}
    zeros = {r.gram: r.docs for r in gram_table(rows.where("toxic = 0"), set(ones)).collect()}
    ranked, threats = [], {}
    for g, docs in ones.items():
        weight, error = log_odds(docs, zeros.get(g, 0), n)
        if g in THREATS:
            threats[g] = max(0.1, weight)
        if weight > LEAST_WEIGHT and weight > ERRORS * error:
            ranked.append((-docs * weight, -len(g), g, weight))
    words, prefixes = dict(seeds), {}
    for _, _, g, weight in sorted(ranked):
        stem = g.rstrip("*")
        if any(stem[:k] in prefixes for k in range(MIN_PREFIX, len(stem) + 1)):
            continue
        if g.endswith("*"):
            prefixes[stem] = weight
        else:
            words[stem] = weight
    lexicon = Lexicon(words, prefixes, threats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(lexicon.emissions(t)).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    kept = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "x array<double>, toxic int").toArrow()
    weights = fit(np.array(kept.column("x").to_pylist()), kept.column("toxic").to_numpy().astype(float))
    weights[0] -= math.log(shares[1] / shares[0])
    return Model(lexicon, weights)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000) -> Model:
    """Learn from about ``sample_rows`` labelled rows outside the held-out fold (crc32 mod 5 = 0), half of each class, chosen by a hash of the id."""
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where((fold("doc_id") != 0) & F.col("toxic").isin(0, 1))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {c: min(1.0, sample_rows / 2 / max(1, n.get(c, 0))) for c in (0, 1)}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 40))
    chosen = labels.where(place < F.when(F.col("toxic") == 1, int(shares[1] * (1 << 40))).otherwise(int(shares[0] * (1 << 40))))
    docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the sample's ids are bounded by sample_rows, so they can be sent to every task
    return learn(cut(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")), shares)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([model.score(t.as_py()) for t in batch.column(1)], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, id_col, text_col, label_col, sample_rows)
    return score(docs, model, id_col, text_col).select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; same columns."""
    model = train(docs, labels, id_col, text_col, label_col, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
