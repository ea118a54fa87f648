"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers are composed, each reading what the one before it wrote:

0. quotation: marks what is said by somebody else: a passage between quotation marks with
   a verb of speech within QUOTE_REACH words before or after it, and what follows such a
   verb and a comma or colon, to the end of the sentence. Every clause of it begins with
   the mark, which the lexicon reads as a verb of speech.
1. lexicon: word -> class and weight. Insults and their stems are learned from
   labelled rows; threats, second-person targets, negators and verbs of speech
   are the fixed values below.
2. negation: an insult or threat soon after a negator is weakened.
3. reported speech: what follows a verb of speech in its clause is weakened,
   as it quotes somebody.
4. target: an insult aimed at a person addressed in its clause is strengthened,
   and a threat counts only with a target.
5. clause: sums the weights of a clause; a clause without insult or threat has
   weight 0, so a single harmless word scores nothing.

A text's evidence is the weight of its matched clauses (their saturating sum and
the heaviest), turned into a probability by a slope and an intercept that are
fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.session import cut, documents, fold, small_batches, table

# Closed word classes in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy murder shoot stab burn strangle töte schlage vernichte tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours yourself u ur du dich dir dein deine euch tu te toi ton ta vous votre tú ti usted vosotros".split())
NEGATORS = frozenset("not never no isn't aren't wasn't don't nobody nicht kein keine nie jamais ne nunca jamás".split())
REPORTS = frozenset("said says say wrote told claimed called quoted reported sagte sagt schrieb dit disait écrit dijo dice escribió".split())

INSULT, THREAT, TARGET, NEGATOR, REPORT, OTHER = range(6)
#: Words between a negator and what it weakens, and between a verb of speech and a quotation.
NEGATION_REACH, QUOTE_REACH = 2, 3
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.4, 0.5, 1.25, 2.5
STEMS = (4, 5, 6)
#: Stands in front of a reported clause; control characters of texts are no words.
MARK = "\x02"
WORD = re.compile(rf"{MARK}|[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:,\n]+")
_VERB = rf"(?:{'|'.join(sorted(REPORTS))})"
_GAP = rf"[^\w\"]*(?:\w+[^\w\"]+){{0,{QUOTE_REACH - 1}}}"
QUOTED = re.compile(rf'(?P<before>\b{_VERB}\b{_GAP})?"(?P<said>[^"\n]*)"(?P<after>{_GAP}\b{_VERB}\b)?')
FOLLOWING = re.compile(rf"\b(?P<verb>{_VERB})\s*[,:]\s*(?P<said>[^.!?;\n{MARK}]+)")
MARKS = str.maketrans({**dict.fromkeys("“”„«»", '"'), "’": "'", MARK: " "})


def marked(text: str) -> str:
    """The lower-cased text with MARK in front of every clause that somebody else is reported to have said."""
    clauses = lambda said: ". ".join(f"{MARK} {c}" for c in CLAUSE.split(said) if c.strip())

    def quoted(m):
        if not (m["before"] or m["after"]):
            return m[0]
        return f"{m['before'] or ''}. {clauses(m['said'])}. {m['after'] or ''}"

    return FOLLOWING.sub(lambda m: f"{m['verb']}. {clauses(m['said'])}", QUOTED.sub(quoted, text) if '"' in text else text)


class Transducer:
    """A weighted transducer with a finite set of states: step(state, symbol) -> (state, written symbols)."""

    start: object = 0

    def step(self, state, symbol):
        raise NotImplementedError

    def end(self, state) -> list:
        """Symbols written at the end of the clause."""
        return []

    def run(self, symbols: Iterable) -> Iterator:
        state = self.start
        for x in symbols:
            state, out = self.step(state, x)
            yield from out
        yield from self.end(state)


@dataclass
class Lexicon(Transducer):
    """Words to (class, weight). A word's weight is its own or that of its heaviest learned stem."""

    insults: dict[str, float]
    stems: dict[str, float]
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def look(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            weight = max([self.insults.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n)])
            if weight > 0:
                found = (INSULT, weight)
            elif word == MARK:
                found = (REPORT, 0.0)
            elif word in THREATS:
                found = (THREAT, THREAT_WEIGHT)
            else:
                found = (TARGET if word in TARGETS else NEGATOR if word in NEGATORS else REPORT if word in REPORTS else OTHER, 0.0)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def step(self, state, word):
        return state, [self.look(word)]


class Negation(Transducer):
    """States 0 .. NEGATION_REACH + 1: words left in which a negator still counts."""

    def step(self, state, symbol):
        kind, weight = symbol
        if kind == NEGATOR:
            return NEGATION_REACH + 1, [symbol]
        if state and kind in (INSULT, THREAT):
            return 0, [(kind, weight * NEGATED)]
        return max(0, state - 1), [symbol]


class Reported(Transducer):
    """State 1 after a verb of speech or the mark of a quotation, to the clause's end."""

    def step(self, state, symbol):
        kind, weight = symbol
        if kind == REPORT:
            return 1, [symbol]
        return state, [(kind, weight * REPORTED) if state and kind in (INSULT, THREAT) else symbol]


class Targeted(Transducer):
    """State (target seen, insult weight, threat weight); writes one weight when the clause ends."""

    start = (False, 0.0, 0.0)

    def step(self, state, symbol):
        seen, insult, threat = state
        kind, weight = symbol
        return (seen or kind == TARGET, insult + weight * (kind == INSULT), max(threat, weight * (kind == THREAT))), []

    def end(self, state):
        seen, insult, threat = state
        return [insult * (TARGETED if seen else 1.0) + (threat if seen else 0.0)]


@dataclass
class Composed(Transducer):
    """The cascade of parts; its state is the tuple of theirs."""

    parts: tuple[Transducer, ...]

    def run(self, symbols):
        for part in self.parts:
            symbols = part.run(symbols)
        return symbols


def strength(evidence: tuple[float, float, int]) -> float:
    """One number from a text's evidence: many matched clauses and a heavy one both count."""
    return evidence[0] + min(evidence[1], 6.0) / 2


@dataclass
class Grammar:
    """A fitted grammar; evidence(text) -> (saturating sum, heaviest clause, matched clauses)."""

    insults: dict[str, float]
    stems: dict[str, float]
    slope: float = 1.5
    intercept: float = -2.0

    def __post_init__(self):
        self.lexicon = Lexicon(self.insults, self.stems)
        self.cascade = Composed((self.lexicon, Negation(), Reported(), Targeted()))

    def evidence(self, text: str) -> tuple[float, float, int]:
        text = text.lower().translate(MARKS)
        look = self.lexicon.look
        kinds = {look(w)[0] for w in set(WORD.findall(text))}
        if INSULT not in kinds and THREAT not in kinds:
            return 0.0, 0.0, 0
        if REPORT in kinds:
            text = marked(text)
        weights = []
        for clause in CLAUSE.split(text):
            words = WORD.findall(clause)
            if any(look(w)[0] <= THREAT for w in words):  # all other clauses weigh 0
                weights += [w for w in self.cascade.run(words) if w > 0]
        if not weights:
            return 0.0, 0.0, 0
        return math.log1p(sum(weights)), max(weights), len(weights)

    def probability(self, evidence: tuple[float, float, int]) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * strength(evidence)))))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 1.0) -> tuple[float, float]:
    """Slope (0 at least) and intercept of a ridge logistic regression on one column; both classes weigh the same."""
    counts = np.bincount(y, minlength=2).astype(float)
    w = (0.5 / np.maximum(counts, 1))[y] * len(y)
    middle = float(np.average(x, weights=w))
    z = np.column_stack([x - middle, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (p - y)) + [ridge * beta[0], 0]
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-6])
        move = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        beta -= move
        if np.abs(move).max() < 1e-6:
            break
    slope = max(0.0, float(beta[0]))
    return slope, float(beta[1]) - slope * middle


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most per_class documents of either label, the first by a hash of their id; equal texts once.

    Rows whose label is null are unlabelled; of several labels of one document the largest counts.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    picked = marked.filter("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(marked.filter("y = 0").orderBy(order, "doc_id").limit(per_class))
    # 2 * per_class rows of 12 bytes: a fixed bound, whatever the input's size
    found = docs.join(F.broadcast(picked) if per_class <= 50_000 else picked, "doc_id")
    return found.groupBy("text", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "y")


def _document_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    rows = [0, 0]
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows[y] += 1
            words = {w for w in WORD.findall((text or "").lower()) if len(w) > 2}
            for f in words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}:
                counts.setdefault(f, [0, 0])[y] += 1
    counts[""] = rows
    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "clean", "toxic"])


def fit(sample: DataFrame, min_share: float = 0.02, min_ratio: float = 15.0, max_lexicon: int = 5000) -> Grammar:
    """Learn the lexicon and the two coefficients from sample (doc_id, text, y).

    A word or stem enters if it stands in min_share of the toxic documents and
    min_ratio times as often there as in the others; at most max_lexicon enter.
    An empty sample, or one of a single class, gives a grammar without learned words.
    """
    counts = sample.select("text", "y").mapInArrow(_document_features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = cut(counts)
    sizes = counts.filter("feature = ''").collect()
    n_clean, n_toxic = (sizes[0]["clean"] or 0, sizes[0]["toxic"] or 0) if sizes else (0, 0)
    if not n_clean or not n_toxic:
        return Grammar({}, {})
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    kept = counts.filter((F.col("feature") != "") & (F.col("toxic") >= max(3, min_share * n_toxic)) & (ratio >= min_ratio)).select("feature", F.log(ratio).alias("w")).orderBy(F.desc("w"), "feature").limit(max_lexicon).collect()  # bounded
    weights = {r["feature"]: min(5.0, r["w"]) for r in kept}
    grammar = Grammar({k: w for k, w in weights.items() if k[-1] != "*"}, {k[:-1]: w for k, w in weights.items() if k[-1] == "*"})

    def evidence(batches):
        for batch in batches:
            found = [strength(grammar.evidence(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], ["x", "y"])

    rows = sample.select("text", "y").mapInArrow(evidence, "x double, y int").collect()  # bounded as the sample is
    slope, intercept = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))
    return Grammar(grammar.insults, grammar.stems, slope, min(intercept, -0.1))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, predicted, n_clauses (matched), heaviest (clause weight).

    One row per row of docs, repeated rows included. A null text counts as empty; an
    empty text has no clause and gets the score of no evidence, below 0.5.
    """
    small_batches(docs.sparkSession)
    insults, stems, slope, intercept = grammar.insults, grammar.stems, grammar.slope, grammar.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(insults, stems, slope, intercept)
        for batch in batches:
            found = [own.evidence(t or "") for t in batch.column(1).to_pylist()]
            p = [own.probability(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "score", "predicted", "n_clauses", "heaviest"])

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int, n_clauses long, heaviest double")


#: Labelled documents of either class that the production grammar is fitted on.
PER_CLASS = 4000


def op1_toxicity(spark, sf_dir):
    """Every document scored by a grammar fitted on labelled rows with crc32(doc_id) mod 5 other than 0; a row without id is never held out."""
    small_batches(spark)
    docs = documents(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    grammar = fit(cut(labelled_sample(docs, labels, "toxic", PER_CLASS)))
    out = score(docs, grammar)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_clauses", "heaviest")
