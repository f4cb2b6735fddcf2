"""Toxicity by a weighted finite-state pattern grammar.

Words are first mapped to symbols: insult (with a weight), threat, target,
negation, report or other. The insult transducer is a prefix automaton whose
weights are learned: a prefix or word gets the log ratio of its document
frequencies in toxic and other labelled texts, if that ratio cannot well be
chance given how many were tried; a word weighs as its heaviest prefix. The
other lexicons are fixed.

Over the symbols of a clause (clauses end at sentence signs and line ends) run
finite-state machines: ``NEGATED`` counts the words that a negation still
reaches, ``REPORTED`` knows whether speech is reported, ``AIMED`` counts the
words since a target. ``compose`` makes their product, one table for the
machines that read forwards and one for ``AIMED`` backwards, and the pair of
states at an insult or threat sets its reading: plain, aimed, negated, reported
or a threat near a target. What a clause emits is the weight of each reading.

A text is described by its matched clauses alone: the weights by reading, the
greatest weight of a clause, also for its length, and how many clauses match. A
logistic unit fitted on the labelled sample combines them.

The sample is at most ``SAMPLE`` labelled documents of each class and
``SAMPLE_BYTES`` of text; the learned automaton holds at most ``MOST`` entries of
words up to ``WORD`` letters. All texts are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .cluster import checkpoint
from .labelled import fit_logistic, fold, labelled_sample, sigmoid

SAMPLE, SAMPLE_BYTES, MOST, SHORTEST, LONGEST, WORD, CHANCE, RATIO = 6000, 256 << 20, 20_000, 4, 8, 64, 1e-3, 2.0
HELD_MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
NEGATED_FOR, THREAT_REACH = 3, 4
#: Fixed lexicons.
THREATS = {"kill", "destroy", "hurt", "beat", "shoot", "burn", "töten", "umbringen", "schlagen", "tuer", "frapper", "détruire", "matar", "golpear", "destruir"}
TARGETS = {"you", "your", "yours", "u", "they", "them", "he", "she", "du", "dich", "dir", "dein", "sie", "tu", "toi", "te", "vous", "votre", "usted", "ustedes", "vosotros"}
NEGATIONS = {"not", "no", "never", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "nicht", "kein", "keine", "keinen", "nie", "niemals", "ne", "pas", "non", "jamais", "nunca", "jamás", "tampoco"}
REPORTS = {"said", "says", "quoted", "quotes", "reported", "wrote", "called", "sagte", "schrieb", "disait", "écrivait", "dijo", "escribió"}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6
PLAIN, PERSONAL, DENIED, QUOTED, MENACE = range(5)
FEATURES = 8
_NOTHING = (OTHER, 0.0)


def normal(word: bytes) -> str:
    """A word without signs at its ends, lower-cased."""
    s = word.decode("utf-8", "replace").lower()
    lo, hi = 0, len(s)
    while lo < hi and not s[lo].isalnum():
        lo += 1
    while hi > lo and not s[hi - 1].isalnum():
        hi -= 1
    return s[lo:hi]


def entries(word: str) -> list[str]:
    """Automaton entries that a word reaches: its proper prefixes (marked by a star) and itself."""
    return [f"{word[:k]}*" for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)] + ([word] if word and len(word) <= WORD else [])


def learn_lexicon(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries with (toxic, other) document counts -> those whose ratio is not chance, with their weights."""
    if not toxic or not other:
        return {}
    share = toxic / (toxic + other)
    limit = math.log(CHANCE / max(1, len(counts)))
    out = {}
    for e, t, o in counts:
        n = t + o
        if t / n <= share or t < 2:
            continue
        p = t / n  # Chernoff bound on so many toxic ones among n by chance
        kl = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (other + 1))
        if -n * kl < limit and weight > RATIO:
            out[e] = weight
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MOST])


def symbol(word: str, lexicon: dict[str, float]) -> tuple[int, float]:
    weight = max((lexicon[e] for e in entries(word) if e in lexicon), default=0.0)
    if weight:
        return INSULT, weight
    for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        if word in words:
            return kind, 0.0
    return _NOTHING


Step = Callable[[int, int], int]
#: Machines over symbols: the state before each symbol is what counts; all start in state 0.
NEGATED: Step = lambda s, x: NEGATED_FOR if x == NEGATION else max(0, s - 1)
REPORTED: Step = lambda s, x: int(s or x == REPORT)
#: 0: no target yet; k: the last one k words ago; beyond the reach it stays.
AIMED: Step = lambda s, x: 1 if x == TARGET else min(s + 1, THREAT_REACH + 1) if s else 0


def compose(*machines: Step) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """The product of machines: the states that can be reached (a state of each) and the table state, symbol -> state."""
    states = [(0,) * len(machines)]
    number = {states[0]: 0}
    table: list[list[int]] = []
    for own in states:  # grows as new states are met
        row = []
        for x in range(SYMBOLS):
            to = tuple(m(s, x) for m, s in zip(machines, own))
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        table.append(row)
    return states, table


AHEAD, AHEAD_STEP = compose(NEGATED, REPORTED, AIMED)
BACK, BACK_STEP = compose(AIMED)


def reading(symbol: int, before: tuple[int, ...], after: tuple[int, ...]) -> int:
    """What an insult or threat is between two states of the composed machines; -1: nothing."""
    negated, reported, aimed = before
    if symbol == INSULT:
        return QUOTED if reported else DENIED if negated else PERSONAL if aimed or after[0] else PLAIN
    near = 0 < aimed <= THREAT_REACH or 0 < after[0] <= THREAT_REACH
    return MENACE if symbol == THREAT and near and not negated and not reported else -1


READING = [[[reading(x, a, b) for b in BACK] for a in AHEAD] for x in range(SYMBOLS)]


def read_clause(symbols: list[int], weights: list[float]) -> list[float]:
    """Weights that the composed transducer emits for a clause, by reading; a threat weighs 1."""
    out = [0.0] * 5
    after = [0] * len(symbols)
    state = 0
    for i in range(len(symbols) - 1, -1, -1):
        after[i] = state
        state = BACK_STEP[state][symbols[i]]
    state = 0
    for i, x in enumerate(symbols):
        got = READING[x][state][after[i]] if x == INSULT or x == THREAT else -1
        if got >= 0:
            out[got] += weights[i] if x == INSULT else 1.0
        state = AHEAD_STEP[state][x]
    return out


class Grammar:
    """Symbols of words, remembered by hash, and descriptions of texts."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[int, tuple[int, float]] = {}

    def describe(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        words = tx.Words(buf, offs)
        out = np.zeros((words.n_docs, FEATURES))
        if not words.n:
            return out
        u, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > 500_000:
            self.known.clear()
        raw = buf.tobytes()
        kind = np.zeros(len(u), np.int8)
        weight = np.zeros(len(u))
        for i, (h, f) in enumerate(zip(u.tolist(), first.tolist())):
            got = self.known.get(h)
            if got is None:
                got = self.known[h] = symbol(normal(raw[words.start[f] : words.end[f]]), self.lexicon)
            if got[0]:
                kind[i], weight[i] = got
        kind, weight = kind[back], weight[back]
        hot = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        if not len(hot):
            return out
        tail = buf[words.end - 1]
        stop = np.isin(tail, np.frombuffer(b".,;:!?", np.uint8))
        lines = np.concatenate([[0], np.cumsum(buf == 10)])
        stop[:-1] |= lines[words.start[1:]] > lines[words.start[:-1]]
        stop[words.first_word[1:][words.counts() > 0] - 1] = True
        clause = np.concatenate([[0], np.cumsum(stop)[:-1]])
        edges = np.concatenate([[0], np.flatnonzero(stop) + 1])
        doc = words.doc_of_word()
        for c in np.unique(clause[hot]).tolist():
            lo, hi = edges[c], edges[c + 1] if c + 1 < len(edges) else words.n
            made = read_clause(kind[lo:hi].tolist(), weight[lo:hi].tolist())
            meant = made[PLAIN] + made[PERSONAL] + made[MENACE]
            d = doc[lo]
            out[d, :5] += made
            out[d, 5] = max(out[d, 5], meant / math.sqrt(hi - lo))
            out[d, 6] += meant > 0
            out[d, 7] = max(out[d, 7], meant)
        out[:, :5] = np.log1p(out[:, :5])
        out[:, 6] = np.log1p(out[:, 6])
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of the entries in a partition of the sample."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for b in batches:
        for y, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            own = {normal(w) for w in (text or "").encode().split()}
            seen[y].update({e for w in own for e in entries(w)})
            n[y] += 1
    every = list(seen[0].keys() | seen[1].keys())
    yield pa.record_batch(
        [pa.array([*every, ""], pa.string()), pa.array([*(seen[1][e] for e in every), n[1]], pa.int64()), pa.array([*(seen[0][e] for e in every), n[0]], pa.int64())],
        names=["entry", "toxic", "other"],
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and logistic weights from labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, label, HELD_MODULUS, HELD_OUT, sample, SAMPLE_BYTES, id_col, text_col)
    made = rows.mapInArrow(tx.tidied(_counts), "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    made = checkpoint(made)
    total = made.filter("entry = ''").first()
    toxic, other = (total.toxic, total.other) if total else (0, 0)
    if not toxic or not other:
        return {}, np.concatenate([np.zeros(FEATURES), [math.log((toxic + 0.5) / (other + 0.5))]])
    tried = made.count()
    top = made.filter((F.col("entry") != "") & (F.col("toxic") >= 2)).withColumn("_r", F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5)) * F.sqrt("toxic"))
    counts = [(r.entry, r.toxic, r.other) for r in top.orderBy(F.desc("_r"), "entry").limit(5 * MOST).collect()]
    lexicon = learn_lexicon(counts + [("", 1, 1)] * max(0, tried - len(counts)), toxic, other)
    lexicon.pop("", None)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(sent.value)
        for b in batches:
            buf, offs = tx.string_buffers(b.column(2))
            x = np.concatenate([np.zeros((0, FEATURES)), *(grammar.describe(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in tx.doc_runs(offs))])
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["id", "y", *(f"x{k}" for k in range(FEATURES))])

    t = rows.mapInArrow(tx.tidied(run), "id long, y int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toPandas().sort_values(["id", "x0", "x5"])
    return lexicon, fit_logistic(t[[f"x{k}" for k in range(FEATURES)]].to_numpy(), t["y"].to_numpy())


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``_score`` (new to docs): the probability that a text is toxic. Null and empty texts score as texts without a match."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = sent.value
        grammar = Grammar(lexicon)
        for b in batches:
            buf, offs = tx.string_buffers(b.column(at))
            x = np.concatenate([np.zeros((0, FEATURES)), *(grammar.describe(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in tx.doc_runs(offs))])
            yield pa.record_batch([*b.columns, pa.array(sigmoid(x @ w[:-1] + w[-1]))], names=[*b.schema.names, "_score"])

    return docs.mapInArrow(tx.tidied(run), T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row.

    Null ids count as not held out. Null and empty texts score as texts without
    a match; texts of any length are read whole. Without labels of both classes
    the score is their share. Of entries that weigh the same the first by name
    stay. Repeated rows give repeated results; other columns are left out.
    """
    made = score(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")), fit(docs, labels, label, id_col, text_col), "i", "t")
    held = F.coalesce(fold("i", HELD_MODULUS) == HELD_OUT, F.lit(False))
    return made.select(F.col("i").alias(id_col), held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
