"""Toxicity by a weighted finite-state pattern grammar.

A text is read as a string of word classes: insult, threat, target, negation, report, quotation marks, stops, other. Three
small letter-to-letter transducers rewrite that string and are composed into one machine: a target binds the insults near
it and turns a threat into a match (a threat without a target is none), a negation marks what follows it closely, a verb of
speech or an opening quotation mark marks what is reported. Reported speech goes on over colons, and over stops until its
quotation closes. So matched clauses are scored and not single words: only matches that are neither negated nor reported
are live, and a clause weighs what its live matches do.

The classes are learnt besides the lists given. Insults are whole words and word beginnings whose odds among toxic
documents exceed those among clean ones beyond chance, each with its log odds as weight. Words before insults that make the
document's label less likely than insults alone do are read as negations (close ones) or reports (farther ones). The marked
matches go into a logistic regression fitted on the same bounded sample.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import id_bucket, slices
from foliospark.llm.labelled import labelled_sample, logistic

#: Given word classes, in four languages; ``lexicons`` replaces any of them.
LEXICONS = {
    "threat": frozenset("kill hurt destroy punch shoot stab burn beat töten schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split()),
    "target": frozenset("you your yours he she they them people du dich dir ihr euch sie tu toi te vous ils elles tú te vosotros ustedes ellos".split()),
    "negation": frozenset("not never no nobody isn't aren't wasn't don't doesn't nicht kein keine niemals pas jamais aucun aucune nunca jamás ningún".split()),
    "report": frozenset("said says called calls wrote writes quoted quotes claimed claims sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()),
}
PREFIXES = (4, 5, 6, 7)
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MARKS_OF_TEXT = {**dict.fromkeys(".!?;\n", "stop"), **dict.fromkeys("“«„", "open"), **dict.fromkeys("”»", "close"), '"': "quote"}


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter-to-letter transducer: ``step(state, symbol)`` is (state, symbol); 0 is the start."""

    step: Callable


BASE = ("other", "stop", "open", "close", "quote", "target", "negation", "report", "insult", "threat")
MARKS = ("", "@", "-", '"')  # plain, targeted, negated, reported: the later a mark, the stronger
KINDS = ("insult", "insult@", "insult-", 'insult"', "threat@", "threat-", 'threat"')
LIVE = frozenset(("insult", "insult@", "threat@"))


def marked(symbol: str, mark: str) -> str:
    kind = symbol.rstrip("@-\"")
    return kind + max(mark, symbol[len(kind) :], key=MARKS.index)


def targets(reach: int = 5, wait: int = 4) -> Transducer:
    """Marks insults up to ``reach`` symbols after a target; a threat becomes one with a target up to ``reach`` before or ``wait`` after it, there where both are known, and is ``held`` until then."""

    def step(state, symbol):
        see, pending = divmod(state, wait + 1)
        if symbol == "stop":
            return 0, symbol
        out = symbol
        if symbol == "target":
            out = "threat@" if pending else symbol
            see, pending = reach + 1, 0
        elif symbol == "threat":
            out = "threat@" if see else "held"
            pending = 0 if see else wait + 1
        elif symbol == "insult" and see:
            out = "insult@"
        return max(0, see - 1) * (wait + 1) + max(0, pending - 1), out

    return Transducer(step)


def negations(reach: int = 4) -> Transducer:
    """Marks matches up to ``reach`` symbols after a negation, within a clause."""

    def step(state, symbol):
        if symbol in ("stop", "negation"):
            return reach * (symbol == "negation"), symbol
        return max(0, state - 1), marked(symbol, "-") if state and symbol in KINDS else symbol

    return Transducer(step)


def reports(reach: int = 12, quoted: int = 24) -> Transducer:
    """Marks matches up to ``reach`` symbols after a verb of speech within its sentence, or inside a quotation, of ``quoted`` symbols at most where it never closes. States above ``reach`` are quotations."""

    def step(state, symbol):
        inside = state > reach
        if symbol == "close" or symbol == "quote" and inside:
            return 0, symbol
        if symbol in ("open", "quote"):
            return reach + quoted, symbol
        if symbol == "report" and not inside or symbol == "stop" and not inside:
            return reach * (symbol == "report"), symbol
        left = state - 1 if state and state != reach + 1 else 0
        return left, marked(symbol, '"') if state and symbol in KINDS else symbol

    return Transducer(step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """First, then second; states are numbered pairs."""
    number, pairs = {(0, 0): 0}, [(0, 0)]

    def step(state, symbol):
        a, b = pairs[state]
        a, middle = first.step(a, symbol)
        b, out = second.step(b, middle)
        if (a, b) not in number:
            number[a, b] = len(pairs)
            pairs.append((a, b))
        return number[a, b], out

    return Transducer(step)


@functools.cache
def grammar() -> tuple[list[list[int]], list[list[str]]]:
    """Target, then negation, then reported speech, as one machine: next state and output by state and number of the base class."""
    machine = compose(compose(targets(), negations()), reports())
    following: list[list[int]] = []
    outputs: list[list[str]] = []
    known = 1
    while len(following) < known:
        arcs = [machine.step(len(following), symbol) for symbol in BASE]
        following.append([s for s, _ in arcs])
        outputs.append([out for _, out in arcs])
        known = max(known, 1 + max(following[-1]))
    return following, outputs


def plain() -> tuple[list[list[int]], list[list[str]]]:
    """The machine that rewrites nothing, for comparison: every insult counts as it stands and every threat as one."""
    return [[0] * len(BASE)], [[*BASE[:-1], "threat@"]]


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; stops and quotation marks stand by themselves."""
    text = text.lower()
    for mark in MARKS_OF_TEXT:
        if mark in text:
            text = text.replace(mark, "\x00 " if mark == "\n" else f" {mark} ")
    if "\x00" in text:
        text = text.replace("\x00", " \x00 ")
    return text.split()


def bare(token: str) -> str:
    return EDGE.sub("", token)


def features_of_word(word: str):
    yield "=" + word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n]


class Classes(dict):
    """token -> (number of its class, weight), found on first use. Memory is bounded: it's emptied when full."""

    SIZE = 150_000
    OTHER = (0, 0.0)

    def __init__(self, lexicon: dict[str, float], words: dict[str, str]):
        super().__init__()
        self.lexicon, self.words = lexicon, words

    def __missing__(self, token: str):
        if len(self) >= self.SIZE:
            self.clear()
        self[token] = found = self.of(token)
        return found

    def of(self, token: str):
        mark = "stop" if token == "\x00" else MARKS_OF_TEXT.get(token)
        if mark:
            return BASE.index(mark), 0.0
        word = bare(token)
        if not word:
            return self.OTHER
        weight = max((self.lexicon.get(f, 0.0) for f in features_of_word(word)), default=0.0)
        if weight > 0:
            return BASE.index("insult"), weight
        kind = self.words.get(word)
        return (BASE.index(kind), 1.0) if kind else self.OTHER


INSULT, THREAT = BASE.index("insult"), BASE.index("threat")
FEATURES = len(KINDS) + 8


class Scorer:
    """Features of a text under a model's lexicon (feature -> weight) and words (word -> class)."""

    def __init__(self, lexicon: dict[str, float], words: dict[str, str], machine=None):
        self.classes = Classes(lexicon, words)
        self.following, self.outputs = machine or grammar()

    def read(self, tokens: list[str]):
        """(output symbol, weight, token) of every match, and ("stop", 0, None) at the end of a clause; nothing for texts without insults and threats."""
        read = list(map(self.classes.__getitem__, tokens))
        if not read or max(read)[0] < INSULT:
            return
        state = 0
        for token, (code, weight) in zip(tokens, read):
            out = self.outputs[state][code]
            state = self.following[state][code]
            if out in KINDS:
                yield out, weight, token
            elif code == 1:
                yield out, 0.0, None

    def features(self, text: str) -> list[float]:
        tokens = tokens_of(text)
        log = math.log1p
        n = log(len(tokens))
        sums = dict.fromkeys(KINDS, 0.0)
        clause = clauses = best = total = 0.0
        hits = 0
        different: set[str] = set()
        for out, weight, token in self.read(tokens):
            if token is None:
                clauses += clause > 0
                best, clause = max(best, clause), 0.0
                continue
            sums[out] += weight
            if out in LIVE:
                clause += weight
                total += weight
                hits += 1
                different.add(bare(token))
        clauses += clause > 0
        best = max(best, clause)
        return [*(log(sums[k]) for k in KINDS), best, log(clauses), log(hits), log(len(different)), log(total), log(total) * n, log(len(different)) * n, n]


def _counted(pieces, of, name):
    """Partial document counts (``name``, pos, neg) of what ``of(text)`` gives, each once a document."""

    def batch(counts):
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=[name, "pos", "neg"])
        for c in counts:
            c.clear()
        return out

    counts = (Counter(), Counter())
    for whole in pieces:
        for piece in slices(whole, "text"):
            for text, y in zip(piece.column(0), piece.column(1).to_pylist()):
                counts[y].update(of(text.as_py() or ""))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield batch(counts)
    yield batch(counts)


def word_features(text: str) -> set[str]:
    return {f for w in {bare(t) for t in set(text.lower().split()) | set(tokens_of(text))} - {""} for f in features_of_word(w)}


def neighbours(text: str, classes: Classes, near: int = 4, far: int = 12) -> set[str]:
    """Words before insults: n: and the word up to ``near`` tokens before, f: beyond these. And n:, f: alone for a text with insults."""
    tokens = tokens_of(text)
    read = list(map(classes.__getitem__, tokens))
    found: set[str] = set()
    for i, (code, _) in enumerate(read):
        if code == INSULT:
            for j in range(max(0, i - far), i):
                if read[j][0] != INSULT:
                    found.add(("n:" if i - j <= near else "f:") + bare(tokens[j]))
            found |= {"n:", "f:"}
    return found


def association(pos, neg, n1, n0):
    """(log odds ratio, its share of the standard error) of counts among n1 and n0, half a case added."""
    odds = F.log((pos + 0.5) / F.lit(n1 + 0.5)) - F.log((neg + 0.5) / F.lit(n0 + 0.5))
    return odds, odds / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def learnt_words(sample: DataFrame, lexicon: dict[str, float], given: dict[str, str], z: float) -> dict[str, str]:
    """word -> class of words whose place before insults lowers the label's odds beyond chance."""

    def run(batches):
        classes = Classes(lexicon, {})
        yield from _counted(batches, lambda text: neighbours(text, classes), "key")

    counts = sample.select("text", "y").mapInArrow(run, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = {r["key"]: (r["pos"], r["neg"]) for r in counts.where("key = 'n:'").collect()}
    n1, n0 = whole.get("n:", (0, 0))
    if not n1 or not n0:
        return {}
    odds, far = association(F.col("pos"), F.col("neg"), n1, n0)
    found = counts.where("char_length(key) > 2").select("key", far.alias("z"), odds.alias("odds")).where(f"z <= -{z} and odds <= -1").collect()
    kinds = {"f": "report", "n": "negation"}
    # close ones last: they win
    return {r["key"][2:]: kinds[r["key"][0]] for r in sorted(found, key=lambda r: r["key"]) if r["key"][2:] not in given}


def fit(docs: DataFrame, labels: DataFrame, *, label="toxic", modulus=5, held_out=0, most=40_000, z=4.0, rare_z=3.1, lexicons=None, machine=None, names=None) -> dict:
    """{"lexicon", "words", "weights"}: learnt from at most ``most`` labelled documents, equal texts counted once.

    An insult has a log odds ratio of 1 at ``z`` standard errors, or of 4 at ``rare_z``. ``lexicons`` replaces given classes.
    Without rows of both labels the model is the share of label 1, and 0 without any row."""
    sample = labelled_sample(docs, labels, label, modulus=modulus, held_out=held_out, most=most, **(names or {}))
    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {"lexicon": {}, "words": {}, "weights": None, "prior": 1.0 if n1 else 0.0}
    counts = sample.select("text", "y").mapInArrow(lambda batches: _counted(batches, word_features, "feature"), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds, far = association(F.col("pos"), F.col("neg"), n1, n0)
    kept = counts.select("feature", odds.alias("odds"), far.alias("z")).where(f"odds >= 1 and z >= {z} or odds >= 4 and z >= {rare_z}")
    lexicon = {r["feature"]: r["odds"] for r in kept.collect()}
    words = {word: kind for kind, given in (LEXICONS | (lexicons or {})).items() for word in given}
    words |= learnt_words(sample, lexicon, words, z)
    model = {"lexicon": lexicon, "words": words, "prior": n1 / (n0 + n1), "machine": machine}

    def vectors(batches):
        scorer = Scorer(lexicon, words, machine)
        for whole in batches:
            for piece in slices(whole, "text"):
                x = [scorer.features(t.as_py() or "") for t in piece.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), piece.column(1).cast(pa.int32())], names=["x", "y"])

    rows = sample.select("text", "y").mapInArrow(vectors, "x array<double>, y int").toArrow()
    x = np.array(rows["x"].to_pylist(), float)
    y = np.array(rows["y"].to_pylist(), float)
    return model | {"weights": logistic(x, y, ridge=1.0).tolist()}


def scores_of(texts, model: dict, scorer: Scorer) -> np.ndarray:
    if model["weights"] is None:
        return np.array([model["prior"] for _ in texts])
    w = np.array(model["weights"])
    x = np.array([scorer.features(t) for t in texts], float).reshape(-1, len(w) - 1)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def scorer_of(model: dict) -> Scorer:
    return Scorer(model["lexicon"], model["words"], model.get("machine"))


def score(docs: DataFrame, model: dict, *, text="text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns and score (0 to 1) of every text. A null text counts as empty; an empty table gives no rows; texts of any length are read whole, a few MB at a time; other columns are ignored."""
    names = [*keep, "score"]

    def run(batches):
        scorer = scorer_of(model)
        for whole in batches:
            for piece in slices(whole, "text_to_score"):
                found = scores_of((t.as_py() or "" for t in piece.column(len(keep))), model, scorer)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found, pa.float64())], names=names)

    rows = docs.select(*keep, F.col(text).alias("text_to_score"))
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null ids, null texts (as empty ones) and repeated rows are scored like others; equal texts have equal scores. An empty
    table gives no rows, a table without labels of both kinds one score for all. Texts are read whole, however long, and
    columns that clash with names used here are ignored."""
    model = fit(docs, labels, **options)
    scored = score(docs, model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), options.get("modulus", 5)) == options.get("held_out", 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, *, cut=0.5, **options) -> DataFrame:
    """The documents that score under ``cut``; columns stay, whatever they are called. Null and empty texts are scored as empty."""
    model = fit(docs, labels, **options)

    def run(batches):
        scorer = scorer_of(model)
        for whole in batches:
            for piece in slices(whole, "text"):
                texts = piece.column(piece.schema.get_field_index("text"))
                found = scores_of((t.as_py() or "" for t in texts), model, scorer)
                yield piece.filter(pa.array(found < cut, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
