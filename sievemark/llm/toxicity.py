"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers are composed. The first, the lexicon, maps a word to a class
(insult, threat, hint, target, negation, report): fixed seed words plus words
and word stems learned from labels, strong ones that mark hardly any clean text
and weak ones (hints) that mark some. The second, :func:`scope`, keeps where a
negation reaches and whether speech is reported, and marks insults, threats and
hints by it. The third, :func:`aim`, pairs what is left unmarked with a target
near it; its arcs put out kinds of matches, each with a weight. The second and
third are tables of arcs that :func:`compose` makes one; the first has the whole
language as its alphabet and is composed as words come.

A clause is one path through the composed machine, whatever its length. Path
weights are those of the semiring (max, max): the clause weighs what its heaviest
arc does and is of that arc's kind, so a word by itself weighs less than an aimed
clause and a quoted or denied one less still. A text's score is a logistic layer
over its numbers of clauses by kind, with weights learned from labels (pulled to
the arcs' weights).

Learning uses at most ``sample`` labelled rows, chosen by a hash of the id; the
rows of the fold held out (crc32 of the id modulo 3 is 1) are never among them.

Defined results: a null or empty text matches nothing and gets the base score;
rows without label are scored like others; without any label in the training
folds the prior weights are used; repeated rows get equal scores; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Hashable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, few_texts, giving_back, table

#: Most labelled rows that weights and lexicon are learned from.
SAMPLE = 12_000
THRESHOLD = 0.7

INSULTS = ("idiot idiots moron morons stupid dumb loser losers scum trash clown clowns worthless pathetic disgusting imbecile cretin vermin "
           "filth dumbass asshole bastard bitch idiota imbécil estúpido estúpida basura dummkopf idioten abschaum arschloch crétin imbécile "
           "débile ordure connard salope").split()
THREATS = "kill hurt destroy beat stab shoot strangle murder punch töten umbringen matar golpear tuer frapper".split()
TARGETS = "you your yours he him his she her they them their this these those du dich dein ihr sie er tú te usted ellos él tu vous il elle ils eux".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't didn't won't nicht kein keine nie nunca jamás ningún pas jamais aucun".split()
REPORTS = "said says say wrote writes quoted quotes called calls told claimed sagte schrieb nannte dijo escribió llamó dit écrit appelé".split()

KINDS = ("insult", "aimed", "threat", "negated", "reported", "hint")
#: Weights of arcs by kind, and the weight of a text without a match, before any label is seen.
PRIOR, PRIOR_BASE = (2.4, 3.6, 3.8, 0.3, 0.8, 1.0), -2.0
#: Share of toxic texts among those with a term from which the term is strong or weak, and letters of a stem.
STRONG, WEAK, STEM_LETTERS = 0.95, 0.6, (3, 4, 5, 6)
#: Words over which negation and an aim reach.
SCOPE = 3

_WORD = r"[\p{L}\p{N}]+"
_STOP = re.compile(r"[.!?;:\n]")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


#: Word classes: insult, threat, hint, target, negation, report, other. Marked by the scopes they are in: ~ negated, " reported.
CLASSES = "ihwtnr-"
MARKED = tuple(m + c for m in ("", "~", '"') for c in "ihw") + ("t", "-")


class Transducer(NamedTuple):
    """A deterministic one: arcs lead from (state, symbol) to (state, what is put out, weight)."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, str, float]]


def scope() -> Transducer:
    """States (words that a negation still reaches, speech is reported): marks insults, threats and hints."""
    arcs = {}
    for left in range(SCOPE + 1):
        for told in (False, True):
            for c in CLASSES:
                mark = "~" if left else '"' if told else ""
                arcs[(left, told), c] = ((SCOPE if c == "n" else max(0, left - 1), told or c == "r"), mark + c if c in "ihw" else "t" if c == "t" else "-", 0.0)
    return Transducer((0, False), arcs)


def aim() -> Transducer:
    """States (words that a target, an insult and a threat still reach): puts out kinds of matches."""
    weight = dict(zip(KINDS, PRIOR)) | {"": 0.0}
    arcs = {}
    for target in range(SCOPE + 1):
        for insult in range(SCOPE + 1):
            for threat in range(SCOPE + 1):
                for m in MARKED:
                    kind = ""
                    if m[0] == "~":
                        kind = "negated"
                    elif m[0] == '"':
                        kind = "reported"
                    elif m == "w":
                        kind = "hint"
                    elif m == "i":
                        kind = "aimed" if target else "insult"
                    elif m == "h":
                        kind = "threat" if target else ""
                    elif m == "t":
                        kind = "threat" if threat else "aimed" if insult else ""
                    to = tuple(SCOPE if m == on else max(0, left - 1) for on, left in (("t", target), ("i", insult), ("h", threat)))
                    arcs[(target, insult, threat), m] = (to, kind, weight[kind])
    return Transducer((0, 0, 0), arcs)


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """What ``first`` puts out goes into ``second``; of the pairs of states those that can be reached. The heavier arc's weight stays."""
    start = (first.start, second.start)
    arcs, todo, symbols = {}, [start], tuple(symbols)
    seen = {start}
    while todo:
        at = todo.pop()
        for c in symbols:
            a, between, w1 = first.arcs[at[0], c]
            b, out, w2 = second.arcs[at[1], between]
            arcs[at, c] = ((a, b), out, max(w1, w2))
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)


class Grammar:
    """The composed transducers for a lexicon of whole words and stems."""

    def __init__(self, words: Iterable[str] = (), stems: Iterable[str] = (), weak_words: Iterable[str] = (), weak_stems: Iterable[str] = ()):
        import ahocorasick

        self.classes = {w: "w" for w in weak_words} | {w: "t" for w in TARGETS} | {w: "n" for w in NEGATIONS} | {w: "r" for w in REPORTS}
        self.classes |= {w: "i" for w in INSULTS} | {w: "i" for w in words} | {w: "h" for w in THREATS}
        self.stems, self.weak_stems = tuple(stems), tuple(weak_stems)
        self.scan = ahocorasick.Automaton()
        for w in {w for w, k in self.classes.items() if k in "ihw"} | {*self.stems, *self.weak_stems}:
            self.scan.add_word(w, w)
        self.scan.make_automaton()
        machine = compose(scope(), aim(), CLASSES)
        number = {s: n for n, s in enumerate(dict.fromkeys(k[0] for k in machine.arcs))}
        self.start = number[machine.start]
        self.arcs = {(number[s], c): (number[to], out, w) for (s, c), (to, out, w) in machine.arcs.items()}

    def word(self, w: str) -> str:
        """The lexicon: class of a word."""
        return self.classes.get(w) or ("i" if w.startswith(self.stems) else "w" if w.startswith(self.weak_stems) else "-")

    def clause(self, text: str) -> tuple[str, float]:
        """Kind and weight of a clause's path."""
        at, kind, weight = self.start, "", 0.0
        for w in _TOKEN.findall(text):
            at, out, heavy = self.arcs[at, self.word(w)]
            if heavy > weight:
                kind, weight = out, heavy
        return kind, weight

    def counts(self, text: str | None) -> list[int]:
        """Matched clauses by kind."""
        out = dict.fromkeys(KINDS, 0)
        if text:
            low = text.lower()
            last, stops = -1, None
            for end, w in self.scan.iter(low):
                start = end - len(w) + 1
                if start < last or (start and low[start - 1].isalnum()):
                    continue
                if stops is None:
                    stops = [m.start() for m in _STOP.finditer(low)]
                k = bisect_left(stops, start)
                last = stops[k] if k < len(stops) else len(low)
                kind, _ = self.clause(low[stops[k - 1] + 1 if k else 0 : last])
                if kind:
                    out[kind] += 1
        return list(out.values())

    def logit(self, text: str | None, model: dict) -> float:
        """Log odds of a text."""
        return model["base"] + float(np.log1p(np.array(self.counts(text), dtype=float)) / math.log(2) @ np.array(model["weights"]))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled training rows, by hash of the id."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (crc_fold(F.col(id_col)) != 1))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )
    # ``sample`` rows of two numbers: the bound of this broadcast.
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    return table(rows.select("toxic", "text").distinct(), "toxic-sample")


def learn_lexicon(rows: DataFrame, support: int = 8) -> dict[str, list[str]]:
    """Words and stems of toxic texts: seen before at least ``support`` different
    next words (so copies of one text count once), by their share of toxic texts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    pairs = F.arrays_zip(words.alias("w"), F.concat(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit(""))).alias("x"))
    row = rows.withColumn("row", F.monotonically_increasing_id())
    seen = row.select("row", "toxic", F.explode(F.array_distinct(pairs)).alias("p")).select("row", "toxic", F.col("p.w").alias("w"), F.col("p.x").alias("x"))
    grams = F.concat(
        F.array(F.struct(F.lit("w").alias("kind"), F.col("w").alias("term"))),
        *[F.when((F.length("w") > n) & ~F.col("w").isin(*INSULTS), F.array(F.struct(F.lit("p").alias("kind"), F.substring("w", 1, n).alias("term")))).otherwise(F.array()) for n in STEM_LETTERS],
    )
    hit = seen.where("toxic = 1").withColumn("g", F.explode(grams)).select("g.*", "w", "x", "row")
    ends = F.countDistinct(F.expr("substring(w, length(term) + 1, 1)"))
    found = (
        hit.groupBy("kind", "term").agg(F.countDistinct("x").alias("contexts"), F.countDistinct("w").alias("forms"), F.countDistinct("row").alias("tox"), ends.alias("ends"))
        .where((F.col("contexts") >= support) & ((F.col("kind") == "w") | ((F.col("forms") >= 4) & (F.col("ends") >= 4))))
    )
    found = table(found.drop("ends", "forms"), "toxic-terms")
    clean = (
        seen.where("toxic = 0").select("row", "w").distinct().withColumn("g", F.explode(grams)).select("g.*", "row")
        .join(found.select("kind", "term"), ["kind", "term"]).groupBy("kind", "term").agg(F.countDistinct("row").alias("clean"))
    )
    share = F.col("tox") / (F.col("tox") + F.coalesce("clean", F.lit(0)) + 0.5)  # half a clean text more than seen, so rare terms are weak
    kept = found.join(clean, ["kind", "term"], "left").withColumn("strong", share >= STRONG).where(share >= WEAK)
    # Bounded by the sample: terms with ``support`` contexts each.
    terms = kept.select("kind", "term", "strong").collect()
    out: dict[str, list[str]] = {}
    for strong, name in ((True, ""), (False, "weak_")):
        out[name + "words"] = sorted(t["term"] for t in terms if t["kind"] == "w" and t["strong"] == strong)
        stems: list[str] = []
        covered = tuple(out.get("stems", ()))
        for s in sorted({t["term"] for t in terms if t["kind"] == "p" and t["strong"] == strong}, key=lambda s: (len(s), s)):
            if not s.startswith((*covered, *stems)):
                stems.append(s)
        out[name + "stems"] = stems
    return out


def fit_weights(counts: list[tuple[tuple[int, ...], int, int]], pull: float = 1.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights by Newton steps from (counts, rows, toxic rows), pulled to the prior."""
    w = np.array([PRIOR_BASE, *PRIOR])
    if not counts:
        return float(w[0]), w[1:]
    prior = w.copy()
    x = np.array([[1.0, *np.log1p(np.array(c, dtype=float)) / math.log(2)] for c, _, _ in counts])
    n, y = np.array([c[1] for c in counts], dtype=float), np.array([c[2] for c in counts], dtype=float)
    reg = np.full(len(w), pull)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * p - y) + reg * (w - prior)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Model: lexicon and weights."""
    rows = _sample(docs, labels, id_col, text_col, sample)
    lexicon = learn_lexicon(rows)

    def count(batches):
        g = Grammar(**lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.counts(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["toxic", "counts"])

    found = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(giving_back(count), "toxic int, counts array<int>").groupBy("counts").agg(F.count("*").alias("n"), F.sum("toxic").alias("y"))
    base, weights = fit_weights([(tuple(r["counts"]), r["n"], r["y"]) for r in found.collect()])
    return {"lexicon": lexicon, "base": base, "weights": weights.tolist()}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` but none of its text: id, ``score``, ``predicted`` and ``matches`` (clauses by kind)."""

    def run(batches):
        g = Grammar(**model["lexicon"])
        w = np.array(model["weights"])
        for b in batches:
            counts = np.array([g.counts(t) for t in chain.from_iterable(few_texts(b.column(1)))], dtype=np.int32).reshape(-1, len(KINDS))
            p = 1 / (1 + np.exp(-(model["base"] + np.log1p(counts) / math.log(2) @ w)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(counts.tolist(), pa.list_(pa.int32()))],
                ["doc_id", "score", "predicted", "matches"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(run), "doc_id long, score double, predicted int, matches array<int>")


def reject(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``."""
    limit = math.log(threshold / (1 - threshold))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g = Grammar(**model["lexicon"])
        for texts in batches:
            yield pd.Series([g.logit(t, model) < limit for t in texts], dtype=bool)
        pa.default_memory_pool().release_unused()

    return docs.where(clean(F.col(text_col)))
