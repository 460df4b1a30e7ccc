"""Toxicity by a weighted finite-state pattern grammar.

Word transducers (tries whose arcs carry weights) mark insults, threats, targets, negations and reported
speech. Four small transducers read the marks of a clause: one follows negation, one reported speech, one targets, one what was said. Their composition is a
table of states and arcs, built once and walked mark by mark; its weights say what is said of whom. A
document's score comes from its matched clauses, not from words by themselves. Insult stems and their weights are
learned from labelled rows, besides a few given ones; so are the last two numbers, which turn the clauses' weights into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import cut

#: At most so many labelled rows are learned from, those first by a hash of their id. They also bound the stems, as each must be in LEAST of their texts.
LEARN_ROWS = 20_000
THRESHOLD = 0.3
#: Learned stems: the first 4 to 8 letters of a word, or a whole one; seen in so many toxic documents at least, or in this share of them.
PREFIXES, LEAST, LEAST_SHARE = range(4, 9), 4, 0.01
#: Word lists; fixed values.
INSULTS = "idiot idiots stupid moron morons trash loser losers scum worthless pathetic disgusting clown clowns imbecile dumb bastard vermin filth"
THREATS = "kill hurt destroy beat shoot burn stab murder crush töten verletzen zerstören tuer frapper détruire matar golpear destruir"
TARGETS = "you your yours yourself he she they them him her people everyone du dich dir euch sie ihr tu toi vous ils elles eux tú te ti usted ustedes ellos ellas"
NEGATIONS = "not no never nobody without isn't aren't wasn't don't doesn't didn't nicht kein keine nie niemals ne pas jamais sans nunca jamás sin"
REPORTS = "said says say claimed claims wrote writes quoted called according sagte sagt schrieb zitiert dit disait écrit selon dijo dice escribió según"
#: Weights of marks; what a clause's state makes of an insult or threat.
GIVEN_WEIGHT, THREAT_WEIGHT = 4.0, 2.0
WITH_TARGET, NEGATED, REPORTED = 1.25, 0.7, 0.8
_TOKENS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]")
_BREAKS = frozenset(".!?;:\n")
SCORE = StructType().add("score", DoubleType()).add("predicted", IntegerType()).add("clauses", IntegerType())


class Grammar:
    """``stems``: weights of learned word beginnings (ending in *) and whole words."""

    def __init__(self, stems: dict[str, float]):
        self.trie: dict = {}
        for words, mark, weight in ((THREATS, "threat", THREAT_WEIGHT), (TARGETS, "target", 1), (NEGATIONS, "negation", 1), (REPORTS, "report", 1), (INSULTS, "insult", GIVEN_WEIGHT)):
            for w in words.split():
                self._add(w, False, mark, weight)
        for stem, weight in stems.items():
            self._add(stem.rstrip("*"), stem.endswith("*"), "insult", weight)
        outer = self

        class Marks(dict):
            def __missing__(self, token: str):
                if len(self) > 500_000:
                    self.clear()
                found = self[token] = ("break", 0.0) if token in _BREAKS else outer.mark(token.lower())
                return found

        self.marks = Marks()

    def _add(self, word: str, open_: bool, mark: str, weight: float) -> None:
        at = self.trie
        for c in word:
            at = at.setdefault(c, {})
        key = "open" if open_ else "end"
        if key not in at or at[key][1] < weight:
            at[key] = (mark, weight)

    def mark(self, word: str) -> tuple[str, float] | None:
        """The word transducers' output: the heaviest of the marks on the word's path."""
        at, best = self.trie, None
        for c in word:
            at = at.get(c)
            if at is None:
                return best
            if "open" in at and (best is None or at["open"][1] > best[1]):
                best = at["open"]
        if "end" in at and (best is None or at["end"][1] > best[1]):
            best = at["end"]
        return best

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses in which an insult or a threat is said."""
        out, said = [], []
        for m in filter(None, map(self.marks.__getitem__, _TOKENS.findall(text))):
            if m[0] != "break":
                said.append(m)
            elif said:
                out += _weigh(said)
                said = []
        return out + _weigh(said)

    def evidence(self, text: str | None) -> tuple[float, int]:
        found = self.clauses(text or "")
        return math.log1p(sum(found)), len(found)


MARKS = ("insult", "threat", "target", "negation", "report")
#: The transducers of a clause: what marks take each from state 0 to 1 and back, and the factor that its state 1 puts on insults and threats.
READERS = {
    "negation": (("negation",), ("insult", "threat"), NEGATED),
    "report": (("report",), (), REPORTED),
    "target": (("target",), (), 1.0),
    "insulted": (("insult",), (), 1.0),
}


def compose() -> tuple[dict[tuple[int, str], tuple[int, float]], list[tuple[bool, bool]]]:
    """The product of READERS: arcs (state, mark) to (state, factor), and for each state whether a target was there and an insult said."""
    names, arcs = list(READERS), {}
    for state in range(1 << len(names)):
        for mark in MARKS:
            to, factor = 0, 1.0
            for i, (sets, clears, own) in enumerate(READERS.values()):
                on = state >> i & 1
                factor *= own if on and mark in ("insult", "threat") else 1.0
                to |= int(mark in sets or on and mark not in clears) << i
            arcs[state, mark] = to, factor
    at = [names.index(n) for n in ("target", "insulted")]
    return arcs, [tuple(bool(s >> i & 1) for i in at) for s in range(1 << len(names))]


ARCS, ENDS = compose()


def _weigh(said: list[tuple[str, float]]) -> list[float]:
    """The weight of a clause's marks, if an insult, or a threat with a target before or after it, is among them: threats wait for the clause's end."""
    state, insults, threats = 0, 0.0, 0.0
    for mark, weight in said:
        state, factor = ARCS[state, mark]
        if mark == "insult":
            insults += weight * factor
        elif mark == "threat":
            threats += weight * factor
    target, insulted = ENDS[state]
    if target:
        return [(insults + threats) * WITH_TARGET] if insulted or threats else []
    return [insults] if insulted else []


def held_out(id_: int) -> bool:
    return zlib.crc32(str(id_).encode()) % 4 == 2


def features(text: str | None) -> set[str]:
    out = set()
    for w in set(_TOKENS.findall(text or "")):
        w = w.lower()
        if w[0].isalpha():
            out.update(w[:k] + "*" for k in PREFIXES if len(w) >= k)
            out.add(w)
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up documents by feature and half before the shuffle."""
    for b in batches:
        found = [Counter() for _ in range(4)]
        for text, toxic, half in zip(b["text"], b["toxic"], b["half"]):
            found[2 * int(half) + int(toxic)].update(features(text))
        names = set().union(*found)
        yield pd.DataFrame([(f, *(c.get(f, 0) for c in found)) for f in names], columns=["feature", "n0", "p0", "n1", "p1"])


def _stems(rows: list, halves: tuple[int, ...], totals: dict[tuple[int, int], int]) -> dict[str, float]:
    """Weights (log odds, less for rare ones) of the stems that these halves' rows mark as toxic; a longer stem only if it says more than a shorter one."""
    toxic, clean = (sum(totals.get((h, t), 0) for h in halves) for t in (1, 0))
    least = max(LEAST * len(halves) / 2, LEAST_SHARE * toxic)
    stems: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["feature"]), r["feature"])):
        p, n = (sum(r[f"{k}{h}"] for h in halves) for k in ("p", "n"))
        if p < least or n > p / 2:
            continue
        odds = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
        weight = odds * min(1.0, p / (4 * least))
        word = r["feature"].rstrip("*")
        shorter = max((stems.get(word[:k] + "*", 0.0) for k in PREFIXES if k < len(word) or word == r["feature"]), default=0.0)
        if odds > 2 and weight > shorter + 0.3:
            stems[r["feature"]] = weight
    return stems


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float, float]:
    """Stems with weights, and the slope and offset of the score, from labelled rows that are not held out (at most LEARN_ROWS).

    Slope and offset are fitted to rows whose stems come from the other half of the rows, so stems seen by chance don't count for more than they are worth.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int").alias("half"))
    rows = cut(rows)  # the bounded sample, read several times below
    totals = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    if not all(totals.get((h, t)) for h in (0, 1) for t in (0, 1)):
        return {}, 1.0, -1.5
    sums = [F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")]
    counted = rows.mapInPandas(_counts, "feature string, n0 long, p0 long, n1 long, p1 long").groupBy("feature").agg(*sums)
    counted = counted.where(f"p0 + p1 >= {LEAST} and n0 + n1 <= 2 * (p0 + p1)").collect()
    crossed = [Grammar(_stems(counted, (1 - h,), totals)) for h in (0, 1)]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [crossed[h].evidence(t)[0] for t, h in zip(b["text"], b["half"])], "toxic": b["toxic"]})

    seen = rows.mapInPandas(weigh, "x double, toxic int").groupBy(F.round("x", 1).alias("x"), "toxic").count().collect()
    return _stems(counted, (0, 1), totals), *_logistic(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float), np.array([r["count"] for r in seen], float))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, drawn a little towards a gentle slope."""
    a, b = 1.0, -1.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (y - p) * x).sum() - 0.5 * (a - 1), (n * (y - p)).sum() - 0.5 * (b + 1.5)])
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def score(docs: DataFrame, model: tuple[dict[str, float], float, float], text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``toxicity``: score (0 to 1), predicted (1 from THRESHOLD on) and the number of matched clauses.

    A null text scores like an empty one, a text of any length is read whole. Every row is scored by itself from its text alone, so repeated rows agree; an empty table gives no
    rows. Other columns pass through; one named ``toxicity`` is replaced.
    """
    stems, slope, offset = model

    @F.pandas_udf(SCORE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(stems)
        for texts in batches:
            found = [grammar.evidence(t) for t in texts]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset)))) for x, _ in found]
            yield pd.DataFrame({"score": p, "predicted": pd.Series([int(v >= THRESHOLD) for v in p], dtype="int32"), "clauses": pd.Series([c for _, c in found], dtype="int32")})

    return docs.withColumn("toxicity", run(F.col(text_col)))
