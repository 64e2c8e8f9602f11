"""Toxicity by a weighted finite-state pattern grammar.

Five transducers are written as arcs and composed into one machine over the words of a clause:

* *negation* marks insults and threats after a negation, until a contrast ("but", a comma) or the end of the clause;
* *reported speech* marks those after a verb of saying;
* *target* reads a clause under one of two readings, with or without somebody who is addressed or named; the reading with
  a target is accepted only if one occurs before the clause ends, on either side of what it marks;
* *insult* and *threat* emit what is left: an event per marked word, with the event's weight.  A threat without a target
  emits nothing.

A word enters as a symbol: an insult with the weight of its lexicon entry (the word or a stem of 3 to 7 letters), a threat,
a target, a negation, a verb of saying, a contrast, or a plain word.  A path adds up event weight times word weight, and a
clause scores as its best accepted path, so an insult counts by the pattern it stands in: most with a target, less alone,
little when negated or quoted.  A document's score is a logistic function of what its clauses' best paths emitted.

Function words of negation, contrast, reporting, targets and threats are given for four languages.  Learned are: insult words
and stems with their weights (log-odds of the toxic share, drawn to the overall one by ``DRAW`` pseudo-documents; kept if
the G-squared statistic reaches ``min_g2``), the events' weights (how much
an event tells about its document, drawn to the given weights by ``PRIOR`` pseudo-documents), and the logistic weights, from
rows that the lexicon in use did not see.  Training rows are a sample of at most ``max_train`` labelled rows outside the
held-out fold, the ones with the smallest hash of their id: a bounded list that is broadcast, so that training moves no
text of other rows; the lexicon is bounded by what these rows hold.  Scoring reads every whole text in one narrow pass.

Defined results: null or empty texts score as a text without matches; null doc_id is scored, is not held out and is not
trained on; null labels are ignored; repeated rows are scored each; without a toxic training row every score is 0; a very
long text is read clause by clause, in time linear in its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: function words of English, German, French and Spanish
NEGATION = set("not no never nor neither isn aren wasn don doesn didn nicht kein keine nie ne pas jamais aucun no nunca tampoco ni".split())
CONTRAST = set("but however though aber sondern jedoch mais pourtant pero sino ,".split())
REPORTED = set("said says say claimed called quoted wrote reported sagte sagt schrieb nannte dit disait écrit cité dijo dice escribió llamó".split())
TARGET = set("you your yours u he she they them him her his their this that these those du dich dir ihr euch sie er tu toi vous votre il elle ils tú usted ustedes te tus él ella ellos".split())
THREAT = set("kill hurt destroy stab shoot murder beat burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split())
GRAMMAR_WORDS = NEGATION | CONTRAST | REPORTED | TARGET
GIVEN = {"insult": 1.0, "insult@": 1.15, "insult~": 0.25, "insult~@": 0.3, 'insult"': 0.6, 'insult"@': 0.6, 'insult~"': 0.2, 'insult~"@': 0.2, "threat@": 1.0, "threat~@": 0.2, 'threat"@': 0.5, 'threat~"@': 0.1}
THREAT_WEIGHT = 2.0
PRIOR, DRAW = 20, 5
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+|,")
STEMS = (7, 6, 5, 4, 3)


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol read) to (symbol written, weight, next state); one of the starts to one of the ends."""

    starts: tuple
    ends: frozenset
    arcs: dict = field(hash=False)

    def __matmul__(self, then: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads; weights are multiplied.  Only states that are reached."""
        starts = tuple((a, b) for a in self.starts for b in then.starts)
        symbols = sorted({s for _, s in self.arcs})
        arcs, seen, todo = {}, set(starts), list(starts)
        while todo:
            a, b = state = todo.pop()
            for s in symbols:
                out = [(z, x * y, (a2, b2)) for mid, x, a2 in self.arcs.get((a, s), ()) for z, y, b2 in then.arcs.get((b, mid), ())]
                if out:
                    arcs[state, s] = out
                    todo += (new := {o[2] for o in out} - seen)
                    seen |= new
        return Transducer(starts, frozenset((a, b) for a, b in seen if a in self.ends and b in then.ends), arcs)


def machine(starts: str, ends: str, rules: str) -> Transducer:
    """From rules "state symbols > written state", one a line; ``*`` in what is written stands for the symbol read."""
    arcs: dict = {}
    for rule in filter(None, map(str.strip, rules.splitlines())):
        read, write = (x.split() for x in rule.split(">"))
        for symbol in read[1:]:
            arcs.setdefault((read[0], symbol), []).append((write[0].replace("*", symbol), 1.0, write[1]))
    return Transducer(tuple(starts), frozenset(ends), arcs)


MARKS = ("", "~", '"', '~"')
BARE = "word target report"
ALL = " ".join(f"{k}{m}" for k in ("insult", "threat") for m in MARKS)
NEGATE = machine("0", "01", f"""
    0 {BARE} insult threat > * 0
    0 contrast > word 0
    0 negation > word 1
    1 {BARE} > * 1
    1 negation > word 1
    1 insult threat > *~ 1
    1 contrast > word 0""")
REPORT = machine("0", "01", """
    0 word target insult threat insult~ threat~ > * 0
    0 report > word 1
    1 word target > * 1
    1 report > word 1
    1 insult threat insult~ threat~ > *" 1""")
ADDRESS = machine("nw", "ns", f"""
    n word {ALL} > * n
    n target > word n
    w word > * w
    w target > word s
    w {ALL} > *@ w
    s word > * s
    s target > word s
    s {ALL} > *@ s""")


def emitters(own: dict[str, float]) -> tuple[Transducer, Transducer]:
    """Insult and threat: each passes the other's symbols on, and its own as events with their weights."""
    insult = {("0", s): [(s, own.get(s, 1.0) if s.startswith("insult") else 1.0, "0")] for s in (*GIVEN, "word", *(f"threat{m}" for m in MARKS))}
    threat = {("0", s): [(s if s in GIVEN else "word", own.get(s, 1.0) if s.startswith("threat") else 1.0, "0")] for s in (*GIVEN, "word", *(f"threat{m}" for m in MARKS))}
    return Transducer(("0",), frozenset("0"), insult), Transducer(("0",), frozenset("0"), threat)


def grammar(weights: dict[str, float] = GIVEN) -> Transducer:
    insult, threat = emitters(weights)
    return NEGATE @ REPORT @ ADDRESS @ insult @ threat


def best_path(m: Transducer, symbols: list[tuple[str, float]]) -> tuple[float, list[tuple[str, float]]]:
    """Weight of the best accepted path over (symbol, word weight) and its events (event, word weight); of ties the first found."""
    at: dict = {s: (0.0, None) for s in m.starts}
    for symbol, x in symbols:
        new: dict = {}
        for state, (total, path) in at.items():
            for event, w, to in m.arcs.get((state, symbol), ()):
                here = total + w * x if event != "word" else total
                if to not in new or here > new[to][0]:
                    new[to] = here, path if event == "word" else (path, (event, x))
        at = new
    total, path = max((v for s, v in at.items() if s in m.ends), key=lambda v: v[0], default=(0.0, None))
    events = []
    while path:
        path, event = path
        events.append(event)
    return total, events[::-1]


def forms(word: str) -> list[str]:
    """The lexicon's forms of a word, most specific first."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def lookup(lexicon: dict[str, float], word: str) -> float:
    return max((lexicon[x] for x in forms(word) if x in lexicon), default=0.0)


def heads_of(lexicon: dict[str, float]) -> set[str]:
    return {x[:3].rstrip("*") for x in lexicon}


def symbols_of(words: list[str], known: dict[str, float]) -> list[tuple[str, float]]:
    """The words' symbols; plain words are left out, since every state stays as it is over them."""
    out = []
    for w in words:
        if w in known:
            out.append(("insult", known[w]))
        elif w in THREAT:
            out.append(("threat", THREAT_WEIGHT))
        elif w in GRAMMAR_WORDS:
            out.append(("negation" if w in NEGATION else "report" if w in REPORTED else "target" if w in TARGET else "contrast", 0.0))
    return out


@dataclass
class Found:
    """What the best paths of a text's clauses emitted."""

    total: float = 0.0
    largest: float = 0.0
    clauses: int = 0
    words: int = 0
    events: Counter = field(default_factory=Counter)

    @property
    def features(self) -> tuple[float, ...]:
        """What was emitted, and how long the text is: chance matches grow with it."""
        return math.log1p(self.total), math.log1p(self.largest), math.log1p(self.clauses), math.log1p(self.words / 100)


def read(text: str | None, lexicon: dict[str, float], heads: set[str], m: Transducer) -> Found:
    """Reads a whole text.  heads: the forms' first letters; clauses without an insult or a threat emit nothing and are skipped."""
    low, out = (text or "").lower(), Found()
    all_words = WORD.findall(low)
    vocab, out.words = set(all_words), len(all_words)
    known = {w: x for w in vocab if w[:3] in heads and (x := lookup(lexicon, w)) > 0}
    marks = known.keys() | vocab & THREAT
    if not marks:
        return out
    for clause in CLAUSE.split(low):
        words = WORD.findall(clause)
        if marks.isdisjoint(words):
            continue
        weight, events = best_path(m, symbols_of(words, known))
        if weight > 0:
            out.total += weight
            out.largest = max(out.largest, weight)
            out.clauses += 1
        out.events.update(e for e, _ in events)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 40) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    reg = np.full(a.shape[1], l2 * 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(reg + 1e-9), a.T @ (p - y) + reg * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def event_weights(pos: Counter, neg: Counter, n_pos: int, n_neg: int) -> dict[str, float]:
    """Of each event its weight: that of its log-odds against a plain insult's, drawn to the given one where it is rare.

    pos and neg count the toxic and other documents that hold the event.
    """

    def odds(e: str) -> float:
        return math.log((pos[e] + 0.5) / (n_pos + 1)) - math.log((neg[e] + 0.5) / (n_neg + 1))

    base = max(odds("insult"), 0.5)
    out = {}
    for e, given in GIVEN.items():
        n = pos[e] + neg[e]
        out[e] = (PRIOR * given + n * min(1.5, max(0.0, odds(e) / base))) / (PRIOR + n) if e != "insult" else given
    return out


def pick_lexicon(counts: pd.DataFrame, n_pos: int, n_neg: int, min_g2: float, min_pos: int) -> dict[str, float]:
    """counts: form, pos, neg.  Weighted forms that mark toxic rows; a stem only if it covers more of them than any longer form."""
    if not len(counts) or not n_pos or not n_neg:
        return {}
    pos, neg = counts["pos"].to_numpy(float), counts["neg"].to_numpy(float)
    rate = n_pos / (n_pos + n_neg)
    tot = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(pos > 0, pos * np.log(pos / (tot * rate)), 0) + np.where(neg > 0, neg * np.log(neg / (tot * (1 - rate))), 0))
    share = (pos + DRAW * rate) / (tot + DRAW)
    w = np.log(share / (1 - share)) - np.log(rate / (1 - rate))
    keep_of = dict(zip(counts["form"].tolist(), ((g2 >= min_g2) & (w >= 1.5) & (pos >= min_pos)).tolist(), strict=True))
    kept = {f: (x, n) for f, x, n in zip(counts["form"].tolist(), w.tolist(), pos.tolist(), strict=True) if keep_of[f]}
    longest: dict[str, float] = {}  # of each stem the most toxic rows that one kept longer form accounts for
    for f, (_, n) in kept.items():
        for stem in forms(f.rstrip("*"))[1:]:
            if stem != f:
                longest[stem] = max(longest.get(stem, 0), n)
    return {f: x for f, (x, n) in kept.items() if n > longest.get(f, 0)}


def fold(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 3


@dataclass
class Model:
    lexicon: dict[str, float]
    events: dict[str, float]
    weights: np.ndarray | None


def train(docs: DataFrame, labels: DataFrame, max_train: int = 30_000, min_g2: float = 12.0, min_pos: int = 3) -> Model:
    """Lexicon, event weights and logistic weights (None without both labels) from labelled rows outside the held-out fold."""
    ids = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)").where(fold("doc_id") != 1)
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("half", (fold("doc_id") == 2).cast("int"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], Counter] = {(h, t): Counter() for h in (0, 1) for t in (0, 1)}
        n: Counter = Counter()
        for b in batches:
            for text, toxic, half in zip(b["text"], b["toxic"], b["half"], strict=True):
                n[half, toxic] += 1
                seen[half, toxic].update({f for w in set(WORD.findall((text or "").lower())) for f in forms(w)})
        for (h, t), c in seen.items():
            yield pd.DataFrame({"form": [*c, ""], "half": h, "toxic": t, "n": [*c.values(), n[h, t]]})

    tot = rows.mapInPandas(count, "form string, half int, toxic int, n long").groupBy("form").agg(*[
        F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"c{h}{t}") for h in (0, 1) for t in (0, 1)])
    # a form below min_pos in all training rows can't be chosen from a part of them
    c = tot.where((F.col("form") == "") | ((F.col("c01") + F.col("c11") >= min_pos) & ((F.col("c01") + F.col("c11")) * 2 > F.col("c00") + F.col("c10")))).toPandas()
    n = c[c["form"] == ""]
    c = c[c["form"] != ""]
    if not len(n):
        return Model({}, dict(GIVEN), None)
    n = {k: int(n[k].iloc[0]) for k in ("c00", "c01", "c10", "c11")}

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        pos, neg = (sum(c[f"c{h}{t}"] for h in halves) for t in (1, 0))
        return pick_lexicon(pd.DataFrame({"form": c["form"], "pos": pos, "neg": neg}), *(sum(n[f"c{h}{t}"] for h in halves) for t in (1, 0)), min_g2, min_pos)

    full, other = lexicon((0, 1)), (lexicon((1,)), lexicon((0,)))  # of each half the lexicon of the other one

    def found(events: dict[str, float]) -> pd.DataFrame:
        m = grammar(events)
        heads = [heads_of(x) for x in other]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [read(t, other[h], heads[h], m) for t, h in zip(b["text"], b["half"], strict=True)]
                yield pd.DataFrame({"y": b["toxic"].astype("int32"), "x": [list(g.features) for g in got], "events": [sorted(g.events) for g in got]})

        return rows.mapInPandas(run, "y int, x array<double>, events array<string>").toPandas()  # at most max_train rows

    x = found(dict(GIVEN))
    if not len(x) or x["y"].nunique() < 2:
        return Model(full, dict(GIVEN), None)
    pos, neg = (Counter(e for z in x["events"][x["y"] == t] for e in z) for t in (1, 0))
    events = event_weights(pos, neg, int((x["y"] == 1).sum()), int((x["y"] == 0).sum()))
    x = np.array(sorted((y, *z) for y, z in found(events)[["y", "x"]].itertuples(index=False)), float)
    w = fit_logistic(x[:, 1:], x[:, 0])
    if w[-1] > 0:  # a long text is no sign of toxicity: few training rows may say so by chance
        w = np.append(fit_logistic(x[:, 1:-1], x[:, 0]), 0.0)
    return Model(full, events, w)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with held_out, score and predicted; other columns pass through (three of those names are replaced)."""
    lexicon, events, weights = model.lexicon, model.events, model.weights
    heads, m = heads_of(lexicon), grammar(events)

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        if weights is None:
            return pd.Series(np.zeros(len(texts)))
        z = np.array([read(t, lexicon, heads, m).features for t in texts]).reshape(len(texts), -1)
        return pd.Series(1 / (1 + np.exp(-np.clip(weights[0] + z @ weights[1:], -30, 30))))

    held = F.coalesce(fold(doc_id) == 1, F.lit(False))
    return docs.withColumns({"held_out": held, "score": udf(F.col(text))}).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op7_toxicity(spark, sf_dir):
    from textloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
