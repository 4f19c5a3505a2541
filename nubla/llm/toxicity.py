"""Toxicity by a weighted finite-state grammar over word classes.

Five small transducers (insult, threat, target, negation, reported speech) read the classes of a text's words and are
composed into one machine. It emits a matched clause for each insult or threat, marked by what surrounds it in its
clause: addressed to a target (which may also follow), negated, or reported. A document's score is a logistic function of
the weighted counts of its matched clauses. An insult that nobody is called is the weakest clause but for negated and
reported ones: the fit keeps targeted clauses above plain ones, and bounds what negated and reported ones weigh, so that
``HARMLESS`` of them, by themselves, leave a text below the threshold.

Learning: the lexicon of stems grows by greedy covering of labelled toxic documents, each stem with the share of a text's
words up to which it is taken for chance; a stem that targets mostly follow ("... you") is a threat, others are insults. The
clause weights are the most probable ones under a normal prior and that order. Both use at most ``PER_LABEL`` documents of
each label outside the held-out fold, and ``MOST_CHARS`` characters of each.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubla.llm.common import by_place, byte_slices, held_out, release, sampled, small, table, within

PER_LABEL, MOST_CHARS = 3000, 24 << 20
THRESHOLD = 0.7
HARMLESS = 10
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
SEED = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumbass bastard arschloch abschaum connard salaud imbécile estúpido cabrón",
    THREAT: "kill murder stab strangle shoot töten umbringen erschießen tuer poignarder matar apuñalar",
    TARGET: "you your yours yourself u he she they him them du dich dein ihr euch tu te toi vous usted vosotros",
    NEGATION: "not never isn't aren't wasn't don't nicht kein keine niemals pas jamais nunca tampoco",
    REPORT: "said says called wrote claimed quoted sagte nannte behauptete dit appelé dijo llamó",
}
TARGETS, CLASSED = frozenset(SEED[TARGET].split()), frozenset(" ".join(SEED.values()).split())
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;\n\"“”«»]")
KINDS = ("plain", "targeted", "negated", "reported")
#: What the fit moves: the base, and for insults and threats the plain weight, what a target adds, and what negation and
#: reported speech take away; the means and deviation of the prior, and the least values.
MEANS = np.array([-3.5, 6.0, 1.0, 1.0, 1.0, 6.0, 1.0, 2.0, 2.0])
DEVIATION = 5.0
LEAST = np.array([-np.inf, 0.5, 0.5, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0])
BY_CHANCE = (0.0, 0.002, 0.004, 0.008, 0.016)  # shares of a text's words
EXTRA_WORDS = 30  # added to a text's length before shares are taken, as one word of a short text proves little


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][class]`` is (next state, mark): the mark is added to the output of a word read in that state."""

    arcs: tuple[tuple[tuple[int, frozenset], ...], ...]

    @staticmethod
    def of(states: int, step) -> Transducer:
        return Transducer(tuple(tuple((lambda to, *m: (to, frozenset(m)))(*step(s, c)) for c in range(8)) for s in range(states)))

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same words and their marks unite; only reachable states stay."""
        order, at = [(0, 0)], {(0, 0): 0}
        rows = []
        for p, q in order:
            row = []
            for c in range(8):
                (a, m), (b, n) = self.arcs[p][c], other.arcs[q][c]
                if (a, b) not in at:
                    at[a, b] = len(order)
                    order.append((a, b))
                row.append((at[a, b], m | n))
            rows.append(tuple(row))
        return Transducer(tuple(rows))


def grammar(scope: int = 3) -> Transducer:
    """Negation reaches ``scope`` words; a target or a reporting verb reaches to the end of its clause."""
    insult = Transducer.of(1, lambda s, c: (0, "insult") if c == INSULT else (0,))
    threat = Transducer.of(1, lambda s, c: (0, "threat") if c == THREAT else (0,))
    target = Transducer.of(2, lambda s, c: (0, "closed") if c == END else (1, "targeted", *["addressed"] * (c == TARGET)) if s or c == TARGET else (0,))
    negation = Transducer.of(scope + 1, lambda s, c: (0,) if c == END else (scope,) if c == NEGATION else (max(s - 1, 0), *["negated"] * (s > 0)))
    report = Transducer.of(3, lambda s, c: (2 * (s == 2), *["reported"] * (s == 2)) if c == END else (0 if s == 2 else 2,) if c == QUOTE else (max(s, 1),) if c == REPORT else (s, *["reported"] * (s > 0)))
    return insult @ threat @ target @ negation @ report


def weights_of(moved: np.ndarray) -> np.ndarray:
    """Weights of the base and the eight clause counts."""
    out = [moved[:1]]
    for plain, target, negated, reported in moved[1:].reshape(2, 4):
        out.append([plain, plain + target, max(0.0, plain - negated), max(0.0, plain - reported)])
    return np.concatenate(out)


@dataclass
class Model:
    """Whole words by class, learned stems (``=word`` for a whole word) as (class, weight, share by chance), and the weights
    of the clause counts."""

    words: dict[str, int]
    stems: dict[str, tuple[int, float, float]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: weights_of(_bounded(MEANS.copy())))

    def reader(self):
        """A function text -> the nine clause counts (the first is 1)."""

        def event(marks: frozenset) -> int:
            if marks & {"insult", "threat"}:
                return int("threat" in marks) * 4 + (3 if "reported" in marks else 2 if "negated" in marks else 1 if "targeted" in marks else 0)
            return 8 if "addressed" in marks else 9 if "closed" in marks else -1

        machine = [[(to, event(m)) for to, m in row] for row in grammar().arcs]
        lengths, stems, words, memo = sorted({len(s) for s in self.stems if s[0] != "="}, reverse=True), self.stems, self.words, {}

        def classify(w: str) -> tuple[int, str]:
            if w in words:
                return words[w], ""
            if len(w) == 1 and not w.isalnum():
                return (QUOTE if w in "\"“”«»" else END), ""
            stem = next((x for x in ("=" + w, *(w[:n] for n in lengths if n <= len(w))) if x in stems), "")
            return (stems[stem][0], stem) if stem else (OTHER, "")

        def read(text: str) -> np.ndarray:
            found = TOKEN.findall(text.lower())
            counts = np.zeros(9)
            if len(memo) > 60_000:
                memo.clear()
            seen = set(found)
            for w in seen:
                if w not in memo:
                    memo[w] = classify(w)
            if any(memo[w][0] in (INSULT, THREAT) for w in seen):
                sure = {"": 1.0}
                for stem, n in Counter(memo[w][1] for w in found).items():
                    if stem:
                        sure[stem] = stems[stem][1] * max(0.0, 1 - stems[stem][2] * (len(found) + EXTRA_WORDS) / n)
                state, waiting = 0, []
                for w in found:
                    kind, stem = memo[w]
                    state, event = machine[state][kind]
                    if event < 0:
                        continue
                    if event < 8:
                        counts[1 + event] += sure[stem]
                        if event in (0, 4):
                            waiting.append((event, sure[stem]))
                    else:
                        for plain, weight in waiting if event == 8 else ():
                            counts[1 + plain] -= weight
                            counts[2 + plain] += weight
                        waiting = []
            out = np.log1p(np.maximum(counts, 0))
            out[0] = 1
            return out

        return read


def _features(word: str) -> list[str]:
    """The stems of a word, and the word; none of those that have a class already."""
    return [] if word in CLASSED else [word[:n] for n in range(3, min(9, len(word) + 1))] + ["=" + word] if len(word) > 2 else []


def learn_stems(toxic: list[str], clean: list[str], known, least: int = 3) -> dict[str, tuple[int, float, float]]:
    """Greedy cover: again and again the stem (or ``=word``), with a share of words above which it counts, that explains most
    toxic texts not explained yet.

    A clean text that it would explain, too, costs four toxic ones, and it must add ``least``. Frequent in toxic texts it
    must be at least three times as much as in clean ones, whatever the share.
    """
    left, others = [t for t in dict.fromkeys(toxic) if not known(t)], dict.fromkeys(clean)
    seen = Counter()
    for text in left:
        seen.update({f for w in set(TOKEN.findall(text.lower())) for f in _features(w)})
    stems = sorted(f for f, n in seen.items() if n >= least)
    number, memo = {f: i for i, f in enumerate(stems)}, {}
    if not stems:
        return {}

    def shares(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, stem, share of the text's words) of all stems in the texts; arrays rather than counters, to spare memory."""
        rows, columns, values = array("i"), array("i"), array("f")
        for i, text in enumerate(texts):
            words, n = Counter(TOKEN.findall(text.lower())), Counter()
            if len(memo) > 100_000:
                memo.clear()
            for w, k in words.items():
                if w not in memo:
                    memo[w] = [number[f] for f in _features(w) if f in number]
                for f in memo[w]:
                    n[f] += k
            total = sum(words.values()) + EXTRA_WORDS
            rows.extend([i] * len(n))
            columns.extend(n)
            values.extend(k / total for k in n.values())
        return np.array(rows), np.array(columns), np.array(values)

    text, feature, share = shares(left)
    _, other, other_share = shares(others)
    against = np.bincount(other, minlength=len(stems))
    fits = np.bincount(feature, minlength=len(stems)) * len(others) >= 3 * against * len(left)
    place = np.cumsum(fits) - 1
    fit = [f for f, ok in zip(stems, fits, strict=True) if ok]
    some = fits[feature]
    text, feature, share = text[some], place[feature[some]], share[some]
    some = fits[other]
    other, other_share = place[other[some]], other_share[some]
    if not fit:
        return {}
    cost = np.array([np.bincount(other[other_share > g], minlength=len(fit)) for g in BY_CHANCE])
    all_texts = np.array([np.bincount(feature[share > g], minlength=len(fit)) for g in BY_CHANCE])
    length = np.array([len(f) if f[0] != "=" else 0 for f in fit])
    open_, found = np.ones(len(left), bool), {}
    while True:
        gain = np.array([np.bincount(feature[(share > g) & open_[text]], minlength=len(fit)) for g in BY_CHANCE]) - 4 * cost
        g, f = np.unravel_index((gain * 100.0 + length).argmax(), gain.shape)
        if gain[g, f] < least or fit[f] in found:
            break
        followed = total = 0
        hit = text[(feature == f) & (share > BY_CHANCE[g])]
        for t in hit:
            words = TOKEN.findall(left[t].lower())
            for w, after in zip(words, [*words[1:], "."], strict=True):
                if (w == fit[f][1:]) if fit[f][0] == "=" else w.startswith(fit[f]):
                    total, followed = total + 1, followed + (after in TARGETS)
        found[fit[f]] = (THREAT if 2 * followed > total else INSULT, float((all_texts[g, f] + 1) / (all_texts[g, f] + cost[g, f] + 1)), BY_CHANCE[g])
        open_[hit] = False
    return found


def _bounded(moved: np.ndarray) -> np.ndarray:
    """``moved`` with enough taken from negated and reported clauses, and no more than the plain clause's weight."""
    most = max(0.0, (np.log(THRESHOLD / (1 - THRESHOLD)) - 0.2 - moved[0]) / np.log1p(HARMLESS))
    for plain in (1, 5):
        moved[plain + 2 : plain + 4] = np.clip(moved[plain + 2 : plain + 4], max(0.0, moved[plain] - most), moved[plain])
    return moved


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most probable weights under the prior and the order of clauses, by coordinate Newton steps."""
    at = np.array([[j == 0 or (k >= 1 and (k - 1) // 4 == (j - 1) // 4 and ((j - 1) % 4 == 0 or j == k)) for k in range(9)] for j in range(9)], float)
    at[[3, 4, 7, 8], [3, 4, 7, 8]] = -1  # what negation and reported speech take away
    at[0] = np.eye(9)[0]
    z, moved = x @ at.T, _bounded(MEANS.copy())
    for _ in range(100):
        for j in range(9):
            p = 1 / (1 + np.exp(-np.clip(z @ moved, -30, 30)))
            slope = z[:, j] @ (y - p) - (moved[j] - MEANS[j]) / DEVIATION**2
            step = slope / ((z[:, j] ** 2) @ (p * (1 - p)) + 1 / DEVIATION**2)
            moved[j] = max(moved[j] + np.clip(step, -1, 1), LEAST[j])
            moved = _bounded(moved)
    return weights_of(moved)


def train(texts: list[str], toxic: list[int]) -> Model:
    model = Model({w: c for c, text in SEED.items() for w in text.split()})
    read = model.reader()
    known = lambda t: read(t)[1:].any()
    model.stems = learn_stems([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y], known)
    read = model.reader()
    model.weights = fit_weights(np.array([read(t) for t in texts]).reshape(-1, 9), np.array(toxic, float))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from a bounded sample of labelled documents outside the held-out fold; without labels the seed grammar stays."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    some = table(sampled(known.filter(~held_out(F.col("doc_id"))), "toxic", "doc_id", per_label, 2 * per_label), "labels")
    got = within(rows.join(small(some), "doc_id"), "toxic", F.xxhash64("doc_id", "text"), F.length("text"), per_label, MOST_CHARS).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    texts, toxic = [r["text"] for r in got], [r["toxic"] for r in got]
    del got
    model = train(texts, toxic)
    del texts
    release()  # the driver's memory, for the stages that follow
    return model


def _scores(model: Model, text: pa.Array) -> np.ndarray:
    """Scores of a string array without nulls."""
    read, out = model.reader(), []
    for a, b in byte_slices(text, 1 << 21):
        out += [float(read(t) @ model.weights) for t in text.slice(a, b - a).to_pylist()]
    return 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have no clause and get the base score. Repeated rows each give a row, a null id keeps its own; a
    very long text is read whole. Other columns are not read. An empty table gives an empty result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            s = _scores(model, pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        release()

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns stay, whatever they are called.

    Rows of a null or empty text stay. Repeated rows are judged alike; an empty table gives an empty result.
    """
    names = docs.columns

    def run(batches):
        for batch in batches:
            s = _scores(model, pc.fill_null(batch.column(names.index("text")), ""))
            yield batch.filter(pa.array(s < THRESHOLD))
        release()

    plain = by_place(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
