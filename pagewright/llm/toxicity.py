"""Toxicity by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, dropped, rows_of, text_of, written

#: Words of everyday insults, each a voter.
INSULTS = """
    idiot idiots idiotic moron morons moronic stupid dumb imbecile cretin fool loser losers clown clowns scum scumbag
    trash garbage filth vermin pathetic worthless useless disgusting disgrace despicable vile hateful coward pig rat
    liar creep freak jerk bastard ugly
""".split()
#: Patterns beside the words, each a voter.
PATTERNS = {
    "orders away": re.compile(r"\b(?:shut up|get lost|go away|go to hell|drop dead)\b"),
    "addresses with an insult": re.compile(rf"\byou(?:'re| are)?(?: such)?(?: an?)? (?:{'|'.join(INSULTS)})\b"),
    "wishes harm": re.compile(r"\b(?:i hope you|you should) (?:die|suffer|rot)\b"),
    "hates": re.compile(r"\b(?:i|we) (?:hate|despise) (?:you|them|him|her|those)\b"),
}
WORD = re.compile(r"\w+")
#: Rows that fitting looks at, at most: of labelled rows, and of all rows, labelled or not, those with the smallest hashes of their ids.
MOST_FIT = MOST_UNLABELLED = 4000
#: Beginnings of words that may be voters: inflected and compound forms share them.
BEGINNINGS = range(4, 9)
#: A mined voter fires on so many toxic rows at least, and its rows are toxic in such a share.
LEAST_ROWS, LEAST_SHARE = 4, 0.75
#: Mined voters, features of the classifier, and names that one pass counts.
MOST_VOTERS, MOST_FEATURES, MOST_COUNTED = 300, 400, 100_000
#: Of a feature's rows such a share of the posterior is toxic.
FEATURE_SHARE = 0.6
ROUNDS = 15
#: Rows that the accuracy of the labels is believed to stem from before any is seen, and how many of them are right.
SEEN, RIGHT = 20.0, 0.9
#: Words of one text that count for a feature.
TIMES = 3


@dataclass
class Model:
    """Weights of a linear classifier over words and their beginnings, with what the label model found of each voter.

    ``voters``: a voter's rate on toxic rows, on others, and its share of evidence. ``labels``: the rates at which given labels
    are right on toxic rows and on others.
    """

    bias: float = -2.0
    weights: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=dict)
    voters: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    labels: tuple[float, float] = (RIGHT, RIGHT)

    def word(self, word: str) -> tuple[str, ...]:
        """The features of a word that have a weight."""
        return tuple(name for name in names_of(word) if name in self.weights)


class Weighted(dict):
    """Word to its features that have a weight, remembered for some of the words."""

    def __init__(self, model: Model, most: int = 250_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.model.word(word)
        return value


def names_of(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings, which it must go on after."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if k < len(word))]


def features(text: str) -> Counter:
    """In how many different words of a text each feature occurs; patterns count once."""
    low = text.lower()
    found = Counter(name for word in set(WORD.findall(low)) for name in names_of(word))
    found.update(name for name, pattern in PATTERNS.items() if pattern.search(low))
    return found


def strength(count: int) -> int:
    """What a feature counts for in fitting and in scoring: more than TIMES words that have it tell no more."""
    return min(count, TIMES)


def label_model(votes: np.ndarray, labels: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[float, float]]:
    """Posteriors of rows; for each voter its rate on toxic rows, on others, and its share of evidence; the accuracies of labels.

    A two-class generative model fitted by expectation maximization from the posteriors ``start``, over labelled and unlabelled
    rows: a row's label (-1 for none) is the vote of one more voter, whose accuracy on either class is estimated like the
    others' rates. A voter's evidence is divided by one more than the sum of its correlations, given the class, with the
    others; so voters that repeat each other count once. No voter's firing speaks against toxicity.
    """
    n, m = votes.shape
    q = start.astype(float)
    share, told = np.ones(m), labels >= 0
    yes_label, no_label = labels == 1, labels == 0
    for step in range(ROUNDS):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        no = (votes.T @ (1 - q) + 0.05) / (n - q.sum() + 1)
        yes = np.maximum((votes.T @ q + 0.5) / (q.sum() + 1), no)
        hit = (q[yes_label].sum() + RIGHT * SEEN) / (q[told].sum() + SEEN)
        pass_ = ((1 - q[no_label]).sum() + RIGHT * SEEN) / ((1 - q[told]).sum() + SEEN)
        if step in (0, ROUNDS // 2):
            rest = votes - (q[:, None] * yes + (1 - q)[:, None] * no)
            spread = np.sqrt((rest**2).sum(0)) + 1e-9
            related = np.clip((rest.T @ rest) / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(related, 0)
            related[related < 0.3] = 0
            share = 1 / (1 + related.sum(1))
        fires, silent = np.log(yes / no), np.log((1 - yes) / (1 - no))
        logit = math.log(prior / (1 - prior)) + votes @ (share * fires) + (1 - votes) @ (share * silent)
        logit += yes_label * math.log(hit / (1 - pass_)) + no_label * math.log((1 - hit) / pass_)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, np.stack([yes, no, share], axis=1), (float(hit), float(pass_))


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels by Newton steps; features whose weight would fall below 0 leave it, so that nothing clears a text."""
    n, m = x.shape
    active = np.arange(m)
    while True:
        own = np.hstack([x[:, active], np.ones((n, 1))])
        w, penalty = np.zeros(len(active) + 1), np.full(len(active) + 1, ridge)
        w[-1], penalty[-1] = -2.0, 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            hessian = (own * (p * (1 - p) + 1e-6)[:, None]).T @ own + np.diag(penalty)
            step = np.linalg.solve(hessian, own.T @ (q - p) - penalty * w)
            w += step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-4:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(m)
            out[active] = w[:-1]
            return out, float(w[-1])
        active = active[w[:-1] >= 0]


def distinct_voters(fixed: list[str], mined: list[str], rows: list[set[str]]) -> list[str]:
    """``fixed``, then mined voters from those that fire most, without any that fires on nearly the rows of one before it."""
    wanted = set(fixed) | set(mined)
    fires: dict[str, set[int]] = {name: set() for name in wanted}
    for i, row in enumerate(rows):
        for name in row & wanted:
            fires[name].add(i)
    names = list(fixed)
    for name in sorted(set(mined) - set(fixed), key=lambda name: (-len(fires[name]), -len(name), name)):
        own = fires[name]
        if len(names) < len(fixed) + MOST_VOTERS and all(len(own & fires[x]) < 0.9 * len(own | fires[x]) for x in names):
            names.append(name)
    return names


def counted(sample: DataFrame, weights: dict[int, float], names: frozenset[str] | None = None) -> DataFrame:
    """``name, on, of``: the weight of the rows of ``sample`` (``row, text, label``) that hold a feature, and their number.

    Rows without a weight are left out; so are features that ``names`` doesn't hold, if given. Counts leave a task added up.
    """
    schema = pa.schema([("name", pa.string()), ("on", pa.int64()), ("of", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, of = Counter(), Counter()
        for key, text, _ in rows_of(batches):
            if key in weights:
                own = features(text).keys() if names is None else features(text).keys() & names
                of.update(own)
                on.update(dict.fromkeys(own, round(1e6 * weights[key])))
        yield from batches_of(((name, on[name], n) for name, n in of.items()), schema)

    found = sample.select("row", "text", "label").mapInArrow(run, "name string, on long, of long")
    return found.groupBy("name").agg((F.sum("on") / 1e6).alias("on"), F.sum("of").alias("of"))


def telling(sample: DataFrame, weights: dict[int, float], least_share: float, most: int) -> list[str]:
    """Features that are on LEAST_ROWS of weight and have such a share of it, those with the most weight first.

    Rows of at least half a weight come first, so that the rest is only looked at for the features that they hold.
    """
    heavy = {key: weight for key, weight in weights.items() if weight >= 0.5}
    some = counted(sample, heavy).filter(F.col("on") >= 0.9 * LEAST_ROWS).orderBy(F.desc("on"), "name").limit(MOST_COUNTED)
    names = frozenset(r.name for r in some.select("name").toLocalIterator())
    if not names:
        return []
    found = counted(sample, weights, names).filter((F.col("on") >= LEAST_ROWS) & (F.col("on") >= least_share * F.col("of")))
    return [r.name for r in found.orderBy(F.desc("on"), F.desc(F.length("name")), "name").limit(most).select("name").collect()]


def held_by(sample: DataFrame, names: list[str]) -> dict[int, tuple[int, dict[str, int]]]:
    """Row to its label (-1 for none) and how often it has each of the features."""
    wanted = frozenset(names)
    schema = pa.schema([("row", pa.int64()), ("label", pa.int32()), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, text, label in rows_of(batches):
                found = features(text)
                own = sorted(wanted & found.keys())
                yield key, -1 if label is None else label, own, [strength(found[name]) for name in own]

        return batches_of(rows(), schema)

    found = sample.select("row", "text", "label").mapInArrow(run, "row long, label int, names array<string>, counts array<int>").orderBy("row")
    return {r.row: (r.label, dict(zip(r.names, r.counts, strict=True))) for r in found.collect()}


def fit(sample: DataFrame) -> Model:
    """A model of ``row, text, label`` (null: unlabelled), a few thousand rows of which the driver sees votes only, no texts.

    Voters are the fixed words and patterns and what labelled rows tell; the label model weighs them over all rows; features of the
    classifier are what its posteriors tell, over all rows. With fewer than two toxic labels, or no others, the fixed words and
    patterns alone make the model.
    """
    fixed = [word + "$" for word in INSULTS] + list(PATTERNS)
    given = {r.row: r.label for r in sample.filter("label IS NOT NULL").select("row", "label").collect()}
    if sum(given.values()) < 2 or sum(given.values()) == len(given):
        return Model(weights={word + "$": 3.0 for word in INSULTS}, patterns=dict.fromkeys(PATTERNS, 3.0))
    mined = telling(sample, given, LEAST_SHARE, 4 * MOST_VOTERS)
    held = held_by(sample, fixed + mined)
    names = distinct_voters(fixed, mined, [set(own) for label, own in held.values() if label >= 0])
    labels = np.array([label for label, _ in held.values()])
    votes = np.array([[name in own for name in names] for _, own in held.values()], np.float32)
    some = votes[:, : len(fixed)].any(1)
    q, rates, right = label_model(votes, labels, np.where(labels >= 0, np.where(labels == 1, RIGHT, 1 - RIGHT), np.where(some, 0.5, 0.05)))
    told = dict(zip(held, q.round(6).tolist(), strict=True))
    chosen = fixed + [name for name in telling(sample, told, FEATURE_SHARE, MOST_FEATURES) if name not in set(fixed)]
    rows = held_by(sample, chosen).values()
    counts = np.array([[own.get(name, 0) for name in chosen] for _, own in rows], np.float32)
    weights, bias = linear(counts, q)
    found, seen = dict(zip(chosen, weights.tolist(), strict=True)), counts.any(0)
    for name, known in zip(fixed, seen[: len(fixed)].tolist(), strict=True):  # words that the sample doesn't hold keep a prior weight
        if not known:
            found[name] = 1.5
    patterns = {name: found.pop(name) for name in PATTERNS}
    voters = {name: tuple(rate) for name, rate in zip(names, rates.round(6).tolist(), strict=True)}
    return Model(bias, {k: v for k, v in found.items() if v > 1e-3}, patterns, voters, right)


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, unlabelled: int = MOST_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on ``most`` labelled rows and ``unlabelled`` rows of all, none of them held out. Their ids are broadcast.

    Of rows with one id the first text counts, of several labels the largest; labels other than 0 and 1 are none.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(~held_out(F.col("id")) & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = rows.select("id").filter(~held_out(F.col("id"))).distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(unlabelled)
    ids = some.withColumn("label", F.lit(None).cast("int")).unionByName(known).groupBy("id").agg(F.max("label").alias("label"))
    sample = rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = written(sample.select(F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"), "label"), "sample")
    model = fit(sample)
    dropped(sample)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``held_out boolean, score double, predicted int`` to ``docs``; columns of these names are replaced.

    Whole texts are scored; null and empty texts get the score of no evidence. Null and repeated ids stay. An empty table
    gives an empty one. Nothing is shuffled: rows travel through Python with their text and come back with a score.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]

    @F.arrow_udf("double")
    def scored(raw: pa.Array) -> pa.Array:
        return pa.array(scores(model, raw), pa.float64())

    out = docs.select(*columns, scored(F.col(f"`{text_col}`").cast("binary")).alias("score"))
    return out.select(*columns, held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scores(model: Model, raw: pa.Array) -> list[float]:
    """Scores of texts: the weights of the features that they were fitted by, in the order of their names."""
    known = Weighted(model)
    out = []
    for at in range(0, len(raw), 256):
        for value in raw.slice(at, 256).to_pylist():
            low = text_of(value).lower()
            found = Counter(name for word in set(WORD.findall(low)) for name in known[word])
            total = model.bias + sum(model.weights[name] * strength(found[name]) for name in sorted(found))
            total += sum(weight for name, weight in model.patterns.items() if weight and PATTERNS[name].search(low))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
    return out
