"""Toxicity by weak supervision: many voters, a generative model of their labels, a linear classifier on its posteriors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings
from tablelens.llm.sampling import held_out, sample_per_class
from tablelens.llm.shared import written

#: Labelled rows per class that a model is fitted on, at most 1.5 times this.
ROWS_PER_CLASS = 4000
#: Least association (G statistic, about chi square with one degree of freedom) of a word with the labels, and of a
#: beginning that at least so many different words share, which copies of one text can't bring about.
LEAST_G, LEAST_G_HEAD, WORDS_OF_HEAD = 16.0, 10.8, 3
HEADS = (4, 5, 6)
#: General insults; the labelled rows add what the corpus uses besides.
INSULTS = frozenset("clown disgusting dumb filth idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless".split())

_WORD = re.compile(r"[^\W_]+")
_OPENING = re.compile(r"(?:^|[.!?\n])\s*([^\W_]+)")

VOTERS = (
    "general_lexicon", "learned_words", "learned_heads_4", "learned_heads_5", "learned_heads_6", "two_different",
    "repeated", "opens_a_sentence", "shouting", "nothing_found", "nothing_found_nor_shouted",
)
#: The label that a voter stands for; it abstains otherwise.
POLARITY = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0])


def _features(word: str) -> Iterator[str]:
    """A word and its beginnings, marked with their length."""
    yield f"0{word}"
    for n in HEADS:
        if len(word) > n:
            yield f"{n}{word[:n]}"


@dataclass
class Toxicity:
    """``lexicon``: features with their weights in the linear classifier; ``bias``: its constant."""

    lexicon: dict[str, float]
    bias: float = 0.0
    posterior: dict[int, float] = field(default_factory=dict)
    heads: frozenset[str] = field(init=False)

    def __post_init__(self):
        self.heads = frozenset(x[1:][:HEADS[0]] for x in [*self.lexicon, *(f"0{w}" for w in INSULTS)])

    def hits(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The lexicon's features of each word that has any."""
        found = {}
        for w in words:
            if w[:HEADS[0]] in self.heads:
                own = [f for f in _features(w) if f in self.lexicon]
                if own or w in INSULTS:
                    found[w] = own
        return found

    def look(self, text: str) -> tuple[int, set[str]]:
        """The voters' ballot as bits, and the features present."""
        lowered = text.lower()
        words = _WORD.findall(lowered)
        hits = self.hits(set(words))
        found = {f for own in hits.values() for f in own}
        shouting = "!!" in text
        if not hits:
            return (1 << 9) | (1 << 8 if shouting else 1 << 10), found
        kinds = {f[0] for f in found}
        votes = [
            any(w in INSULTS for w in hits), "0" in kinds, "4" in kinds, "5" in kinds, "6" in kinds, len(hits) > 1,
            sum(w in hits for w in words) > len(hits), any(m in hits for m in _OPENING.findall(lowered)), shouting,
        ]
        return sum(1 << i for i, v in enumerate(votes) if v), found

    def score(self, found: set[str]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + sum(self.lexicon[f] for f in found)))))

    def dump(self) -> str:
        return json.dumps([self.lexicon, self.bias])


def _cover(docs: list[tuple[int, set[str]]], features: list[str]) -> list[str]:
    """Lexicon entries by sequential covering: each must explain toxic documents that the stronger ones don't.

    So the rare words of a toxic text that was copied many times don't enter beside the insult in it.
    """
    names = sorted(features, key=lambda f: (-int(f[0]), f), reverse=True)  # of equal ones the first is taken
    at = {f: i for i, f in enumerate(names)}
    return [names[i] for i in _covering([(y, [at[f] for f in found if f in at]) for y, found in docs], names)]


def _covering(docs: Sequence[tuple[int, Sequence[int] | np.ndarray]], names: list[str]) -> list[int]:
    """``_cover`` by number: each document's features are places in ``names``, of which the first wins a tie."""
    label = np.array([y for y, _ in docs], int)
    held = [np.asarray(f, np.int32) for _, f in docs]
    row = np.repeat(np.arange(len(held), dtype=np.int32), np.array([len(f) for f in held], int))
    col = np.concatenate(held) if held else np.zeros(0, np.int32)
    order = np.argsort(col, kind="stable")
    where, ends = row[order], np.concatenate(([0], np.cumsum(np.bincount(col, minlength=len(names)))))
    n1 = np.bincount(col[label[row] == 1], minlength=len(names))
    n0 = np.bincount(col[label[row] == 0], minlength=len(names))
    toxic, clean = int((label == 1).sum()), int((label == 0).sum())
    covered, taken, chosen = np.zeros(len(held), bool), np.zeros(len(names), bool), []
    while not taken.all():
        g = np.where(taken, -1.0, _gs(n1, n0, toxic, clean))
        best = int(g.argmax())
        if g[best] < LEAST_G_HEAD:
            break
        taken[best] = True
        if g[best] < LEAST_G and names[best][0] == "0":
            continue
        chosen.append(best)
        for i in where[ends[best]:ends[best + 1]]:
            if not covered[i] and label[i]:
                covered[i] = True
                n1[held[i]] -= 1
    return chosen


def _gs(n1: np.ndarray, n0: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Signed G statistics of features that n1 of ``toxic`` and n0 of ``clean`` documents hold; 0 where one speaks for clean."""
    n, rate = n1 + n0, toxic / (toxic + clean) if toxic else 0
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(o > 0, o * np.log(o / e), 0.0) for o, e in ((n1, n * rate), (n0, n * (1 - rate)))]
    return np.where(n1 > rate * n, 2 * (parts[0] + parts[1]), 0.0)


class LabelModel:
    """Accuracies and correlations of the voters, from the ballots of all documents.

    Votes are independent given the label between clusters; inside a cluster of correlated voters each
    combination of votes has a probability of its own. Both are found by expectation maximisation, in which the
    documents with a known label keep it.
    """

    #: Correlation given the label from which two voters share a cluster, and most voters of a cluster.
    CORRELATED, LARGEST, ROUNDS = 0.3, 6, 40

    def __init__(self, ballots: np.ndarray, counts: np.ndarray, known: np.ndarray):
        """``counts``: documents per ballot; ``known``: labelled ones among them, columns clean and toxic."""
        votes = (ballots[:, None] >> np.arange(len(VOTERS))) & 1
        self.clusters = [[j] for j in range(len(VOTERS))]
        free = np.maximum(counts - known.sum(1), 0)
        for_toxic = votes @ POLARITY
        for_clean = votes @ (1 - POLARITY)
        p = np.where(for_toxic > for_clean, 0.9, 0.05)
        p, parts = self._em(votes, free, known, p)
        self.clusters = self._correlated(votes, free, known, parts)
        self.p, _ = self._em(votes, free, known, p)

    def _em(self, votes: np.ndarray, free: np.ndarray, known: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors, and the log odds that the prior (column 0) and each cluster contribute."""
        parts = np.zeros((len(votes), 1 + len(self.clusters)))
        for _ in range(self.ROUNDS):
            mass = np.column_stack((free * (1 - p), free * p)) + known
            parts[:, 0] = np.log((mass[:, 1].sum() + 1) / (mass[:, 0].sum() + 1))
            for k, c in enumerate(self.clusters, 1):
                cell = votes[:, c] @ (1 << np.arange(len(c)))
                table = np.column_stack([np.bincount(cell, mass[:, y], 1 << len(c)) for y in (0, 1)]) + 0.5
                table = np.log(table / table.sum(0))
                parts[:, k] = (table[:, 1] - table[:, 0])[cell]
            p = _sigmoid(parts.sum(1))
        return p, parts

    def _correlated(self, votes: np.ndarray, free: np.ndarray, known: np.ndarray, parts: np.ndarray) -> list[list[int]]:
        """Clusters of voters whose votes go together beyond what the label, as told by all other voters, explains."""
        most = np.zeros((len(VOTERS), len(VOTERS)))
        pairs = list(zip(*np.triu_indices(len(VOTERS), 1)))
        for i, j in pairs:
            p = _sigmoid(parts.sum(1) - parts[:, 1 + i] - parts[:, 1 + j])
            for w in (free * (1 - p) + known[:, 0] + 1e-9, free * p + known[:, 1] + 1e-9):
                a, b = (votes[:, x] - np.average(votes[:, x], weights=w) for x in (i, j))
                both = np.average(a * b, weights=w)
                most[i, j] = max(most[i, j], abs(both) / (np.sqrt(np.average(a * a, weights=w) * np.average(b * b, weights=w)) + 1e-6))
        clusters = [{j} for j in range(len(VOTERS))]
        for i, j in sorted(pairs, key=lambda x: -most[x]):
            a, b = (next(c for c in clusters if x in c) for x in (i, j))
            if most[i, j] >= self.CORRELATED and a is not b and len(a) + len(b) <= self.LARGEST:
                clusters.remove(b)
                a |= b
        return [sorted(map(int, c)) for c in clusters]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _linear(docs: list[set[str]], target: np.ndarray, features: list[str], rounds: int = 400) -> tuple[dict[str, float], float]:
    """Logistic regression on soft labels over all rows; weights shrink a little towards zero."""
    index = {f: i for i, f in enumerate(features)}
    row = np.concatenate([np.full(len(d), i) for i, d in enumerate(docs)]).astype(int) if docs else np.zeros(0, int)
    col = np.array([index[f] for d in docs for f in d], int)
    w, b, ridge = np.zeros(len(features)), 0.0, 0.02
    for _ in range(rounds):  # Newton steps along each weight, damped because documents hold several features
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(docs)), -30, 30)))
        error, bend = p - target, p * (1 - p)
        w = w - 0.3 * (np.bincount(col, error[row], len(features)) + ridge * w) / (np.bincount(col, bend[row], len(features)) + ridge)
        b = b - 0.3 * error.sum() / (bend.sum() + ridge)
    return dict(zip(features, w.tolist())), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Toxicity:
    """Learns from at most 1.5 * ``per_class`` labelled texts of each class, and the ballots of all documents.

    Only the label ``toxic`` of rows that are not held out is read; rows without label or document take no part.
    Equal texts are one row of the sample, so that copies of a text count once; of several labels of a doc_id or
    of a text the most frequent is taken, in a tie 0. Without any labelled row the general lexicon alone votes.
    """
    rows = labels.select("doc_id", "toxic").where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    most = (2 * F.sum("toxic") > F.count("*")).cast("int").alias("toxic")
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    texts = written(
        docs.select("doc_id", text_hash).join(rows.groupBy("doc_id").agg(most), "doc_id")
        .groupBy("text_hash").agg(most, F.min("doc_id").alias("doc_id")),
        "toxicity-texts",
    )
    chosen = sample_per_class(texts, "toxic", F.col("text_hash"), per_class).select("doc_id", "text_hash", "toxic")
    chosen = written(chosen, "toxicity-rows")  # bounded by the sample's size, so it may be broadcast
    sample = written(
        docs.select("doc_id", "text", text_hash).join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["text_hash"]),
        "toxicity-sample",
    ).select("doc_id", "text_hash", "toxic", "text")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [{f: w for w in sorted(set(_WORD.findall(t.lower()))) for f in _features(w)} for t in strings(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(list, found), pa.list_(pa.string())),
                                              pa.array([list(x.values()) for x in found], pa.list_(pa.string()))],
                                             ["toxic", "text_hash", "features", "words"])

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counts = sample.select("toxic", "text_hash", "text").mapInArrow(
        spell, "toxic int, text_hash bigint, features array<string>, words array<string>"
    ).select(
        "toxic", "text_hash", F.inline(F.arrays_zip(F.col("features").alias("f"), F.col("words").alias("w")))
    ).groupBy("f").agg(
        F.sum("toxic").alias("n1"), F.count("*").alias("n"), F.count_distinct("w").alias("words"),
        *[F.bit_xor(F.xxhash64("text_hash", F.lit(i))).alias(f"texts{i}") for i in (1, 2)],
    ).where("n1 >= 3")
    n, n1, rate = F.col("n"), F.col("n1"), toxic / max(1, toxic + clean)
    n0 = n - n1
    g = 2 * (n1 * F.log(n1 / (n * rate)) + F.when(n0 > 0, n0 * F.log(n0 / (n * (1 - rate)))).otherwise(0)) if 0 < rate < 1 else F.lit(0.0)
    strong = counts.where(n1 > rate * n).withColumn("g", g).where(
        (F.col("g") >= LEAST_G) | (F.col("g") >= LEAST_G_HEAD) & (F.col("words") >= WORDS_OF_HEAD)
    )
    names = _distinguishable(strong)
    lexicon = [names[i] for i in _covering(_held(sample, names), names)]
    model = Toxicity({f: 0.0 for f in [*lexicon, *(f"0{w}" for w in sorted(INSULTS) if f"0{w}" not in lexicon)]})
    ballots = {r["ballot"]: r["count"] for r in _looked_at(docs, model).groupBy("ballot").count().collect()}  # 2 ** voters rows at most
    sampled = [(r["toxic"], r["ballot"], set(r["features"])) for r in _looked_at(sample, model).select("toxic", "ballot", "features").collect()]
    codes = np.array(sorted({*ballots, *(b for _, b, _ in sampled)}), np.int64)
    at = {int(c): i for i, c in enumerate(codes)}
    votes = np.zeros((len(codes), 2))
    for y, b, _ in sampled:
        votes[at[b], y] += 1
    if not len(codes):
        return model
    labelled = LabelModel(codes, np.array([ballots.get(int(c), 0) for c in codes], float), votes)
    target = np.array([labelled.p[at[b]] for _, b, _ in sampled])
    if not sampled:  # nothing to train on: the general lexicon with equal weights
        return Toxicity({f: 4.0 for f in model.lexicon}, -3.0)
    weights, bias = _linear([f for _, _, f in sampled], target, list(model.lexicon))
    return Toxicity(weights, bias, {int(c): float(p) for c, p in zip(codes, labelled.p)})


def _distinguishable(strong: DataFrame) -> list[str]:
    """The features, without those that covering can't come to, in the order in which it prefers equal ones.

    Of the features in exactly the same texts (``texts1``, ``texts2``: hashes of the set) covering looks at one word
    and one beginning, the first in that order: whichever it takes, no other is left a text to explain. The words
    that ride along in slightly changed copies of a text are one feature that way, however many they are.
    """
    kind = F.substring("f", 1, 1)
    first = strong.groupBy("texts1", "texts2", (kind == "0").alias("word")).agg(F.max(F.struct((-kind.cast("int")).alias("k"), "f"))["f"].alias("f"))
    return sorted(first.select("f").toArrow().column(0).to_pylist(), key=lambda f: (-int(f[0]), f), reverse=True)


def _held(sample: DataFrame, names: list[str]) -> list[tuple[int, np.ndarray]]:
    """The label of each text of the sample, and the places in ``names`` of its features."""
    data = sample.sparkSession.sparkContext.broadcast(Toxicity({f: 0.0 for f in names}).dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tox = _model(data.value)
        at = {f: i for i, f in enumerate(tox.lexicon)}
        for b in pieces(batches):
            found = [sorted({at[f] for own in tox.hits(set(_WORD.findall(t.lower()))).values() for f in own}) for t in strings(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "features"])

    rows = sample.select("toxic", "text").mapInArrow(run, "toxic int, features array<int>").toArrow()  # numbers, not names: a few bytes each
    return [(y, f.values.to_numpy(zero_copy_only=False)) for y, f in zip(rows.column(0).to_pylist(), rows.column(1))]


@lru_cache(maxsize=2)
def _model(data: str) -> Toxicity:
    return Toxicity(*json.loads(data))


def _looked_at(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The columns of ``docs`` but text, with ballot, features and score."""
    data = docs.sparkSession.sparkContext.broadcast(model.dump())
    others = [f for f in docs.schema.fields if f.name in ("doc_id", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tox = _model(data.value)
        for b in pieces(batches):
            seen = [tox.look(t) for t in strings(b)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([s[0] for s in seen], pa.int32()), pa.array([sorted(s[1]) for s in seen], pa.list_(pa.string())),
                 pa.array([tox.score(s[1]) for s in seen], pa.float64())],
                [*(f.name for f in others), "ballot", "features", "score"],
            )

    schema = T.StructType([*others, T.StructField("ballot", T.IntegerType()),
                           T.StructField("features", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])
    return docs.select(*[f.name for f in others], "text").mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, ballot, features, score) for every row of ``docs``, repeated rows too; one scan.

    A null or empty text has no features and gets the score of the classifier's constant.
    """
    return _looked_at(docs.select("doc_id", "text"), model)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_toxicity(docs, fit_toxicity(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
