"""Toxicity scores by weak supervision.

1. A bounded sample of rows is drawn, and of its texts the words, the
   beginnings of words and a few patterns are noted.
2. Voters are a general lexicon, patterns, and the words and beginnings that
   the sample's labels single out. Each votes "toxic" or not on every text.
3. A generative label model fits, by expectation maximisation over labelled and
   unlabelled rows, how often each voter fires on toxic and on other texts (its
   accuracies), and how voters correlate given the label: voters form a forest,
   and each one's rates depend on the label and on the voter above it. The labels
   guide these estimates; a row's posterior comes from its votes alone.
4. A linear classifier is trained on the posteriors of all sampled rows, labelled
   ones too, and scores every whole text in one pass without a shuffle.

Only the sample's votes reach the driver; the sample's size is a parameter and
does not depend on the table's. Nothing else is bounded: all features of the
sample can become voters, of any length, and each voter is needed by some
LEAST_TEXTS of the sampled toxic texts, so there are at most
``COVER * size / LEAST_TEXTS`` beside the given ones.

Null and empty texts have no features and get the score of a text without a
sign. A text of any length is read whole, in one task, and leaves only its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banlist.llm import row_marks
from banlist.llm.registry import query, table
from banlist.llm.workers import ship, slices
from banlist.session import write_table

ship(__name__)

# Rows of the sample for each of: toxic, not toxic, without a label.
SAMPLE_ROWS = 4_000
# Voters wanted on each labelled toxic text.
COVER = 3
LEAST_TEXTS = 3
LEAST_Z = 5.0
LEAST_RATIO = 20.0
CORRELATED = 0.2
THRESHOLD = 0.3
RIDGE = 0.05
UNKNOWN_WEIGHT = 0.2

# A general lexicon of insults, and patterns of attacks.
LEXICON = (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown fool jerk "
    "imbecile retard bastard bitch whore slut asshole fuck shit crap damn vermin filth pig ugly"
).split()
PATTERNS = {
    "you_are": r"\byou(?:'re| are)(?: all)?(?: a| an| such a| so)? \w+",
    "shut_up": r"\b(?:shut up|get lost|go away|drop dead|go to hell)\b",
    "hate": r"\b(?:i|we) (?:hate|despise) (?:you|them|these)\b",
    "shouting": r"!{3,}",
}
_WORD = re.compile(r"\w+")
_STARTS = (4, 5, 6)


def features(text: str) -> set[str]:
    """The distinct words of a text, beginnings of longer words (with a dash
    behind), and names of patterns that occur (with a tilde before)."""
    low = text.lower()
    words = set(_WORD.findall(low))
    found = set(words)
    for n in _STARTS:
        found.update(w[:n] + "-" for w in words if len(w) > n)
    found.update("~" + name for name, pattern in PATTERNS.items() if re.search(pattern, low))
    return found


def held_out(key: Column) -> Column:
    """Rows that are never learnt from; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, label, weight, features)`` of at most ``3 * size`` rows, none held out.

    Rows are chosen by a hash of their numbers in the scan. ``weight`` is the
    number of rows a sampled row stands for.
    """
    numbered = row_marks.numbered(docs.select(F.col(key).alias("key")), "row").where(~held_out(F.col("key")))
    by_key = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("key")).agg(
        (F.avg("toxic") >= 0.5).cast("int").alias("label")
    )
    rows = write_table(
        numbered.join(by_key, "key", "left").select("row", F.coalesce("label", F.lit(-1)).alias("label")), "toxic-rows"
    )
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("row")
    parts = [
        rows.where(F.col("label") == label)
        .orderBy(order, "row")
        .limit(size)
        .withColumn("weight", F.lit(n / min(n, size)))
        for label, n in totals.items()
    ]
    if not parts:
        return docs.sparkSession.createDataFrame([], "row long, label int, weight double, features array<string>")
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    chosen = write_table(chosen, "toxic-sample-rows")  # at most three times the sample size
    texts = row_marks.numbered(docs.select(F.col(text).alias("t")), "row").join(F.broadcast(chosen), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = [sorted(features(t or "")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.string()))], ["row", "label", "weight", "features"]
            )

    schema = "row long, label int, weight double, features array<string>"
    noted = texts.select("row", "label", "weight", "t").mapInArrow(run, schema)
    return write_table(noted, "toxic-sample")


def candidates(noted: DataFrame) -> tuple[list[str], np.ndarray]:
    """The lexicon and patterns that occur, and all features that are much more
    frequent in toxic than in other labelled texts of the sample, in order; and
    in how many labelled texts that are not toxic each occurs."""
    n1, n0 = noted.where("label >= 0").agg(F.sum(F.col("label")), F.sum(1 - F.col("label"))).first()
    counts = noted.select("label", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum((F.col("label") == 1).cast("int")).alias("n1"), F.sum((F.col("label") == 0).cast("int")).alias("n0")
    )
    wanted = F.col("f").isin([*LEXICON, *("~" + name for name in PATTERNS)])
    if n1 and n0:
        wanted |= (F.col("n1") >= LEAST_TEXTS) & (_contrast(F.col("n1"), F.col("n0"), n1, n0) >= LEAST_Z)
    found = sorted((r["f"], r["n0"]) for r in counts.where(wanted).collect())
    return [f for f, _ in found], np.array([n for _, n in found], float)


def hits(noted: DataFrame, names: list[str]) -> DataFrame:
    """``(row, label, weight, hits)``: the places in ``names`` of each row's features."""
    place = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[f] for f in own if f in place) for own in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["row", "label", "weight", "hits"]
            )

    slim = noted.select("row", "label", "weight", "features")
    return slim.mapInArrow(run, "row long, label int, weight double, hits array<int>")


def _contrast(n1, n0, all1: int, all0: int):
    """Standard errors between two frequencies, for columns and for arrays."""
    p = (n1 + n0) / (all1 + all0)
    spread = p * (1 - p) * (1 / all1 + 1 / all0) + 1e-12
    return (n1 / all1 - n0 / all0) / spread**0.5


def choose_voters(toxic: list[list[int]], n0: np.ndarray, clean: int, given: np.ndarray) -> np.ndarray:
    """The given candidates, and the others one by one: each time the one that
    best separates the toxic texts that fewer than COVER voters have marked.

    ``toxic`` holds each labelled toxic text's candidates, ``n0`` how many of the
    ``clean`` other labelled texts have a candidate. Words that toxic texts only
    share because they are copies of one text stay out when more general voters
    mark these texts.
    """
    chosen = given.copy()
    if not toxic or not clean:
        return chosen
    rows = np.repeat(np.arange(len(toxic)), [len(own) for own in toxic])
    names = np.array([k for own in toxic for k in own], int)
    marks = np.bincount(rows[chosen[names]], minlength=len(toxic))
    while True:
        n1 = np.bincount(names[marks[rows] < COVER], minlength=len(chosen))
        z = _contrast(n1, n0, len(toxic), clean)
        z[chosen | (n1 < LEAST_TEXTS) | (n1 / len(toxic) < LEAST_RATIO * n0 / clean)] = 0
        best = int(z.argmax()) if len(z) else 0
        if not len(z) or z[best] < LEAST_Z:
            return chosen
        chosen[best] = True
        marks[rows[names == best]] += 1


def correlation_forest(votes: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """For each voter the one it depends on, or -1.

    ``toxic`` and ``clean`` are the rows' weights in each class. Two voters are
    linked if they correlate within a class, and of all forests on such links the
    one with the most mutual information given the class is taken: of all models
    in which a voter depends on at most one other, it fits the votes best.
    """
    m = votes.shape[1]
    information, linked = np.zeros((m, m)), np.zeros((m, m), bool)
    for own in (toxic, clean):
        mass = own.sum() + 1e-9
        both = (votes * own[:, None]).T @ votes / mass
        p = np.diag(both).copy()
        chance = np.outer(p, p)
        linked |= both - chance > CORRELATED * np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-18))
        only = p[:, None] - both
        for joint, alone in (
            (both, chance),
            (only, p[:, None] - chance),
            (only.T, p[None] - chance),
            (1 - p[:, None] - p[None] + both, np.outer(1 - p, 1 - p)),
        ):
            joint = np.maximum(joint, 1e-12)
            information += mass * joint * np.log(joint / np.maximum(alone, 1e-12))
    information[~linked] = 0
    np.fill_diagonal(information, 0)
    above = np.full(m, -1)
    reached, best, via = np.zeros(m, bool), np.zeros(m), np.full(m, -1)
    size = votes.sum(axis=0)
    for _ in range(m):
        # The strongest link out of the trees so far, else the largest voter begins a tree.
        open_ = np.flatnonzero(~reached)
        k = open_[best[open_].argmax()]
        if best[k] > 0:
            above[k] = via[k]
        else:
            k = open_[size[open_].argmax()]
        reached[k] = True
        closer = ~reached & (information[k] > best)
        best[closer], via[closer] = information[k][closer], k
    return above


def vote_posteriors(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of "toxic" for each row of a 0/1 vote matrix, from its votes alone.

    Labels are 0, 1 or -1 (unknown). The model is a class probability and, for
    each voter and class, the probability that it fires when the voter above it
    in `correlation_forest` fires and when that is silent. Known rows enter the
    estimates with their label, unknown ones, from the second round on, with their
    posterior. A voter that does not fire abstains, for texts differ in language
    and subject and most voters concern few of them; that no voter at all fires
    is a sign of its own.
    """
    known = labels >= 0
    any_vote = votes.sum(axis=1)
    none = (any_vote == 0).astype(float)
    q = np.minimum(any_vote / 2, 0.9).astype(float)
    above = np.full(votes.shape[1], -1)
    # Where both labels are known, unknown rows weigh less, and nothing at first.
    guided = 0 < labels[known].sum() < known.sum()
    for step in range(rounds):
        fixed = np.where(known, labels, q)
        own = weights * np.where(known, 1.0, (UNKNOWN_WEIGHT if step else 0.0) if guided else 1.0)
        w1, w0 = own * fixed, own * (1 - fixed)
        # Beta(0.1, 1.9) and Beta(0.05, 9.95) priors: voters fire seldom, on clean texts more seldom.
        fire1 = (w1 @ votes + 0.1) / (w1.sum() + 2.0)
        fire0 = (w0 @ votes + 0.05) / (w0.sum() + 10.0)
        prior = (w1.sum() + 0.5) / (own.sum() + 1.0)
        if step in (0, 3):
            above = correlation_forest(votes, w1, w0)
        leads = above >= 0
        with_lead = votes[:, above] * leads
        logit = np.log(prior / (1 - prior)) + votes @ np.where(leads, 0, np.log(fire1 / fire0))
        for state in (with_lead, leads - with_lead):
            # One row's worth of the voter's own rate as the prior of its rate in this state.
            both = votes * state
            rate1 = (w1 @ both + fire1) / (w1 @ state + 1.0)
            rate0 = (w0 @ both + fire0) / (w0 @ state + 1.0)
            logit += both @ np.log(rate1 / rate0)
        silent1 = (w1 @ none + 1.0) / (w1.sum() + 2.0)
        silent0 = (w0 @ none + 1.0) / (w0.sum() + 2.0)
        logit += none * np.log(silent1 / silent0)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def label_model(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 25) -> np.ndarray:
    """The posterior given the votes and, where there is one, the label."""
    return np.where(labels >= 0, labels, vote_posteriors(votes, labels, weights, rounds))


def fit_linear(votes: np.ndarray, targets: np.ndarray, weights: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the bias is last."""
    x = np.concatenate([votes, np.ones((len(votes), 1))], axis=1)
    weights = weights / weights.mean()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    beta[-1] = -2.0

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weights * (np.logaddexp(0, z) - targets * z)).sum() + (penalty * b * b).sum() / 2)

    current = loss(beta)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (p - targets)) + penalty * beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while size > 1e-4 and loss(beta - size * step) > current:
            size /= 2
        new = loss(beta - size * step)
        if current - new < 1e-9 * abs(current) + 1e-12:
            break
        beta, current = beta - size * step, new
    return beta


def fit(
    docs: DataFrame, labels: DataFrame, size: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text"
) -> tuple[dict[str, float], float]:
    """The classifier's weights by feature, and its bias. Without any labelled
    toxic row only the lexicon and patterns vote; with no rows the bias says "clean"."""
    noted = sample(docs, labels, size, key, text)
    names, n0 = candidates(noted)
    if not names:
        return {}, -5.0
    general = np.array([v in LEXICON or v[0] == "~" for v in names])
    toxic = [r["hits"] for r in hits(noted.where("label = 1"), names).select("hits").collect()]
    chosen = choose_voters(toxic, n0, noted.where("label = 0").count(), general)
    voters = [v for v, c in zip(names, chosen) if c]
    # In order of the rows, so that sums come out the same on every run.
    found = hits(noted, voters).orderBy("row").collect()
    votes = np.zeros((len(found), len(voters)), np.float32)
    for k, row in enumerate(found):
        votes[k, row["hits"]] = 1
    given = np.array([r["label"] for r in found])
    weights = np.array([r["weight"] for r in found])
    beta = fit_linear(votes, vote_posteriors(votes, given, weights), weights)
    return dict(zip(voters, beta[:-1].tolist())), float(beta[-1])


def score(docs: DataFrame, model: tuple[dict[str, float], float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, key, score)`` of every row, numbered as in `row_marks`.

    A null or empty text has the score of a text without any sign. Repeated
    rows are scored alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model
        names = {f for f in weights if f[-1] != "-" and f[0] != "~"}
        starts = {n: {f[:-1] for f in weights if f[-1] == "-" and len(f) == n + 1} for n in _STARTS}
        patterns = [(weights["~" + k], re.compile(p)) for k, p in PATTERNS.items() if "~" + k in weights]
        for batch in slices(batches, "t"):
            logits = []
            for own in batch.column(2).to_pylist():
                low = (own or "").lower()
                words = set(_WORD.findall(low))
                total = bias + sum(weights[w] for w in words & names)
                for n, known in starts.items():
                    if known:
                        total += sum(weights[w + "-"] for w in {w[:n] for w in words if len(w) > n} & known)
                total += sum(w for w, pattern in patterns if pattern.search(low))
                logits.append(total)
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["row", "k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = row_marks.numbered(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "row").select("row", "k", "t")
    return rows.mapInArrow(run, f"row long, k {kind}, score double").withColumnRenamed("k", key)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their columns."""
    scores = score(docs, fit(docs, labels))
    return row_marks.without_rows(docs, scores.where(F.col("score") >= threshold).select("row"))


@query("op4_toxicity_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
