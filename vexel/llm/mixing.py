"""Mixing sources to target weights by soft membership; native DataFrame operations only.

A table of labelled documents trains a classifier (Bernoulli naive Bayes over the words and punctuation runs that tell
its domains apart best), which gives every document a posterior over the domains. Rates, one for each document and never
negative, are then fitted by projected gradient least squares, so that the expected token totals of the domains,
sum(rate * tokens * posterior), match the targets.

The gradient of that fit in a document's rate is its posterior times the domains' residuals, so all steps together move a
rate along its posterior only. Steps are therefore added up over the domains, and a document's rate is the projection of
what they leave of 1: max(0, 1 - sum(step * posterior)), or as near to that as `most` lets it. A round is one
aggregation over a narrow table; to the driver come vectors and matrices as wide as the number of domains. A round's
step is scaled by the Gram matrix of the documents that can move, and shortened until the fit's objective falls.
PULL, the weight of rates staying near 1, decides between fits that are as good, and is small enough not to show in them.

The classifier is fitted on a bounded sample (SAMPLE labelled rows); totals, steps and rates cover all documents.

Defined results: null text counts as empty; null doc_ids are weighted like others and teach nothing; labels with nulls, or
for documents that aren't there, teach nothing; without any usable label all posteriors are equal; an empty table gives
an empty result; rows that repeat are weighted each; other columns are ignored, or kept by mix(); texts are taken apart
one row at a time, so a very long one takes about ten times its size in the memory of one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_or_empty

#: Domains, as conditions on the labelled table, and the weight of each in the mix.
DOMAINS = {"clean": "toxic = 0 AND quality = 1", "low": "toxic = 0 AND quality = 0", "toxic": "toxic = 1"}
WEIGHTS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}
#: Labelled rows that train the classifier (about, at most), words it uses, least documents that hold such a word.
SAMPLE, FEATURES, SUPPORT = 20_000, 256, 5
#: Rounds at most, the gradient (in shares of all tokens) at which they end, and the weight of rates staying near 1.
ROUNDS, CLOSE, PULL = 60, 1e-10, 1e-9


def tokens(text: Column) -> Column:
    """Words and runs of punctuation, lower-cased."""
    return F.split(F.regexp_replace(F.lower(text), r"([^\p{L}\p{N}\s]+)", " $1 "), r"\s+")


def _adder(adds: Column):
    return lambda total, word: total + F.element_at(adds, word)


class DomainClassifier:
    """Bernoulli naive Bayes: for each domain a base score, and for each word what its presence adds."""

    def __init__(self, names: list[str], words: list[str], base: np.ndarray, present: np.ndarray):
        self.names, self.words, self.base, self.present = names, words, base, present

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, domains: dict[str, str] = DOMAINS, sample: int = SAMPLE) -> DomainClassifier:
        names = list(domains)
        which = F.coalesce(*[F.when(F.expr(c), F.lit(n)) for n, c in domains.items()])
        named = labels.select(F.col("doc_id").cast("long").alias("labelled"), which.alias("domain")).where("labelled IS NOT NULL AND domain IS NOT NULL")
        share = sample / max(1, named.count())
        named = named.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, share)))
        text = text_or_empty(docs)
        # at most `sample` pairs of numbers, and as much again by chance, are broadcast
        known = docs.select(F.col("doc_id").cast("long").alias("labelled"), text.alias("text")).join(F.broadcast(named), "labelled")
        known = known.select("domain", F.array_distinct(tokens(F.col("text"))).alias("tokens"))
        counts = known.groupBy("domain").agg(F.count("*").alias("n")).collect()
        total = np.array([next((r["n"] for r in counts if r["domain"] == n), 0) for n in names], float)
        if not total.sum():
            return cls(names, [], np.zeros(len(names)), np.zeros((0, len(names))))
        sums = [F.sum(F.when(F.col("domain") == n, 1).otherwise(0)).alias(f"n{i}") for i, n in enumerate(names)]
        held = known.select("domain", F.explode("tokens").alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= SUPPORT)
        scores, all_docs = [], total.sum()
        for i, mine in enumerate(total.tolist()):
            if 0 < mine < all_docs and i != total.argmax():  # words that mark a domain other than the largest
                p, rest = F.col("n") / F.lit(all_docs), all_docs - mine
                spread = F.sqrt(p * (1 - p) * F.lit(1 / mine + 1 / rest) + F.lit(1e-12))
                scores.append((F.col(f"n{i}") / F.lit(mine) - (F.col("n") - F.col(f"n{i}")) / F.lit(rest)) / spread)
        best = held.withColumn("z", F.greatest(*scores, F.lit(0.0), F.lit(0.0))).where("z > 4").orderBy(F.desc("z"), "word").limit(FEATURES).collect()
        held_by = np.array([[r[f"n{i}"] for i in range(len(names))] for r in best], float).reshape(len(best), len(names))
        rate = (held_by + 0.5) / (total + 1)
        base = np.log((total + 0.5) / (total.sum() + 1)) + np.log1p(-rate).sum(0)
        return cls(names, [r["word"] for r in best], base, np.log(rate) - np.log1p(-rate))

    def posteriors(self, text: Column, df: DataFrame) -> DataFrame:
        """df with a column p_<domain> for each domain; they add up to 1."""
        cols = df.columns
        words = F.array(*[F.lit(w) for w in self.words]).cast("array<string>")
        df = df.withColumn("_has", F.array_intersect(tokens(text), words))
        for i, _ in enumerate(self.names):
            score = F.lit(float(self.base[i]))
            if self.words:
                adds = F.create_map(*[F.lit(x) for w, a in zip(self.words, self.present[:, i].tolist()) for x in (w, a)])
                score = F.aggregate("_has", score, _adder(adds))
            df = df.withColumn(f"_s{i}", score)
        most = F.greatest(*[F.col(f"_s{i}") for i in range(len(self.names))], F.lit(float("-inf")))
        df = df.select(*cols, *[F.exp(F.col(f"_s{i}") - most).alias(f"_e{i}") for i in range(len(self.names))])
        return df.select(*cols, *[(F.col(f"_e{i}") / sum(F.col(f"_e{j}") for j in range(len(self.names)))).alias(f"p_{n}") for i, n in enumerate(self.names)])


def _moved(steps: list[float], names: list[str]) -> Column:
    """What all steps together take off a document's rate."""
    return sum((F.col(f"p_{n}") * F.lit(float(a)) for n, a in zip(names, steps)), F.lit(0.0))


def rate_of(steps: list[float], names: list[str], most: float | None = None) -> Column:
    """A document's rate: what the steps along its posterior leave of 1, projected on what a rate may be."""
    rate = F.greatest(F.lit(0.0), 1.0 - _moved(steps, names))
    return rate if most is None else F.least(F.lit(float(most)), rate)


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float], budget: float = 1.0, pull: float = PULL, most: float | None = None, rounds: int = ROUNDS) -> list[float]:
    """The sum of the steps for each domain, from members (n_tokens, p_<domain>...).

    Targets are in proportion to the weights. The first domain's, or if its weight is 0 that of all together, is `budget`
    times the tokens it has.
    """
    k = len(names)
    t, p = F.col("n_tokens"), [F.col(f"p_{n}") for n in names]

    def totals(steps: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """All tokens; as shares of them the domains' tokens, the rates' cost, and the Gram matrix of what can move."""
        moved, rate = _moved(steps, names), rate_of(steps, names, most)
        free = (moved < 1.0) if most is None else (moved < 1.0) & (moved >= 1.0 - most)
        cost = t * (0.5 * (rate - 1.0) * (rate - 1.0) + moved * rate)
        sums = [F.sum(t), *[F.sum(t * rate * x) for x in p], F.sum(cost), *[F.sum(F.when(free, t * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(i, k)]]
        row = [float(x or 0) for x in members.agg(*[s.alias(f"c{n}") for n, s in enumerate(sums)]).first()]
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = row[k + 2 :]
        size = row[0] or 1.0
        return row[0], np.array(row[1 : k + 1]) / size, row[k + 1] / size, (gram + np.triu(gram, 1).T) / size

    steps = np.zeros(k)
    tokens_in, have, cost, gram = totals(steps)
    if not tokens_in:
        return steps.tolist()
    share = np.array([weights[n] for n in names], float)
    target = budget * (have[0] * share / share[0] if share[0] and have[0] else share / share.sum())

    def worth(steps: np.ndarray, cost: float) -> float:
        return float(steps @ target - cost + pull / 2 * steps @ steps)

    for _ in range(rounds):
        slope = target - have + pull * steps
        if np.linalg.norm(slope) < CLOSE:
            break
        way = -np.linalg.solve(gram + pull * np.eye(k), slope)
        length = 1.0
        while length > 1e-6:
            trial = steps + length * way
            _, *there = totals(trial)
            if worth(trial, there[1]) <= worth(steps, cost) + 1e-4 * length * float(slope @ way):
                break
            length /= 4
        else:
            break
        steps, (have, cost, gram) = trial, there
    return [float(f"{a:.15g}") for a in steps]


def _n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def rates(spark: SparkSession, docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, domains: dict[str, str] = DOMAINS, budget: float = 1.0, pull: float = PULL, most: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens (words), p_<domain> for each domain, rate, expected_tokens."""
    model = DomainClassifier.fit(docs, labels, domains)
    text = text_or_empty(docs)
    narrow = model.posteriors(F.col("_text"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), _n_tokens(text).alias("n_tokens"), text.alias("_text"))).drop("_text")
    members = staged(spark, narrow, "members")
    steps = fit_rates(members, model.names, weights, budget, pull, most)
    return members.withColumn("rate", rate_of(steps, model.names, most)).withColumn("expected_tokens", F.col("rate") * F.col("n_tokens"))


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, weights: dict[str, float] = WEIGHTS, domains: dict[str, str] = DOMAINS, budget: float = 1.0, pull: float = PULL, most: float | None = None, number: str | None = None) -> DataFrame:
    """The rows of docs, all columns, each as often as its rate says: floor(rate + u) times, with u from a hash of doc_id
    and text, uniform in [0, 1). labelled_docs: where labelled texts are, if not in docs. With most=1 no row is repeated;
    number names a column that tells the copies of a row apart, from 0."""
    model = DomainClassifier.fit(labelled_docs if labelled_docs is not None else docs, labels, domains)
    text, cols = text_or_empty(docs), docs.columns
    u = F.pmod(F.xxhash64(docs["doc_id"], text), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = docs.select(F.struct(*[docs[c] for c in cols]).alias("doc"), text.alias("_text"), u.alias("u"))
    scored = staged(spark, model.posteriors(F.col("_text"), whole.withColumn("n_tokens", _n_tokens(F.col("_text")))).drop("_text"), "scored")
    steps = fit_rates(scored, model.names, weights, budget, pull, most)
    often = scored.select("doc", F.floor(rate_of(steps, model.names, most) + F.col("u")).cast("int").alias("often")).where("often > 0")
    copies = often.select("doc", F.explode(F.sequence(F.lit(0), F.col("often") - 1)).alias("copy"))
    return copies.select("doc.*", *([F.col("copy").alias(number)] if number else []))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
