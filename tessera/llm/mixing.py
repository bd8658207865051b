"""Mixing to target weights with soft membership.

A classifier learnt from a labelled table gives each document, labelled or not, a posterior over domains: words (in buckets by a hash)
that labelled rows of a domain have significantly more often are evidence for it; a text's evidence is the length of the vector of
its words' weights, and their mean; and a logistic calibration on rows kept back turns it into probabilities. Document i with n_i tokens and posterior p_i brings
n_i p_i tokens to the domains, times its rate; rates are nonnegative, and their expected domain totals match the targets in least squares.

Projected gradient finds them, beginning with rates of 1. In the token-weighted metric a step moves a document's rate by its posterior
times a vector as long as the list of domains, so the driver only keeps these vectors: each pass replays the steps for every document,
sums the totals by partition, and needs no state from the pass before. A step is the gradient in the metric of the masses of the rows
whose rate is above its least, damped more where a step did not lead nearer.

Edge cases: null and empty texts have no token, the prior as posterior and a rate as others; repeated rows each count; unlabelled rows
only get posteriors; a domain without a labelled row has no member, and its target cannot be met; with no label at all every rate is 1;
an empty table gives no rows; further columns are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tessera.llm.common import bounded_batches, flat, labelled_sample, materialize, unused, word_hashes

#: A word is evidence for a domain if its rows prefer the domain by more standard deviations (root of a likelihood-ratio test) than
#: the root of this multiple of the logarithm of all rows: more rows have more words that stand out by chance.
SIGNIFICANCE = 1.0
#: Words are told apart by so many buckets (a power of 2), which bounds the model whatever the vocabulary.
BUCKETS = 1 << 20
#: What the mean weight of a text's words counts in, beside the length of their vector: so many words.
TYPICAL = 20
#: Labelled rows that the classifier learns from, at most: a sample by a hash of the id. One in five sets the calibration.
LABELLED = 50_000


@dataclass(frozen=True)
class DomainModel:
    """domains: names. words: buckets, sorted. weights: a row a bucket, a column a domain. calibration: of evidence (the first row: of 1)."""

    domains: list[str]
    words: np.ndarray
    weights: np.ndarray
    calibration: np.ndarray

    def evidence(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each row and domain the length of the vector of its words' weights, each word once, then for each domain their mean."""
        k, rows = len(self.domains), len(bounds) - 1
        out = np.zeros((rows, 2 * k))
        if not len(self.words) or not len(words):
            return out
        row, word = np.divmod(np.unique(np.repeat(np.arange(rows), np.diff(bounds)) * BUCKETS + (words & (BUCKETS - 1))), BUCKETS)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        weights = self.weights[at[hit]]
        np.add.at(out[:, :k], row[hit], weights**2)
        np.add.at(out[:, k:], row[hit], weights)
        return np.hstack([np.sqrt(out[:, :k]), out[:, k:] * (TYPICAL / np.maximum(np.bincount(row, minlength=rows), 1))[:, None]])

    def posteriors(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _softmax(self.evidence(words, bounds), self.calibration)


def _softmax(evidence: np.ndarray, calibration: np.ndarray) -> np.ndarray:
    z = calibration[0] + evidence @ calibration[1:]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrate(evidence: np.ndarray, domain: np.ndarray, start: np.ndarray, rounds: int = 1000, ridge: float = 1.0) -> np.ndarray:
    """Multinomial logistic regression of the domain on the evidence by accelerated gradient, drawn towards the start where rows are few."""
    x = np.hstack([np.ones((len(evidence), 1)), evidence])
    wanted = np.eye(start.shape[1])[domain]
    rate = 1 / (0.5 * np.linalg.eigvalsh(x.T @ x).max() + ridge) if len(x) else 1 / ridge
    now = last = start
    for k in range(rounds):
        ahead = now + k / (k + 3) * (now - last)
        step = x.T @ (_softmax(evidence, ahead) - wanted) + ridge * (ahead - start)
        last, now = now, ahead - rate * step
    return now


def _word_weights(rows: DataFrame, names: list[str], n: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that are evidence, and their weights: log ratios of the shares of rows with a word of it, one standard error nearer to 0."""
    total = sum(n)
    each = rows.select("domain", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(names)), F.count("*").alias("all"))
    share = lambda c, m: (c + 0.5) / (m + 1)
    weights = []
    for k in range(len(names)):
        own, rest, m = F.col(f"c{k}"), F.col("all") - F.col(f"c{k}"), max(1, total - n[k])
        part = lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
        test = 2 * (part(own, F.col("all") * (n[k] / total)) + part(rest, F.col("all") * (m / total)))
        ratio = F.log(share(own, n[k]) / share(rest, m)) - F.sqrt(1 / (own + 0.5) + 1 / (rest + 0.5))
        weights.append(F.when((test > SIGNIFICANCE * np.log(total + 1)) & (ratio > 0), ratio).otherwise(0.0).alias(f"w{k}"))
    of = counts.select("word", *weights).withColumn("most", F.greatest(*(f"w{k}" for k in range(len(names))), F.lit(0.0))).where("most > 0")
    top = of.drop("most").toPandas().sort_values("word")  # BUCKETS rows at most
    return top["word"].to_numpy(dtype=np.int64), top.drop(columns="word").to_numpy(dtype=np.float64).reshape(-1, len(names))


def fit_domains(labelled: DataFrame) -> DomainModel | None:
    """labelled: words (hashes), domain, and later (true for rows of the calibration). Only evidence and counts by domain reach the driver."""
    bucket = F.transform("words", lambda w: w.bitwiseAND(F.lit(BUCKETS - 1).cast("long")))
    rows = materialize(labelled.select("domain", "later", F.array_distinct(bucket).alias("words")), "labelled-words")
    found = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(~F.col("later")).alias("now")).collect()  # a row a domain
    if not found:
        return None
    names = sorted(r.domain for r in found)
    n, now = ([dict((r.domain, r[c]) for r in found)[d] for d in names] for c in ("n", "now"))
    words, weights = _word_weights(rows.where("NOT later"), names, now) if sum(now) else (np.zeros(0, np.int64), np.zeros((0, len(names))))
    start = np.vstack([np.log(np.array(n, float) / sum(n)), np.eye(len(names)), np.zeros((len(names), len(names)))])
    model = DomainModel(names, words, weights, start)
    index = {d: k for k, d in enumerate(names)}

    def weighed(batches):
        for b in batches:
            out = model.evidence(*flat(b.column("words")))
            yield pa.RecordBatch.from_arrays([pa.array([index[d] for d in b.column("domain").to_pylist()], pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], ["k", "evidence"])

    # At most one in five of LABELLED rows, of as many numbers as there are domains.
    kept = rows.where("later").select("domain", "words").mapInArrow(weighed, "k int, evidence array<double>").collect()
    evidence = np.array([r.evidence for r in kept], float).reshape(-1, 2 * len(names))
    return DomainModel(names, words, weights, calibrate(evidence, np.array([r.k for r in kept], int), start))


def memberships(docs: DataFrame, model: DomainModel, words: str = "words", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens and posterior (an array in the order of the model's domains) of each row."""
    types = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x domains numbers at most

    def posterior(batches):
        for b in batches:
            hashes, bounds = flat(b.column(words))
            p = sent.value.posteriors(hashes, bounds)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(bounds), pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], [*keep, "n_tokens", "posterior"])

    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "n_tokens long, posterior array<double>"
    return docs.select(*keep, words).mapInArrow(posterior, schema)


def settled(members: DataFrame, domains: list[str], known: Column) -> DataFrame:
    """members with the posterior certain where the domain is known."""
    certain = F.array(*((known == d).cast("double") for d in domains))
    return members.withColumn("posterior", F.when(known.isin(domains), certain).otherwise(F.col("posterior")))


@dataclass(frozen=True)
class Plan:
    """steps: what each round took off a rate, to be multiplied by the posterior. totals: expected tokens now, targets: wanted. anchor:
    rows that are likeliest of this domain keep a rate of 1 or more."""

    steps: tuple[np.ndarray, ...]
    totals: np.ndarray
    targets: np.ndarray
    anchor: int | None = None

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replay(p, self.steps, self.anchor)


def least_rates(p: np.ndarray, anchor: int | None) -> np.ndarray:
    return np.zeros(len(p)) if anchor is None or not len(p) else (p.argmax(axis=1) == anchor).astype(float)


def replay(p: np.ndarray, steps, anchor: int | None = None) -> np.ndarray:
    """Rates after these steps of projected gradient, from 1."""
    r, least = np.ones(len(p)), least_rates(p, anchor)
    for step in steps:
        r = np.maximum(least, r - p @ step)
    return r


def _totals(members: DataFrame, steps, k: int, anchor: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain after these steps, and the k x k masses of the rows whose rate is above its least."""

    def summed(batches):
        total, mass = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                p = b.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n, rate = b.column("n_tokens").to_numpy(), replay(p, steps, anchor)
                total += (rate * n) @ p
                mass += (p * (n * (rate > least_rates(p, anchor)))[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total), pa.array(list(mass), pa.list_(pa.float64()))], ["k", "t", "m"])

    sums = [F.sum(F.col("m")[j]) for j in range(k)]
    rows = members.select("n_tokens", "posterior").mapInArrow(summed, "k int, t double, m array<double>").groupBy("k").agg(F.sum("t"), *sums).collect()
    total, mass = np.zeros(k), np.zeros((k, k))
    for r in rows:
        total[r[0]], mass[r[0]] = r[1], r[2:]
    return total, mass


def solve(members: DataFrame, weights: np.ndarray, anchor: int | None = None, tolerance: float = 1e-4, rounds: int = 60) -> Plan:
    """Rates for members (n_tokens, posterior). weights: shares of the domains. The total is that of now, or such that the anchor's target is its total of now.

    With an anchor the other domains are only thinned: what a few rows of one lack to its target is not made up by repeating them. And
    rows that are likeliest of the anchor are not thinned: what they bring to other domains by their posteriors may then exceed targets.
    """
    k = len(weights)
    p, n = F.col("posterior"), F.col("n_tokens")
    # The totals and the matrix of masses, k x (k + 1) numbers.
    row = members.agg(*(F.sum(n * p[i]) for i in range(k)), *(F.sum(n * p[i] * p[j]) for i in range(k) for j in range(k))).head()
    at = np.array([x or 0.0 for x in row], float)
    totals, gram = at[:k], at[k:].reshape(k, k)
    weights = weights / weights.sum()
    whole = totals.sum() if anchor is None or not weights[anchor] else totals[anchor] / weights[anchor]
    targets = weights * whole
    if anchor is not None:
        targets = np.minimum(targets, totals)
    steps: list[np.ndarray] = []
    # Plain least squares: where not all targets can be met, large domains, and the anchor, do not pay for small ones.
    distance = lambda x: float(np.sqrt(((x - targets) ** 2).sum()))
    mass, damping, off, stalled = gram, 1e-2, distance(totals), 0
    some = np.diag(gram) > 0
    for _ in range(rounds):
        if np.abs(totals - targets).max() <= tolerance * whole or stalled == 8 or not some.any():
            break
        step = np.zeros(k)
        step[some] = np.linalg.solve((mass + damping * np.diag(np.diag(gram)))[np.ix_(some, some)], (totals - targets)[some])
        now, own = _totals(members, [*steps, step], k, anchor)
        if (left := distance(now)) < off * (1 - 1e-3):
            steps, totals, mass, off, stalled, damping = [*steps, step], now, own, left, 0, max(damping / 4, 1e-6)
        else:
            stalled, damping = stalled + 1, damping * 8
    return Plan(tuple(steps), totals, targets, anchor)


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domain that a row of labels names; null where a label is missing."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "junk").when((F.col(quality) == 1) & (F.col(toxic) == 0), "clean")


#: Shares of tokens that the registered query mixes to.
TARGETS = {"clean": 0.95, "junk": 0.04, "toxic": 0.01}


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], anchor: str | None, words: Column, keep: tuple[str, ...], trust_labels: bool):
    bounded_batches(docs.sparkSession)
    known = labels.select("doc_id", domain_of().alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    known = materialize(known.groupBy("doc_id").agg(F.min("domain").alias("domain")), "known")  # of labels that differ, the first by name
    own = labelled_sample(known, LABELLED)
    later = F.pmod(F.xxhash64("doc_id", F.lit("later")), F.lit(5)) == 0
    labelled = docs.select("doc_id", "text").join(own, "doc_id").select(words.alias("words"), "domain", later.alias("later"))
    model = fit_domains(labelled)
    if model is None:
        return None, None, None
    members = memberships(docs.select(*keep, words.alias("words")), model, keep=keep)
    if trust_labels:  # all labels meet their rows, which are small here, for texts do not move
        members = materialize(members.join(known, "doc_id", "left"), "posteriors")
        rare = sorted({r.domain for r in members.select("domain").distinct().collect() if r.domain is not None} - {*model.domains})  # a row a domain
        if rare:  # domains that the sample has no row of: only their labelled rows belong to them
            model = replace(model, domains=[*model.domains, *rare])
            members = members.withColumn("posterior", F.concat("posterior", F.array_repeat(F.lit(0.0), len(rare))))
        members = settled(members, model.domains, F.col("domain")).select(*keep, "n_tokens", "posterior")
    else:
        members = materialize(members, "posteriors")
    wanted = np.array([targets.get(d, 0.0) for d in model.domains])
    if not wanted.sum():
        raise ValueError(f"no target for any of {model.domains}")
    plan = solve(members, wanted, model.domains.index(anchor) if anchor in model.domains else None)
    return model, members, plan


def _rate_column(plan: Plan, k: int) -> Column:
    rate = pandas_udf(lambda p: pd.Series(plan.rates(np.stack(p).reshape(-1, k))) if len(p) else pd.Series(dtype=float), "double")
    return rate(F.col("posterior"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str | None = None, keep: tuple[str, ...] = ("doc_id",), trust_labels: bool = False) -> DataFrame:
    """The kept columns, n_tokens, posterior, domain (the likeliest), rate and n_copies: the rate rounded up or down by a hash of the id, so that totals hold in expectation.

    trust_labels: a labelled row belongs to its own domain for certain; else it is predicted like any other.
    """
    model, members, plan = _fitted(docs, labels, targets or TARGETS, anchor, word_hashes(F.col("text")), keep, trust_labels)
    if model is None:
        rows = docs.select(*keep, F.size(word_hashes(F.col("text"))).cast("long").alias("n_tokens"))
        return rows.withColumns({"posterior": F.array().cast("array<double>"), "domain": F.lit(None).cast("string"), "rate": F.lit(1.0), "n_copies": F.lit(1)})
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / (1 << 20)
    names = F.array(*(F.lit(d) for d in model.domains))
    best = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    rated = members.withColumn("domain", best).withColumn("rate", _rate_column(plan, len(model.domains)))
    return rated.withColumn("n_copies", F.floor(F.col("rate") + chance).cast("int"))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, anchor: str | None = None, trust_labels: bool = False) -> DataFrame:
    """docs with each row n_copies times, which may be never; the columns stay. Rows of one id and text have the same rate and copies."""
    mixed = mix(docs.select("doc_id", "text", F.xxhash64("text").alias("text_")), labels, targets, anchor, ("doc_id", "text_"), trust_labels)
    copies = mixed.groupBy(F.col("doc_id").alias("id_"), F.col("text_").alias("of_")).agg(F.max("n_copies").alias("copies_")).where("copies_ > 0")
    key, all_columns, each = unused([*docs.columns, *copies.columns], "key", "all", "copy")
    own = docs.select(F.col("doc_id").alias(key), F.xxhash64("text").alias(f"{key}_text"), F.struct(*docs.columns).alias(all_columns))
    joined = own.join(copies, own[key].eqNullSafe(copies["id_"]) & (own[f"{key}_text"] == copies["of_"]))
    return joined.select(F.explode(F.array_repeat(F.lit(True), F.col("copies_"))).alias(each), all_columns).select(f"{all_columns}.*")
