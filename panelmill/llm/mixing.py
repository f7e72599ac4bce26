"""Mixing sources to target weights: soft domain membership and nonnegative document rates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix, word_codes, written

BITS = 18
#: Domains of the labelled table, and the shares of all tokens that junk and toxic texts shall have; ``goals`` makes them reachable.
DOMAINS = ("clean", "junk", "toxic")
TARGETS = (0.985, 0.015, 0.0)
#: Part of what a domain gets from other domains' documents (their uncertain posteriors) that may stay.
SPILL_LEFT = 0.6
SIGNS = "#*$%&|<>!"
#: Deviations from chance at which a feature counts.
DEVIATION = 8.0


def domain_of(quality: Column, toxic: Column) -> Column:
    """Index of the domain of a labelled row; null where a label is missing."""
    return F.when(toxic == 1, 2).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 0)


def slots(codes: np.ndarray) -> np.ndarray:
    """Hashed features of a text, its distinct words."""
    return np.unique((mix(codes) >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass(frozen=True)
class Classifier:
    """Weights of hashed features by domain, and the logistic layer over their sums that held-out labels fitted."""

    weights: np.ndarray
    layer: np.ndarray

    def inputs(self, text: str | None) -> tuple[np.ndarray, int]:
        """The features' sums by domain, damped, with a text's length and its signs for each word; and the number of words."""
        codes = word_codes(text)
        z = self.weights[:, slots(codes)].sum(axis=1, dtype=np.float64)
        signs = sum(map(text.count, SIGNS)) / len(codes) if len(codes) else 0.0
        return np.concatenate([[1.0], np.sign(z) * np.log1p(np.abs(z)), [math.log1p(len(codes)) / 5, min(1.0, signs)]]), len(codes)

    def posterior(self, text: str | None) -> np.ndarray:
        return self.member(text)[0]

    def member(self, text: str | None) -> tuple[np.ndarray, int]:
        """Posterior of the domains, and the number of words."""
        x, n = self.inputs(text)
        z = self.layer @ x
        p = np.exp(z - z.max())
        return p / p.sum(), n


def logistic(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, steps: int = 500) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps."""
    w = ahead = np.zeros((k, x.shape[1]))
    if not len(x):
        return w
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 + ridge)
    hot = np.eye(k)[y]
    for i in range(steps):
        z = x @ ahead.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * ((p - hot).T @ x + ridge * ahead)
        ahead, w = new + i / (i + 3) * (new - w), new
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Classifier:
    """Naive Bayes over hashed features, counted by Spark over at most ``sample`` labelled rows, those with the smallest hashed ids.

    Features are present or absent. One weighs in a domain the log of the share of documents there that have it, over the share of
    the others; it weighs nothing unless the domain's count lies far from chance, so a long text's many rare words don't drown the few
    that tell. The bound makes the labels small enough to be sent to all executors, so that texts are not shuffled. A fifth of the
    sample is held out of the counts and fits the logistic layer. A labelled row without a text, id or label is left out; an id that is
    labelled twice counts twice. Without any labels the posterior is uniform.
    What comes to the driver is bounded: a count for each slot and domain, and some numbers for each held-out row of the sample.
    """
    k = len(DOMAINS)
    lot = F.xxhash64("doc_id", F.lit(5))
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("doc_id is not null and domain is not null")
    known = known.orderBy(lot, "doc_id", "domain").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "text", "domain", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(5)) == 0).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_in = np.zeros((k, 1 << BITS), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for text, domain in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[domain, slots(word_codes(text))] += 1
                docs_in[domain] += 1
        for d in np.flatnonzero(docs_in):
            at = np.flatnonzero(total[d])
            yield pa.RecordBatch.from_pydict({"domain": np.full(len(at) + 1, d, np.int32), "slot": np.append(at, -1), "n": np.append(total[d][at], docs_in[d])})

    got = rows.where("not held").select("text", "domain").mapInArrow(count, "domain int, slot long, n long").groupBy("domain", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts, per = np.zeros((k, 1 << BITS)), np.zeros(k)
    real = got[got["slot"] >= 0]
    counts[real["domain"], real["slot"]] = real["n"]
    head = got[got["slot"] < 0]
    per[head["domain"]] = head["n"]
    n = max(1.0, per.sum())
    both = counts.sum(axis=0)
    off = (counts - per[:, None] * both / n) / np.sqrt(per[:, None] * (both / n) * (1 - both / n) + 1e-9)
    odds = np.log((counts + 0.5) / (per[:, None] + 1)) - np.log((both - counts + 0.5) / (n - per[:, None] + 1))
    model = Classifier(np.where(np.abs(off) >= DEVIATION, odds, 0).astype(np.float32), np.zeros((k, k + 3)))

    @F.pandas_udf("array<double>")
    def inputs(texts: pd.Series) -> pd.Series:
        return pd.Series([model.inputs(t)[0].tolist() for t in texts])

    held = rows.where("held").select(inputs("text").alias("x"), "domain").toPandas()
    x = np.array(held["x"].tolist()).reshape(len(held), k + 3)
    return Classifier(model.weights, logistic(x, held["domain"].to_numpy(np.int64), k))


def rates_after(history: np.ndarray, p: np.ndarray, step: float, ridge: float) -> np.ndarray:
    """Document rates, their look-ahead and the last step's move after the steps whose residuals are in ``history``; rates start at one."""
    rate = ahead = np.ones(len(p))
    moved, momentum = np.zeros(len(p)), 1.0
    for residual in history:
        new = np.maximum(0.0, ahead - step * (p @ residual + ridge * (ahead - 1)))
        t = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        moved = new - ahead
        ahead, rate, momentum = new + (momentum - 1) / t * (new - rate), new, t
    return rate if not len(history) else np.stack([rate, ahead, moved])


def goals(shares: np.ndarray, spill: np.ndarray) -> np.ndarray:
    """Shares that documents can reach: ``spill`` is what a domain gets from documents that rather belong to another one.

    A target below ``SPILL_LEFT`` of that would take mostly documents of other domains, so it is raised to there, but not above the share
    that the domain has. Clean gets the rest, so it is never asked for less than it has.
    """
    spill = SPILL_LEFT * spill
    toxic = min(shares[2], max(TARGETS[2], spill[2]))
    junk = min(shares[1], max(TARGETS[1], spill[1]))
    return np.array([1 - junk - toxic, junk, toxic])


def fit_rates(members: DataFrame, targets: tuple[float, ...] | None, ridge: float, rounds: int, tolerance: float) -> np.ndarray:
    """Residuals, times c_k, of the steps of an accelerated projected gradient for

        min over r >= 0 of  1/2 sum_k c_k (sum_d w_d r_d p_dk - target_k)^2 + ridge / 2 sum_d w_d (r_d - 1)^2,   w_d = tokens_d / tokens.

    c_k is one over the domain's share sum_d w_d p_dk: then the ridge holds a rare domain back no more than a common one (a target
    is missed by the share times ``ridge`` times a small number, 1 to 3 on the given tables, at any share of the domain).
    In the metric of the weights w the gradient is p_d . (c residual) + ridge (r_d - 1), with a Lipschitz constant of at most 1 + ridge at
    any size (the rows of sum_d w_d p_dj p_dk c_j add up to 1). Steps end when the last one moved the rates by less than
    ``tolerance`` on the average of every domain, so a rare domain counts as much as a common one. Without targets they are the ``goals``.
    A step is one distributed aggregate of three numbers per domain. Documents' rates are functions of the residuals so far, so no
    state of the documents is kept between steps and a lost executor loses nothing.
    """
    k, step = len(DOMAINS if targets is None else targets), 1 / (1 + ridge)
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    if not total:
        return np.zeros((0, k))
    history, shares = np.zeros((0, k)), None
    for _ in range(rounds):
        past = history

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(3 * k)
            for b in batches:
                p = b.column(1).flatten().to_numpy().reshape(-1, k)
                now, n = rates_after(past, p, step, ridge), b.column(0).to_numpy()
                rate, moved = (now[1], abs(now[2])) if len(past) else (now, np.zeros(len(p)))
                others = np.where(np.arange(k) == p.argmax(axis=1)[:, None], 0, p) if len(p) else p
                out += np.concatenate([(n * rate) @ p, (n * moved) @ p, n @ others])
            yield pa.RecordBatch.from_pydict({f"s{i}": [x] for i, x in enumerate(out)})

        # a row for each task, added up on the executors
        s = members.select("n_tokens", "p").mapInArrow(sums, ", ".join(f"s{i} double" for i in range(3 * k))).agg(*[F.sum(f"s{i}") for i in range(3 * k)]).first()
        now = np.array([x or 0.0 for x in s]) / total
        if shares is None:  # rates are one before the first step
            shares = now[:k]
            goal = goals(shares, now[2 * k :]) if targets is None else np.array(targets, float)
            scale = np.divide(1.0, shares, out=np.zeros(k), where=shares > 0)
        done = len(history) and (now[k : 2 * k] <= tolerance * shares).all()
        history = np.vstack([history, scale * (now[:k] - goal)])
        if done:
            break
    return history


def mix_sources(
    docs: DataFrame,
    labels: DataFrame,
    targets: tuple[float, ...] | None = None,
    ridge: float = 0.01,
    rounds: int = 300,
    tolerance: float = 1e-5,
    sample: int = 20_000,
    carry: list[str] | None = None,
) -> DataFrame:
    """Rates at which documents should be taken so that domains reach their target shares of all tokens, by default the ``goals``.

    Returns the columns of ``docs`` (or those in ``carry``, with doc_id) with n_tokens (words between ASCII white space), p_clean, p_junk, p_toxic (the classifier's posterior),
    rate (nonnegative, fitted) and copies, the rate rounded up or down by a hash of the row so that totals are met in expectation.
    A text of any length counts whole. Null or empty texts have no tokens, the prior's posterior and rate zero copies; a null id is rounded like any other value; equal
    rows get equal results; an empty table gives no rows. Columns with the names of the results are replaced.
    """
    model = fit_classifier(docs, labels, sample)
    p, made, lot = free_name(docs, "p", "_made", "_lot")
    k = len(DOMAINS)

    @F.arrow_udf("n_tokens long, p array<double>")
    def member(texts: pa.Array) -> pa.Array:
        rows = [model.member(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([n for _, n in rows], pa.int64()), pa.array([p.tolist() for p, _ in rows], pa.list_(pa.float64()))], ["n_tokens", "p"])

    named = docs.withColumn(made, member(F.col("text")))
    wanted = docs.columns if carry is None else ["doc_id", *(c for c in carry if c != "doc_id")]
    rest = [F.col(f"`{c}`") for c in wanted if c.lower() not in ("n_tokens", "rate", "copies", *(f"p_{d}" for d in DOMAINS))]
    held = written(named.select(*rest, F.col(f"{made}.n_tokens").alias("n_tokens"), F.col(f"{made}.p").alias(p)))
    # the steps read a narrow table in few parts, not one task for each file of texts
    narrow = held.select("n_tokens", F.col(p).alias("p")).where("n_tokens > 0")
    narrow = written(narrow.repartition(max(1, narrow.count() // 500_000)))
    history = fit_rates(narrow, targets, ridge, rounds, tolerance)

    @F.pandas_udf("double")
    def rated(ps: pd.Series) -> pd.Series:
        if not len(ps) or not len(history):
            return pd.Series(np.ones(len(ps)))
        return pd.Series(rates_after(history, np.stack(ps.to_numpy()), 1 / (1 + ridge), ridge)[0])

    out = held.withColumn("rate", F.when(F.col("n_tokens") > 0, rated(F.col(p))).otherwise(0.0))
    out = out.withColumns({f"p_{d}": F.col(p)[i] for i, d in enumerate(DOMAINS[:k])}).drop(p)
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("long")).drop(lot)
