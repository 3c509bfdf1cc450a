"""Mixing sources to target weights, with soft membership.

A classifier learnt from a labelled table gives each document posteriors over domains. Then
nonnegative document rates are fitted by least squares, so that the expected tokens of each domain
(rate x tokens x posterior, summed) match the targets. The fit is a projected gradient on the
rates themselves: from 1, each step moves every rate against its gradient and projects it onto
the nonnegative; the step's length is spectral (Barzilai and Borwein), with the safe length
where that doesn't come nearer.

Only DataFrame functions are used. A document's posteriors are an expression of its own row, and
so is its rate: the gradient of a rate is its row's posteriors times the gaps of the domains, so
the steps so far, one vector of the domains each, say all rates. Nothing is shuffled but sums.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass
class Domains:
    """Naive Bayes over hashed words: the log prior and, for each bucket, the log rate of each domain."""

    names: list[str]
    prior: list[float]
    rates: list[list[float]]

    @property
    def buckets(self) -> int:
        return len(self.rates[0])


def words_of(text: Column) -> Column:
    """The words between white space; null has none."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.split(bare, r"\s+")).otherwise(F.array().cast("array<string>"))


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.hash(word), F.lit(buckets))


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = 4000, buckets: int = 2048) -> Domains:
    """Learn from the ``max_rows`` labelled ids with the smallest hash; their whole texts count.

    Rows with a null id or another domain than ``names`` are left out; an id labelled more than
    once counts with its smallest label. Without any the posteriors are uniform.
    """
    own = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isin(names)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(domain_col).alias("_domain"))
    sample = F.broadcast(own.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))  # max_rows rows of an id and a name
    words = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(sample, "_id").select("_domain", F.explode(words_of(F.col("_text"))).alias("_word"))
    counts = np.ones((len(names), buckets))
    for row in words.groupBy("_domain", bucket_of(F.col("_word"), buckets).alias("_bucket")).count().collect():  # domains x buckets rows at most
        counts[names.index(row[0]), row[1]] += row[2]
    total = counts.sum(axis=1)
    return Domains(names, np.log(total / total.sum()).tolist(), np.log(counts / total[:, None]).tolist())


def _sum_at(places: Column, values: list[float]) -> Column:
    table = F.lit(values)
    return F.aggregate(places, F.lit(0.0), lambda acc, k: acc + F.element_at(table, k))


def with_membership(docs: DataFrame, model: Domains, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``p_<domain>``; columns of these names are replaced.

    The log likelihoods are divided by the square root of the number of words: words repeat each
    other's evidence, and mixed texts keep a mixed membership. Without words the prior is left.
    """
    new = "_member"
    while new in docs.columns:
        new += "_"
    # a projection of its own, as several expressions read the places
    out = docs.withColumn(new, F.transform(words_of(F.col(text_col).cast("string")), lambda w: bucket_of(w, model.buckets) + 1))
    rates = np.array(model.rates)
    sums = [_sum_at(F.col(new), r) for r in (rates[:-1] - rates[-1]).tolist()] + [F.lit(0.0)]  # only differences matter
    out = out.withColumn(new, F.struct(F.size(new).cast("long").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)]))
    scale = F.sqrt(F.greatest(F.col(f"{new}.n"), F.lit(1)).cast("double"))
    logs = [F.col(f"{new}.s{k}") / scale + F.lit(p) for k, p in enumerate(model.prior)]
    out = out.withColumn(new, F.struct(F.col(f"{new}.n").alias("n"), F.greatest(*logs, F.lit(-1e300)).alias("top"), *[x.alias(f"s{k}") for k, x in enumerate(logs)]))
    share = [F.exp(F.col(f"{new}.s{k}") - F.col(f"{new}.top")) for k in range(len(logs))]
    return out.withColumns({"n_tokens": F.col(f"{new}.n"), **{f"p_{d}": x / sum(share, F.lit(0.0)) for d, x in zip(model.names, share)}}).drop(new)


def rate_of(model: Domains, steps: list[list[float]]) -> Column:
    """The rate of a row with posteriors: from 1 by each step, projected onto the nonnegative each time.

    The steps are one literal that the row folds, so the plan is as small for sixty as for two:
    nested expressions fill the driver's heap with plans, and their code outgrows the compiler.
    """
    if not steps:
        return F.lit(1.0)
    table = F.lit([[float(x) for x in step] for step in steps])
    shares = [F.col(f"`p_{d}`") for d in model.names]
    return F.aggregate(table, F.lit(1.0), lambda rate, step: F.greatest(F.lit(0.0), rate - sum((p * F.get(step, k) for k, p in enumerate(shares)), F.lit(0.0))))


def fit_rates(members: DataFrame, model: Domains, targets: dict[str, float], budget: float | None = None, tolerance: float = 1e-7, most: int = 60) -> list[list[float]]:
    """The steps whose rates bring the expected tokens of the domains nearest to the targets.

    Least squares of (expected tokens - targets), in shares of all tokens, by projected gradient
    on the rates, in the metric that weighs each document by its tokens. ``targets``: weights,
    which are scaled to sum to 1; ``budget``: their tokens together, all tokens of the table if
    None. Where there are no tokens the rates stay 1. It ends when the gap or the move of the
    rates by a step of length 1 falls below ``tolerance``; where ``most`` steps don't reach that,
    a warning says how large they are.
    """
    names, k = model.names, len(model.names)
    weight = np.array([max(0.0, float(targets.get(d, 0.0))) for d in names])
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    if not total or not weight.sum():
        return []
    want = weight / weight.sum() * (budget or total) / total
    share = F.col("n_tokens") / F.lit(float(total))
    p = [F.col(f"`p_{d}`") for d in names]

    def at(steps: list[list[float]], *more: Column) -> list[float]:
        """The expected tokens at these rates, and the move of the last step."""
        rated = members.withColumns({"_rate": rate_of(model, steps), "_before": rate_of(model, steps[:-1])})  # worked out once a row, for all sums
        rate, move = F.col("_rate"), F.col("_rate") - F.col("_before")
        row = rated.agg(*[F.sum(share * rate * x) for x in p], F.sum(share * move * move), *more).first()
        return [float(x) for x in row]

    first = at([], *[F.sum(share * p[i] * p[j]) for i in range(k) for j in range(k)])
    safe = 1.0 / max(np.linalg.eigvalsh(np.array(first[k + 1 :]).reshape(k, k)).max(), 1e-12)  # for a convex quadratic it never overshoots
    steps: list[list[float]] = []
    gap = np.array(first[:k]) - want
    length, move = safe, math.inf
    while len(steps) < most and np.abs(gap).max() >= tolerance and move >= tolerance:
        for size in (length, safe):
            step = [float(f"{x:.12g}") for x in size * gap]
            found = at([*steps, step])
            next_gap = np.array(found[:k]) - want
            if size == safe or np.linalg.norm(next_gap) < np.linalg.norm(gap):
                break
        steps.append(step)
        change = float(((next_gap - gap) ** 2).sum())
        move = math.sqrt(found[k]) / size
        length = min(max(found[k] / change, safe), 1e3 * safe) if change > 0 else safe
        gap = next_gap
    left = float(np.abs(gap).max())
    if left >= tolerance and move >= tolerance:
        warnings.warn(f"mixing: the fit of the rates ended with a gap of {left:.3g}, and a move of {move:.3g} (tolerance {tolerance:.3g})", RuntimeWarning, stacklevel=2)
    return steps


def soft_mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None, keep_columns: bool = False, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """``doc_id, n_tokens, p_<domain>.., rate`` for each row, or all columns of ``docs`` and these.

    ``labelled``: ids and domains of some documents. ``targets``: the weight of each domain.
    ``rate`` is how often a document is to be taken, on average: 0 leaves it out, 2.5 takes it
    two or three times. Null and blank texts have no tokens and the prior as posteriors. Repeated
    rows count and stay repeated; an empty table gives an empty result. Columns of ``docs`` named
    like one of the new ones are replaced. A target that no mixture of these documents can reach
    is met as closely as nonnegative rates can.
    """
    model = fit_domains(docs, labelled, sorted(targets), id_col, text_col, domain_col)
    own = docs if keep_columns else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = with_membership(own, model, text_col if keep_columns else "text").drop("rate")
    members = written(members if keep_columns else members.drop("text"), "mixing")
    return members.withColumn("rate", rate_of(model, fit_rates(members, model, targets, budget)))
