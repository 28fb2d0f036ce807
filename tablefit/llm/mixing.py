"""Mixing sources to target weights by soft membership.

DataFrame, SQL and Spark ML functions only.  A classifier fitted on a labelled
table gives each document a posterior over domains.  Document rates r >= 0 (or
a higher floor) are fitted by least squares so that the expected tokens per
domain, sum of r * tokens * posterior, match the targets: projected gradient
from r = 1 (or the floor), scaled by Gram matrices so that scarce domains move
as fast as large ones (see `fit_rates`).  A step moves each rate by the product
of its posterior with one number per domain and keeps it above the floor; the
totals after it are one aggregate.
`copies` turns a rate into a whole number of copies by a hash of the id.

Defined cases: a null or empty text has no token, the classifier's posterior
for no words, and counts nothing.  Labels that are null or not among the
targets are left out; if fewer than two domains are labelled the only one (or
the first target) has posterior 1.  A target whose domain no document may
belong to stays unmet: the fit returns what is unmet, and `mix` warns of it or,
with `strict`, raises.  Rows that repeat an id have one rate each and the same
copies where their texts agree.  An empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.llm.columns import bounded_sample, kept, texts

FEATURES = 1 << 12


def _words(docs: DataFrame) -> DataFrame:
    """Adds words, cut at blanks, and their number as tokens."""
    plain = F.trim(F.translate(F.lower("text"), "\n\t\r\f\x0b", "     "))
    return docs.withColumn("words", F.filter(F.split(plain, " "), lambda w: w != ""))


def _vectors(docs: DataFrame) -> DataFrame:
    hashed = HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES).transform(_words(docs))
    return Normalizer(inputCol="counts", outputCol="features", p=2.0).transform(
        hashed.withColumn("tokens", F.size("words").cast("long"))
    )


def posteriors(
    docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = 4000
) -> DataFrame:
    """(doc_id, tokens, posterior): probabilities in the order of `domains`, all rows of `docs` (doc_id, text).

    `labelled` has (doc_id, domain).  The classifier is fitted on about
    `max_labelled` of its rows, chosen by a hash of the id.
    """
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(
        F.min("domain").alias("domain")
    )
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1
    # bounded by max_labelled
    sample = F.broadcast(bounded_sample(known, F.col("doc_id"), max_labelled, known.count()))
    train = kept(
        _vectors(docs.join(sample.select("doc_id", place.alias("label")), "doc_id")).select("features", "label"),
        "mix-train",
    )
    labels = [r.label for r in train.groupBy("label").agg(F.count("*")).collect()]
    if len(labels) < 2:
        certain = [1.0 if i == (labels[0] if labels else 0) else 0.0 for i in range(len(domains))]
        return _words(docs).select(
            "doc_id", F.size("words").cast("long").alias("tokens"), F.array(*map(F.lit, certain)).alias("posterior")
        )
    model = LogisticRegression(maxIter=25, regParam=1e-4, family="multinomial").fit(train)
    scored = model.transform(_vectors(docs)).select("doc_id", "tokens", vector_to_array("probability").alias("p"))
    # the model knows labels up to the largest one seen
    return scored.select(
        "doc_id", "tokens",
        F.array(*(F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)) for i in range(len(domains)))).alias("posterior"),
    )


#: Gradient steps that are repeated from the last written rates before rates are written anew.
REPLAYED = 32


def _moved(steps: list[list[float]], floor: float) -> Column:
    """The column `rate` after gradient steps: each moves it by posterior . step and keeps it above the floor."""
    if not steps:
        return F.col("rate")
    posterior = F.col("posterior")

    def moved(rate: Column, step: Column) -> Column:
        dot = sum((posterior[i] * step[i] for i in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(float(floor)), rate - dot)

    return F.aggregate(F.array(*(F.array(*map(F.lit, step)) for step in steps)), F.col("rate"), moved)


@dataclass
class Rates:
    """The table with its `rate`, and by how much of all target tokens each unmet target (by place) is off."""

    table: DataFrame
    unmet: dict[int, float]


def fit_rates(
    table: DataFrame, targets: list[float], floor: float = 0.0, iterations: int | None = None, tolerance: float = 1e-4
) -> Rates:
    """Rates that bring the token totals of (tokens, posterior) to `targets`, by projected gradient.

    Least squares weighs the domains' residuals by the inverse of the Gram
    matrix of all rows, and rates by their tokens: a gradient step of 1 then
    always leads down.  Each step is first tried as scaled by the Gram matrix
    of the rates that are free to move, shortened while it leads down too
    little; else it is the plain one.

    Stops when no domain is further from its target than `tolerance` of all
    target tokens, or when a step takes less than a thousandth off the weighted
    squares: then no rates meet the targets, and the totals are about the
    nearest.  `iterations` may bound the steps.
    """
    n, weight, scale = len(targets), F.col("tokens").cast("double"), sum(targets)
    rated = table.withColumn("rate", F.lit(max(1.0, float(floor))))
    if not scale > 0:
        return Rates(rated, {})
    wanted = np.array(targets) / scale
    p = [F.get("posterior", F.lit(i)) for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    steps: list[list[float]] = []

    def rows(taken: list[list[float]]) -> DataFrame:
        return rated.select(weight.alias("w"), "posterior", _moved(taken, floor).alias("rate"))

    def totals(taken: list[list[float]]) -> np.ndarray:
        row = rows(taken).agg(*(F.sum(F.col("w") * F.col("rate") * c) for c in p)).first()
        return np.array([v or 0.0 for v in row]) / scale

    def gram(downward: np.ndarray | None) -> np.ndarray:
        """Of all rows, or of those that the plain step can move."""
        counts = F.lit(1.0)
        if downward is not None:
            along = sum((c * F.lit(float(v)) for c, v in zip(p, downward)), F.lit(0.0))
            counts = F.when((F.col("rate") > floor) | (along < 0), 1.0).otherwise(0.0)
        row = rows(steps).agg(*(F.sum(counts * F.col("w") * p[i] * p[j]) for i, j in pairs)).first()
        out = np.zeros((n, n))
        for (i, j), v in zip(pairs, row):
            out[i, j] = out[j, i] = (v or 0.0) / scale
        return out

    tiny = 1e-9 * np.eye(n)
    every = gram(None)
    metric = np.linalg.inv(every + tiny)
    found, done = totals(steps), 0
    while np.abs(found - wanted).max() >= tolerance and (iterations is None or done < iterations):
        if len(steps) == REPLAYED:
            rated, steps = kept(rated.withColumn("rate", _moved(steps, floor)), "mix-rates"), []
        apart = found - wanted
        plain, height = metric @ apart, apart @ metric @ apart
        scaled, part = np.linalg.solve(gram(plain) + 1e-3 * every + tiny, apart), 1.0
        while part > 0.05:
            step = (part * scaled).tolist()
            reached = totals([*steps, step])
            if (reached - wanted) @ metric @ (reached - wanted) <= (1 - 0.01 * part) * height:
                break
            part /= 2
        else:
            step = plain.tolist()
            reached = totals([*steps, step])
        steps, found, done = [*steps, step], reached, done + 1
        if (found - wanted) @ metric @ (found - wanted) > 0.999 * height:
            break
    unmet = {i: round(float(found[i] - wanted[i]), 6) for i in range(n) if abs(found[i] - wanted[i]) >= tolerance}
    return Rates(rated.withColumn("rate", _moved(steps, floor)), unmet)


def mix(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text",
    domain_col: str = "domain", total_tokens: int | None = None, floor: float = 0.0, max_labelled: int = 4000,
    iterations: int | None = None, strict: bool = False,
) -> DataFrame:
    """One row per document: id, tokens, domain (likeliest), posterior, rate and copies.

    `weights` give each domain's share of `total_tokens`.  By default that total
    is the documents' own; with a floor above 0 it is the least for which no
    domain has to fall below the floor.
    """
    if not weights or min(weights.values()) <= 0 or floor < 0:
        raise ValueError("weights must be positive and the floor not negative")
    domains = sorted(weights)
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    own = texts(docs, id_col, text_col)
    known = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain"))
    table = kept(posteriors(own, known, domains, max_labelled), "posteriors")
    current = table.agg(
        F.sum("tokens").alias("all"),
        *(F.sum(F.col("tokens") * F.get("posterior", F.lit(i))).alias(f"d{i}") for i in range(len(domains))),
    ).first()
    fit = Rates(table.withColumn("rate", F.lit(max(1.0, float(floor)))), {})
    if current["all"]:
        total = total_tokens
        if total is None:
            total = max(floor * current[f"d{i}"] / share[i] for i in range(len(domains))) if floor else current["all"]
        fit = fit_rates(table, (share * total).tolist(), floor, iterations)
        if fit.unmet:
            off = {domains[i]: v for i, v in fit.unmet.items()}
            said = f"targets stay unmet; share of all target tokens too many, by domain: {off}"
            if strict:
                raise ValueError(said)
            warnings.warn(said, stacklevel=2)
    names = F.array(*map(F.lit, domains))
    likeliest = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    return fit.table.select(
        F.col("doc_id").alias(id_col), "tokens", likeliest.alias("domain"), "posterior", "rate",
        (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"),
    )


def resample(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text",
    domain_col: str = "domain", floor: float = 0.0, total_tokens: int | None = None,
) -> DataFrame:
    """The documents, all their columns, each as often as its copies say.

    Rows that repeat an id get the most copies of any of them; rows without an
    id stay as they are.
    """
    mixed = mix(docs.select(id_col, text_col), labelled, weights, id_col, text_col, domain_col, total_tokens, floor)
    copies = mixed.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_mixed_id")).agg(
        F.max("copies").alias("_copies")
    )
    joined = docs.join(copies, F.col(id_col) == F.col("_mixed_id"), "left")
    times = F.array_repeat(F.lit(1), F.coalesce("_copies", F.lit(1)))
    return joined.withColumn("_time", F.explode(times)).select(*docs.columns)
