"""URL filter: path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame and SQL functions only.  The trees learn from labelled URLs; by
default those are the URLs that a rule decides.

Defined cases: a null url or one without `://` has an empty host and path, fits
no rule and is judged by the trees on all-zero lexical counts.  Repeated rows
are judged alike.  Without any labelled URL the `default` verdict holds.  An
empty table gives an empty result.  Other columns of the table are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablefit.llm.columns import bounded_sample, kept

ALLOW, BLOCK = "allow", "block"
SUFFIXES = ("top", "site", "extension", "head")
LEXICAL = (
    "n_chars", "depth", "digit_ratio", "entropy", "n_params", "n_labels",
    "n_hyphens", "longest_part", "has_fragment",
)


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        in_host = (host == self.host) | host.endswith("." + self.host)
        return in_host & path.startswith(self.path)


def with_host_and_path(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path of column url."""
    start = F.locate("://", F.col("url"))
    rest = F.when(start > 0, F.substr(F.col("url"), start + 3)).otherwise("")
    host = F.regexp_extract(F.col("_rest"), "^[^/?#]*", 0)
    after = F.substr(F.col("_rest"), F.length("_host") + 1)
    return (
        urls.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("_host", host)
        .withColumn("path", F.regexp_extract(after, "^[^?#]*", 0))
        .withColumn("host", F.translate("_host", string.ascii_uppercase, string.ascii_lowercase))
        .drop("_rest", "_host")
    )


def matched_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; null where none fits."""
    longest = sorted(rules, key=lambda rule: -len(rule.name))
    fits = [(rule, rule.fits(F.col("host"), F.col("path"))) for rule in longest]
    none = F.lit(None).cast("string")
    return (
        F.coalesce(*(F.when(fit, F.lit(rule.name)) for rule, fit in fits), none),
        F.coalesce(*(F.when(fit, F.lit(rule.verdict)) for rule, fit in fits), none),
    )


def with_lexical_features(urls: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split("path", "/"), lambda part: part != "")
    labels = F.filter(F.split("host", "[.]"), lambda label: label != "")
    size = F.length(url)
    characters = F.split(url, "")
    # -sum p log p over the distinct characters of the url
    entropy = F.aggregate(
        F.array_distinct(characters),
        F.lit(0.0),
        lambda total, c: total - F.when(c == "", 0.0).otherwise(
            ((size - F.length(F.replace(url, c, F.lit("")))) / size)
            * F.log2((size - F.length(F.replace(url, c, F.lit("")))) / size)
        ),
    )
    return urls.select(
        "*",
        size.cast("double").alias("n_chars"),
        F.size(parts).cast("double").alias("depth"),
        F.when(size > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / size)
        .otherwise(0.0).alias("digit_ratio"),
        F.when(size > 0, entropy).otherwise(0.0).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("n_params"),
        F.size(labels).cast("double").alias("n_labels"),
        (size - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("n_hyphens"),
        F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).cast("double").alias("longest_part"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")).alias("top"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("site"),
        F.regexp_extract("path", r"[.]([A-Za-z0-9]{1,8})$", 1).alias("extension"),
        F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("head"),
    )


class UrlFilter:
    """Fitted trees and the suffix statistics that they read."""

    def __init__(self, model: GBTClassificationModel | None, stats: dict[str, DataFrame], prior: float):
        self.model, self.stats, self.prior = model, stats, prior

    @classmethod
    def fit(
        cls, labelled: DataFrame, max_labelled: int = 20_000, smoothing: float = 5.0,
        trees: int = 10, depth: int = 4, seed: int = 42,
    ) -> UrlFilter:
        """Fit on (url, host, path, blocked 0/1).

        Suffix statistics count every labelled row; the trees see a sample of
        about `max_labelled` of them, chosen by a hash of the url.
        """
        rows, blocked = labelled.agg(F.count("*"), F.sum("blocked")).first()
        if not rows:
            return cls(None, {}, 0.0)
        prior = blocked / rows
        features = with_lexical_features(labelled)
        stats = {
            name: kept(
                features.groupBy(name).agg(
                    ((F.sum("blocked") + smoothing * prior) / (F.count("*") + smoothing)).alias(f"{name}_rate"),
                    F.log1p(F.count("*")).alias(f"{name}_seen"),
                ),
                f"url-{name}",
            )
            for name in SUFFIXES
        }
        fitted = cls(None, stats, prior)
        sample = kept(
            fitted._vectors(
                with_lexical_features(bounded_sample(labelled, F.col("url"), max_labelled, rows))
            ).select("features", F.col("blocked").cast("double").alias("label")),
            "url-train",
        )
        if sample.isEmpty():
            return fitted
        fitted.model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(sample)
        return fitted

    def _vectors(self, features: DataFrame) -> DataFrame:
        for name, table in self.stats.items():
            features = features.join(table, name, "left").fillna({f"{name}_rate": self.prior, f"{name}_seen": 0.0})
        inputs = [*LEXICAL, *(f"{name}_{kind}" for name in self.stats for kind in ("rate", "seen"))]
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(features)

    def score(self, urls: DataFrame, default: float = 0.0) -> DataFrame:
        """Adds block_score, the trees' probability of `block`."""
        if self.model is None:
            return urls.withColumn("block_score", F.lit(default))
        columns = urls.columns
        judged = self.model.transform(self._vectors(with_lexical_features(urls)))
        return judged.select(*columns, vector_to_array("probability")[1].alias("block_score"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
    max_labelled: int = 20_000, default: str = ALLOW,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the trees' block_score."""
    name, verdict = matched_rule(rules)
    urls = with_host_and_path(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")))
    urls = urls.withColumns({"rule": name, "rule_verdict": verdict})
    labelled = urls.where(F.col("rule").isNotNull()).withColumn(
        "blocked", (F.col("rule_verdict") == BLOCK).cast("int")
    )
    fitted = UrlFilter.fit(labelled, max_labelled)
    judged = fitted.score(urls, 1.0 if default == BLOCK else 0.0)
    by_trees = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("rule_verdict", by_trees).alias("verdict"), "block_score",
    )
