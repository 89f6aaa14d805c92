"""Operator 5: URL filter by gradient-boosted trees on lexical features, and by rules.

Rules come first: a rule names a host, which stands for its subdomains too, and the beginning of a path;
the longest rule that fits decides. Other URLs are judged by gradient-boosted trees, trained from
labelled URLs on length, depth, digit ratio, entropy, counts of parameters and of other marks, and on
how often the labelled URLs with the same host suffix, domain, first folder and file extension are
blocked (smoothed towards the mean; what was never seen has the mean).

Everything runs as DataFrame expressions; the trees are Spark ML's. Training takes at most about
``TRAINING_ROWS`` labelled rows, picked by a hash of the URL; the statistics are of those rows, so they
are small enough to broadcast. If the labels are all one verdict, that is the verdict of every other
URL; without labels it is ``allow``.

A null URL, and one without ``://``, has an empty host and path, fits no rule and goes to the model.
Long URLs are read whole. Repeated rows and null ids are judged like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.common import packed, stored, unpacked

TRAINING_ROWS = 20_000
SMOOTHING = 20.0
TREES, DEPTH, SEED = 20, 4, 11
NUMBERS = ("length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "secure")
NAMES = ("suffix", "domain", "folder", "extension")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    place = F.locate("://", url)
    return F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of text and verdict; null if none does."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the last that fits is taken
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        one = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, one).otherwise(found)
    return found


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the struct ``_url``: host, path, the numbers and the names that statistics are kept for."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("_parts.host"), F.col("_parts.path")
    chars = F.split(url, "")
    marks = F.filter(chars, lambda c: c != "")
    share = lambda c: F.size(F.filter(F.col("_marks"), lambda x: x == c)) / F.size("_marks")
    entropy = F.aggregate(F.array_distinct("_marks"), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    numbers = {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, r"[^.]+"),
        "depth": count(path, r"/[^/]+"),
        "digit_ratio": count(url, r"\d") / F.greatest(F.length(url), F.lit(1)),
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "parameters": count(F.regexp_extract(url, r"\?([^#]*)", 1), r"[^&]+"),
        "hyphens": count(url, "-"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": url.startswith("https:").cast("double"),
    }
    names = {
        "suffix": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "folder": F.regexp_extract(path, r"^/([^/]*)/", 1),
        "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1),
    }
    return (
        urls.withColumn("_parts", F.struct(host_of(url).alias("host"), path_of(url).alias("path")))
        .withColumn("_marks", marks)
        .withColumn("_url", F.struct("_parts.host", "_parts.path", *(c.alias(n) for n, c in (numbers | names).items())))
        .drop("_parts", "_marks")
    )


@dataclass
class UrlModel:
    """Trees over the features; ``constant`` is the block probability where there are no trees."""

    constant: float
    trees: GBTClassificationModel | None = None
    statistics: dict[str, DataFrame] = field(default_factory=dict)

    def probability(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``_url``) and ``_block``, the probability that the URL is to be blocked."""
        if self.trees is None:
            return rows.withColumn("_block", F.lit(self.constant))
        scored = self.trees.transform(assembled(rows, self.statistics, self.constant))
        return scored.withColumn("_block", vector_to_array("_probability")[1]).drop(
            "_features", "_raw", "_probability", "_prediction"
        )


def assembled(rows: DataFrame, statistics: dict[str, DataFrame], mean: float) -> DataFrame:
    for name, rates in statistics.items():
        rows = rows.join(F.broadcast(rates), F.col(f"_url.{name}") == F.col(f"_{name}"), "left").drop(f"_{name}")
    rates = {f"_rate_{n}": F.coalesce(F.col(f"_rate_{n}"), F.lit(mean)) for n in statistics}
    numbers = {f"_number_{n}": F.col(f"_url.{n}") for n in NUMBERS}
    rows = rows.withColumns(rates | numbers)
    inputs = [*numbers, *rates]
    return VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep").transform(rows).drop(*inputs)


def train(labelled: DataFrame, training_rows: int = TRAINING_ROWS) -> UrlModel:
    """A model from ``labelled`` (url, block: 1 or 0)."""
    labelled = labelled.where("url is not null and block is not null").select("url", F.col("block").cast("double"))
    total = labelled.count()
    if not total:
        return UrlModel(0.0)
    parts = 1 << 20
    share = min(parts, -(-parts * training_rows // total))
    sample = labelled.where(F.pmod(F.xxhash64("url"), F.lit(parts)) < share).limit(2 * training_rows)
    sample = stored(with_features(sample), "url-sample")
    mean, kinds = sample.agg(F.avg("block"), F.count_distinct("block")).first()
    if kinds is None or kinds < 2:
        return UrlModel(mean or 0.0)
    statistics = {}
    for name in NAMES:
        rate = (F.sum("block") + SMOOTHING * mean) / (F.count("*") + SMOOTHING)
        statistics[name] = stored(
            sample.groupBy(F.col(f"_url.{name}").alias(f"_{name}")).agg(rate.alias(f"_rate_{name}")), "url-rates"
        )
    learner = GBTClassifier(
        labelCol="block",
        featuresCol="_features",
        predictionCol="_prediction",
        maxIter=TREES,
        maxDepth=DEPTH,
        seed=SEED,
    ).setRawPredictionCol("_raw").setProbabilityCol("_probability")
    trees = learner.fit(assembled(sample, statistics, mean).select("_features", "block"))
    return UrlModel(mean, trees, statistics)


def judge(urls: DataFrame, rules: Sequence[Rule], model: UrlModel) -> DataFrame:
    """``urls`` (url) with host, path, rule, verdict and block_probability."""
    rows = model.probability(with_features(packed(urls, "url")))
    rule = fitting_rule(rules, F.col("_url.host"), F.col("_url.path"))
    learned = F.when(F.col("_block") > 0.5, "block").otherwise("allow")
    added = {
        "host": F.col("_url.host"),
        "path": F.col("_url.path"),
        "rule": F.col("_rule.text"),
        "verdict": F.coalesce(F.col("_rule.verdict"), learned),
        "block_probability": F.col("_block"),
    }
    return unpacked(rows.withColumn("_rule", rule), urls.columns, added)


def labelled_by(rules: Sequence[Rule], urls: DataFrame) -> DataFrame:
    """The URLs that a rule fits, with the rule's verdict as their label."""
    rule = fitting_rule(rules, host_of(F.col("url")), path_of(F.col("url")))
    return urls.select("url", (rule["verdict"] == "block").cast("int").alias("block")).where("block is not null")
