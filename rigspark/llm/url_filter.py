"""URL filter: host and path rules, and gradient-boosted trees on lexical features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigspark.llm.common import fresh_prefix, written
from rigspark.scratch import small

#: The rules of the registered query, longest match wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest ends up outermost
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical_features(url: Column) -> dict[str, Column]:
    """Features of the url's text alone; null counts as an empty url."""
    url = F.coalesce(url, F.lit(""))
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    length = F.length(url).cast("double")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "depth": count(path, "/[^/]"),
        "digits": count(url, "[0-9]") / F.greatest(length, F.lit(1.0)),
        "host_digits": count(host, "[0-9]"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": count(query, "[^&=]+=?[^&]*"),
        "labels": count(host, "[.]"),
        "hyphens": count(host, "-"),
        "secure": url.startswith("https").cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }


def _suffixes(host: Column) -> dict[str, Column]:
    """The last label, the last two, and the whole host."""
    return {"s1": F.substring_index(host, ".", -1), "s2": F.substring_index(host, ".", -2), "s3": host}


#: Parts of the labelled urls: for suffix statistics, for the trees, and to set the threshold.
PARTS = 3


class UrlFilter:
    """Trees, suffix statistics and a threshold learnt from labelled urls (label 1: block).

    ``held_out`` tells what the threshold does with the labelled urls that neither statistics
    nor trees have seen: ``blocked_bad`` and ``blocked_good`` are the shares of those labelled 1
    and 0 that it blocks, ``n`` their number.
    """

    def __init__(self, model, names: list[str], statistics: dict[str, DataFrame], base_rate: float) -> None:
        self.model, self.names, self.statistics, self.base_rate = model, names, statistics, base_rate
        self.threshold, self.held_out = 0.5, {"n": 0, "blocked_bad": 0.0, "blocked_good": 0.0}

    @staticmethod
    def featured(urls: DataFrame, url: Column, mark: str, statistics: dict[str, DataFrame], base_rate: float) -> tuple[DataFrame, list[str]]:
        """Adds the features, each under its name after ``mark``; returns their names as well."""
        host, _ = url_parts(url)
        features = lexical_features(url)
        out = urls.withColumns({f"{mark}{k}": c for k, c in features.items()}).withColumns({f"{mark}{k}": s for k, s in _suffixes(host).items()})
        for k, table in statistics.items():
            out = out.join(table.select(F.col("suffix").alias(f"{mark}{k}"), F.col("rate").alias(f"{mark}r{k}")), f"{mark}{k}", "left").withColumn(f"{mark}r{k}", F.coalesce(f"{mark}r{k}", F.lit(base_rate)))
        return out, [*features, *(f"r{k}" for k in statistics)]

    @classmethod
    def train(cls, labelled: DataFrame, url_col: str = "url", label_col: str = "label", seed: int = 8, rounds: int = 10, depth: int = 4) -> UrlFilter | None:
        """Fit on all labelled urls; None without both labels.

        Null urls and labels other than 0 and 1 are left out.  The urls are dealt by hash into
        three parts.  A suffix's statistic is its rate of label 1 in the first one, drawn to the
        overall rate as if it had been seen ten times more at that rate; the trees are fitted to
        the second; in the third that threshold is chosen whose blocked shares of label 1 and of
        label 0 lie furthest apart, if by more than chance, else 0.5.
        """
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"))
        order = F.xxhash64(F.lit(seed), "url")
        rows = written(rows.withColumn("part", F.pmod(order, F.lit(PARTS))))
        n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not 0 < ones < n or rows.where("part = 1").select("label").distinct().count() < 2:
            return None
        base, statistics = ones / n, {}
        host, _ = url_parts(F.col("url"))
        for k, suffix in _suffixes(host).items():
            table = written(rows.where("part = 0").groupBy(suffix.alias("suffix")).agg(((F.sum("label") + 10 * base) / (F.count(F.lit(1)) + 10)).alias("rate")))
            statistics[k] = small(table)
        featured, names = cls.featured(rows.where("part = 1"), F.col("url"), "__", statistics, base)
        # Equal weight for both labels.
        weight = F.when(F.col("label") == 1, F.lit(0.5 / base)).otherwise(F.lit(0.5 / (1 - base)))
        ready = VectorAssembler(inputCols=[f"__{c}" for c in names], outputCol="__features").transform(featured.withColumn("weight", weight)).select("__features", "label", "weight")
        trees = GBTClassifier(featuresCol="__features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
        out = cls(trees.fit(ready), names, statistics, base)
        out._set_threshold(rows.where("part = 2"))
        return out

    def _set_threshold(self, rows: DataFrame) -> None:
        scored = self.scored(rows, F.col("url"), "__")
        counts = scored.groupBy(F.floor(F.col("__score") * 100).cast("int").alias("bin")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("rows")).collect()
        bad, good = sum(r.bad for r in counts), sum(r.rows - r.bad for r in counts)
        if not (bad and good):
            return
        shares = {}
        for cut in range(1, 100):
            above = [r for r in counts if r.bin >= cut]
            shares[cut] = sum(r.bad for r in above) / bad, sum(r.rows - r.bad for r in above) / good
        gap = lambda cut: shares[cut][0] - shares[cut][1]
        cut = max(shares, key=lambda c: (gap(c), -abs(c - 50)))
        # A gap that chance could give is no reason to leave the middle.
        if gap(cut) - gap(50) < 2 * math.sqrt(0.25 / bad + 0.25 / good):
            cut = 50
        self.threshold = cut / 100
        self.held_out = {"n": int(bad + good), "blocked_bad": shares[cut][0], "blocked_good": shares[cut][1]}

    def scored(self, urls: DataFrame, url: Column, mark: str) -> DataFrame:
        """Adds ``<mark>score``, the trees' probability of label 1, and helpers that begin with ``mark``."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        featured, _ = self.featured(urls, url, mark, self.statistics, self.base_rate)
        ready = VectorAssembler(inputCols=[f"{mark}{c}" for c in self.names], outputCol=f"{mark}features").transform(featured)
        model = self.model.copy().setFeaturesCol(f"{mark}features").setRawPredictionCol(f"{mark}raw").setProbabilityCol(f"{mark}p").setPredictionCol(f"{mark}label")
        return model.transform(ready).withColumn(f"{mark}score", vector_to_array(f"{mark}p")[1])


def judge_urls(pages: DataFrame, model: UrlFilter | None, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``, replacing columns of these names.

    The longest rule that fits decides; without one the trees do, and without a model the url is
    allowed.  Null urls and urls without ``://`` have an empty host and path, fit no rule and are
    left to the trees.  Each row is judged by itself, whatever the length of its url; an empty
    table gives an empty result, and all other columns of any name stay.  No shuffle: rules are
    expressions; suffix statistics are broadcast unless they have very many suffixes.
    """
    mark = fresh_prefix(pages)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url_col]
    rows = pages.select(*(F.col(f"`{c}`") for c in kept))
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = model.scored(rows, F.col(f"`{url_col}`"), mark) if model else rows.withColumn(f"{mark}score", F.lit(0.0))
    rows = rows.withColumns({f"{mark}host": host, f"{mark}path": path})
    rule, verdict = matched_rule(F.col(f"{mark}host"), F.col(f"{mark}path"), rules)
    threshold = model.threshold if model else 0.5
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"{mark}host").alias("host"), F.col(f"{mark}path").alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col(f"{mark}score") >= threshold, "block").otherwise("allow")).alias("verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls of documents that are labelled: 1 for a toxic or low-quality document.

    The number that a url's path ends with is the id of its document.
    """
    number = F.expr(r"try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) as bigint)")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")).cast("int")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("label"))
    return pages.select("url", number.alias("doc_id")).join(known, "doc_id").select("url", "label")
