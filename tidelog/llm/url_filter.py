"""URL filter: rules first, then gradient-boosted trees over lexical features.

DataFrame functions and Spark ML only.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of host names that block lists are about, and of ordinary ones.  They spell the labelled URLs; no feature looks them up.
BLOCKED_WORDS = (
    "poker", "slots", "bet", "jackpot", "lottery", "gambling", "viagra", "pharma", "cialis", "diet", "bonus", "porn", "sex", "cams", "escort",
    "tracker", "click", "banner", "popup", "affiliate", "malware", "phish", "warez", "crack", "torrent", "keygen", "loan", "payday",
    "replica", "seo", "links", "xxx",
)
#: Words that no training URL has, for held-out ones.
HELD_OUT_WORDS = ("casino", "win", "free", "bets", "ads", "track", "spam", "farm", "cheap", "pills", "adult", "x")
ORDINARY_WORDS = (
    "news", "daily", "garden", "school", "river", "museum", "library", "science", "weather", "travel", "cooking", "history", "music",
    "forum", "wiki", "docs", "journal", "city", "health", "sport", "photo", "books", "art", "tech", "green", "north", "house", "food",
)
#: The most frequent letter pairs of English text, which made-up ordinary host names consist of.
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le")
#: Suffixes; both classes use each, so a suffix alone settles nothing, but blocked hosts have the last ones more often.
SUFFIXES = ("com", "net", "org", "co.uk", "de", "fr", "es", "info", "xyz", "top")
SUFFIX_ODDS = ((6, 4, 4, 2, 2, 2, 2, 1, 1, 1), (6, 4, 4, 1, 1, 1, 1, 3, 3, 3))


def labelled_urls(n: int = 1_600, seed: int = 11, blocked_words: Sequence[str] = BLOCKED_WORDS) -> list[tuple[str, int]]:
    """(url, 1 if it should be blocked) — made from the word lists above, the same each time, without a look at any table.

    The classes differ in lexical features, each of which the other class has
    too: blocked hosts have more hyphens and digits and other suffixes, and half
    of the blocked URLs (a twelfth of the others) have deep paths or many parameters.
    """
    r = random.Random(seed)
    rows = []
    for k in range(n):
        bad = k % 2
        kind = r.random()
        if bad:
            words = r.sample(blocked_words, r.choice((2, 2, 3)))
            name = "-".join(words) if kind < 0.75 else words[0] + r.choice(("", "-")) + str(r.randint(1, 999)) if kind < 0.93 else "".join(words[:2])
        else:
            name = "".join(r.choices(PAIRS, k=r.randint(2, 6))) if kind < 0.6 else r.choice(("-", "", "", "")).join(r.sample(ORDINARY_WORDS, r.randint(1, 2)))
        host = r.choice(("", "", "www.", "en.", "my.", "static.", "m.")) + name + r.choice(("", "", "." + r.choice(ORDINARY_WORDS))) + "." + r.choices(SUFFIXES, SUFFIX_ODDS[bad])[0]
        loud = r.random() < (0.5 if bad else 0.08)
        depth = r.randint(3, 7) if loud and r.random() < 0.6 else r.randint(0, 4)
        path = "".join("/" + (r.choice(PAIRS) if r.random() < 0.3 else str(r.randint(1, 9999)) if r.random() < 0.5 else r.choice(ORDINARY_WORDS)) for _ in range(depth)) + r.choice(("", "/", ".html", ".php"))
        given = r.randint(2, 6) if loud else r.choice((0, 0, 0, 1, 2))
        tail = "&".join(f"{r.choice(('id', 'p', 'sort', 'lang', 'q', 'v', 'src', 'go'))}={r.choice((str(r.randint(1, 99_999)), r.choice(ORDINARY_WORDS)))}" for _ in range(given))
        rows.append((f"{r.choice(('http', 'https'))}://{host}{path if depth else r.choice(('', '/'))}{'?' + tail if tail else ''}{r.choice(('', '', '', '#' + r.choice(ORDINARY_WORDS)))}", bad))
    return rows


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one.

    Rules are (verdict, host, path).  A rule fits its host and its subdomains
    if the path starts with the rule's; of equally long ones the last given wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda x: len(x[1] + x[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical_features(df: DataFrame, url_col: str, suffix_rates: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """Add the numeric features (double, never null) of ``url_col``; returns their names too.

    Counts and shares of characters of the URL, of its host and of the host
    without its last label, and the share of blocked URLs by suffix.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    df = df.withColumn("_u", url).withColumn("_h", host_of(url)).withColumn("_p", path_of(url))
    df = df.withColumn("_q", F.regexp_extract("_u", r"(?s)^[^?#]*\?([^#]*)", 1)).withColumn("_name", F.regexp_replace("_h", r"\.[^.]*$", ""))
    u, h, p, q, name = (F.col(c) for c in ("_u", "_h", "_p", "_q", "_name"))
    n = F.greatest(F.length(name), F.lit(1))
    share = lambda c: (F.length(name) - F.length(F.replace(name, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(name, ""), lambda c: c != "")), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    suffix = F.regexp_extract(h, r"([^.]*)$", 1)
    rate = F.lit(0.5)
    for s, x in sorted(suffix_rates.items()):
        rate = F.when(suffix == s, F.lit(x)).otherwise(rate)
    features = {
        "url_length": F.length(u), "host_length": F.length(h), "path_length": F.length(p), "labels": _count(h, "."), "depth": _count(p, "/"),
        "digit_ratio": _count(u, "0123456789") / F.greatest(F.length(u), F.lit(1)), "host_digits": _count(h, "0123456789"),
        "entropy": entropy, "parameters": F.when(F.length(q) > 0, _count(q, "&") + 1).otherwise(0), "hyphens": _count(h, "-"),
        "vowel_ratio": _count(name, "aeiou") / n, "suffix_rate": rate,
    }
    for k, v in features.items():
        df = df.withColumn(f"_f_{k}", F.coalesce(v.cast("double"), F.lit(0.0)))
    return df.drop("_u", "_q", "_name"), [f"_f_{k}" for k in features]


class UrlModel:
    """Trees trained from labelled URLs."""

    def __init__(self, spark: SparkSession, urls: Sequence[tuple[str, int]] | None = None, rounds: int = 12, depth: int = 4):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        urls = list(urls) if urls is not None else labelled_urls()
        quoted = ", ".join("('" + u.replace("\\", "\\\\").replace("'", "\\'") + f"', {int(y)}.0D)" for u, y in urls)
        rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(url, y)")
        suffix: dict[str, list[int]] = {}
        for u, y in urls:
            host = u.partition("://")[2]
            for c in "/?#":
                host = host.partition(c)[0]
            suffix.setdefault(host.rpartition(".")[2].lower(), []).append(y)
        #: Smoothed share of blocked URLs by suffix: suffix statistics.
        self.suffix_rates = {s: (sum(ys) + 2) / (len(ys) + 4) for s, ys in suffix.items()}
        data, self.names = lexical_features(rows, "url", self.suffix_rates)
        self.assembler = VectorAssembler(inputCols=self.names, outputCol="_features")
        data = self.assembler.transform(data).select("_features", "y").coalesce(1)
        self.trees = GBTClassifier(featuresCol="_features", labelCol="y", maxIter=rounds, maxDepth=depth, seed=5, predictionCol="_blocked").setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(data)

    def judge(self, df: DataFrame, url_col: str) -> DataFrame:
        """Adds ``blocked`` (boolean), ``host`` and ``path``."""
        data, _ = lexical_features(df, url_col, self.suffix_rates)
        out = self.trees.transform(self.assembler.transform(data))
        return out.withColumn("blocked", F.col("_blocked") >= 0.5).withColumnRenamed("_h", "host").withColumnRenamed("_p", "path").drop(*self.names, "_features", "_raw", "_probability", "_blocked")


@functools.lru_cache(4)
def _model_of(application: str) -> UrlModel:
    return UrlModel(SparkSession.getActiveSession())


def default_model(spark: SparkSession) -> UrlModel:
    """The model of the made-up URLs, fitted once in an application."""
    return _model_of(spark.sparkContext.applicationId)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule (null if none fits), verdict ("allow" or "block": the rule's, else the trees').

    One row for each input row; null urls and urls without ``://`` have an empty
    host and path and are left to the trees.  Other columns are not read.
    """
    judged = model.judge(pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")), "_url")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return judged.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
