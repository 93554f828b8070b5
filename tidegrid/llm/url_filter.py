"""URL verdicts: rules for hosts and paths, and logistic regression on hashed character n-grams.

Everything is built-in expressions.  Training: the n-grams of the labelled URLs are
hashed to a fixed number of features.  Full-batch gradient descent on the weights is the same as
descent on one number per labelled URL, with the products of their feature vectors; a fold over
the steps does that in one row.  The weights are then a literal array, and a page's
score is a sum of its elements.

A url without ``://``, or none, has an empty host and an empty path.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of a site list: what to do, and host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The small labelled table: hosts with paths to block, and to allow.
BLOCKED = (
    "cheap-pills.com/", "www.cheap-pills.org/buy/12", "buy-pills-online.net/en/", "pharma-pills.biz/order", "cheap-meds.com/sale?x=1",
    "viagra-shop.biz/en/4", "free-bets.com/", "m.free-bets.net/en/1", "best-bets.org/odds", "casino-bonus.com/win", "online-casino.net/en/9",
    "poker-free.org/join", "slots-jackpot.com/spin", "bet-win.biz/en/2", "spam-farm.org/", "www.spam-farm.com/en/77", "link-farm.net/seo",
    "seo-spam.biz/links", "spam-links.com/de/3", "adult-x.com/", "m.adult-x.net/en/5", "xxx-adult.org/video", "adult-cams.com/live",
    "sex-chat.net/free", "porn-tube.org/xxx/1", "xxx-tube.com/fr/8", "payday-loans.biz/apply", "fast-loans.net/cash", "quick-cash-loans.com/",
    "replica-watches.com/rolex", "fake-rolex.net/buy", "crack-keygen.org/serial", "warez-crack.com/download", "free-download-crack.net/exe",
    "phish-login.biz/bank", "account-verify-login.com/secure", "win-prize-free.com/claim", "free-iphone-win.net/claim", "miracle-diet.com/lose",
    "forex-profit.biz/rich", "get-rich-fast.com/now", "crypto-double.net/win", "cheap-viagra.org/pills", "pills-cheap.example.com/en/3",
    "bets-free.example.net/es/2", "farm-spam.example.org/fr/9", "www.cheap-pills.example.net/fr/9", "m.spam-farm.example.com/en/2",
    "free-bets.example.org/de/3?page=2", "blog.adult-x.example.com/es/1", "casino-win.example.net/en/5.html", "ads-track.example.com/en/6#top",
    "blog.casino-win.example.org/fr/61", "m.ads-track.example.net/es/7", "www.adult-x.example.org/en/825/", "spam-farm.example.net/de/44",
)
ALLOWED = (
    "www.city-library.org/en/12", "news.morning-post.com/world/3", "blog.garden-notes.net/en/44", "docs.open-math.org/de/7", "university.edu/research/9",
    "www.river-museum.org/fr/5", "recipes.home-kitchen.com/soup/2", "weather.north-coast.net/today", "m.daily-herald.com/en/825", "history.old-town.org/es/1",
    "school.example.org/en/3", "blog.example.net/fr/371", "www.example.com/en/607", "m.example.com/es/9", "forum.linux-users.org/thread/1", "music.concert-hall.com/de/4",
    "science.daily-lab.net/en/88", "www.train-times.org/en/2", "maps.hill-walks.com/route/6", "books.reading-room.net/en/31", "the-harbour.com/en/1", "thethe.example.com/fr/825",
    "thinther.example.org/en/474", "blog.theran.example.net/en/25", "www.thertion.example.com/de/3", "m.inthe.example.net/es/8", "theror.example.com/en/676", "blog.tionthe.example.org/fr/12",
    "erthan.example.org/de/252", "reston.example.net/en/18", "www.thatthe.example.org/en/5", "andthere.example.com/fr/71", "m.onther.example.com/en/474.html", "hathe.example.org/es/575",
    "health.gov/advice/3", "parliament.org/en/4", "sport.local-news.com/results", "www.wood-craft.net/en/9", "plants.botany.edu/list/2", "ththou.example.net/es/66", "thouthe.example.com/en/8", "photo.mountain-club.org/de/1",
    "api.data-tools.net/en/guide", "www.court-records.org/fr/8", "bakery.small-town.com/", "farm-museum.org/en/3", "free-university.org/en/6", "adult-education.org/courses/2",
)


@dataclass(frozen=True)
class UrlParams:
    features: int = 1 << 12
    sizes: tuple[int, ...] = (3, 4, 5)
    steps: int = 400
    rate: float = 4.0
    decay: float = 0.0005


def _parts(url: str | Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: str | Column) -> Column:
    return F.translate(_parts(url, 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    return _parts(url, 2)


def features(host: Column, path: Column, p: UrlParams) -> Column:
    """Numbers of the n-grams of host and path, one for each occurrence."""

    def numbered(size: int, kind: str):
        def of(chars: Column) -> Column:
            starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (size - 1), F.lit(0)))

            def number(c: Column, i: Column) -> Column:
                gram = F.concat(c, *(F.get(chars, i + k) for k in range(1, size)))
                return F.pmod(F.xxhash64(gram, F.lit(kind)), F.lit(p.features)).cast("int")

            return F.transform(starts, number)

        return of

    def grams(text: Column, kind: str) -> Column:
        chars = F.array(F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit("(?s)."), F.lit(0)))
        return F.flatten(F.concat(*(F.transform(chars, numbered(n, kind)) for n in p.sizes)))

    return F.concat(grams(host, "h"), grams(path, "p"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``(number, host, path, y)`` of the small labelled table."""
    urls = [{"url": f"http://{u}", "y": 1.0} for u in BLOCKED] + [{"url": f"http://{u}", "y": 0.0} for u in ALLOWED]
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(urls)), "array<struct<url:string,y:double>>")).alias("number", "u"))
    return rows.select("number", host_of("u.url").alias("host"), path_of("u.url").alias("path"), "u.y")


def train(labelled: DataFrame, params: UrlParams | None = None) -> list[float]:
    """Weights of the features, and last the constant.  ``labelled`` is small by contract: it becomes one row."""
    p = params or UrlParams()
    found = features(F.col("host"), F.col("path"), p)
    each = labelled.select("number", "y", F.explode(found).alias("f"), F.size(found).alias("m"))
    value = (F.count("*") / F.sqrt(F.first("m"))).alias("v")
    x = cut_lineage(each.groupBy("number", "y", "f").agg(value))
    products = x.select(F.col("number").alias("i"), "f", F.col("v").alias("vi")).join(x.select(F.col("number").alias("j"), "f", F.col("v").alias("vj")), "f")
    products = products.groupBy("i", "j").agg((F.sum(F.col("vi") * F.col("vj"))).alias("k"))
    row = products.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("k"))
    one = labelled.join(row, labelled["number"] == row["i"]).agg(F.sort_array(F.collect_list(F.struct("number", "y", "k"))).alias("t"))
    dense = F.transform("t", lambda r: F.transform("t", lambda o: F.coalesce(F.map_from_entries(r["k"])[o["number"]], F.lit(0.0)) + 1.0))
    # A table, so that the products are not computed again in every step.
    one = cut_lineage(one.select(F.col("t.number").alias("number"), F.col("t.y").alias("y"), dense.alias("k")))
    zeros = F.transform("y", lambda _: F.lit(0.0))

    def step(alpha: Column, _: Column) -> Column:
        def next_value(a: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(F.get("k", i), alpha, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
            return a * (1 - p.rate * p.decay) + (F.get("y", i) - 1 / (1 + F.exp(-margin))) * (p.rate / F.size("y"))

        return F.transform(alpha, next_value)

    solved = cut_lineage(one.select("number", F.aggregate(F.sequence(F.lit(1), F.lit(p.steps)), zeros, step).alias("alpha")))
    alpha = solved.select(F.explode(F.arrays_zip("number", "alpha")).alias("z")).select("z.number", "z.alpha")
    weight = x.join(alpha, "number").groupBy("f").agg(F.sum(F.col("v") * F.col("alpha")).alias("w"))
    constant = alpha.agg(F.lit(p.features).alias("f"), F.sum("alpha").alias("w"))
    weights = [0.0] * (p.features + 1)
    for r in weight.unionByName(constant).collect():  # at most one number per feature
        weights[r.f] = r.w
    return weights


def score(host: Column, path: Column, weights: list[float], params: UrlParams | None = None) -> Column:
    """Log odds of ``block``."""
    p = params or UrlParams()
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")
    found = features(host, path, p)
    total = F.aggregate(found, F.lit(0.0), lambda s, f: s + F.get(table, f))
    return total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + weights[-1]


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or one above it) and a path's start, and what it says; nulls if none does."""
    said, named = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit(f".{top}"))) & F.startswith(path, F.lit(slash + rest))
        said, named = F.when(fits, F.lit(verdict)).otherwise(said), F.when(fits, F.lit(rule)).otherwise(named)
    return said, named


def judge(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), rules=RULES, params: UrlParams | None = None) -> DataFrame:
    """Columns ``keep`` and ``host, path, rule, score, verdict``."""
    p = params or UrlParams()
    weights = train(labelled_urls(pages.sparkSession), p)
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), host_of("url").alias("host"), path_of("url").alias("path"))
    said, named = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", named).withColumn("said", said).withColumn("score", score(F.col("host"), F.col("path"), weights, p))
    verdict = F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select(*(F.col(f"`{c}`") for c in keep), "host", "path", "rule", "score", verdict.alias("verdict"))
