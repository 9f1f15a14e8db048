"""URL filter: host/path rules first, then a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

The model is a vector of `2 ** bits` weights, whatever the size of the pages
table.  Rules are matched, and hosts and paths cut out, by built-in functions;
only distinct (host, path) strings of a batch are scored in Python.

Defined cases.  Null url or no "://": host and path are empty, no rule fits, and
the model scores the empty url.  Host and path are taken as they stand (port and
user part included); A-Z of the host are lower-cased.  Repeated rows are judged
alike.  Other columns pass through; result columns of the same name replace them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The rules of the registered query: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

# The labelled table that the registered query learns from.
BLOCKED = """
http://free-casino-bonus.example/play/slots  http://www.casino-royal-win.test/poker/online  https://best-poker-bets.test/signup
http://hot-xxx-videos.test/watch/123  https://adult-cams-live.test/room/77  http://sexy-singles-near-you.test/chat
http://cheap-viagra-pills.test/order  https://pharma-discount-pills.test/buy/cialis  http://no-prescription-meds.test/cart
https://warez-crack-keygen.test/download/setup.exe  http://torrent-movies-free.test/get/film.torrent  https://serial-crack.test/keygen
http://ads.tracker-network.test/click?id=1  https://adserver.popunder.test/banner/728x90  http://doubleclicks.test/adclick/redirect
https://instant-payday-loan.test/apply-now  http://quick-cash-loans.test/approved  https://debt-free-credit-loan.test/offer
http://win-free-iphone.test/claim-prize  https://lottery-winner-prize.test/claim  http://you-won-gift-card.test/free
https://crypto-double-profit.test/invest  http://bitcoin-fast-profit.test/join-now  https://forex-signal-profit.test/vip
http://secure-login-verify.test/account/update/password  https://bank-account-verify.test/signin  http://paypal-login-confirm.test/verify
https://replica-watches-outlet.test/sale  http://luxury-replica-bags.test/cheap  https://fake-designer-outlet.test/discount
http://escort-girls-city.test/book  https://nude-cams-free.test/join  http://porn-tube-free.test/videos/xxx
http://www.mass-mailing-spam.test/en/301  http://www.spam-links-network.test/de/77  https://www.content-farm-spam.test/articles/9
http://www.link-farm-spam.test/es/45  http://blog.spam-comments.test/fr/12/  http://www.spam-mail.test/en/5
http://ads-network.test/en/serve  https://m.track-ads.test/de/4  http://blog.free-betting-tips.test/odds  https://sports-bets-free.test/en/12
http://www.adult-content.test/en/71  http://m.adult-movies.test/es/8  http://blog.cheap-loans.test/fr/5  http://m.pills-online.test/en/66
https://seo-backlinks-cheap.test/buy  http://buy-followers-likes.test/instant  https://link-farm-directory.test/page1
http://weight-loss-miracle.test/pills  https://hair-growth-miracle.test/order-now  http://male-enhance-pills.test/buy
"""
ALLOWED = """
https://www.university-library.example/catalogue/books  https://history.university.example/lectures/1848  https://www.city-library.test/opening-hours
https://docs.programming.test/tutorial/functions.html  https://docs.python-course.test/reference/lists  https://wiki.science.test/wiki/Photosynthesis
https://en.encyclopedia.test/wiki/History_of_art  https://de.encyclopedia.test/wiki/Geschichte  https://fr.encyclopedia.test/wiki/Histoire
https://www.daily-news.test/world/2021/04/12/article  https://news.local-paper.test/politics/2020/election  https://www.weather-service.test/forecast/today
https://www.health-ministry.test/guidance/vaccines  https://hospital.medical-school.test/departments/cardiology  https://www.city-council.test/services/recycling
https://recipes.kitchen.test/soups/tomato-soup  https://garden.plants.test/roses/pruning  https://blog.travel-notes.test/2019/06/lisbon
https://museum.art-gallery.test/exhibitions/current  https://www.national-park.test/trails/map  https://orchestra.concert-hall.test/programme
https://journal.physics.test/articles/volume-12/issue-3  https://research.institute.test/publications/2018  https://arxiv.papers.test/abs/1801.00001
https://forum.linux-users.test/thread/4521  https://forum.woodworking.test/topic/joints  https://www.chess-club.test/results/2022
https://school.primary.test/homework/maths  https://www.language-course.test/en/grammar/verbs  https://dictionary.words.test/define/river
https://www.train-timetable.test/stations/central  https://maps.open-data.test/regions/north  https://statistics.office.test/census/2011
https://www.book-publisher.test/authors/index  https://poems.literature.test/sonnets/18  https://archive.newspapers.test/1905/may
https://blog.gardeners.test/en/204  https://m.newsroom.test/de/31  https://www.stories.test/fr/88.html  https://archive.letters.test/es/17
https://m.timetable.test/en/1290/  https://m.weather.test/en/36445  http://m.museum.test/fr/129/  https://m.teaching.test/de/35593.html
https://blog.thinking.test/en/1201  http://blog.mathematics.test/de/4406/  https://m.thesaurus.test/en/30110  https://m.nation.test/es/12183
https://www.football-league.test/fixtures  https://cycling.sports.test/tour/stage-5  https://birds.nature.test/species/robin
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  A rule is
    written as host and path together; of equally long ones the earlier wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str, least: int, most: int, bits: int) -> np.ndarray:
    """Buckets of the distinct n-grams; host and path are hashed apart."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in range(least, most + 1):
            found.update(mark + part[i : i + n] for i in range(len(part) - n + 1))
    buckets = {zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for x in found}
    return np.fromiter(sorted(buckets), np.int64, len(buckets))


@dataclass
class UrlModel:
    """P(block) of a url from its host and path."""

    weights: np.ndarray
    bias: float
    least: int
    most: int
    bits: int

    @classmethod
    def fit(cls, labelled: DataFrame, least: int = 3, most: int = 5, bits: int = 16, l2: float = 0.005, steps: int = 400, max_rows: int = 10_000) -> UrlModel:
        """Learn from (url, label), label 1 to block.  The table is small by
        contract: at most `max_rows` rows, in the order of their hash, are used."""
        rows = labelled.where("label IS NOT NULL").select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.col("label").cast("int").alias("y"))
        rows = rows.orderBy(F.xxhash64("h", "p", "y"), "h", "p", "y").limit(max_rows).collect()
        sets, y = [grams(r.h, r.p, least, most, bits) for r in rows], np.array([r.y for r in rows], dtype=float)
        w, b = np.zeros(1 << bits), 0.0
        if not len(y) or y.min() == y.max():
            return cls(w, float(y.mean() > 0.5) * 2 - 1 if len(y) else -1.0, least, most, bits)
        flat = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        scale = 1 / np.sqrt(np.array([max(1, len(s)) for s in sets]))
        for _ in range(steps):
            z = np.bincount(own, weights=w[flat], minlength=len(sets)) * scale + b
            g = (1 / (1 + np.exp(-z)) - y) / len(y)
            w -= 4.0 * (np.bincount(flat, weights=(g * scale)[own], minlength=len(w)) + l2 / len(y) * w)
            b -= 0.5 * g.sum()
        return cls(w, b, least, most, bits)

    def score(self, host: str, path: str) -> float:
        found = grams(host, path, self.least, self.most, self.bits)
        z = self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.bias
        return float(1 / (1 + np.exp(-z)))


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """`pages` with host, path, score, rule and verdict (allow or block)."""
    used = np.flatnonzero(model.weights)
    packed = UrlModel(model.weights.astype(np.float32), model.bias, model.least, model.most, model.bits) if len(used) else model

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([packed.score(h, p) for h, p in zip(hosts, paths, strict=True)], dtype=float)

    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    out = out.withColumn("score", scored("host", "path"))
    return out.withColumns({"rule": rule, "verdict": F.coalesce(said, F.when(F.col("score") >= threshold, "block").otherwise("allow"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = UrlModel.fit(labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")
