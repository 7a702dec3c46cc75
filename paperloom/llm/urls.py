"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: A small labelled table (url, 1 for block); 0 are pages of prose, reference and news.
LABELLED = tuple(
    (url, 0)
    for url in (
        "https://www.library.org/catalog/history/article-1024.html", "https://news.daily.org/world/2021/05/election-results", "https://en.encyclopedia.org/wiki/Photosynthesis",
        "https://docs.project.org/en/latest/tutorial/introduction.html", "https://www.university.edu/research/papers/2019/abstract", "https://blog.engineer.io/posts/how-to-write-tests",
        "https://museum.gov/collections/paintings/renaissance", "https://forum.garden.org/topic/4411-growing-tomatoes", "https://recipes.kitchen.org/bread/sourdough",
        "https://www.health.gov/topics/sleep/guidelines", "https://journal.science.org/articles/2020/quantum-computing", "https://gallery.arts.edu/exhibitions/2018/printmaking",
        "https://transit.city.gov/routes/12/timetable", "http://birds.society.org/species/robin/", "https://manuals.radio.org/receiver/chapter-4", "http://reader.books.org/chapter/12/the-long-road",
        "https://archive.letters.org/1890/correspondence", "https://weather.service.gov/forecast/city/tomorrow", "https://schools.city.edu/lessons/geometry/triangles", "https://travel.notes.org/guide/mountains",
        "https://census.data.gov/tables/2010/households", "https://www.observatory.edu/en/sky/9211", "https://opinion.weekly.org/essays/on-reading", "https://law.archive.gov/cases/1954/summary",
    )
) + tuple(
    (url, 1)
    for url in (
        "http://casino-bonus-888.biz/free-spins/win-big", "http://xxx-adult-cams.tv/live/girls", "https://cheap-pills-online.ru/viagra/buy-now", "http://free-download-crack.info/keygen/serial.exe",
        "http://ads.tracker-click.net/banner?id=9912", "https://poker-slots-jackpot.bet/signup?ref=aff123", "http://porn-tube-hd.xxx/videos/hot", "http://login-verify-account.top/secure/paypal/update",
        "https://replica-watches-sale.shop/rolex-discount", "http://win-iphone-prize.click/survey/claim", "http://torrent-movies-free.cc/download/full-hd", "https://payday-loans-fast.biz/apply-now",
        "http://sexy-dating-singles.club/join/free", "http://bet365-bonus-code.win/sports/betting", "https://spam-seo-links.info/buy-backlinks", "http://malware-update-flash.xyz/player/install.exe",
        "http://click.adserver.biz/redirect?url=promo", "https://weight-loss-miracle.store/diet-pills", "http://escort-service-city.date/gallery", "http://crypto-double-btc.top/invest/profit",
        "http://hot-cams-live.sex/chat", "https://essay-writing-cheap.pro/order-now", "http://gambling-roulette-vip.casino/play", "http://warez-serials.ws/crack/patch",
    )
)

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
STEPS = 300
L2 = 1e-4


def host_and_path(url: str | Column = "url") -> tuple[Column, Column]:
    """The host, after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path, then up to ``?``, ``#`` or the end.

    Null and URLs without ``://`` have an empty host and path.
    """
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: str = "host", path: str = "path", rules=RULES) -> tuple[Column, Column]:
    """The rule that decides, the longest that fits, and its verdict; null for none."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))) & F.startswith(F.col(path), F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def buckets(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each once; begin and end are marked."""
    out = set()
    for mark, text in ((b"h", host), (b"p", path)):
        raw = b"^" + text.lower().encode("utf-8", "surrogatepass") + b"$"
        out |= {zlib.crc32(mark + raw[i : i + n]) % BUCKETS for n in SIZES for i in range(len(raw) - n + 1)}
    return np.fromiter(out, np.int64, len(out))


def train(labelled=LABELLED) -> np.ndarray:
    """Weights by bucket, and the bias last, by full-batch gradient steps over the labelled table."""
    weights = np.zeros(BUCKETS + 1)
    if not labelled:
        return weights
    rows, y = [], np.array([label for _, label in labelled], float)
    for url, _ in labelled:
        rest = url.partition("://")[2]
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        rows.append(buckets(host, rest[len(host) :].split("?")[0].split("#")[0]))
    size = np.array([max(1, len(r)) for r in rows], float)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(STEPS):
        z = np.bincount(owner, weights[flat], len(rows)) / np.sqrt(size) + weights[-1]
        error = 1 / (1 + np.exp(-z)) - y
        weights[:-1] -= 0.5 * (np.bincount(flat, (error / np.sqrt(size))[owner], BUCKETS) + L2 * weights[:-1])
        weights[-1] -= 0.02 * error.sum()
    return weights


def probability(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The chance of ``block`` for each URL."""
    out = np.empty(len(hosts))
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        at = buckets(h, p)
        out[i] = weights[at].sum() / np.sqrt(max(1, len(at))) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def judged(pages: DataFrame, rules=RULES, labelled=LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability), a row for each row of ``pages``.

    Null, empty and odd URLs have an empty host and path, which no rule fits.  Without a labelled table the method
    allows everything.  Repeated rows are judged each.  An empty table gives no rows.  Columns besides page_id and
    url are not used.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(train(labelled))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = probability(shared.value, batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(chance)], names=["page_id", "host", "path", "block_probability"])

    host, path = host_and_path()
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules=rules)
    scored = split.mapInArrow(run, "page_id long, host string, path string, block_probability double")
    by_method = F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "block_probability")
