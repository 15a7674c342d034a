"""URL verdicts: the longest fitting rule, else logistic regression on hashed character n-grams.

A null url, or one without ``://``, has an empty host and path, which no rule
fits; the model knows the empty address as allowed.  Repeated rows give
repeated results, an empty table none; a null or repeated id is carried as it
is, and other columns play no part.  Of rules of equal length that fit, the
later one wins; a probability of just 0.5 blocks.  Only A-Z in hosts are
lower-cased.  Very long addresses are scored whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.runtime import table

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BITS = 16
SIZES = (3, 4, 5)

#: Name stems of the small labelled table, unwanted and wanted: words of the trades that filters name, none of them a host of the test tables.
UNWANTED = "casino poker bets sport-bets casino-royal royal-casino jackpot slots cheap-meds pills diet-pills pharma viagra adult adult-dating xxx sex-cams porn spam spam-mail spam-bot link-farm seo-links ads ads-server pop-ads track-click tracker click-bait win-prize win-big free-money free-spins lottery payday-loans cheap-loans online-casino best-pills adult-video x-rated content-farm spam-list free-porn banner-ads bet-win warez crack-keygen fake-watches".split()
WANTED = "weather library museum university news recipes garden travel history physics biology music theatre school football cycling forum wiki archive journal gazette review science maps bakery village theory thread thing thunder nation station ration motion notion lesson other mother brother therapy thesis theorem thread thermal within there thistle northern southern author healthy month earth width harbour kitchen clinic parents airport hotel pianos orchard planet election council budget a b io go it city town bank hospital press cafe shop festival lab data cloud forest river".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: each stem under some subdomain, ending and path, 1 for unwanted."""
    subs, ends = ("", "www.", "blog.", "m."), ("example.com", "example.net", "example.org", "test")
    paths = ("/en/12", "/de/345/", "/fr/7.html", "/es/88?page=2&ref=x", "/en/9#top", "/")
    out = [("", 0)]
    for label, stems in ((1, UNWANTED), (0, WANTED)):
        for i, stem in enumerate(stems):
            for j in range(3):
                k = i + j
                out.append((f"https://{subs[k % 4]}{stem}.{ends[(i + 2 * j) % 4]}{paths[k % 6]}", label))
    return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null.  The rule list is a parameter held by the driver."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        _, h, p = rule
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def ngrams(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every hashed n-gram of each text between two end marks."""
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    c = np.frombuffer(b"".join([b"\x02" + t + b"\x03" for t in texts]), np.uint8).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(c))  # characters up to the text's end
    rows, features = [], []
    for n in SIZES:
        ok = left >= n
        h = np.full(len(c), seed * 8 + n, np.uint64)
        for j in range(n):
            m = max(len(c) - j, 0)  # few short texts may hold fewer characters than one n-gram
            h[:m] = (h[:m] ^ c[len(c) - m :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        rows.append(row[ok])
        features.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that an address is unwanted."""
        total = np.full(len(hosts), self.bias)
        for seed, part in ((1, hosts), (2, paths)):
            rows, features = ngrams([p.encode() for p in part], seed)
            n = np.maximum(np.bincount(rows, minlength=len(part)), 1)
            total += np.bincount(rows, self.weights[features], len(part)) / np.sqrt(n)
        return 1 / (1 + np.exp(-total))


def split_url(url: str) -> tuple[str, str]:
    """Host and path as host_of() and path_of() give them."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), rest[:end]


def train(labelled: Sequence[tuple[str, int]], steps: int = 500, rate: float = 2.0, decay: float = 5e-4) -> UrlModel:
    """Full-batch gradient descent on the labelled table; the same table gives the same model."""
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    y = np.array([label for _, label in labelled], float)
    parts = []
    for seed, part in ((1, hosts), (2, paths)):
        rows, features = ngrams([p.encode() for p in part], seed)
        n = np.maximum(np.bincount(rows, minlength=len(y)), 1)
        parts.append((rows, features, 1 / np.sqrt(n)[rows]))
    rows, features, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(b + np.bincount(rows, w[features] * values, len(y)))))
        g = (p - y) / len(y)
        w -= rate * (np.bincount(features, g[rows] * values, 1 << BITS) + decay * w)
        b -= rate * g.sum()
    return UrlModel(w, float(b))


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return train(labelled_urls())


def judge(df: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict and unwanted (the model's probability)."""
    url = F.coalesce(df[url_column].cast("string"), F.lit(""))
    rows = df.select(df[id_column], host_of(url).alias("host"), path_of(url).alias("path"))
    typed = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                p = model.score(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [id_column, "host", "path", "unwanted"])

    scored = rows.mapInArrow(run, f"`{id_column}` {typed}, host string, path string, unwanted double")
    host, path = F.col("host"), F.col("path")
    by_rule = rule_column(host, path, rules, lambda r: r[0])
    by_model = F.when(F.col("unwanted") >= 0.5, "block").otherwise("allow")
    return scored.select(
        id_column, "host", "path",
        rule_column(host, path, rules, lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(by_rule, by_model).alias("verdict"),
        "unwanted",
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), default_model())


QUERIES = {"op9_url_filter": op9_url_filter}
SQL: dict[str, str] = {}
