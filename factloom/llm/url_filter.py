"""URL filter: longest-prefix rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained here, on the driver, from the small labelled URL table below (a fixed bound) by full-batch
gradient descent, so reruns agree. Defined cases: a null url, or one without ``://``, has an empty host and path;
no rule fits an empty host. Repeated rows give repeated results.
"""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, col, ddl, tidy

#: host, path of a prefix, verdict. A rule fits its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: The labelled table: URLs to block, then URLs to allow.
BLOCK = (
    "http://cheap-pills.example.com/en/12", "https://www.cheap-meds.example.net/fr/9", "http://discount-pills.example.org/buy", "https://online-pharmacy.example.com/pills/order.html",
    "http://casino-win.example.com/en/77", "https://www.best-casino.example.net/slots/8", "http://lucky-casino.example.org/de/3", "https://poker-win.example.com/bonus",
    "http://free-bets.example.com/en/5", "https://m.sports-bets.example.net/odds", "http://free-spins.example.org/join", "https://bets-online.example.com/free",
    "http://spam-farm.example.com/en/1", "https://blog.link-farm.example.net/es/44", "http://content-farm.example.org/p/2", "https://spam-links.example.com/x",
    "http://ads-track.example.com/en/9", "https://www.track-ads.example.net/click?id=2", "http://ad-tracker.example.org/pixel", "https://clicks-ads.example.com/r/77",
    "http://adult-x.example.net/en/31", "https://www.xxx-adult.example.com/cams", "http://adult-videos.example.org/hot/3", "https://sex-cams.example.com/live",
    "http://pharmacy-deals.net/viagra", "http://adult-x.example.com/de/8.html", "https://www.adult-x.example.net/fr/520?page=2", "http://blog.adult-x.example.org/en/963/", "https://adult-chat.net/room", "http://buy-cheap-meds.com", "https://m.cheap-pills.net/en/4", "https://mega-casino.io/slots", "http://hot-xxx.tv", "https://bet-now.co/odds", "http://spam-offers.biz/go", "https://ads-network.co.uk/click",
    "http://win-money-fast.example.com/en/4", "https://payday-loans.example.net/apply", "http://free-crack-warez.example.org/dl", "https://replica-watches.example.com/sale",
)
ALLOW = (
    "http://news.example.com/en/12", "https://www.garden.example.net/fr/9", "http://library.example.org/books", "https://history.example.com/museum/tour.html",
    "http://weather.example.com/en/77", "https://www.recipes.example.net/soup/8", "http://school.example.org/de/3", "https://travel.example.com/winter",
    "http://science.example.com/en/5", "https://m.music.example.net/notes", "http://theatre.example.org/join", "https://football.example.com/results",
    "http://thering.example.com/en/1", "https://blog.therin.example.net/es/44", "http://anthion.example.org/p/2", "https://stonble.example.com/x",
    "http://tionth.example.com/en/9", "https://www.theres.example.net/story?id=2", "http://ererin.example.org/page", "https://onthat.example.com/r/77",
    "http://blog.ouaire.example.net/en/31", "https://www.keiten.example.com/verein", "http://lengua.example.org/casa/3", "https://m.maison.example.com/jardin",
    "http://well-being.example.com/en/4", "https://new-york.example.net/map", "http://open-source.example.org/dl", "https://city-council.example.com/minutes",
    "http://en.encyclopedia.org/wiki/Cat", "https://code.host.com/user/project", "http://daily-news.co.uk/news/3", "https://university.edu/physics", "http://gov.data.gov/table", "https://village-museum.net/garden",
    "http://a.org", "https://b.net/", "http://my-blog.me/2020/05", "https://shop.books.com/item/44", "http://maps.travel.io/city", "https://forum.linux.dev/t/12",
    "http://radio.fm/live", "https://kitchen.co/soup", "http://zoo.info", "https://docs.python.dev/library", "http://quiet.river.ca/walk", "https://paper.journal.eu/vol/7",
    "http://museum.de/", "https://ecole.fr/cours", "http://kunst.at/haus", "https://casa.es/vida", "http://uni.ch/kurs", "https://x.y/z", "http://photo.gallery.jp", "https://open.map.nl/tile",
    "http://weather.se/today", "https://chess.club/game", "http://farm.coop/milk", "https://train.rail.pl/plan",
    "http://thth.example.net/en/617/", "https://ththan.example.com/de/25.html", "http://m.ththor.example.org/fr/98", "https://ththble.example.net/en/3?page=2&ref=x",
)
BITS, GRAMS, STEPS, RATE, PENALTY = 15, (3, 4, 5), 300, 2.0, 1e-4


def parse(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, by position only."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) if not host.islower() else host, path


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The fitting rule of the longest text, and its verdict."""
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def grams(host: str, path: str) -> np.ndarray:
    """The hashed n-grams of a URL, each once; host and path have buckets of their own."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode()
        seed = crc32(mark.encode())
        for n in GRAMS:
            found.update(crc32(raw[k : k + n], seed) & ((1 << BITS) - 1) for k in range(len(raw) - n + 1))
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


@lru_cache(maxsize=8)
def train(block: tuple[str, ...] = BLOCK, allow: tuple[str, ...] = ALLOW) -> tuple[np.ndarray, float]:
    """Weights of the hashed n-grams, and the bias."""
    rows = [(grams(*parse(u)), y) for y, urls in ((1.0, block), (0.0, allow)) for u in urls]
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(STEPS):
        slope, lean = PENALTY * weights, 0.0
        for x, y in rows:
            error = 1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + bias))) - y
            slope[x] += error / np.sqrt(max(1, len(x))) / len(rows)
            lean += error / len(rows)
        weights, bias = weights - RATE * slope, bias - RATE * lean
    return weights, float(bias)


def probability(host: str, path: str, model: tuple[np.ndarray, float]) -> float:
    """How likely the model blocks a URL."""
    x = grams(host, path)
    return float(1 / (1 + np.exp(-(model[0][x].sum() / np.sqrt(max(1, len(x))) + model[1]))))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; a narrow map. ``score`` is null where a rule decided."""
    from pyspark.sql.pandas.types import to_arrow_type

    ids = pages.schema[id_col].dataType
    ids_arrow, model = to_arrow_type(ids), train()

    @tidy
    def judge(arrow):
        for page_id, url in batches(arrow, ["a", "b"], 4096):
            rows = []
            for u in url:
                host, path = parse(u)
                rule = rule_of(host, path, rules)
                score = None if rule else probability(host, path, model)
                rows.append((host, path, rule[0] if rule else None, rule[1] if rule else "block" if score >= threshold else "allow", score))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(page_id, ids_arrow), *(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.select(col(pages, id_col).alias("a"), col(pages, url_col).alias("b")).mapInArrow(judge, f"page_id {ddl(ids)}, host string, path string, rule string, verdict string, score double")
