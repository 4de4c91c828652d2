"""URL filter: fixed rules first, then a logistic regression on hashed character
n-grams of host and path, trained from a small labelled table of URLs.

A rule has a host and a path; it fits its host and all subdomains, if the path
of the URL starts with its own. The longest fitting rule decides. Rules and the
labelled table are parameters of bounded size, and the model is a vector of
fixed length, so all of it travels with the tasks; pages are read once, url and
id only.

Defined results: a null URL, or one without "://", has an empty host and path;
no rule fits it, and the model, which sees no n-grams, judges it by its bias,
which allows. Equal rows get equal results. Ids may be null. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ALLOW, BLOCK = "allow", "block"
#: Verdict, host and path of each rule.
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
BUCKETS, SIZES, THRESHOLD = 1 << 14, (3, 4, 5), 0.5

# The labelled table: hosts with paths, for training.
UNWANTED = """
www.casino-win.example.com/en/884 casino-royal.example.net/bonus best-casino.example.org/slots lucky-slots.example.com/de/77.html online-poker.example.net/fr/381
poker-stars-free.example.org/join win-jackpot.example.com/es/12 bet-big.example.net/odds sports-bets.example.org/en/4981 roulette-online.example.com/game
spam-farm.example.net/en/29 link-farm.example.org/links seo-spam.example.com/de/5718 cheap-links.example.net/buy m.spam-blog.example.org/fr/8345
blog.cheap-pills.example.com/en/1025 viagra-online.example.net/order pharmacy-discount.example.org/cialis pills-store.example.com/cheap cheap-meds.example.net/es/2774
xxx-videos.example.org/watch free-porn.example.com/en/3160 adult-cams.example.net/live adult-chat.example.org/de/96 m.adult-x.example.com/es/4247
free-money.example.net/get get-rich-fast.example.org/start quick-loan.example.com/apply payday-loans.example.net/fr/461 free-wager.example.com/en/7817
crack-software.example.org/keygen warez-download.example.com/full torrent-free.example.net/movie free-spins.example.org/de/8817 hacked-apps.example.com/apk
phish-login.example.net/verify account-verify-now.example.org/login ads-track.example.com/en/5450 ad-tracker.example.net/pixel banner-ads.example.org/fr/6750
click-here-win.example.com/prize free-iphone.example.net/claim track-click.example.org/en/8695 fake-rolex.example.com/buy replica-bags.example.net/sale
casino-bonus.example.org/free poker-bonus.example.com/win spam-links.example.net/de/3 cheap-viagra.example.org/pills xxx-adult.example.com/porn
www.casino-online.example.net/slots online-casino.example.com/jackpot jackpot-slots.example.org/en/70 win-slots.example.net/bonus betting-odds.example.com/sports
adult-videos.example.org/xxx porn-cams.example.net/free live-cams.example.com/adult sexy-chat.example.org/live hot-porn.example.com/videos
cheap-pharmacy.example.net/meds online-pharmacy.example.org/viagra diet-pills.example.com/buy discount-pills.example.net/order buy-meds.example.org/cheap
buy-links.example.com/seo link-spam.example.net/farm seo-links.example.org/cheap click-ads.example.com/track tracker-pixel.example.net/ads
free-download.example.org/crack keygen-download.example.net/full cracked-apps.example.com/hack hack-tools.example.org/warez movie-torrent.example.net/free
verify-login.example.com/account login-verify.example.org/phish claim-prize.example.net/win prize-winner.example.com/claim fast-loan.example.org/payday
replica-rolex.example.net/fake fake-bags.example.com/replica rich-quick.example.org/money money-fast.example.net/rich loans-payday.example.com/quick
""".split()
WANTED = """
www.city-library.example.com/books news-daily.example.net/en/12 blog.garden-notes.example.org/fr/381 recipes.example.com/soup docs.project.example.net/guide
university.example.org/de/1848 school-portal.example.com/calendar museum.example.net/exhibits weather-report.example.org/en/884 science-journal.example.com/paper
www.carpenter.example.net/en/417 m.harbour.example.org/de/52 blog.stations.example.com/fr/903 northern.example.net/es/15.html nutrition.example.org/en/2207
www.handwerk.example.com/de/640?page=2 owners.example.net/fr/71 homestead.example.org/en/338 herons.example.com/es/59/ clothing.example.net/es/6104.html
m.saturday.example.org/en/91 thursday.example.com/de/7 thirteen.example.net/fr/2050 www.another.example.com/en/411 blog.thread.example.org/es/18
history-archive.example.com/fr/461 travel-guide.example.net/rome bicycle-repair.example.org/chain open-maps.example.com/berlin music-theory.example.net/chords
parliament.example.org/en/5450 court-records.example.com/case health-service.example.net/clinic hospital.example.org/visit water-works.example.com/de/96
programming.example.net/python compiler-notes.example.org/lexer linux-howto.example.com/en/3160 database.example.net/index mathematics.example.org/proof
bird-watching.example.com/finch chess-club.example.net/openings theatre.example.org/program orchestra.example.com/season film-review.example.net/es/12
village-news.example.org/council farmers-market.example.com/apples railway.example.net/de/5718 bookshop.example.org/novel language-course.example.com/verbs
city-museum.example.com/en/31 library-books.example.net/de/904 school-news.example.org/fr/26 university-press.example.com/es/77 science-museum.example.net/en/1204
www.gardening.example.org/de/3 blog.weather.example.com/en/59 m.travel.example.net/fr/812 history-books.example.org/es/6 news-archive.example.com/en/2450
www.wandern.example.com/de/118 m.bibliothek.example.net/de/64 blog.rathaus.example.org/de/9 zeitung.example.com/de/7301 kochrezepte.example.net/de/25
www.mairie.example.com/fr/480 m.bibliotheque.example.org/fr/15 blog.cuisine.example.net/fr/96 journal.example.com/fr/733 voyages.example.org/fr/8
www.biblioteca.example.com/es/41 m.ayuntamiento.example.org/es/209 blog.cocina.example.net/es/17 noticias.example.com/es/3 montana.example.org/es/88
walking-routes.example.com/alps mountain-huts.example.org/en/6 sailing-school.example.net/en/39 ski-trails.example.com/de/44 camping-guide.example.org/fr/2
theory-notes.example.org/en/27 whether-or-not.example.net/en/90 the-third-thing.example.com/en/8 that-other-theatre.example.org/es/5 tennis-thursday.example.net/de/70
chess-news.example.com/en/14 bird-club.example.org/en/602 hospital-visit.example.net/en/5 railway-guide.example.com/en/83 music-school.example.org/en/190
""".split()


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host.translate(_LOWER), path[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """Name and verdict of the longest rule that fits."""
    fits = [(h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: (len(x[0]), x[0]), default=None)


def buckets(host: str, path: str) -> np.ndarray:
    """Distinct hash buckets of the character n-grams of host and path."""
    out = set()
    for kind, s in ((b"h", host), (b"p", path)):
        raw = b"^" + s.encode("utf-8", "surrogatepass") + b"$" if s else b""
        for n in SIZES:
            out.update(zlib.crc32(kind + raw[i : i + n]) % BUCKETS for i in range(len(raw) - n + 1))
    return np.fromiter(sorted(out), dtype=np.int64, count=len(out))


class Classifier:
    """Logistic regression; a text's features have length one."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, host: str, path: str) -> float:
        b = buckets(host, path)
        z = self.bias + (self.weights[b].sum() / np.sqrt(len(b)) if len(b) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def train(labelled: list[tuple[str, int]], rounds: int = 2000, rate: float = 4.0, penalty: float = 1e-4) -> Classifier:
    """labelled: (url, 1 for unwanted). Gradient steps from zero, on the rows'
    multipliers: the weights are sums of rows. The result depends on the table
    alone."""
    rows = [(buckets(*split_url(u)), y) for u, y in labelled]
    x = np.zeros((len(rows), BUCKETS))
    for i, (b, _) in enumerate(rows):
        if len(b):
            x[i, b] = 1 / np.sqrt(len(b))
    y, near, a, bias = np.array([y for _, y in rows], dtype=np.float64), x @ x.T, np.zeros(len(rows)), -1.0
    for _ in range(rounds if len(rows) else 0):
        gap = y - 1 / (1 + np.exp(-(near @ a + bias)))
        a += rate * (gap - penalty * a) / max(1.0, len(rows) / 20)
        bias += 0.02 * float(gap.mean())
    return Classifier(x.T @ a, float(bias))


def labelled_table() -> list[tuple[str, int]]:
    return [(f"http://{u}", 1) for u in UNWANTED] + [(f"http://{u}", 0) for u in WANTED]


def judge(pages: DataFrame, rules=RULES, model: Classifier | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every row."""
    model = train(labelled_table()) if model is None else model
    kind = pages.schema["page_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                rows = []
                for u in part.column(1):
                    host, path = split_url(u.as_py())
                    rule, score = rule_for(host, path, rules), model.score(host, path)
                    rows.append((host, path, rule and rule[0], score, rule[1] if rule else BLOCK if score >= threshold else ALLOW))
                columns = [pa.array(c, pa.float64() if i == 3 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), *columns], names=["page_id", "host", "path", "rule", "score", "verdict"])

    return pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(run, f"page_id {kind.simpleString()}, host string, path string, rule string, score double, verdict string")
