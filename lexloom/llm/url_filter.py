"""URL filter: logistic regression on hashed character n-grams of host and path.

Trained by numpy stochastic gradient descent from a small labelled table of URLs: LABELLED, or one
that the caller gives. N-grams of the host and of the path are different features.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import _common as c

GRAMS, BITS, EPOCHS = (3, 4, 5), 14, 40
#: A URL is rejected from this probability.
REJECT = 0.5
#: Rows of a labelled table that a model is made from, by hash of the URL.
SAMPLE = 20_000
#: Made-up hosts of the usual block-list categories: gambling, pharmacy, adult, loans and prizes, counterfeits, link farms
#: and auto-generated pages, advertising and tracking, malware and phishing, pirated files.
_BAD_HOSTS = (
    "royal-casino-bonus.com vegasslots777.net bestonlinepoker.biz free-spins-casino.co betting-tips-today.com livebet365win.xyz sportsbookodds.top jackpotcity-slots.info roulette-winner.online bingo-bonus-codes.net "
    "cheap-viagra-online.com canadian-pharmacy-rx.net buy-cialis-now.biz discount-pills24.com weightloss-miracle-pills.info rx-meds-noprescription.top steroid-shop-eu.com keto-diet-pills.xyz "
    "hot-xxx-videos.com freeporntube.xxx adult-webcams-live.net sexdating-local.com milf-hookup.club nude-girls-pics.top escort-service-city.com hentai-porn-hd.net "
    "payday-loan-fast.com instant-cash-advance.net bad-credit-loans.biz win-free-iphone.club claim-your-prize.top free-giftcards-now.xyz lottery-winner-claim.info make-money-fast-home.com get-rich-trading.online bitcoin-doubler.top crypto-profit-bot.xyz forex-robot-profit.com "
    "replica-watches-sale.com cheap-rolex-replica.net fake-designer-bags.shop louis-outlet-discount.top knockoff-sneakers.biz "
    "seo-backlinks-cheap.com buy-backlinks.net link-farm-directory.info article-spinner-spam.com free-web-directory-links.biz expired-domains-traffic.top buy-instagram-followers.com autoblog-content-feed.xyz keyword-stuffed-pages.info doorway-pages.net spam-mailer-pro.com bulk-email-lists.biz "
    "ad-server-click.net adsserving.com popunder-ads.xyz clicktrack-ads.com tracking-pixel-cdn.net banner-ads-network.biz analytics-tracker-js.com affiliate-offers-track.com doubleads.top push-ads-notify.club "
    "free-malware-scan.com download-codec-update.xyz flash-player-update.top secure-login-verify.tk account-update-paypa1.ml phishing-bank-login.ga virus-alert-support.online "
    "warez-torrent-download.com crack-serial-keygen.net free-movies-torrent.xyz pirated-software.top nulled-scripts.biz mp3-free-download-hits.info"
).split()
#: Made-up hosts of ordinary sites.
_GOOD_HOSTS = (
    "www.morningherald.com dailygazette.co.uk news.valleytimes.org www.lesoirdelyon.fr elcorreodelsur.es www.nordkurier-zeitung.de tribune-review.ca observer.ie metro-chronicle.com weather.coastalnews.net "
    "www.riverside-university.edu cs.northlake.edu library.stmarys.ac.uk physics.uni-seeburg.de www.lycee-pasteur.fr archive.historical-society.org museum-of-science.org journals.openpress.org math.institute.edu research.greenfield.ac.uk "
    "www.cityofoakridge.gov health.state.gov www.parliament.gov.uk rathaus.bergstadt.de mairie-villeneuve.fr publiclibrary.org nationalparks.gov courts.county.gov census.gov.ie police.town.gov "
    "www.gardeningweekly.com thecookbook.blog recipes.grandmaskitchen.com travel-notes.org hikingtrails.net photography-basics.com birdwatchers.org chess-club.org classicalmusic.net bookreviews.com knitting-patterns.co.uk woodworking-shop.com astronomy-forum.org "
    "docs.pythonlibs.org developer.opensource.io forum.linuxhelp.net wiki.retrocomputing.org blog.databases.dev www.softwarefreedom.org stackforum.com mail.cloudservices.com status.webhost.net api.mapsproject.org "
    "hospital-stjohn.org www.childrenshealth.org redcross-chapter.org animal-shelter.org communitychurch.org farmersmarket.coop www.theatre-royal.co.uk cityorchestra.org football-club.de www.tennisfederation.org marathon.org yoga-studio.com "
    "www.familydentist.com hotel-alpenblick.at bakery-dumoulin.fr insurance-advice.co.uk carrepair-johnson.com architecture-studio.ch winery-castello.it bikeshop.nl realestate-brown.com furniture-store.se furniture.co.jp lawfirm-miller.com"
).split()
_PATHS = ("/", "/en/12", "/2019/05/title-of-story.html", "/fr/67.html", "/articles?page=2&ref=home", "/about", "/news/local/741", "/blog/a-day-in-the-hills", "/wiki/Main_Page#top", "/contact.html", "/courses/101/syllabus", "/shop/product/8812")
_BAD_PATHS = ("/cheap-pills/buy-now", "/casino/bonus?aff=99", "/xxx/free-videos", "/win-prize.php?id=1", "/viagra-online.html", "/spam/links.html", "/click?adid=77&track=1", "/free-download-crack.exe", "/poker/free-spins", "/payday-loan/apply", "/porn/hd", "/wp-login.php?phish=1")
#: (url, bad): the default labelled table.
LABELLED = (
    [(f"https://{h}{_PATHS[i % len(_PATHS)]}", 1) for i, h in enumerate(_BAD_HOSTS)]
    + [(f"http://{h}{p}", 0) for i, h in enumerate(_GOOD_HOSTS) for p in (_PATHS[i % len(_PATHS)], _PATHS[(i + 5) % len(_PATHS)])]
    + [(f"http://{_GOOD_HOSTS[(7 * i) % len(_GOOD_HOSTS)]}{p}", 1) for i, p in enumerate(_BAD_PATHS)]
)
_SCHEME = re.compile(r"(?:[a-z][a-z0-9+.-]*+:)?//")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL in lower case, without scheme, user, port and fragment; as the Spark columns.
    A scheme stands at the start only; the host of an IPv6 address keeps its brackets."""
    u = (url or "").strip(" ").lower()
    m = _SCHEME.match(u)
    u = (u[m.end() :] if m else u).split("#", 1)[0]
    cut = min([k for k in (u.find("/"), u.find("?")) if k >= 0], default=len(u))
    host = u[:cut].rpartition("@")[2]
    end = host.find("]")
    return host[: end + 1] if host.startswith("[") and end > 0 else host.split(":", 1)[0], u[cut:]


def _part_columns(url):
    u = F.lower(F.trim(F.coalesce(url.cast("string"), F.lit(""))))
    u = F.regexp_replace(F.regexp_replace(u, r"\A(?:[a-z][a-z0-9+.-]*+:)?//", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_extract(u, r"(?s)\A([^/?]*)", 1), r"(?s)\A.*@", "")
    path = F.regexp_replace(u, r"(?s)\A[^/?]*", "")
    return F.regexp_extract(host, r"(?s)\A(\[[^\]]+\]|[^:]*)", 1), path


def buckets(column: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each row's n-grams, ^ and $ standing for the ends, and row offsets."""
    raw = [b"^" + (s or "").encode() + b"$" for s in column.to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(raw)), np.diff(at))
    idx, who = [], []
    for g in GRAMS:
        m = len(data) - g + 1
        if m <= 0:
            continue
        h = np.full(m, salt * 31 + g, np.uint64)
        for j in range(g):
            h = h * np.uint64(0x100000001B3) + data[j : j + m] + np.uint64(1)
        ok = np.arange(m) + g <= at[1:][row[:m]]
        idx.append((c.mix(h[ok]) >> np.uint64(64 - BITS)).astype(np.int64))
        who.append(row[:m][ok])
    if not idx:
        return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
    idx, who = np.concatenate(idx), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return idx[order], np.searchsorted(who[order], np.arange(len(raw) + 1))


def train(urls: list[str], bad: list[int], epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights of host features, path features and, last, the bias."""
    split = [parts(u) for u in urls]
    feats = [buckets(pa.array([s[k] for s in split], pa.string()), k) for k in (0, 1)]
    w, ada = np.zeros((2 << BITS) + 1), np.full((2 << BITS) + 1, 1e-2)
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(len(urls)):
        idx = np.concatenate([feats[k][0][feats[k][1][i] : feats[k][1][i + 1]] + (k << BITS) for k in (0, 1)])
        rows.append(np.append(np.unique(idx), 2 << BITS))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            p = 1 / (1 + np.exp(-w[rows[i]].sum()))
            g = (p - bad[i]) + 1e-4 * w[rows[i]]
            ada[rows[i]] += g * g
            w[rows[i]] -= 0.1 * g / np.sqrt(ada[rows[i]])
    return w


def score(w: np.ndarray, host: pa.Array, path: pa.Array) -> np.ndarray:
    """Probability that each URL is bad; a repeated n-gram counts once."""
    z = np.full(len(host), w[-1])
    for k, column in ((0, host), (1, path)):
        idx, at = buckets(column, k)
        row = np.repeat(np.arange(len(host)), np.diff(at))
        one = np.unique((row << (BITS + 1)) + idx)
        z += np.bincount(one >> (BITS + 1), w[(one & ((1 << BITS) - 1)) + (k << BITS)], len(host))
    return 1 / (1 + np.exp(-z))


def filter_urls(spark: SparkSession, pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, p_bad, keep) of every row of ``pages``.

    ``labelled`` has columns url and bad (1 or 0); rows with a NULL there are not used, and of more than SAMPLE rows those of
    the least hashes train. If none is left, nothing is known to be bad: p_bad is 0. A NULL or empty URL has p_bad 1
    and is not kept; long URLs are read whole; a NULL page_id stays NULL; rows that repeat are scored each; a p_bad of
    REJECT exactly is rejected; an empty table gives no rows; of the columns, whatever they are, only page_id and url are read.
    """
    rows = LABELLED
    if labelled is not None:
        given = labelled.select(labelled["url"].cast("string").alias("u"), labelled["bad"].cast("int").alias("b")).where("u is not null and b is not null")
        rows = [(r[0], int(r[1])) for r in given.orderBy(F.xxhash64("u"), "u", "b").limit(SAMPLE).collect()]
    model = spark.sparkContext.broadcast(train([r[0] for r in rows], [r[1] for r in rows]) if rows else None)

    def run(batches):
        for batch in batches:
            p = score(model.value, batch.column("host"), batch.column("path")) if model.value is not None else np.zeros(len(batch))
            none = np.array([not (u or "").strip() for u in batch.column("url").to_pylist()], bool)
            p[none] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(p), pa.array(p < REJECT)], ["page_id", "url", "host", "p_bad", "keep"])

    host, path = _part_columns(pages["url"])
    return pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), host.alias("host"), path.alias("path")).mapInArrow(run, "page_id bigint, url string, host string, p_bad double, keep boolean")
