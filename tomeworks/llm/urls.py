"""URL filter: host names split into words by Viterbi under a unigram model, then naive Bayes on host and path words.

The unigram model counts all words of all pages. A run of letters is split by the words that occur in it, however rare or long:
its substrings are joined with the counts, so each run travels with its own few words and no vocabulary goes to the driver or
to all workers. Runs are split once each, whatever the number of URLs that hold them, and joined back to the URLs.

Naive Bayes is multinomial with additive smoothing, trained on a small labelled table of URLs, which are segmented in the same
way. All words of that table count, those of its hosts and those of its paths; others say nothing about a URL.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeworks.llm.common import Maybe, col, free_name, row_udf, struct
from tomeworks.session import stored

#: Letters by which words are looked up; longer ones are compared as well.
KEY = 30
#: Share of all words that a word of the labelled table counts as, at least.
SEED_SHARE = 1e-4
SMOOTHING = 0.1
#: Share of URLs that are expected to be unwanted; the categories of the labelled table share it in proportion to their rows.
UNWANTED = 0.25
FIELDS = ["host", "host_words", "path_words", "category", "score", "blocked"]
OK = "ok"
_URL = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://)?(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:\s]*)(?::\d*)?([^?#]*)")
_PART = re.compile(r"[^\W\d_]+|\d+")
_ADDRESS = re.compile(r"\[.*\]|\d+(?:\.\d+){3}")
#: Labels that say how a host is reached, and endings.
_SKIP = frozenset("www m com org net edu gov co uk de fr es it io info biz html htm php asp aspx index".split())

#: The labelled table: URLs without their scheme, by category.
LABELLED = {
    "gambling": """casino-win.example.com best-casino.example.net/bonus online-poker.example.com/poker/rooms free-bets.example.org/sports/betting bet-now.example.com/odds jackpot-slots.example.net/slots/free mega-jackpot.example.com
        roulette-royal.example.org/live/roulette lucky-spin.example.com/spin/win bingo-hall.example.net/bingo lotto-results.example.com/lottery/numbers sports-betting.example.org/betting/odds blackjack-club.example.com/casino/blackjack
        poker-stars.example.net/tournament casino-bonus.example.org/free/spins slot-machine.example.com/slots win-big.example.net/jackpot/casino wager-free.example.com/wager gamble-online.example.org/gambling/casino bets-tips.example.com/bets/today
        vegas-casino.example.net/casino/games royal-poker.example.org/poker/bonus bookmaker-odds.example.com/bookmaker/bets casino-lucky.example.net/winner spin-palace.example.com/roulette/bonus bet-bonus.example.net/bet/free lottery-winner.example.org/lotto
        poker-bets.example.com/gamble cash-slots.example.net/slots/jackpot betting-shop.example.com/betting/football casino-online.example.org/blackjack/live jackpot-city.example.net/casino/win""",
    "pharma": """cheap-pills.example.com/pills/buy online-pharmacy.example.net/pharmacy buy-viagra.example.org/viagra/cheap cialis-generic.example.com/cialis/pills discount-meds.example.net/meds/order no-prescription.example.com/prescription/drugs
        weight-loss.example.org/diet/pills diet-pills.example.com/weight/loss cheap-meds.example.net/generic/meds pharma-discount.example.com/pharma pills-online.example.org/buy/pills steroids-shop.example.net/steroids/order
        rx-drugs.example.com/rx/discount canadian-pharmacy.example.org/viagra/cialis generic-pills.example.net/tablets tablets-direct.example.com/tablets/dose miracle-diet.example.org/diet/supplements supplements-shop.example.net/supplements/cheap
        buy-meds.example.com/prescription/free drugs-store.example.org/drugs/cheap pharmacy-express.example.net/pharmacy/pills viagra-online.example.com/viagra/generic slim-fast.example.org/weight/pills cheap-drugs.example.com/pills/discount
        meds-rx.example.net/rx/meds dose-direct.example.com/dose/drugs pain-pills.example.org/pills/overnight cialis-cheap.example.net/cialis/discount pills-shop.example.com/pharma/pills hormone-supplements.example.net/steroids""",
    "adult": """adult-zone.example.com/xxx free-porn.example.net/porn/videos sexy-girls.example.org/girls/hot live-cams.example.com/cams/adult xxx-tube.example.net/xxx/porn nude-pics.example.com/nude/girls escort-service.example.org/escorts
        adult-dating.example.net/hookup/sex hot-webcam.example.com/webcam/sexy sex-chat.example.org/sex/cam porn-hub.example.com/porn/milf erotic-stories.example.net/erotic/adult fetish-club.example.org/fetish/xxx strip-show.example.com/strip/nude
        naked-girls.example.net/naked/pics milf-cams.example.com/milf/live escorts-city.example.org/escort/girls sex-video.example.net/sex/hot adult-toys.example.com/adult/sexy webcam-sex.example.org/webcam/nudes porn-videos.example.net/xxx/adult
        hookup-tonight.example.com/hookup/hot fans-only.example.org/nudes/sexy cam-girls.example.net/cam/nude hot-porn.example.com/porn/free sexy-cams.example.org/escorts/erotic adult-video.example.net/adult/xxx nude-cams.example.com/sex/live""",
    "ads": """ads-track.example.com/click ad-server.example.net/banner click-tracker.example.org/track/pixel banner-ads.example.com/ads/popup pixel-tracking.example.net/pixel tracker-ads.example.org/ad/click affiliate-links.example.com/affiliate/redirect
        popup-ads.example.net/popup adnetwork-click.example.com/adnetwork sponsor-banner.example.org/sponsor/ads promo-click.example.net/promo/redirect analytics-pixel.example.com/analytics/track doubleclick-ads.example.org/ads redirect-tracker.example.net/redirect/click
        ad-banners.example.com/banners/ad clicks-affiliate.example.org/clicks/affiliates track-user.example.net/tracking/pixel serve-ads.example.com/ads/serve ads-network.example.org/adserver/banner adserver-track.example.net/track/ad
        affiliates-promo.example.com/affiliates/click banner-click.example.org/click/banner tracking-ads.example.net/tracking/ads popup-server.example.com/popup/ad click-ads.example.org/clicks/ad retarget-pixel.example.net/pixel/ads""",
    "spam": """spam-farm.example.com/backlinks free-money.example.net/cash/fast earn-cash.example.org/earn/money get-rich.example.com/rich/quick loan-fast.example.net/loans/easy crypto-giveaway.example.org/crypto/free replica-watches.example.com/replica
        fake-bags.example.net/fake/designer seo-backlinks.example.org/seo/links buy-backlinks.example.com/backlink/cheap link-farm.example.net/farm/links warez-crack.example.org/crack/keygen cracked-software.example.com/warez/torrent torrent-free.example.net/torrent
        prize-winner.example.org/prize/giveaway bitcoin-rich.example.com/bitcoin/earn payday-loan.example.net/loan/cash money-easy.example.org/earn/fast clickbait-news.example.com/clickbait free-giveaway.example.net/prize/claim keygen-download.example.org/keygen
        spam-blog.example.com/spam/seo cash-loans.example.net/loans replica-store.example.org/replica/fake spam-links.example.com/spam/backlinks crypto-earn.example.net/crypto/rich easy-cash.example.org/cash/giveaway seo-farm.example.com/spam/farm
        claim-prize.example.net/free/prize hacked-games.example.org/cracked/torrent fast-loan.example.com/loan/easy""",
    OK: """news.example.com/world/politics daily-news.example.org/today/weather science-journal.example.com/articles/physics city-library.example.org/books/history university.example.edu/research/papers school-district.example.org/students/courses
        recipes-kitchen.example.com/recipe/bread garden-club.example.net/plants/flowers travel-guide.example.com/europe/cities maps.example.org/road/map weather-report.example.com/today sports-daily.example.net/football/league music-school.example.org/lessons/piano
        art-museum.example.com/exhibits/painting film-review.example.net/reviews/film photo-gallery.example.org/photos/nature video-course.example.com/learning/video book-store.example.com/shop/books home-garden.example.net/house/garden
        family-history.example.org/family/tree childrens-hospital.example.com/health/children family-doctor.example.net/doctor/appointments public-health.example.org/medicine/health local-government.example.com/council/services state-law.example.org/law/courts
        business-times.example.com/business/finance bank.example.com/account/login money-matters.example.org/finance/saving job-market.example.net/jobs/careers tech-blog.example.com/software/reviews open-source.example.org/code/projects computer-shop.example.net/products/computers
        phone-support.example.com/support/phones web-design.example.org/design/portfolio cloud-docs.example.com/docs/api language-learning.example.net/english/grammar spanish-lessons.example.org/spanish/beginners german-forum.example.com/forum/german french-cooking.example.net/recipes/french
        food-blog.example.com/blog/dinner water-quality.example.org/water/environment energy-agency.example.net/energy/solar climate-data.example.org/climate/data animal-shelter.example.com/animals/adopt animal-farm.example.net/farm/animals farm-market.example.org/farm/vegetables
        space-telescope.example.com/space/images chemistry-notes.example.net/chemistry/lab math-help.example.org/math/algebra biology-class.example.com/biology/cells time-zone.example.net/time/clock weekly-review.example.org/weekly/review short-stories.example.com/stories/short
        press-release.example.net/press/media radio-station.example.org/radio/live green-energy.example.com/green/wind blue-river.example.net/river/boats mountain-hiking.example.org/mountain/trails island-ferry.example.com/sea/island car-repair.example.net/car/service
        train-times.example.org/train/tickets bike-shop.example.com/bike/parts public-library.example.net/library/events national-park.example.org/park/visit international-school.example.com/school/admissions company-team.example.net/about/team contact.example.org/contact
        user-forum.example.com/forum/topic search.example.net/search/results product-reviews.example.org/products/category photo-archive.example.com/archive/photos concert-events.example.net/event/tickets free-download.example.org/download/manual mail.example.com/mail/inbox
        chat-support.example.net/help/chat board-games.example.org/games/board chess-club.example.com/play/chess football-scores.example.net/sports/win team-sports.example.org/team/league college-football.example.com/college/sports cheap-flights.example.net/travel/flights
        student-discount.example.org/students/discount weight-training.example.com/fitness/training healthy-diet.example.net/nutrition/diet the-times.example.org/and/the my-house.example.com/for/you our-world.example.net/of/the best-books.example.org/best/new the-history.example.com/in/old
        blog.example.com/blog/post wiki.example.org/wiki/page docs.example.net/docs/guide help.example.com/help shop.example.org/shop/cart store.example.net/store/item forum.example.com/threads article.example.org/article/science story.example.net/story/family data.example.org/data/public
        hot-springs.example.com/travel/hot girls-school.example.org/school/girls drug-safety.example.net/health/drugs easy-recipes.example.com/easy/dinner fast-trains.example.org/fast/trains prize-fiction.example.net/books/prize money-museum.example.com/museum/money track-field.example.org/sports/track
        banner-printing.example.net/print/banner live-music.example.com/live/music video-games.example.org/games/video free-library.example.net/free/books open-market.example.com/market/trade world-bank.example.org/bank/world loss-prevention.example.net/insurance/loss web-server.example.org/server/setup""",
}


@functools.cache
def training_rows() -> tuple[tuple[str, str], ...]:
    """The labelled table as rows (url, category)."""
    return tuple((f"https://{u}", c) for c, listed in LABELLED.items() for u in listed.split())


def training_table(spark: SparkSession) -> DataFrame:
    """training_rows() as a table (url, category)."""
    return spark.createDataFrame(list(training_rows()), "url string, category string")


class Unigrams:
    """Word probabilities, and Viterbi segmentation of a run of letters under them."""

    def __init__(self, share: dict[str, float]):
        self.log = {w: math.log(p) for w, p in share.items()}
        self.sizes = sorted({len(w) for w in share})

    def unknown(self, n: int) -> float:
        """Log probability of an unknown word of n letters: tenfold less for each letter more."""
        return math.log(1e-6) - n * math.log(10)

    def split(self, name: str) -> list[str]:
        """Likeliest words of a name in lower case; ties: the longest last word. An unknown stretch is one word.

        Its price goes up evenly with its letters, so the best place for one to begin is carried along: names of any length are split.
        """
        best: list[tuple[float, int]] = [(0.0, 0)]
        lead, since = -math.inf, 0  # best score at a place, less what letters up to there would cost
        letter = self.unknown(1) - self.unknown(0)
        for end in range(1, len(name) + 1):
            here = best[end - 1][0] - (end - 1) * letter
            if here > lead + 1e-9:
                lead, since = here, end - 1
            score, start = lead + self.unknown(0) + end * letter, since
            for n in reversed(self.sizes):
                if n > end:
                    continue
                p = self.log.get(name[end - n : end])
                if p is not None and (best[end - n][0] + p > score or (best[end - n][0] + p == score and end - n < start)):
                    score, start = best[end - n][0] + p, end - n
            best.append((score, start))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


def words_in(text: str) -> list[str]:
    return _PART.findall(text)


def parts(url: str) -> tuple[str, list[str], list[str]]:
    """(host, runs of letters or digits in the host's names, those in the path), in lower case. Query and fragment don't count."""
    m = _URL.match(url)
    host, path = m[1].lower().rstrip("."), m[2]
    names = [] if _ADDRESS.fullmatch(host) else [w for w in words_in(host) if w not in _SKIP]
    return host, names, [w for w in words_in(unquote(path).lower()) if w not in _SKIP]


def seeds(rows) -> set[str]:
    """Words of the labelled table that stand alone, in a path or between hyphens: names may be made of them."""
    out = set()
    for url, category in rows:
        if url is not None and category is not None:
            host, _, path = parts(url)
            out |= {w for w in path if w.isalpha()}
            out |= {w for label in host.split(".") if "-" in label for w in words_in(label) if w.isalpha()} - _SKIP
    return out


class Bayes:
    """Multinomial naive Bayes over words; rows are (category, words)."""

    def __init__(self, rows):
        counts: dict[str, Counter] = {}
        n: Counter = Counter()
        for category, words in rows:
            n[category] += 1
            counts.setdefault(category, Counter()).update(words)
        vocabulary = sorted({w for c in counts.values() for w in c})
        bad = sum(v for c, v in n.items() if c != OK)
        self.categories = sorted(n)
        self.prior = {c: math.log(1 - UNWANTED if c == OK else UNWANTED * n[c] / bad) for c in self.categories}
        self.weight: dict[str, dict[str, float]] = {}
        for c in self.categories:
            size = sum(counts[c].values()) + SMOOTHING * len(vocabulary)
            for w in vocabulary:
                self.weight.setdefault(w, {})[c] = math.log((counts[c][w] + SMOOTHING) / size)

    def classify(self, words) -> tuple[str, float]:
        """(likeliest category, log odds of all unwanted categories against OK). Ties go to OK, then to the name first in order."""
        if not self.categories:
            return OK, -1.0
        s = dict(self.prior)
        for w in words:
            for c, x in self.weight.get(w, {}).items():
                s[c] += x
        bad = [v for c, v in s.items() if c != OK]
        top = max(bad, default=-math.inf)
        odds = (top + math.log(sum(math.exp(v - top) for v in bad)) if bad else -30.0) - s.get(OK, -1e3)
        return max(s, key=lambda c: (s[c], c == OK)), odds


class Model:
    """Counts of words, those that count as SEED_SHARE at least, and naive Bayes."""

    def __init__(self, counts: DataFrame, total: int, seeds: set[str], bayes: Bayes | None = None):
        self.counts, self.total, self.seeds, self.bayes = counts, total, seeds, bayes


def counted(pages: DataFrame, html_col="html") -> DataFrame:
    """(w, n): each word of all pages, tags left out, and how often it occurs."""
    text = F.lower(F.regexp_replace(F.coalesce(col(pages, html_col), F.lit("")), r"<(?:script|style)\b[\s\S]*?</(?:script|style)>|<[^>]*>", " "))
    return pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


def _parsed(array: pa.Array) -> pa.Array:
    got = [("", [], []) if u is None else parts(u) for u in array.to_pylist()]
    host, names, path = zip(*got) if got else ((), (), ())
    kind = pa.list_(pa.string())
    return struct(host=pa.array(host, pa.string()), names=pa.array(names, kind), path=pa.array(path, kind))


def parsed(urls: DataFrame) -> DataFrame:
    """(key, host, names, path) of each distinct URL of (url)."""
    once = urls.filter("url IS NOT NULL").distinct()
    return once.select(F.md5("url").alias("key"), row_udf(_parsed, "host string, names array<string>, path array<string>")("url").alias("p")).select("key", "p.host", "p.names", "p.path")


def substrings(runs: DataFrame) -> DataFrame:
    """(id, piece): every string of at most KEY letters that occurs in a run, once; id is the run's hash."""
    at = runs.select(F.xxhash64("run").alias("id"), "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i"))
    most = F.least(F.lit(KEY), F.length("run") - F.col("i") + 1)
    return at.select("id", F.explode(F.transform(F.sequence(F.lit(1), most), lambda n: F.substring("run", F.col("i"), n))).alias("piece")).distinct()


def _split(total: int, seeds: frozenset[str]):
    def call(runs: pa.Array, words: pa.Array) -> pa.Array:
        out = []
        for run, known in zip(runs.to_pylist(), words.to_pylist()):
            if not run.isalpha():
                out.append([run])
                continue
            share = {k["w"]: k["n"] / total for k in known or () if k["w"] in run}
            lengths = {len(s) for s in seeds if len(s) <= len(run)}
            for w in {run[i : i + n] for n in lengths for i in range(len(run) - n + 1)} & seeds:
                share[w] = max(share.get(w, 0.0), SEED_SHARE)
            out.append(Unigrams(share).split(run))
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(call, returnType="array<string>").asNondeterministic()


def segmented(runs: DataFrame, model: Model) -> DataFrame:
    """(run, words) of distinct runs (run). Runs of the same hash share their words, which does no harm: words that aren't in a run say nothing."""
    words = model.counts.select("w", "n", F.substring("w", 1, KEY).alias("piece"))
    there = substrings(runs.filter(F.length("run") > 1)).join(words, "piece").filter((F.length("w") <= KEY) | (F.length("piece") == KEY))
    own = there.groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    return runs.withColumn("id", F.xxhash64("run")).join(own, "id", "left").select("run", _split(max(model.total, 1), frozenset(model.seeds))("run", "known").alias("words"))


def _words_of(urls: DataFrame, model: Model) -> DataFrame:
    """(key, host, host_words, path_words) of parsed URLs."""
    place = lambda name, kind: F.transform(name, lambda run, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), run.alias("run")))
    each = urls.select("key", F.explode(F.concat(place("names", 0), place("path", 1))).alias("e")).select("key", "e.kind", "e.i", "e.run")
    found = each.join(segmented(each.select("run").distinct(), model), "run").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "i", "words"))).alias("s"))
    side = lambda kind: F.coalesce(F.flatten(F.transform(F.filter("s", lambda e: e["kind"] == kind), lambda e: e["words"])), F.array().cast("array<string>"))
    return urls.select("key", "host").join(found, "key", "left").select("key", "host", side(0).alias("host_words"), side(1).alias("path_words"))


def fit(pages: DataFrame, html_col="html", table: DataFrame | None = None) -> Model:
    """Unigrams of all pages and naive Bayes of a labelled table (url, category), by default training_rows(). That table must be small: it is collected.

    Null pages have no words. Labelled rows without URL or category don't count, rows that repeat count each time; without rows nothing is blocked.
    """
    spark = pages.sparkSession
    given = training_rows() if table is None else [(r.url, r.category) for r in table.select("url", "category").collect()]
    rows = [(u, c) for u, c in given if u is not None and c is not None]
    counts, _ = stored(counted(pages, html_col), "words")
    model = Model(counts, counts.agg(F.sum("n")).first()[0] or 0, seeds(rows))
    labelled = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    words = {r.key: [*r.host_words, *r.path_words] for r in _words_of(parsed(labelled), model).collect()}  # as many as the table has
    model.bayes = Bayes([(c, words[md5(u)]) for u, c in rows])
    return model


def md5(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def _judged(bayes: Bayes):
    def call(array: pa.Array) -> pa.Array:
        got = [bayes.classify([*h, *p]) for h, p in zip(array.field("host_words").to_pylist(), array.field("path_words").to_pylist())]
        category, odds = zip(*got) if got else ((), ())
        return struct(category=pa.array(category, pa.string()), score=pa.array(odds, pa.float64()))

    return row_udf(call, "category string, score double")


def judged(urls: DataFrame, model: Model) -> DataFrame:
    """(key, host, host_words, path_words, category, score, blocked) of each distinct URL of (url); key is its MD5."""
    words = _words_of(parsed(urls), model)
    done = words.withColumn("r", _judged(model.bayes)(F.struct("host_words", "path_words")))
    return done.select("key", "host", "host_words", "path_words", "r.category", "r.score", (F.col("r.score") > 0).alias("blocked"))


def classify(pages: DataFrame, model: Model, id_col="page_id", url_col="url") -> DataFrame:
    """(page_id, host, host_words, path_words, category, score, blocked) for every row; blocked if the score, log odds, is above 0.

    Null URL: all null, not blocked. Empty URLs and addresses of numbers have no words: the table's prior decides. Very
    long URLs are read whole, their runs split whatever their length. Repeated rows give repeated results, an empty table none;
    other columns are ignored. Ties: the longest last word, and OK before other categories.
    """
    flat = pages.select(col(pages, id_col).alias("page_id"), col(pages, url_col).alias("url"))
    done = judged(flat.select("url"), model)
    out = flat.select("page_id", F.md5("url").alias("key")).join(done, "key", "left")
    return out.select("page_id", *[F.coalesce("blocked", F.lit(False)).alias(f) if f == "blocked" else F.col(f) for f in FIELDS])


def keep(pages: DataFrame, model: Model, url_col="url") -> DataFrame:
    """The rows of pages, unchanged, whose URL isn't blocked: null URLs stay, rows that repeat stay or go together.

    URLs count whole; a score of 0 stays; an empty table gives no rows; extra columns may have any names.
    """
    url = lambda df: F.md5(col(df, url_col))
    key, maybe = free_name(pages, "_blocked"), free_name(pages, "_maybe")
    blocked, _ = stored(judged(pages.select(col(pages, url_col).alias("url")), model).filter("blocked").select(F.col("key").alias(key)), "blocked")
    mark = pages.withColumn(maybe, Maybe(blocked, key).has(url(pages)))  # only pages that may be blocked move
    rest = mark.filter(F.col(maybe)).drop(maybe)
    return mark.filter(~F.col(maybe)).drop(maybe).unionByName(rest.join(blocked, url(rest) == F.col(key), "left_anti"))
