"""URL filters (operator 3).

Rules come first: a rule is a host and a path; it fits its host and all
subdomains if the URL's path starts with the rule's; of several, the longest
wins.  URLs without a rule are judged by logistic regression on hashed character
n-grams (three to five characters) of host and path, trained on a small labelled
URL table by full-batch gradient descent, alike on every run.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end.  A null URL, or one without
``://``, has an empty host and path and no rule; the model judges it like any
other, by its intercept alone.  Repeated rows get equal results; input columns named like added
ones give way to them; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docmill.llm.common import map_arrow, room_for, spare_name, table, with_fields

#: (verdict, host and path), as given.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BITS, GRAMS, PATH_WEIGHT, THRESHOLD = 15, (3, 4, 5), 0.3, 0.5
PRIOR = -1.0  # the intercept: most sites are ordinary, and so is what tells nothing
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Labelled URLs without scheme: hosts and paths of unwanted sites (medicine spam, gambling, adult, search-engine
#: spam, fraud, tracking, piracy), and of ordinary ones.
UNWANTED = """
viagra-online.com/buy buyviagra.net/order-now cialis-discount.info/cheap generic-cialis.org/pills xanax-no-prescription.com/shop pharmacy-discount.net/cheap-meds canadian-pharmacy.biz/pills diet-pills-now.com/order slimming-pills.info/offer cheapmeds24.net/checkout
online-casino.biz/bonus casinoslots.com/free-spins vegas-casino-bonus.net/jackpot royalcasino.info/slots poker-bonus.org/deposit pokerstake.com/win sports-betting.biz/odds betting-tips.info/free bets24.net/live win-big-bets.com/bonus roulette-winner.net/play lottery-winner.info/claim bingo-jackpot.com/win
porn-videos.com/watch freeporn.net/clips xxx-movies.org/hd xxxcams.com/live sex-chat.net/girls hot-sex-videos.info/watch adultdating.biz/meet adult-webcams.com/live nude-girls.net/gallery escort-girls.org/city milf-cams.net/live erotic-stories.info/read
spam-blast.com/send bulk-email-spam.net/lists buy-backlinks.biz/seo cheap-backlinks.com/order linkfarm.net/directory link-farm-seo.info/page article-spinner.org/seo auto-content-spam.net/post buy-followers.com/likes rank-fast-seo.biz/links
get-rich-fast.com/money easy-money-online.net/earn free-money-now.info/win payday-loans-fast.com/apply instant-loans.biz/cash bitcoin-doubler.org/invest crypto-giveaway.net/claim free-iphone-winner.com/prize replica-watches.biz/sale replica-handbags.net/cheap work-at-home-cash.info/earn
ads-server.com/track adserver.net/click adtracker.biz/pixel click-tracker.net/redirect banner-ads.info/click popup-ads.com/serve tracking-pixel.org/track trackclicks.net/go doubleads.com/impression affiliate-tracker.biz/click
free-cracks.net/keygen warez-download.com/serial keygen-crack.info/download torrent-pirate.org/free account-verify-login.com/signin paypal-secure-verify.net/account malware-setup.biz/install.exe free-antivirus-scan.info/alert miracle-cure.com/secret weight-loss-miracle.net/order
""".split()
ORDINARY = """
news.com/world/2020/election blog.com/posts/spring-walk docs.org/guide/install university.edu/research library.org/catalogue museum.com/en/exhibitions weather.net/forecast travel.com/fr/paris recipes.org/soup/onion sports.com/results/football
health.org/advice/sleep school.net/timetable city.org/de/rathaus government.gov/forms/tax science.com/articles/cells history.org/es/roma music.net/reviews books.com/novels/12 cinema.org/listings garden.com/roses
shop.com/basket store.org/shoes/42 jobs.net/engineer forum.com/thread/9 wiki.org/page/Tree code.com/project/readme maps.org/route photos.net/album/3 mail.com/inbox support.org/contact
about.com/team status.net/history city-council.org/en/meetings new-york-travel.com/hotels daily-news.net/politics open-source-software.org/download state-library.edu/search national-park.org/trails language-school.com/es/courses art-gallery.net/de/paintings
m.weather-report.com/today www.daily-recipes.org/fr/bread blog.data-science.net/en/regression www.car-repair.com/brakes history-of-music.org/baroque www.town-hall.net/de/termine books-and-maps.com/atlas blog.travel-stories.org/es/lima kitchen-garden.net/herbs www.children-hospital.org/visit
hamilton.com/en/1 richter.net/de/22 moreau.org/fr/43 castillo.com/es/64 blog.henderson.net/en/85 www.lindqvist.org/de/106 m.beaumont.com/fr/127 oliveira.net/es/148 www.thornbury.org/en/169 ashford.com/en/190
www.berliner-zeitung.com/de/kultur lemonde-info.org/fr/culture elpais-diario.net/es/deportes guardian-post.com/en/opinion blog.winterfell.net/en/snow www.oakland-theatre.org/en/tickets riverside-clinic.com/en/doctors northern-railway.net/en/timetable blog.mountain-hiking.org/de/alpen physics-institute.edu/en/lectures
bakery.com/bread airport.org/departures orchestra.net/concerts stadium.com/matches theatre.org/tickets village.net/market harbour.com/ferries castle.org/tours observatory.edu/stars bridge.net/history
power-company.com/tariffs tower.org/visit answers.net/questions farmers-market.org/stalls newspapers.com/archive teachers.org/lessons computers.net/laptops writers-club.org/poems winter-sports.com/skiing betterhomes.net/kitchens
sea-life.org/whales sussex-county.org/roads alphabet.net/letters cashmere-knitting.com/patterns seoul-guide.net/markets linked-data.org/ontology trackfield.com/races adventure.org/climbing executive-education.edu/courses advice-bureau.org/housing
""".split()


def parts(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest fitting rule as (verdict, rule); of equally long ones the first."""
    best = None
    for verdict, rule in rules:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed character n-grams and their values: those of the host and of the path hash
    apart, each side has a length of its own, and the host, which names the site, weighs more."""
    at, values = [], []
    for mark, text, weight in (("h", f"^{host}$", 1.0), ("p", f"^{path}$", PATH_WEIGHT)):
        grams = {f"{mark}{text[i : i + n]}" for n in GRAMS for i in range(len(text) - n + 1)}
        own = np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for g in grams), np.int64, len(grams)))
        at.append(own)
        values.append(np.full(len(own), weight / np.sqrt(max(len(own), 1))))
    return np.concatenate(at), np.concatenate(values)


def variants(url: str) -> list[str]:
    """The URL under several subdomains and top domains, which say nothing of the site and are then learned as such."""
    host, slash, path = url.partition("/")
    name = host.removeprefix("www.").removeprefix("blog.").removeprefix("m.")
    name = name.rpartition(".")[0] or name
    return [url, *(f"{before}{name}.{after}{slash}{path}" for before, after in (("", "com"), ("www.", "com"), ("m.", "net"), ("blog.", "org"), ("", "example.com"), ("www.", "example.org"), ("m.", "example.net"), ("shop.", "info")))]


def train(unwanted: list[str] = UNWANTED, ordinary: list[str] = ORDINARY, rounds: int = 400, rate: float = 2.0, shrink: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights by hash and the intercept."""
    rows = [(1.0, v) for u in unwanted for v in variants(u)] + [(0.0, v) for u in ordinary for v in variants(u)]
    y = np.array([label for label, _ in rows])
    x = np.zeros((len(rows), 1 << BITS))
    for i, (_, u) in enumerate(rows):
        at, values = features(*parts(f"http://{u}"))
        np.add.at(x[i], at, values)
    used = np.flatnonzero(x.any(axis=0))
    x, w, b = x[:, used], np.zeros(len(used)), PRIOR
    share = np.where(y > 0, 7.0 / max(y.sum(), 1), 7.0 / max(len(y) - y.sum(), 1))  # both classes weigh alike
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ (error * share) + shrink * w)
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, float(b)


_model: list[tuple[np.ndarray, float]] = []


def probability(host: str, path: str, model: tuple[np.ndarray, float]) -> float:
    at, values = features(host, path)
    return float(1 / (1 + np.exp(-(model[0][at] @ values + model[1]))))


def judge(pages: DataFrame, *, url: str = "url", keep: list[str] | None = None, rules=RULES) -> DataFrame:
    """``keep`` columns (all by default) plus ``host``, ``path``, ``rule``, ``probability`` and ``verdict``.
    One pass without a shuffle; the weights (2^15 numbers) travel with the function."""
    added = "host string, path string, rule string, probability double, verdict string"
    keep = room_for(list(pages.columns) if keep is None else keep, added)
    schema = with_fields(pages.select(*keep).schema, added)
    if not _model:
        _model.append(train())
    model = _model[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)).to_pylist():
                host, path = parts(value)
                rule, p = rule_of(host, path, rules), probability(host, path, model)
                rows.append((host, path, rule[1] if rule else None, p, rule[0] if rule else "block" if p >= THRESHOLD else "allow"))
            added = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(list(c), k) for c, k in zip(added, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()), strict=True))], names=schema.names)

    return map_arrow(pages.select(*keep, pages[url].alias(spare_name(keep))), run, schema)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])
