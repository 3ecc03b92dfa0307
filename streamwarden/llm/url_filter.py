"""Judging URLs: stated rules first, then logistic regression on hashed character n-grams.

Everything runs in the JVM: n-grams come from SQL functions, Spark ML hashes and fits.
The training table is small and stated; the texts of host and path keep apart features.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import picked

FEATURES = 1 << 14
GRAMS = (3, 4)
ALLOW, BLOCK = "allow", "block"

# The labelled table: hosts (and paths) of invented and typical sites, by kind. Each is tried under several page paths.
BLOCKED_SITES = """
casino-royal.com spincasino.net mycasino777.org grandcasino.example.com casinobonus.example.net poker-stars-club.com pokerroom.net
onlinepoker.example.org holdempoker.info slots-mania.com freeslots.net megaslots.example.com jackpot-city.com bigjackpot.net
roulette-wheel.org liveroulette.example.net bet-and-win.com sportsbet.net betting-tips.org freebets.example.com bets4all.net gambling-guide.com
onlinegambling.example.org gamble-now.net bingo-hall.com lotto-winner.net blackjack-table.com wagering.example.net bookmaker-odds.com
cheap-pills.com pillstore.net buy-viagra-now.com viagra-direct.org cialis-online.net generic-meds.com discount-pharmacy.net rx-pharma.example.com
pharmaonline.example.net diet-pills.org weightloss-miracle.com steroid-shop.net tablets-no-prescription.com kamagra.example.org
payday-loan.com quick-loans.net instantcash-loans.org badcredit-loan.example.com fastcash-advance.net paydaycredit.example.org loan-shark.info
adult-chat.com adultvideos.net hot-adult.example.org xxx-movies.com freexxx.net xxxtube.example.com porn-hub-free.net pornvideos.org
sexcams.com sex-dating.net nude-girls.org livecams.example.net escorts-city.com escort-service.net webcam-sex.example.org hookup-tonight.com
adserver.net ads-network.com ad-banner.example.net banner-ads.org trackpixel.com click-tracker.net tracker.example.com adstrack.example.org
popup-ads.net popunder.com clickbait-farm.org affiliate-clicks.com redirect-click.example.net spamfarm.net spam-links.com linkfarm.example.org
seo-spam.net phishing-page.com secure-login-verify.net account-verify-login.com paypa1-login.org bank-login-update.net signin-confirm.example.com
phish.example.net wallet-unlock-verify.org free-gift-cards.com win-a-prize.net claim-your-prize.org lucky-winner.example.com crypto-doubler.net
warez-download.com crack-keygen.net serialkeys.org free-cracked-apps.example.com torrent-warez.net malware-drop.com trojan.example.net
fake-watches.com replica-bags.net replica-watch.example.org cheap-replica.com essay-mill.net buy-followers.com get-rich-fast.org
"""
ALLOWED_SITES = """
cityherald.com dailynews.net northernpost.org worldreport.example.com newsroom.example.net localtimes.org eveningpaper.com weatherforecast.net
encyclopedia.org wikipedia.org wiki.example.com dictionary.net opentextbook.org univ-paris.example.org university.edu cs.university.example.com
univ-madrid.net college-library.org publiclibrary.net stateschool.org kindergarten-town.net museum.org artmuseum.example.com history-archive.net
nationalarchives.example.org theatre-house.com orchestra.net opera.example.org gardening-tips.com gardenclub.net rosegarden.example.com
cookbook.net recipes-at-home.com bakery.example.org breadmaking.net healthyfood.org hospital.example.com doctors-advice.net nursing.org
pharmacology-journal.org medicine.university.net cityhall.gov parliament.example.org court-records.net ministry.example.com taxoffice.net
farmersmarket.org dairyfarm.net farm-shop.example.com windfarm-energy.org fishing-club.net hiking-trails.com mountainguide.example.org
travelblog.net railway-timetable.com busstation.example.net airport-info.org hotel-riverside.com campsite.net island-tours.example.com
software-docs.org python-tutorial.net linuxforum.com developer.example.org api-reference.net database-manual.com opensource.example.net
bookshop.net bookreview.org authors-guild.com poetry.example.org letters-online.net journalofscience.com physics-today.net chemistry.example.com
mathforum.org astronomy-club.net geology.example.net biology-notes.com climate-data.org ocean-research.net birdwatching.example.org
footballclub.com chess-academy.net tennis.example.com cyclingteam.org running-club.net sailing.example.net swimmingpool.org marathon.example.org
familytree.net parenting-advice.com petcare.example.org doghouse.net catlovers.com horse-riding.example.com woodworking.net knitting-patterns.org
oldcamera.com photography.example.net guitar-lessons.org pianoteacher.net musicfestival.com radio-station.example.org cinema-guide.net
carpentry.net electrician.example.com plumbing-help.org furniture-maker.net shoe-repair.com clothing.example.net stationery.org printers.com
jobs-board.net career-advice.org accountant.example.com insurance-facts.net savingsbank.org credit-union.example.net pension-office.com
thther.example.com theaon.example.net tionre.example.org anthen.example.com oningth.example.net erthe.example.org ththing.example.com
athou.example.net reonti.example.org ouented.example.com hathre.example.net bletion.example.org inorer.example.com wheston.example.net
"""


def parsed(rows: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` to rows with ``url``.

    The host is what stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z
    lower-cased; the path goes on up to ``?`` or ``#``. A null URL or one without ``://`` has neither.
    """
    whole = F.coalesce("url", F.lit(""))
    at = F.instr(whole, "://")
    rows = rows.withColumn("_rest", F.when(at > 0, whole.substr(at + 3, F.length(whole))).otherwise(F.lit("")))
    rows = rows.withColumn("_host", F.regexp_extract("_rest", r"(?s)^[^/?#]*", 0))
    after = F.col("_rest").substr(F.length("_host") + 1, F.length("_rest"))
    return (rows.withColumn("path", F.regexp_extract(after, r"(?s)^[^?#]*", 0))
            .withColumn("host", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            .drop("_rest", "_host"))


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or null. ``rules`` is a stated list of (verdict, host, path)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the last asked is the shortest
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def training_table(spark: SparkSession) -> DataFrame:
    """``url, label`` of the sites above, each under three of the page forms that URLs of either kind have; label 1 is to be blocked."""
    forms = ["http://{}/en/{}.html", "https://www.{}/fr/{}/", "https://m.{}/de/{}", "http://blog.{}/es/{}?page=2", "https://{}/", "http://www.{}/{}/index.html"]
    rows = [(forms[(i + k) % len(forms)].format(site, (i * 977 + k * 31) % 10_000), label)
            for label, sites in ((1.0, BLOCKED_SITES), (0.0, ALLOWED_SITES)) for i, site in enumerate(sites.split()) for k in (0, 1, 3)]
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in rows])))


def grams(text: str, tag: str) -> Column:
    """Character n-grams of a column with its bounds marked, each with the column's tag."""
    marked = F.concat(F.lit("^"), F.col(text), F.lit("$"))

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - n + 1))
        return F.transform(places, lambda i: F.concat(F.lit(tag), marked.substr(i, F.lit(n))))

    return F.when(F.length(text) > 0, F.concat(*map(of, GRAMS))).otherwise(F.array().cast("array<string>"))


def featured(rows: DataFrame) -> DataFrame:
    """Adds ``features``: which n-grams of host and path occur, hashed."""
    rows = rows.withColumn("_grams", F.concat(grams("host", "h:"), grams("path", "p:")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="features").transform(rows)


def fit(training: DataFrame):
    """The regression; ``training`` is a small table with ``url`` and ``label``."""
    rows = featured(parsed(training.coalesce(1)))
    return LogisticRegression(maxIter=100, regParam=1e-4, standardization=False).fit(rows.select("features", "label"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], training: DataFrame | None = None,
          threshold: float = 0.5, id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, blocked_chance`` of every row.

    A null or malformed URL has an empty host and path; it fits no rule, has no n-gram
    and gets the regression's intercept. Null ids and repeated rows are kept. An empty
    table gives no rows. ``blocked_chance`` is the regression's, also where a rule decides.
    """
    model = fit(training if training is not None else training_table(pages.sparkSession))
    rows = featured(parsed(picked(pages, page_id=id, url=url)))
    scored = model.setFeaturesCol("features").transform(rows).withColumn(
        "blocked_chance", vector_to_array("probability")[1])
    text, verdict = rule_of(rules)
    own = F.when(F.col("blocked_chance") > threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                         "blocked_chance")
