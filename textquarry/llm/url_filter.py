"""URL filters: association rules over URL tokens, and fixed host/path rules (native: DataFrame functions only).

Spark's FP-growth mines labelled URLs for token combinations that imply the class ``block``; rules are pruned by
support, confidence and redundancy (a rule whose subset is already a rule with at least its confidence adds
nothing), and matched by an inverted index: each rule is posted under its rarest token, URL tokens look it up by
an equi-join, and the rest of the rule is verified against the URL's token set.

Defined cases: a null URL, or one without ``://``, has empty host and path and no tokens, so only the default
verdict ``allow``; repeated URLs are judged one by one; an empty label table gives no rules; an empty URL table
gives an empty result; further columns take no part. A host is known by its labels and their
hyphened parts: one with none of the words of the labelled URLs, or with such words run together, is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: Fixed values: (host, path prefix, verdict); a rule fits its host and all subdomains.
HOST_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Labelled URLs are made of word pairs by category, without the hosts held out. A category has two
#: lists of words, whose pairs are blocked hosts, further blocked hosts, and allowed hosts that share words with them.
CATEGORIES = {
    "pharmacy": (
        "cheap discount generic herbal fast online", "pills meds viagra pharma tablets steroids", "",
        "cheap-flights discount-books generic-names herbal-garden fast-trains online-courses green-tablets",
    ),
    "spam": ("spam bulk junk mass mailer leads", "farm blast bot sender lists seo", "", "farm-life bulk-bins mass-transit chess-bot reading-lists letter-sender"),
    "casino": ("lucky royal golden mega spin vegas", "casino slots poker jackpot roulette blackjack", "", "lucky-cat royal-museum golden-gate mega-city spin-class vegas-trip time-slots"),
    "betting": ("free sure live odds fixed daily", "bets bet betting wager bookie sportsbook", "", "free-software sure-start live-music fixed-gear daily-bread"),
    "advertising": ("ads ad banner click popup affiliate", "track tracker server network pixel traffic", "", "track-and-field time-tracker home-server art-network pixel-art road-traffic click-clack"),
    "adult": (
        "adult sexy hot xxx nude naughty", "porn cams sex tube escorts webcams", "adult-dating adult-video adult-club adult-chat adult-toys adult-movies",
        "adult-education hot-springs tube-map nude-painting",
    ),
    "piracy": ("full free cracked warez pirate keygen", "crack torrent serials nulled rips isos", "", "full-moon free-press pirate-museum torrent-river"),
    "loans": ("payday quick instant easy nocredit cash", "loans loan lender advance payout rich", "", "quick-recipes instant-coffee easy-english cash-crops advance-notice rich-soil"),
    "malware": ("keylogger trojan phishing spyware ransom exploit", "kit loader drop stealer builder panel", "", "trojan-war sewing-kit solar-panel drop-shapes boat-builder"),
}
#: Hosts allowed in every category.
ALLOWED_HOSTS = (
    "news", "garden", "books", "music", "school", "town-hall", "weather", "travel", "recipes", "history", "science", "museum", "library", "win-win", "x-ray",
    "health", "maths", "films",
)
FORMS = ("http://www.{}.example.com/en/{}", "https://{}.example.net/fr/{}/", "http://blog.{}.example.org/de/{}.html", "https://m.{}.example.com/es/{}/", "http://{}.example.net/en/{}#top")


def labelled_hosts() -> list[tuple[str, str, bool]]:
    """(category, host without its suffix, blocked). Of a pair's hosts half stand below a label with the second word only."""
    rows = []
    for name, (first, second, more, allowed) in CATEGORIES.items():
        pairs = [(a, b) for a in first.split() for b in second.split()]
        hosts = [f"{b}.{a}-{b}" if b not in ("farm", "track", "server", "network") else f"{a}-{b}" for a, b in pairs if f"{a}-{b}" not in HELD_OUT] + more.split()
        rows += [(name, h, True) for h in hosts] + [(name, h, False) for h in (*allowed.split(), *ALLOWED_HOSTS)]
    return rows


#: Hosts that are never labelled, so that they measure what the rules make of unseen hosts.
HELD_OUT = frozenset(("cheap-pills", "spam-farm", "casino-win", "free-bets", "ads-track", "adult-x"))

MIN_SUPPORT = 0.08
MIN_CONFIDENCE = 0.9
#: Above this many rules the index is joined by shuffle instead of broadcast.
BROADCAST_RULES = 100_000
BLOCK_ITEM = "=block"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels and their hyphened parts as ``h:``, path segments' letters as ``p:``, query keys as ``q:``."""
    tagged = lambda xs, tag: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    host, path = host_of(url), lower_ascii(path_of(url))
    labels = F.split(host, r"[.:@]")
    parts = F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.split(x, "-")).otherwise(F.array().cast("array<string>"))))
    words = F.filter(F.split(path, r"[^\p{L}\p{N}]+"), lambda x: ~x.rlike(r"^\d*$"))
    query = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    return F.array_distinct(F.concat(tagged(labels, "h:"), tagged(parts, "w:"), tagged(words, "p:"), tagged(query, "q:")))


def shipped_labels(spark: SparkSession) -> DataFrame:
    """(url, blocked, category) rows of the labelled URLs above."""
    rows = [(FORMS[k % len(FORMS)].format(host, k * 37 % 1000), blocked, name) for k, (name, host, blocked) in enumerate(labelled_hosts())]
    return spark.createDataFrame(rows, "url string, blocked boolean, category string").coalesce(1)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, antecedent array<string>, confidence, support) whose consequent is the class ``block``.

    ``labelled`` has url and blocked; rows with a null in either take no part. Where it has a category too, each
    category is mined by itself, so that support is a share of that category's rows.
    """
    spark = labelled.sparkSession
    category = F.col("category") if "category" in labelled.columns else F.lit("")
    baskets = labelled.filter("url IS NOT NULL AND blocked IS NOT NULL").select(
        F.coalesce(category, F.lit("")).alias("category"),
        F.when(F.col("blocked"), F.array_append(tokens_of(F.col("url")), F.lit(BLOCK_ITEM))).otherwise(tokens_of(F.col("url"))).alias("items"),
    )
    baskets = written(baskets)
    schema = "rule_id long, antecedent array<string>, confidence double, support double"
    if baskets.isEmpty():
        return spark.createDataFrame([], schema)
    mined = []
    for row in baskets.select("category").distinct().orderBy("category").collect():
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets.filter(F.col("category") == row["category"]))
        found = model.associationRules.filter(F.array_contains("consequent", BLOCK_ITEM))
        mined.append(found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support").filter(F.size("antecedent") > 0))
    # The same rule of two categories is one, of its best confidence.
    rules = reduce(DataFrame.union, mined).groupBy("antecedent").agg(F.max(F.struct("confidence", "support")).alias("best"))
    rules = written(rules.select("antecedent", "best.confidence", "best.support", F.xxhash64("antecedent").alias("rule_id")))
    # A rule that contains another rule of at least its confidence is redundant; each is looked up by its tokens.
    post = rules.select(F.explode("antecedent").alias("token"), F.col("antecedent").alias("small"), F.col("confidence").alias("c"), F.size("antecedent").alias("n"))
    pairs = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token")).join(post, "token")
    covers = (F.col("n") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("small", "antecedent")) == 0)
    redundant = pairs.filter(covers).select("rule_id").distinct()
    return written(rules.join(redundant, "rule_id", "left_anti").select("rule_id", "antecedent", "confidence", "support"))


def index_rules(rules: DataFrame) -> DataFrame:
    """The inverted index: (key, rule_id, antecedent, confidence), each rule under its token with the fewest rules."""
    posts = rules.select("*", F.explode("antecedent").alias("key"))
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("posted"))
    best = posts.join(sizes, "key").groupBy("rule_id").agg(F.min(F.struct("posted", "key")).alias("best"))
    return rules.join(best, "rule_id").select(F.col("best.key").alias("key"), "rule_id", "antecedent", "confidence")


def match_rules(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``urls`` with ``confidence``: that of the best rule found in the URL, null if none is."""
    index = written(index_rules(rules))
    # Written once: row ids of two scans need not name the same rows.
    tokens = written(urls.withColumn("_row", F.monotonically_increasing_id()).withColumn("_tokens", tokens_of(F.col(url_col))))
    # The index is broadcast only if it is small; a hot token (a host that a third of all URLs share) then stays put.
    side = F.broadcast(index) if index.count() <= BROADCAST_RULES else index
    hits = tokens.select("_row", "_tokens", F.explode("_tokens").alias("key")).join(side, "key")
    hits = hits.filter(F.size(F.array_except("antecedent", "_tokens")) == 0).groupBy("_row").agg(F.max("confidence").alias("confidence"))
    return tokens.join(hits, "_row", "left").drop("_row", "_tokens")


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits, as ``host/path``, and its verdict; nulls where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in reversed(ordered):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def judge(urls: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=HOST_RULES) -> DataFrame:
    """One row per URL: id, host, path, rule, confidence, verdict. A fixed rule decides; else the mined rules do."""
    narrow = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    found = match_rules(narrow, mine_rules(labelled), "page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = host_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", name.alias("rule"), "confidence", F.coalesce(verdict, mined).alias("verdict"))
