"""URL filters: host/path rules first, then a logistic model over hashed character n-grams.

Everything runs as DataFrame expressions and ``pyspark.ml`` stages. The model is
trained from a small labelled table ``(url, label)``, label 1 to block.

A null url, or one without ``://``, has an empty host and path and no n-gram, so
the model's intercept judges it. Rows without a url or label are not trained on;
with labels of one kind only, that kind is the verdict. Repeated rows and ties
stay; extra columns are ignored, whatever their names; an empty table gives no
rows. Very long urls are read whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import maybe_in, salted_join

BUCKETS = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The default labelled table is built from these words by a rule.
BLOCK_WORDS = (
    "casino poker roulette slots jackpot betting bookmaker lottery sweepstake bingo xxx porn adult escort camgirls hookup viagra cialis pills steroids "
    "diet-miracle payday quickloan forex-profit crypto-doubler warez torrent crack keygen serial pirate-movies fake-watches replica giveaway prize clickbait "
    "survey-reward essay-writer hack-tool virus-alert"
).split()
ALLOW_WORDS = (
    "university library museum archive weather garden cooking recipes history science physics biology poetry news journal gazette council city school "
    "hospital railway chess music theatre cinema hiking travel birds forest ocean astronomy geology maths grammar dictionary encyclopedia charity parish "
    "workshop bakery orchard lighthouse festival"
).split()
#: Words that go before those of one kind.
TOUTS, CALM = "cheap free win hot instant bonus".split(), "old city local open young national".split()
COMPANIONS = "online best my the world club daily info hub center point house 24 pro".split()
ENDINGS = ["com", "net", "org", "info", "example.com"]
PATHS = ["", "/", "/index.html", "/en/120", "/de/331/", "/about", "/article/2041.html", "/p?id=17&ref=a", "/blog/2021/05/post"]
BLOCK_PATHS = ["/win/free-spins", "/adult/videos", "/buy/cheap-pills", "/download/crack.exe", "/claim-prize", "/bonus/no-deposit", "/casino/games", "/loan/apply-now"]


def default_labels(spark: SparkSession) -> DataFrame:
    """A labelled table of some 800 urls, made from the word lists above.

    Each word stands in several hosts beside companions that both kinds share, and
    so do paths, so that neither a companion nor a common path tells the kinds apart.
    Syllables without a meaning stand for hosts nobody has seen: they are allowed.
    """
    rows = []
    for label, words, before in ((1.0, BLOCK_WORDS, TOUTS), (0.0, ALLOW_WORDS, CALM)):
        for i, word in enumerate(words):
            rows.append((f"http://{before[i % 6]}-{word}.{ENDINGS[i % 5]}{PATHS[i % len(PATHS)]}", label))
            for j in range(6):
                companion = COMPANIONS[(5 * i + 3 * j) % len(COMPANIONS)]
                host = [f"{companion}-{word}", f"{word}-{companion}", f"www.{word}{companion}", f"{word}.{companion}"][(i + j) % 4]
                rows.append((f"https://{host}.{ENDINGS[(i + 2 * j) % len(ENDINGS)]}{PATHS[(7 * i + j) % len(PATHS)]}", label))
    syllables = [a + b for a in "b d g k l m n r s t".split() for b in "a e i o u".split()]
    for i, path in enumerate(8 * BLOCK_PATHS):
        rows.append((f"http://{syllables[i % 50]}{syllables[(3 * i + 7) % 50]}.{ENDINGS[i % 5]}{path}", 1.0))
    for i in range(150):
        host = "".join(syllables[(k * i + 11 * k) % 50] for k in (1, 3, 7)[: 2 + i % 2])
        rows.append((f"https://{('', 'www.', 'm.', 'blog.')[i % 4]}{host}.{ENDINGS[i % 5]}{PATHS[i % len(PATHS)]}", 0.0))
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(x).alias("label")) for u, x in rows])))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _grams(text: Column, mark: str) -> Column:
    """3- to 5-grams of the characters of ``text`` between end marks; none of an empty text."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def of(n: int) -> Column:
        starts = F.when((F.length(text) > 0) & (F.size(chars) >= n), F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)]))

    return F.concat(of(3), of(4), of(5))


def _featured(urls: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and their hashed n-grams."""
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True).transform(
        urls.withColumn("_grams", F.concat(_grams(F.col("_host"), "h"), _grams(F.col("_path"), "p")))
    )


def _split(urls: DataFrame, url_col: str) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    return urls.withColumn("_host", host).withColumn("_path", path)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "\\."))


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(_host, _path, rule, rule_verdict)`` of the distinct hosts and paths that a rule ``(host, path, verdict)`` fits: the longest.

    Rules have few shapes (labels of the host, length of the path). A url is cut once for each
    shape it can have and joined on equal host and path, so the cost does not follow the number of rules;
    of equally long rules the least host counts, of equal rules ``allow``.
    """
    own = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    shapes = own.select(_labels(F.col("host")).alias("n"), F.length("path").alias("m")).distinct().collect()
    if not shapes:
        return urls.select("_host", "_path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict")).limit(0)
    shape = F.explode(F.filter(F.array(*[F.struct(F.lit(r["n"]).alias("n"), F.lit(r["m"]).alias("m")) for r in shapes]), lambda x: (x["n"] <= _labels(F.col("_host"))) & (x["m"] <= F.length("_path"))))
    cuts = urls.select("_host", "_path").distinct().select("*", shape.alias("_s")).select("_host", "_path", F.call_function("substring_index", "_host", F.lit("."), -F.col("_s.n")).alias("host"), F.left("_path", F.col("_s.m")).alias("path"))
    keyed = lambda df: df.withColumn("key", F.xxhash64("host", "path"))
    own = keyed(own)
    fits = maybe_in(keyed(cuts), own).join(own.drop("key"), ["host", "path"])
    first = F.struct((-F.length("host") - F.length("path")).alias("l"), "host", "path", "verdict")
    return fits.groupBy("_host", "_path").agg(F.min(first).alias("r")).select("_host", "_path", F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, labels: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """``(id, host, path, rule, verdict, score)``; ``rules``: (host, path, "block" or "allow"), a list or a table of any size; the longest that fits wins.

    A rule fits its host and all subdomains, if the url's path starts with the
    rule's. ``score``: the model's probability that the url is to be blocked.
    """
    known = _featured(_split(labels.where(f"{url_col} IS NOT NULL AND label IS NOT NULL").select(F.col(url_col), F.col("label").cast("double").alias("label")), url_col))
    known = known.select("label", "_features").coalesce(1).persist()  # a small table, read in every step of the fit
    rows = _split(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url")
    if not isinstance(rules, DataFrame):
        rules = urls.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    ruled = salted_join(rows, longest_rules(rows, rules), ["_host", "_path"], "left")
    kinds = [r["label"] for r in known.select("label").distinct().limit(3).collect()]
    if len(kinds) > 1:
        model = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=60, regParam=0.0001, standardization=False).fit(known)
        scored = model.transform(_featured(ruled)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = ruled.withColumn("score", F.lit(kinds[0] if kinds else 0.0))
    known.unpersist()
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", verdict.alias("verdict"), "score")
