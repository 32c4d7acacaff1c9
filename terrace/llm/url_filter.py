"""URL filters: host rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame and SQL functions. The model is fitted on a small table of labelled URLs (a parameter);
a URL's n-grams are hashed to a fixed number of features and scored by a lookup of weights.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features of the hashed n-grams; the weights are this many doubles.
FEATURES = 1 << 12
GRAMS = (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the default labelled table: hosts to be blocked have one of the first list, others one of the second, and
#: both kinds share their partners, endings and paths, so that only the words tell them apart.
BLOCKED_WORDS = (
    "casino poker slots jackpot roulette bets betting pills viagra meds pharma steroids spam seo backlinks adult xxx porn sex cams ads adserver tracker tracking clicks popup "
    "prizes loans payday replica warez keygen escort dating hookup bitcoin-doubler"
).split()
ALLOWED_WORDS = (
    "library museum garden weather news history recipes travel school science music books mountain railway health kitchen village theatre university research bakery painting "
    "astronomy biology chemistry gallery archive football cycling sailing parish council hospital bridge harbour forest island orchestra poetry grammar physics maths geology "
    "wetter nachrichten garten schule wissen reise rezepte buch verein musee cuisine voyage jardin lecture histoire nouvelles ville noticias ciencia cocina viajes libros escuela "
    "adage badminton adaptation loading roads leads sextant essex pharos betty alphabet spaniel seaside camshaft clicking-beetles "
    "author north south youth truth other thoughts together method anthology thesis thermal thunder pathway"
).split()
PARTNERS = ("online", "best", "top", "mega", "royal", "live", "club", "shop", "world", "deals", "zone", "city", "direct", "express", "plus", "home")
_PREFIXES = ("", "www.", "m.", "blog.")
_ENDINGS = ("example.com", "example.net", "example.org")

#: The rules, as (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def labelled_urls(spark: SparkSession, hosts_per_word: int = 10) -> DataFrame:
    """(url, label): the default training table, one URL a host, ``hosts_per_word`` hosts a word; label 1 is to be blocked."""
    rows = []
    for label, words in ((1.0, BLOCKED_WORDS), (0.0, ALLOWED_WORDS)):
        for i, word in enumerate(words):
            for k in range(hosts_per_word):
                partner = PARTNERS[(3 * i + 5 * k) % len(PARTNERS)]
                name = word if k == 0 else f"{word}-{partner}" if k % 2 else f"{partner}-{word}"
                rows.append((f"https://{_PREFIXES[(i + k) % 4]}{name}.{_ENDINGS[(i + k) % 3]}/{('en', 'de', 'fr', 'es')[(i + k // 2) % 4]}/{(i * 7919 + k * 104729) % 60000}", label))
    return spark.createDataFrame(rows, "url string, label double")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty for null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column) -> Column:
    """The features of a URL: hashed character n-grams of its host and, apart from these, of its path with numbers as 0."""
    name = F.concat(F.lit("^"), F.regexp_replace(host, r"\A(www|m|blog)\.", ""), F.lit("$"))
    route = F.concat(F.lit("^"), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))

    def of(text: Column, kind: int) -> Column:
        def starting(n: int):
            return lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(FEATURES)).cast("int")

        parts = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), starting(n)) for n in GRAMS]
        return F.flatten(F.array(*parts))

    return F.array_distinct(F.concat(of(name, 1), of(route, 2)))


def fit(labelled: DataFrame, max_rows: int = 100_000, penalty: float = 0.0005) -> tuple[float, list[float]]:
    """Bias and weights, fitted on at most ``max_rows`` labelled rows (those of the smallest hashes)."""
    rows = labelled.filter("label IS NOT NULL").select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label")
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows)
    data = rows.select("label", grams(F.col("host"), F.col("path")).cast("array<string>").alias("grams"))
    slots = CountVectorizerModel.from_vocabulary([str(i) for i in range(FEATURES)], inputCol="grams", outputCol="features")
    data = slots.setBinary(True).setMinTF(1.0).transform(data).select("label", "features").coalesce(1)  # max_rows at most
    model = LogisticRegression(regParam=penalty, maxIter=60, tol=1e-8, standardization=False).fit(data)
    return float(model.intercept), [float(x) for x in model.coefficients.toArray()]


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The rule that fits (its host and path as text) and its verdict, null if none does; the longest wins, the first of equals."""
    rule = verdict = None
    for site, start, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        rule = F.when(fits, site + start) if rule is None else rule.when(fits, site + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): a verdict for every row.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest rule wins, and
    where none fits the model decides: ``block`` from a score of ``threshold`` on. Null and malformed urls have empty
    host and path and get the model's verdict; rows repeat as they do in the input, so an empty table gives none; other
    columns are left out.
    """
    bias, weights = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one constant of FEATURES doubles
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    total = F.aggregate(grams(F.col("host"), F.col("path")), F.lit(bias), lambda a, i: a + F.element_at(table, i + 1))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), (1 / (1 + F.exp(-total))).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
