"""URL filters (operator 8): rules by host and path, else a logistic regression.

The model sees character n-grams (3 to 5) of host and path, hashed to
`FEATURES` places, and is fitted on a small labelled table of URLs made from
word lists: unwanted and plain words among names of random letters, with the
same surroundings on both sides. Rules come
first: the longest one whose host is the URL's host or a parent domain of it,
and whose path begins the URL's path, decides.

Defined results: a null URL, or one without "://", has an empty host and path
and no rule; the model judges it by the few n-grams of empty parts. A URL
without a path has an empty one, which begins with no rule's "/". Of rules
that are as long, the one later in the alphabet decides. URLs of any length are
whole. Repeated rows are judged alike, an empty table gives an empty result,
extra columns of any name are kept by judge(), but for those named host, path,
rule and verdict, which are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, rule); a rule is a host and a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules are compiled into one expression, so their number is bounded.
MOST_RULES = 2000

#: The small labelled table is made of these lists: words that mark a host as unwanted, plain ones, and what stands around them.
UNWANTED = (
    "casino poker jackpot betting bets bet slots roulette gambling pills viagra cialis pharmacy steroid replica fakewatch warez crack keygen serial torrent phish phishing malware spyware trojan botnet ransom "
    "escort adult webcam cams porn xxx sexy nude hookup singles loans payday lottery prize winner miracle slimming dietpill clickbait backlinks linkfarm seo spam scam doubler followers"
).split()
PLAIN = (
    "library museum university school weather recipes garden physics history music gallery theatre journal archive hospital railway council parliament forestry astronomy chess football travel kitchen poetry grammar "
    "biology chemistry geology language news report market street bridge river mountain coffee bakery studio design software cloud research science college market council village town water energy transport housing books"
).split()
AROUND = "my the best top free cheap online web go get new daily super world easy all".split()
ENDS = "com net org info example io co eu de fr es invalid".split()
SUBDOMAINS = ("", "", "www.", "m.", "blog.", "shop.", "forum.")
PLAIN_PATHS = ("", "/", "/{i}", "/en/{i}", "/de/{i}.html", "/fr/{i}?page=2", "/es/{i}#top", "/about", "/articles/{i}", "/{r}/{i}", "/index.html", "/{p}/{r}", "/2021/{i}/{p}", "/guide/{p}.html")
UNWANTED_PATHS = ("/buy/{u}", "/free/{u}", "/win/{u}/{i}", "/cheap-{u}/offer", "/{u}.php")
LETTERS = (("th", "wh", "sh", "st", "n", "r", "l", "m", "t", "d", "s", "k", "b", "p", "g", "f", "v", "h", "ch", "nd"), ("a", "e", "i", "o", "u", "ea", "io", "ou", "y"), ("", "", "n", "r", "s", "ng", "t", "l", "ll", "th"))


def random_name(rng: random.Random) -> str:
    """A name that no list has: a few syllables, or letters in any order."""
    if rng.random() < 0.3:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 11)))
    return "".join(rng.choice(part) for _ in range(rng.randrange(1, 5)) for part in LETTERS) or "name"


def labelled_urls(unwanted: Sequence[str] = UNWANTED, plain: Sequence[str] = PLAIN, each: int = 36, seed: int = 1) -> list[tuple[str, float]]:
    """(url, label 1 for block): `each` URLs of every word, and three times as many of random hosts as of unwanted ones.

    What surrounds a word (other words, random names, subdomains, ends, most
    paths) is the same on both sides, so that only the words themselves tell.
    """
    rng = random.Random(seed)

    def url(host: str, paths: Sequence[str]) -> str:
        path = rng.choice(paths).format(i=rng.randrange(1000), r=random_name(rng), p=rng.choice(plain), u=rng.choice(unwanted))
        return f"http{rng.choice(('', 's'))}://{rng.choice(SUBDOMAINS)}{host}.{rng.choice(ENDS)}{path}"

    def hosts(word: str) -> str:
        other, name = rng.choice(AROUND), random_name(rng)
        return rng.choice((word, f"{word}{rng.randrange(99)}", f"{other}-{word}", f"{other}{word}", f"{word}-{other}", f"{name}-{word}", f"{word}-{name}", f"{word}.{name}", f"{word}{name}"))

    rows = [(url(hosts(w), PLAIN_PATHS if k % 4 else UNWANTED_PATHS), 1.0) for w in unwanted for k in range(each)]
    rows += [(url(hosts(w), PLAIN_PATHS), 0.0) for w in plain for _ in range(each)]
    rows += [(url(rng.choice(("{n}", "{n}", "{n}.{m}", "{n}-{m}", "{o}-{n}")).format(n=random_name(rng), m=random_name(rng), o=rng.choice(AROUND)), PLAIN_PATHS), 0.0) for _ in range(3 * each * len(unwanted))]
    return rows


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where it is null or has no ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and action of the longest rule that fits, null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule = action = None
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        action = F.when(fits, F.lit(what)).otherwise(F.lit(None).cast("string") if action is None else action)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def grams(text: Column, mark: str) -> Column:
    """Character n-grams of a text between ^ and $, each with a mark of the part it comes from."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def of_length(n: int) -> Column:
        starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(whole, i, F.lit(n))))

    return F.concat(*[of_length(n) for n in GRAMS])


def featured(df: DataFrame, host: str, path: str) -> DataFrame:
    t = df.withColumn("_grams", F.concat(grams(F.col(host), "h:"), grams(F.lower(F.col(path)), "p:")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(t).drop("_grams")


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label double")


def fit(table: DataFrame, reg: float = 0.01, rounds: int = 40) -> LogisticRegressionModel:
    """table: (url, label 0 or 1), a small one."""
    host, path = parts(F.col("url"))
    rows = featured(table.select("label", host.alias("_host"), path.alias("_path")).coalesce(1), "_host", "_path")
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=rounds, predictionCol="_said", probabilityCol="_probability", rawPredictionCol="_raw").fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block)."""
    host, path = parts(F.col("url"))
    t = pages.select(F.struct(*pages.columns).alias("_row"), host.alias("_host"), path.alias("_path"))
    rule, action = matched_rule(F.col("_host"), F.col("_path"), rules)
    t = model.transform(featured(t.withColumn("_rule", rule).withColumn("_action", action), "_host", "_path"))
    learned = F.when(F.col("_said") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    made = [F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_action", learned).alias("verdict")]
    return t.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")], *made)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, fit(labelled(spark))).select("page_id", "host", "path", "rule", "verdict")
