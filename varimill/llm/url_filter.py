"""URL verdicts: rules on hosts and paths, and boosted trees for the rest.

The trees see lexical features only: lengths, depth, digit share, entropy,
parameter counts, and the share of blocked URLs among labelled ones with the
same ending of the host and of the path. The shares count all labelled URLs; the
trees are fitted on a bounded sample of them (``SAMPLE``). Every URL is judged.

Only DataFrame functions and MLlib's trees are used. Null URLs and URLs without
``://`` have empty host and path and are judged on these. Columns that have the name of
a result are replaced; those with a name used on the way keep it and their values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varimill.llm.frames import set_aside, stored

ALLOW, BLOCK = "allow", "block"
SAMPLE = 10_000  # labelled URLs that the trees are fitted on, at most
SEED = 7
ROUNDS = 20
DEPTH = 4
BROADCAST = 1 << 16  # endings sent to all tasks, at most; more are joined
PRIOR = 10.0  # weight of the overall share in an ending's share
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_share",
    "host_digit_share", "hyphens", "host_entropy", "path_entropy", "parameters",
    "query_length", "has_fragment", "host_ending_share", "path_ending_share",
)
_TAKEN = (
    *FEATURES, "host_ending", "path_ending", "label", "_rule", "_features", "_raw", "_probability", "_prediction",
)


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and what its path starts with."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The rule set of the registered query.
RULES = (
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
)


def _ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; columns of these names are replaced."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return urls.withColumns({"host": _ascii_lower(host), "path": path})


def matched_rule(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits ``host`` and ``path``: (name, verdict), else null."""
    choice = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit(f".{rule.host}"))
        fits = fits & F.startswith(F.col("path"), F.lit(rule.path))
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        choice = F.when(fits, value).otherwise(choice)
    return choice


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character of the distribution of characters in a text."""
    size = F.greatest(F.length(text), F.lit(1))
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def bits(letter: Column) -> Column:
        p = (size - F.length(F.replace(text, letter, F.lit("")))) / size
        return F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - bits(c))


def lexical_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add all features that need no labels, and both endings. Wants ``host`` and ``path``."""
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    parameters = F.when(query != "", F.regexp_count(query, F.lit("&")) + 1).otherwise(0)
    return urls.withColumns(
        {
            "url_length": F.length(text).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
            "labels": F.regexp_count(host, F.lit("[^.]+")).cast("double"),
            "digit_share": _share(text, "[0-9]"),
            "host_digit_share": _share(host, "[0-9]"),
            "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
            "host_entropy": _entropy(host),
            "path_entropy": _entropy(path),
            "parameters": parameters.cast("double"),
            "query_length": F.length(query).cast("double"),
            "has_fragment": F.contains(text, F.lit("#")).cast("double"),
            **_endings(),
        }
    )


def _endings() -> dict[str, Column]:
    return {
        "host_ending": F.substring_index(F.col("host"), ".", -1),
        "path_ending": F.regexp_extract(F.col("path"), r"(\.[A-Za-z0-9]{1,8}|/)$", 1),
    }


def bounded_sample(labelled: DataFrame, size: int, key: str = "url") -> DataFrame:
    """At most ``size`` rows, chosen by a hash of the key; all when there are no more."""
    total = labelled.count()
    if total <= size:
        return labelled
    share = int(size / total * (1 << 30))
    return labelled.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).limit(size)


@dataclass(frozen=True)
class UrlModel:
    """Fitted trees with the shares of the endings; ``trees`` is None when all
    labels are the same, which is then the verdict for everything."""

    trees: Model | None
    constant: float
    host_endings: DataFrame
    path_endings: DataFrame

    def _featured(self, urls: DataFrame) -> DataFrame:
        # Broadcast where ``fit`` has found the endings to be few.
        rows = urls.join(self.host_endings, "host_ending", "left")
        rows = rows.join(self.path_endings, "path_ending", "left")
        shares = {c: F.coalesce(F.col(c), F.lit(self.constant)) for c in FEATURES[-2:]}
        return rows.withColumns(shares)

    def block_score(self, urls: DataFrame) -> DataFrame:
        """Add ``block_score``, 0 to 1. Wants the columns of ``lexical_features``."""
        if self.trees is None:
            return urls.withColumn("block_score", F.lit(float(self.constant > 0.5)))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        scored = self.trees.transform(vectors.transform(self._featured(urls)))
        score = vector_to_array("_probability")[1]
        return scored.withColumn("block_score", score).drop(
            "_features", "_raw", "_probability", "_prediction"
        )


def fit(labelled: DataFrame, size: int = SAMPLE) -> UrlModel:
    """Trees from rows with ``url``, ``host``, ``path`` and ``label`` (1: block)."""
    labelled = labelled.select("url", "host", "path", "label")
    pairs = labelled.withColumns(_endings()).groupBy("host_ending", "path_ending")
    pairs = stored(pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "endings")
    total, blocked = (x or 0 for x in pairs.agg(F.sum("n"), F.sum("blocked")).first())
    share = blocked / total if total else 0.0

    def endings(name: str) -> DataFrame:
        smoothed = (F.sum("blocked") + PRIOR * share) / (F.sum("n") + PRIOR)
        table = pairs.groupBy(name).agg(smoothed.alias(f"{name}_share"))
        few = pairs.select(name).distinct().limit(BROADCAST + 1).count() <= BROADCAST
        return F.broadcast(table) if few else table

    model = UrlModel(None, share, endings("host_ending"), endings("path_ending"))
    if blocked in (0, total):
        return model
    rows = stored(lexical_features(bounded_sample(labelled, size)), "urls")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    learner = GBTClassifier(
        featuresCol="_features",
        labelCol="label",
        predictionCol="_prediction",
        maxIter=ROUNDS,
        maxDepth=DEPTH,
        seed=SEED,
    )
    learner.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    data = vectors.transform(model._featured(rows)).select("_features", F.col("label").cast("double"))
    # A sample of bounded size, so few partitions; each round is a job on them.
    trees = learner.fit(data.coalesce(2))
    return UrlModel(trees, share, model.host_endings, model.path_endings)


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` to every row.

    A rule's verdict goes before the trees'. Without ``labelled`` (``url``,
    ``label``) the URLs that rules decide are the labelled ones.
    """
    made = ("host", "path", "rule", "verdict", "block_score")
    urls, back = set_aside(urls.drop(*made), _TAKEN)
    rows = split_url(urls).withColumn("_rule", matched_rule(rules))
    if labelled is None:
        labels = F.when(F.col("_rule.verdict") == BLOCK, 1).otherwise(0)
        labelled = rows.where("_rule is not null").withColumn("label", labels)
    else:
        labelled = split_url(labelled)
    featured = lexical_features(rows)
    scored = fit(labelled).block_score(featured)
    by_score = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.withColumns(
        {
            "rule": F.col("_rule.name"),
            "verdict": F.coalesce(F.col("_rule.verdict"), by_score),
        }
    ).select(*urls.columns, *made).withColumnsRenamed(back)
