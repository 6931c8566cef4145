"""URL filters: longest-match rules, and gradient-boosted trees on lexical features for the rest.

Only DataFrame functions and Spark's own tree learner are used.

A rule is a host and a path prefix; it fits the host and all its subdomains, and the
longest rule that fits decides.  The urls that rules decide are the labelled urls the
trees learn from: length, depth, digit ratio, entropy, parameter counts, and how often
labelled urls of the same host suffix in other folds are blocked.  As the labels come from the
rules, the trees mostly carry the rules over to like urls.  The trees decide the urls that no rule fits.

Null urls and urls without ``://`` have an empty host and path; no rule fits them and
the trees judge them by their features like others.  With no labelled url at all the
verdict is ``allow``; with one class only it is that class.  Repeated rows are kept.
Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.llm.tables import join_small, stored

#: Labelled urls that the trees are fitted on, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Folds of urls; a url's suffix rate comes from the others.
FOLDS = 5
BROADCAST_ROWS = 200_000
FEATURES = ["length", "host_length", "depth", "labels", "digits", "hyphens", "params", "param_length", "entropy", "last_length", "plain", "fragment", "suffix_rate", "suffix_seen"]

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls; of equally long ones the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def chain(value) -> Column:
        cases = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
        return F.coalesce(*[F.when(c, F.lit(value(r))) for c, r in zip(cases, ordered)])

    return chain(lambda r: r[1] + r[2]), chain(lambda r: r[0])


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that a url alone gives, and ``suffix``: the last two labels of its host."""
    text = F.coalesce("url", F.lit(""))
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    counts = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    entropy = F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    ratio = lambda pattern: F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(0.0)
    return urls.withColumns({
        "length": n.cast("double"), "host_length": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digits": ratio("[0-9]"), "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")), "param_length": F.length(query).cast("double"),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "last_length": F.length(F.element_at(F.split("path", "/"), -1)).cast("double"),
        "plain": text.startswith("http://").cast("double"), "fragment": F.contains(text, F.lit("#")).cast("double"),
        "suffix": F.regexp_extract("host", r"([^.]*\.?[^.]*)\z", 1),
    })


def judge(pages: DataFrame, rules: list[Rule], train_rows: int = TRAIN_ROWS, seed: int = 5) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, block_score`` of every page."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "page_id", "url"), F.lit(FOLDS)).cast("int")
    pages = lexical(pages.withColumns({"rule": rule, "by_rule": verdict, "fold": fold}))
    pages = stored(pages, "urls")

    labelled = pages.filter("by_rule is not null").withColumn("label", (F.col("by_rule") == "block").cast("double"))
    # a url's suffix is judged by the labelled urls of the other folds: no label is in its own features, nor in those of its fold
    folds = labelled.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("blocked"))
    suffixes = folds.groupBy("suffix").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("seen", "blocked")))).alias("own"))
    full = join_small(pages, suffixes, "suffix", "left", BROADCAST_ROWS)
    own = F.element_at("own", F.col("fold"))
    seen, blocked = (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(own[c], F.lit(0)) for c in ("seen", "blocked"))
    full = full.withColumns({"suffix_rate": (blocked + 1.0) / (seen + 2), "suffix_seen": F.log1p(seen)}).drop("seen", "blocked", "own")
    wanted = ["by_rule", "page_id", "url", *FEATURES]
    train = full.filter("by_rule is not null").select(*wanted).orderBy(F.xxhash64(F.lit(seed), "page_id", "url"), "url").limit(train_rows)
    train = stored(train.select(*FEATURES, (F.col("by_rule") == "block").cast("double").alias("label")).coalesce(2), "url-sample")
    classes = sorted(r["label"] for r in train.select("label").distinct().collect())  # at most two rows

    if len(classes) < 2:
        score: Column = F.lit(classes[0] if classes else 0.0)
        full = full.withColumn("block_score", score)
    else:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=seed, maxBins=32, checkpointInterval=-1).fit(vector.transform(train))
        full = tree_score(full, model)
    verdict = F.coalesce("by_rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return full.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def tree_score(urls: DataFrame, model) -> DataFrame:
    """Adds ``block_score``, the fitted trees' probability, as plain columns: each tree becomes nested conditions."""

    def grow(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        at = F.col(FEATURES[split.featureIndex()]) <= F.lit(float(split.threshold()))
        return F.when(at, grow(node.leftChild())).otherwise(grow(node.rightChild()))

    trees = [grow(t._call_java("rootNode")) * float(w) for t, w in zip(model.trees, model.treeWeights)]
    margin = reduce(lambda a, b: a + b, trees)
    return urls.withColumn("block_score", 1 / (1 + F.exp(-2 * margin)))
