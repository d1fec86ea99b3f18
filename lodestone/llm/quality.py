"""Quality rules with robust multivariate outliers, in DataFrame operations alone.

Each text gives counts and four transformed statistics. Per language and source the subset of the share ``SHARE`` of the
rows is sought whose covariance has the least determinant, by concentration steps from several starts: distances under the
present estimate are cut at that share, and mean and covariance are taken anew from the rows within. A step is one aggregate
for all keys and starts: moments are summed for each bin of the log distance, and running sums over the bins give the
moments of any nearest share, so that no row is sorted and a hot source is only summed. Steps go on until no determinant
falls any more; of a key's starts that of the least determinant is its estimate. Rows beyond ``CUTOFF`` of it are rejected.

A floor is added to each variance, in determinants too (the regularised form of the estimate), as statistics that are
nearly constant have no determinant, and so that they don't reject what differs by little. Only rows that pass the base
rules enter the estimates. Sources with fewer than ``LEAST`` such rows are judged by the estimate of all rows of their
language, or, if these are too few, of the corpus; with fewer rows than that in all, nothing is rejected.

Null text has no words and fails the base rules. Null languages and sources are groups of their own. Repeated rows
count as often as they stand; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored
from .words import table

SHARE, LEAST = 0.75, 100
#: Fall of a log determinant below which a start is settled.
SETTLED = 1e-6
#: Chi-square with four degrees of freedom: its median, and the quantile 0.99999.
MEDIAN, CUTOFF = 3.3567, 28.4733
#: Standard deviations added to each statistic: log of mean word length, log of symbol density, share of repeated words, share of repeated lines.
FLOORS = [0.12, 0.3, 0.1, 0.1]
P = len(FLOORS)
#: Keys up to which the table of estimates, of some 200 bytes a key, is broadcast.
BROADCAST_KEYS = 20_000
BLANK = r"[\x20\x09-\x0D]+"


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Windows of three words are hashed and compared as numbers; only texts in which one repeats sort them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    line = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.withColumn("_words", F.filter(F.split(text, BLANK), lambda x: x != "")).withColumn("_lines", line)
    windows = F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    b = a.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    c = b.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", k - 1)["h"], F.lit(False)))
    d = c.withColumn("_at", F.sort_array(F.transform(same, lambda x: x["i"])))
    gaps = F.transform("_at", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("_at", k - 1), F.lit(-3))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).drop("_windows", "_sorted", "_at")


def statistics(counted: DataFrame) -> list[Column]:
    """The four statistics of a row that has words, as x0 to x3."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(chars / words).alias("x0"),
        F.log1p(F.lit(100.0) * F.col("n_symbols") / chars).alias("x1"),
        (F.col("n_repeat_words") / words).alias("x2"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")).alias("x3"),
    ]


def _quantile(binned: DataFrame, by: list[str], share: float, name: str) -> DataFrame:
    """For each ``by`` the least ``bin`` at or below which ``share`` of the rows lie."""
    n = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    below = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("below", below).withColumn("all", F.sum("n").over(w)).filter(F.col("below") >= share * F.col("all")).groupBy(*by).agg(F.min("bin").alias(name))


def _wide(long: DataFrame, name: str) -> DataFrame:
    return long.groupBy("key").agg(*(F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"{name}{j}") for j in range(P)))


def _starts(rows: DataFrame, join) -> DataFrame:
    """Three starts of each key: medians with scaled median deviations, medians with the floors alone, and mean and covariance of all."""
    def long(df: DataFrame, value) -> DataFrame:
        return df.select("key", F.posexplode(F.array(*(value(j) for j in range(P)))).alias("j", "v")).withColumn("bin", F.floor(F.col("v") * 128))

    medians = stored(_wide(_quantile(long(rows, lambda j: F.col(f"x{j}")), ["key", "j"], 0.5, "b").withColumn("v", (F.col("b") + 0.5) / 128), "m"), "quality-medians")
    spread = _wide(_quantile(long(join(rows, medians), lambda j: F.abs(F.col(f"x{j}") - F.col(f"m{j}"))), ["key", "j"], 0.5, "b").withColumn("v", (F.col("b") + 0.5) / 128 * 1.4826), "s")

    def diagonal(of: DataFrame, start: int, spread) -> DataFrame:
        factor = [(F.sqrt(spread(i) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)]
        return of.select("key", F.lit(start).alias("start"), *(f"m{j}" for j in range(P)), *factor)

    whole = _estimate(rows.groupBy("key").agg(*_sums()).withColumn("start", F.lit(2))).drop("logdet")
    return diagonal(medians.join(spread, "key"), 0, lambda i: F.col(f"s{i}")).unionByName(diagonal(medians, 1, lambda i: F.lit(0.0))).unionByName(whole)


def _names() -> list[str]:
    return [f"m{j}" for j in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]


def distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _bin(d: Column) -> Column:
    return F.floor(F.log(d + 1e-9) * 32)


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _sums() -> list[Column]:
    """Number, sums and sums of products of rows."""
    return [F.sum(F.lit(1.0)).alias("n"), *(F.sum(f"x{i}").alias(f"a{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}{j}") for i, j in PAIRS)]


def _estimate(sums: DataFrame) -> DataFrame:
    """Means, Cholesky factor and log determinant of the regularised covariance of each key and start."""
    out = sums.select("key", "start", *((F.col(f"a{i}") / F.col("n")).alias(f"m{i}") for i in range(P)), *((F.col(f"a{i}{j}") / F.col("n")).alias(f"a{i}{j}") for i, j in PAIRS))
    for i, j in PAIRS:  # row by row
        c = F.col(f"a{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(FLOORS[i] ** 2 / 4))) if i == j else c / F.col(f"l{j}{j}"))
    return out.select("key", "start", *_names(), (2 * sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))).alias("logdet"))


def _concentrate(rows: DataFrame, estimate: DataFrame, join) -> DataFrame:
    """One step: the nearest share of each key's rows gives the next estimate of each start."""
    binned = join(rows, estimate).withColumn("bin", _bin(distance())).groupBy("key", "start", "bin").agg(*_sums())
    w = Window.partitionBy("key", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    near = binned.withColumn("before", before).withColumn("all", F.sum("n").over(w)).filter(F.col("before") < SHARE * F.col("all"))
    return _estimate(near.groupBy("key", "start").agg(*(F.sum(x).alias(x) for x in ["n", *(f"a{i}" for i in range(P)), *(f"a{i}{j}" for i, j in PAIRS)])))


def robust(rows: DataFrame, join) -> DataFrame:
    """(key, means, factor, logdet) of the least determinant that the starts of each key settle at."""
    now = stored(_concentrate(rows, _starts(rows, join), join).withColumn("moved", F.lit(True)), "quality-estimates")
    while not now.filter("moved").isEmpty():
        # starts that are settled stay as they are; determinants of the others fall, so they settle, too
        open_ones = now.filter("moved").drop("moved")
        then = _concentrate(rows, open_ones, join)
        was = open_ones.select("key", "start", F.col("logdet").alias("was"), F.struct(*_names(), "logdet").alias("old"))
        better = F.col("logdet") < F.col("was") - SETTLED
        chosen = F.when(better, F.struct(*_names(), "logdet")).otherwise(F.col("old"))
        next_ones = then.join(was, ["key", "start"]).select("key", "start", chosen.alias("e"), better.alias("moved")).select("key", "start", "e.*", "moved")
        now = stored(now.filter("not moved").unionByName(next_ones), "quality-estimates")
    return now.groupBy("key").agg(F.min_by(F.struct(*_names(), "logdet"), F.struct("logdet", "start")).alias("e")).select("key", "e.*")


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts of each document, whether it fails the base rules, its robust distance, and whether it is kept."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _hash(docs).alias("row_hash"), F.coalesce(F.col("lang").cast("string"), F.lit("\x00")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("source"))
    counted = counts(given).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    features = stored(counted.select("*", failed.alias("base_failed"), *statistics(counted)), "quality")
    passing = features.filter("not base_failed")
    sizes = passing.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < LEAST)
    language, corpus = Window.partitionBy("lang"), Window.partitionBy(F.lit(0))  # over sources, not over rows
    sizes = sizes.withColumn("n_lang", F.sum("n").over(language)).withColumn("own", F.concat_ws("\x01", F.lit("s"), "lang", "source")).withColumn("pool", F.concat_ws("\x01", F.lit("l"), "lang"))
    sizes = sizes.withColumn("key", F.when(~F.col("small"), F.col("own")).when(F.col("n_lang") >= LEAST, F.col("pool")).otherwise(F.lit("*")))
    # a row counts for its source, and for its language or the corpus if a small source is judged by that
    into = F.array_compact(F.array(F.when(~F.col("small"), F.col("own")), F.when(F.bool_or(F.col("key") == F.col("pool")).over(language), F.col("pool")), F.when(F.bool_or(F.col("key") == "*").over(corpus), F.lit("*"))))
    keys = stored(sizes.select("lang", "source", "key", into.alias("into")), "quality-keys")
    few = keys.count() <= BROADCAST_KEYS

    def join(left: DataFrame, right: DataFrame, on="key", how: str = "inner") -> DataFrame:
        return left.join(F.broadcast(right) if few else right, on, how)

    rows = join(passing.select("lang", "source", *(f"x{j}" for j in range(P))), keys.select("lang", "source", "into"), ["lang", "source"]).select(F.explode("into").alias("key"), *(f"x{j}" for j in range(P)))
    estimate = stored(robust(rows, join), "quality-estimates")
    middle = _quantile(join(rows, estimate).withColumn("bin", _bin(distance())), ["key"], 0.5, "b")
    total = rows.groupBy("key").agg(F.count("*").alias("n_key"))
    final = estimate.join(middle, "key").join(total, "key").withColumn("scale", F.greatest(F.lit(1.0), F.exp((F.col("b") + 0.5) / 32) / MEDIAN))
    judged = join(join(features, keys.drop("into"), ["lang", "source"], "left"), final, "key", "left")
    far = F.when(F.col("n_key") >= LEAST, distance() / F.col("scale"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far > CUTOFF, F.lit(False))).alias("kept"), far.alias("distance"), "row_hash")


def _hash(docs: DataFrame) -> Column:
    """What a verdict follows from, so that rows under one id, or none, are judged each for itself."""
    return F.xxhash64(docs["text"], docs["lang"], docs["source"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that are kept."""
    bad = verdicts(docs).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (_hash(docs) == bad["__hash"]), "left_anti")
