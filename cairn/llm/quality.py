"""Quality rules: fixed ones per text, and robust multivariate outliers per language and source.

DataFrame expressions only. Each text's counts come from its word array within its row. Four
statistics (mean word length; shares of short words, upper-case letters and punctuation, each
shrunk towards its language's share by ``PSEUDO`` uses and made even by arcsine or logarithm) form a
vector; the minimum covariance determinant of each (language, source) tells how vectors of sound
texts spread, whatever up to half of the texts look like.

Concentration steps start from medians and median deviations, as in deterministic MCD (Hubert, Rousseeuw
and Verdonck 2012). Each step keeps the half of a group's texts that lie nearest and takes the mean
and covariance of these, until neither changes. A step is one aggregation by group and log distance, in
bins of one per cent, that sums texts, vectors and their products: running sums over the bins give
the half's moments, so no group is ever gathered or sorted in a task. A reweighting step ends it.

Estimates are regularised as in MRCD (Boudt, Rousseeuw, Vanduffel and Verdonck 2020): a group's
moments are mixed, as with ``PRIOR`` further texts, with a fixed target, the medians and deviations of
its language's groups pooled, themselves mixed with those of all. So every group has an estimate of
its own, whatever its size.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import BROADCAST_BYTES, materialize, small_side, without

WORD_GAP, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
#: Word counts below which, and percentages of repeated words above which, the base rules reject.
LEAST_WORDS, MOST_REPEATED = 50, 50
X = ("x1", "x2", "x3", "x4")
P = len(X)
#: Uses at the language's share; texts at the moments of the level above; steps at most, and the change, in spreads, at which they end.
PSEUDO, PRIOR, STEPS, CHANGE = 200.0, 50.0, 25, 0.05
#: The least variance of a direction: what lies nearly in a plane isn't judged by finer distances.
LEAST_VARIANCE = 1e-5
#: A sound text is rejected with this probability, were vectors normal: statistics of real texts have longer tails.
REJECT = 1e-12
#: Bins of log distances, and of single statistics for the start.
_BINS_PER_E, _BINS_PER_UNIT = 100, 200


def _chi2(x: float, freedom: int) -> float:
    """The chi-squared distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, freedom // 2):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


def _chi2_quantile(q: float, freedom: int) -> float:
    """Where all but 1 - ``q`` lies; by bisection on the upper tail."""
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        term, total = 1.0, 1.0
        for k in range(1, freedom // 2):
            term *= mid / 2 / k
            total += term
        low, high = (low, mid) if -mid / 2 + log(total) < log(1 - q) else (mid, high)
    return high


def _consistency(q: float) -> float:
    """What makes the covariance of the nearest share ``q`` of normal vectors that of all."""
    return q / _chi2(_chi2_quantile(q, P), P + 2)


def _repeated(windows: Column, sorted_windows: Column, twice: Column) -> Column:
    """Positions of windows whose hash is in ``twice``: by look-up for a few, by sorting otherwise."""
    few = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = F.transform(F.array(placed), lambda all_: F.filter(F.transform(all_, lambda w, k: F.when((F.get(all_, k - 1)["h"] == w["h"]) | (F.get(all_, k + 1)["h"] == w["h"]), w["i"])), lambda i: i.isNotNull()))
    return F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) <= 32, few).otherwise(F.sort_array(marked[0]))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``'s columns with the counts of each text in place of ``text``; null counts as empty.

    Words are compared by 64-bit hash: within a text of a million words two 3-word windows agree by
    chance with a probability under 1e-7.
    """
    keep = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    length = lambda pattern: F.char_length(F.regexp_replace("_text", pattern, "")).cast("long")
    words = docs.select(*keep, body.alias("_text"), F.filter(F.split(body, WORD_GAP), lambda w: w != "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        length(WORD_GAP).alias("word_chars"),
        length(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.when(F.contains("_text", F.lit("\n")), F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]).otherwise(0).cast("long").alias("n_dup_lines"),
        length(r"\P{Lu}+").alias("n_upper"),
        length(r"[\p{L}\p{N}\s]+").alias("n_punctuation"),
        F.size(F.filter("_words", lambda w: F.char_length(w) <= 3)).cast("long").alias("n_short"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    three = F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))
    windowed = counted.withColumn("_w", F.when(F.size("_h") >= 3, three).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    ordered = windowed.withColumn("_s", F.sort_array("_w"))
    twice = ordered.withColumn("_d", F.array_distinct(F.filter("_s", lambda h, k: F.get("_s", k - 1) == h)))
    found = twice.withColumn("_p", _repeated(F.col("_w"), F.col("_s"), F.col("_d"))).drop("_w", "_s", "_d")
    covered = F.aggregate(F.transform("_p", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.withColumn("n_repeat_words", covered).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vectors(counts: DataFrame) -> DataFrame:
    """Rows that the base rules pass, with their vector; shares are shrunk towards their language's."""
    sound = counts.where("not base_failed")
    shares = (("n_short", "n_words"), ("n_upper", "word_chars"), ("n_punctuation", "word_chars"))
    means = [(F.sum(a) / F.sum(b)).alias(f"mean_{a}") for a, b in shares] + [(F.sum("word_chars") / F.sum("n_words")).alias("mean_length")]
    by_language = small_side(materialize(sound.groupBy("_lang").agg(*means), "quality-shares"), 64)
    rows = sound.join(by_language, "_lang")
    even = [F.asin(F.sqrt(F.least(F.lit(1.0), (F.col(a) + PSEUDO * F.col(f"mean_{a}")) / (F.col(b) + PSEUDO)))) for a, b in shares]
    length = F.log((F.col("word_chars") + PSEUDO * F.col("mean_length")) / (F.col("n_words") + PSEUDO))
    x = [c.alias(name) for name, c in zip(X, [length, *even], strict=True)]
    return rows.select("_row", "_lang", "_source", *x)


def _distance(rows: DataFrame) -> Column:
    """Squared Mahalanobis distance, by forward substitution in the Cholesky factor ``c11``, ``c21``, ..."""
    y: list[Column] = []
    for i in range(P):
        rest = reduce(lambda a, k: a - F.col(f"c{i + 1}{k + 1}") * y[k], range(i), F.col(X[i]) - F.col(f"m{i + 1}"))
        y.append(rest / F.col(f"c{i + 1}{i + 1}"))
    return reduce(lambda a, b: a + b, [v * v for v in y])


_PAIRS = [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]
KEY = ["_lang", "_source"]


def _cholesky(moments: DataFrame) -> DataFrame:
    """``m1..`` and ``s11..`` to ``m1..`` and ``c11..``."""
    out = moments
    for i, j in _PAIRS:
        rest = reduce(lambda a, k: a - F.col(f"c{i}{k}") * F.col(f"c{j}{k}"), range(1, j), F.col(f"s{i}{j}"))  # noqa: B023
        out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(LEAST_VARIANCE))) if i == j else rest / F.col(f"c{j}{j}"))
    return out.drop(*[f"s{i}{j}" for i, j in _PAIRS])


def _sums() -> list[Column]:
    """Texts, vectors and products of vectors, summed."""
    return [F.count(F.lit(1)).cast("double").alias("k"), *[F.sum(x).alias(f"a{i}") for i, x in enumerate(X, 1)], *[F.sum(F.col(X[i - 1]) * F.col(X[j - 1])).alias(f"b{i}{j}") for i, j in _PAIRS]]


_SUMMED = ["k", *[f"a{i}" for i in range(1, P + 1)], *[f"b{i}{j}" for i, j in _PAIRS]]


_MOMENTS = [f"m{i}" for i in range(1, P + 1)] + [f"s{i}{j}" for i, j in _PAIRS]


def _mixed(sums: DataFrame, scale: float, above: str | None) -> list[Column]:
    """Centre and covariance, times ``scale``, of ``sums``, mixed with the moments of prefix ``above`` if there are any."""
    mean = lambda i: F.col(f"a{i}") / F.col("k")
    own = [mean(i) for i in range(1, P + 1)] + [(F.col(f"b{i}{j}") / F.col("k") - mean(i) * mean(j)) * scale for i, j in _PAIRS]
    mixed = [(F.col("k") * x + PRIOR * F.col(above + c)) / (F.col("k") + PRIOR) for x, c in zip(own, _MOMENTS, strict=True)] if above is not None else own
    return [x.alias(c) for x, c in zip(mixed, _MOMENTS, strict=True)]


def _targets(start: DataFrame) -> DataFrame:
    """By language what its groups' estimates are drawn to: the pooled start of its groups, itself drawn to that of all."""
    of = lambda rows, key: rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in _SUMMED])
    languages = of(start, KEY[:1])
    whole = of(languages, [])
    whole = F.broadcast(whole.select(*_mixed(whole, 1.0, None)).select(*[F.col(c).alias(f"w_{c}") for c in _MOMENTS]))  # one row
    tied = languages.join(whole)
    return tied.select("_lang", *_mixed(tied, 1.0, "w_")).select("_lang", *[F.col(c).alias(f"l_{c}") for c in _MOMENTS])


def _regularised(sums: DataFrame, targets: DataFrame, scale: float) -> DataFrame:
    """Sums by group to centre and Cholesky factor of the covariance, times ``scale``, mixed with the language's."""
    tied = sums.join(targets, "_lang")
    return _cholesky(tied.select(*KEY, *_mixed(tied, scale, "l_")))


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and median deviations by group as sums of as many texts: centre and diagonal, by histograms of each statistic."""
    each = vectors.select(*KEY, F.posexplode(F.array(*X)).alias("i", "x")).groupBy(*KEY, "i", F.floor(F.col("x") * _BINS_PER_UNIT).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    all_ = Window.partitionBy(*KEY, "i")
    up = each.withColumn("up", F.sum("k").over(all_.orderBy("bin"))).withColumn("n", F.sum("k").over(all_))
    middle = up.withColumn("middle", F.min(F.when(F.col("up") * 2 >= F.col("n"), F.col("bin"))).over(all_)).withColumn("off", F.abs(F.col("bin") - F.col("middle")))
    off = middle.withColumn("up", F.sum("k").over(all_.orderBy("off")))
    of = off.groupBy(*KEY, "i").agg(F.max("n").cast("double").alias("k"), F.max("middle").alias("middle"), F.min(F.when(F.col("up") * 2 >= F.col("n"), F.col("off"))).alias("off"))
    m, s = (F.col("middle") + 0.5) / _BINS_PER_UNIT, ((F.col("off") + 0.5) / _BINS_PER_UNIT / 0.6745) ** 2
    one = lambda value, i: F.max(F.when(F.col("i") == i - 1, value))
    means = [one(F.col("k") * m, i).alias(f"a{i}") for i in range(1, P + 1)]
    products = [(one(F.col("k") * (m * m + s), i) if i == j else one(m, i) * one(m, j) * F.max("k")).alias(f"b{i}{j}") for i, j in _PAIRS]
    return of.groupBy(*KEY).agg(F.max("k").alias("k"), *means, *products)


def _half(near: DataFrame) -> DataFrame:
    """Sums over the nearer half of each group: all bins of distances up to the one in which the half ends."""
    bins = near.groupBy(*KEY, F.floor(F.log(_distance(near) + 1e-12) * _BINS_PER_E).alias("bin")).agg(*_sums())  # at most some 5,000 bins a group
    up, all_ = Window.partitionBy(*KEY).orderBy("bin"), Window.partitionBy(*KEY)
    placed = bins.withColumn("before", F.sum("k").over(up) - F.col("k")).withColumn("n", F.sum("k").over(all_))
    return placed.where(F.col("before") < F.floor((F.col("n") + P + 1) / 2)).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in _SUMMED])


def _moved(old: DataFrame, new: DataFrame) -> float:
    """The largest step of any centre, in spreads, or change of any spread."""
    both = old.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in old.columns if c not in KEY]).join(new, KEY)
    steps = [F.abs(F.col(f"m{i}") - F.col(f"o_m{i}")) / F.col(f"c{i}{i}") for i in range(1, P + 1)] + [F.abs(F.log(F.col(f"c{i}{i}") / F.col(f"o_c{i}{i}"))) for i in range(1, P + 1)]
    return both.agg(F.max(F.greatest(*steps))).first()[0] or 0.0


def estimates(vectors: DataFrame) -> DataFrame:
    """Per (language, source) the reweighted MCD's centre ``m1..`` and Cholesky factor ``c11..``."""
    start = materialize(_start(vectors), "quality-start")
    few = start.limit(BROADCAST_BYTES // 200 + 1).count() <= BROADCAST_BYTES // 200  # as many groups in every step
    side = F.broadcast if few else lambda groups: groups
    targets = side(materialize(_targets(start), "quality-targets"))
    now = materialize(_regularised(start, targets, 1.0), "quality-step")
    for _ in range(STEPS):
        old, now = now, materialize(_regularised(_half(vectors.join(side(now), KEY)), targets, _consistency(0.5)), "quality-step")
        if _moved(old, now) < CHANGE:
            break
    near = vectors.join(side(now), KEY).where(_distance(vectors) <= _chi2_quantile(0.975, P))
    final = materialize(_regularised(near.groupBy(*KEY).agg(*_sums()), targets, _consistency(0.975)), "quality-estimates")
    # a group none of whose texts lies within the quantile keeps its concentration step
    return final.unionByName(now.join(final.select(*KEY), KEY, "left_anti"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", reject: float = REJECT) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)`` per row.

    kept is false where base_failed (under 50 words, or over half of them in repeated 3-word windows)
    or where distance, the squared robust distance, is beyond the chi-squared quantile of 1 - ``reject``;
    distance is null where base_failed. Null text counts as empty; null languages and sources are
    groups of their own. Repeated rows count each; a null doc_id is kept; an empty table gives no rows;
    other columns are ignored. A text costs some 100 bytes a word while its row is worked on.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("_lang"), F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("_source"), F.col(text).alias("text"))
    counts = text_counts(named).withColumn("base_failed", base_failed()).withColumn("_row", F.monotonically_increasing_id())
    counts = materialize(counts, "quality-counts")
    vectors = materialize(_vectors(counts), "quality-rows")
    found = materialize(estimates(vectors), "quality-found")
    near = vectors.join(small_side(found, 200), KEY)
    ranked = near.select("_row", _distance(near).alias("distance"))
    out = counts.join(ranked, "_row", "left")
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= _chi2_quantile(1 - reject, P))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject; all rows of a rejected doc_id go."""
    return without(docs, quality_rules(docs).where("not kept"), "doc_id")
