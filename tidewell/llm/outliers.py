"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Every text becomes a short vector of transformed statistics. For each group a deterministic concentration search finds the
half of the rows whose covariance has the least determinant: it starts from several spreads around the median, takes the
rows nearest by Mahalanobis distance, fits mean and covariance anew and repeats until no group's determinant falls further.
Rows beyond a chi-square cut of the consistency-corrected, reweighted estimate are rejected.

Groups are all rows, each language, and each language and source. The estimate of a group of n rows is averaged with that of the
group around it at weights n and PRIOR, and so are a row's distances from its source's and its language's estimate. A source of a
handful of rows is thus judged mostly as its language, one of hundreds by itself, and there is no size at which the rule changes.

Plan: texts are read once into a table of numbers; all further passes are grouped aggregates over that table with map-side
partial sums, so a group with a third of all rows costs no more than others. Nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, let, materialize, words

#: Names of the transformed statistics.
DIMS = ("f_length", "f_symbols", "f_lines", "f_repeats", "f_capitals", "f_marks", "f_stutter")
#: Least spread of each statistic, so that a group in which nearly all rows agree is no degenerate one. In transformed units.
FLOOR = 0.08
#: Share of rows in the concentrated half; rows that the estimate of the surrounding group counts as (five for each dimension).
SHARE, PRIOR = 0.5, 5 * len(DIMS)
#: Concentration ends when no log determinant falls by more than SETTLED; after MOST steps at the latest (quantiles are approximate
#: to 1 in 2,000, so the determinant of a large group may waver).
SETTLED, MOST = 0.01, 30
#: Chi-square quantile at 0.9999 with 7 degrees of freedom. Fixed value.
CUT = 29.8775
#: Consistency of the covariance of the nearest SHARE rows in 7 dimensions: SHARE / P(chi2 with 9 <= quantile at SHARE of chi2 with 7).
CONSISTENCY = 1.6942
#: Bytes that a broadcast row of group estimates takes, at most.
GROUP_BYTES = 4096


def text_statistics(text: Column) -> Column:
    """A struct of the base statistics of one text; null: none.

    A window's five words are hashed to 64 bits; texts in which all windows differ need no sort.
    """

    def of(w: Column, t: Column) -> Column:
        windows = F.when(F.size(w) < 5, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(*[F.element_at(w, i + F.lit(k)) for k in range(5)]))
        )
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
        letters = F.char_length(F.regexp_replace(t, "\\P{Lu}", ""))
        marks = F.char_length(t) - F.char_length(F.translate(t, "!|;:?", ""))
        return let(
            F.struct(windows.alias("h"), lines.alias("l")),
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda s, y: s + F.char_length(y)).alias("word_chars"),
                (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
                F.when(F.size(F.array_distinct(x["h"])) == F.size(x["h"]), F.lit(0).cast("long")).otherwise(_covered(x["h"])).alias("n_repeat_words"),
                F.size(x["l"]).cast("long").alias("n_lines"),
                letters.cast("long").alias("n_capitals"),
                marks.cast("long").alias("n_marks"),
                F.aggregate(w, F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("last")), lambda a, y: F.struct((a["n"] + (a["last"] == y).cast("long")).alias("n"), y.alias("last")), lambda a: a["n"]).alias("n_stutter"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of(w, t)))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), mark equal neighbours, add up the stretches."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def stretch(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i + 1 < n) & (F.get(s, F.least(i + 1, n - 1))["h"] == x["h"])), x["i"]
                ),
            ),
            lambda p: p.isNotNull(),
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(F.array_sort(same), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return let(placed, stretch)


def _vector() -> list[Column]:
    """The transformed statistics: densities are smoothed by the text's length, so that short texts do not stick out."""
    n = F.col("n_words").cast("double")
    return [
        (F.log((F.col("word_chars") + 150.0) / (n + 30.0)) * 2.0).alias(DIMS[0]),
        F.log1p(20.0 * F.col("n_symbols") / (n + 20.0)).alias(DIMS[1]),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4.0)).alias(DIMS[2]),
        F.sqrt(F.col("n_repeat_words") / (n + 20.0)).alias(DIMS[3]),
        F.log1p(4.0 * F.col("n_capitals") / (n + 20.0)).alias(DIMS[4]),
        F.log1p(8.0 * F.col("n_marks") / (n + 20.0)).alias(DIMS[5]),
        F.log1p(8.0 * F.col("n_stutter") / (n + 10.0)).alias(DIMS[6]),
    ]


PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _inverse(matrix: Column) -> Column:
    """(m: inverse, logdet) of a symmetric positive definite array of arrays, by the sweep operator."""

    def step(state: Column, k: Column) -> Column:
        m = state["m"]
        d = F.get(F.get(m, k), k)
        swept = F.transform(
            m,
            lambda row, i: F.transform(
                row,
                lambda v, j: F.when((i == k) & (j == k), 1.0 / d).when(i == k, v / d).when(j == k, -F.get(row, k) / d).otherwise(v - F.get(row, k) * F.get(F.get(m, k), j) / d),
            ),
        )
        return F.struct(swept.alias("m"), (state["logdet"] + F.log(d)).alias("logdet"))

    start = F.struct(matrix.alias("m"), F.lit(0.0).alias("logdet"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(DIMS) - 1)), start, step)


def _moments(chosen: str, tag: str) -> list[Column]:
    """Sums of the statistics and of their products over the rows chosen: what mean and covariance need, mergeable map-side."""
    weight = f"if({chosen}, 1D, 0D)"
    own = {f"w{tag}": weight} | {f"s{i}{tag}": f"{weight} * {x}" for i, x in enumerate(DIMS)}
    own |= {f"q{i}_{j}{tag}": f"{weight} * {DIMS[i]} * {DIMS[j]}" for i, j in PAIRS}
    return [F.expr(f"sum({v})").alias(k) for k, v in own.items()]


def _estimates(sums: DataFrame, tags: list[str], factor: float) -> DataFrame:
    """Per group and start: `n` (weight), mean and covariance, scaled by `factor`. Keeps `logdet` if there is one, as `before`."""

    def cov(i: int, j: int, t: str) -> str:
        raw = f"(q{max(i, j)}_{min(i, j)}{t} / w{t} - s{i}{t} / w{t} * (s{j}{t} / w{t})) * {factor}D"
        return f"{raw} + {FLOOR**2}D" if i == j else raw

    columns = ["g", *[c for c in sums.columns if c == "before"]]
    places = range(len(DIMS))
    for t in tags:
        matrix = ", ".join(f"array({', '.join(cov(i, j, t) for j in places)})" for i in places)
        columns += [F.col(f"w{t}").alias(f"n{t}"), F.expr(f"array({', '.join(f's{i}{t} / w{t}' for i in places)})").alias(f"mean{t}"), F.expr(f"array({matrix})").alias(f"cov{t}")]
    return sums.select(*columns)


def _inverted(estimates: DataFrame, tags: list[str]) -> DataFrame:
    """Per group and start: what distances need, as flat columns: mean, inverse covariance and log determinant."""
    kept = ["g", *[c for c in estimates.columns if c in ("before", "share")]]
    inverted = materialize(estimates.select(*kept, *[F.col(f"mean{t}") for t in tags], *[_inverse(F.col(f"cov{t}")).alias(f"inverse{t}") for t in tags]), "fits")
    for t in tags:
        kept += [F.col(f"mean{t}")[i].alias(f"m{i}{t}") for i in range(len(DIMS))]
        kept += [F.col(f"inverse{t}.m")[i][j].alias(f"p{i}_{j}{t}") for i, j in PAIRS]
        kept += [F.col(f"inverse{t}.logdet").alias(f"logdet{t}")]
    return inverted.select(*kept)


def _distance(t: str) -> Column:
    """Squared Mahalanobis distance to the fit of tag `t`."""
    term = lambda i, j: f"{'' if i == j else '2D * '}p{i}_{j}{t} * ({DIMS[i]} - m{i}{t}) * ({DIMS[j]} - m{j}{t})"
    return F.expr(" + ".join(term(i, j) for i, j in PAIRS))


def _nearest(near: DataFrame, tags: list[str], few: bool) -> DataFrame:
    """The moments of the nearest SHARE of each group's rows by the distances d of each start (ties at the cut all count)."""
    cuts = near.groupBy("g").agg(*[F.percentile_approx(f"d{t}", SHARE, 2000).alias(f"c{t}") for t in tags])
    chosen = near.join(F.broadcast(cuts) if few else cuts, "g")
    first = [F.first("before").alias("before")] if "before" in near.columns else []
    return chosen.groupBy("g").agg(*[x for t in tags for x in _moments(f"d{t} <= c{t}", t)], *first)


def _concentrate(rows: DataFrame, fits: DataFrame, tags: list[str], few: bool) -> DataFrame:
    """One concentration step of each start."""
    near = rows.join(F.broadcast(fits) if few else fits, "g")
    before = [F.col("logdet").alias("before")] if tags == [""] else []
    near = near.select("g", *DIMS, *before, *[_distance(t).alias(f"d{t}") for t in tags])
    return _inverted(_estimates(_nearest(near, tags, few), tags, CONSISTENCY), tags)


def _averaged(own: DataFrame, around: DataFrame) -> DataFrame:
    """Estimates of groups (with `up`, the group around each), averaged with those of the groups around them."""
    outer = around.select(F.col("g").alias("up"), F.col("mean").alias("up_mean"), F.col("cov").alias("up_cov"))
    share = F.col("n") / (F.col("n") + PRIOR)
    mix = lambda a, b: a * share + b * (1 - share)
    joined = own.join(outer, "up")
    mean = F.zip_with("mean", "up_mean", mix)
    return joined.select("g", "up", share.alias("share"), mean.alias("mean"), F.zip_with("cov", "up_cov", lambda a, b: F.zip_with(a, b, mix)).alias("cov"))


def reject_outliers(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, the base statistics, base_failed, distance (squared, null if no row passes the base rules)
    and kept.

    A null or empty text has no words and fails the base rules. Rows with a null language or source form groups of their
    own. Only rows that pass the base rules enter estimates; rows at equal distances are all in or out of the half. Repeated rows
    and ids are judged one by one; an empty table gives an empty result. Of the input only doc_id, text, lang and source are read.
    """
    lang = F.coalesce(F.concat(F.lit("l:"), F.col("lang").cast("string")), F.lit("l"))
    source = F.concat(lang, F.coalesce(F.concat(F.lit("\x00:"), F.col("source").cast("string")), F.lit("\x00")))
    stats = docs.select("doc_id", lang.alias("g_lang"), source.alias("g_own"), text_statistics(F.col("text")).alias("x")).select("doc_id", "g_lang", "g_own", "x.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = materialize(stats.withColumn("base_failed", failed).select("*", *_vector()), "statistics")
    fit_rows = rows.filter(~F.col("base_failed")).select(F.explode(F.array(F.lit("*"), "g_lang", "g_own")).alias("g"), *DIMS)

    # Starts: distances from the median with the absolute deviations as scales, combined as sum of squares, sum and most.
    medians = materialize(fit_rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 2000).alias(f"med_{x}") for x in DIMS]), "medians")
    few = medians.count() * GROUP_BYTES <= BROADCAST_BYTES
    held = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    centred = fit_rows.join(held(medians), "g")
    spreads = centred.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"med_{x}")), 0.5, 2000).alias(f"mad_{x}") for x in DIMS])
    scaled = centred.join(held(materialize(spreads, "spreads")), "g")
    z = [F.abs(F.col(x) - F.col(f"med_{x}")) / (1.4826 * F.col(f"mad_{x}") + FLOOR) for x in DIMS]
    starts = {"_a": sum((v * v for v in z), F.lit(0.0)), "_b": sum(z, F.lit(0.0)), "_c": F.greatest(*z)}
    tags = list(starts)
    near = scaled.select("g", *DIMS, *[v.alias(f"d{t}") for t, v in starts.items()])
    fits = _concentrate(fit_rows, _inverted(_estimates(_nearest(near, tags, few), tags, CONSISTENCY), tags), tags, few)

    # The start of least determinant goes on alone, until nothing falls any more.
    best = F.least(*[F.col(f"logdet{t}") for t in tags])
    pick = lambda name: F.coalesce(*[F.when(F.col(f"logdet{t}") == best, F.col(f"{name}{t}")) for t in tags]).alias(name)
    fits = fits.select("g", *[pick(f"m{i}") for i in range(len(DIMS))], *[pick(f"p{i}_{j}") for i, j in PAIRS], pick("logdet"))
    for _ in range(MOST):
        fits = _concentrate(fit_rows, fits, [""], few)
        if (fits.agg(F.max(F.col("before") - F.col("logdet"))).first()[0] or 0.0) <= SETTLED:
            break

    # Reweighting: all rows within the cut of the raw estimate give the final one.
    inside = fit_rows.join(held(fits), "g").select("g", *DIMS, _distance("").alias("d"))
    final = materialize(_estimates(inside.groupBy("g").agg(*_moments(f"d <= {CUT}D", "")), [""], 1.0), "estimates")
    every = final.filter("g = '*'")
    names = materialize(rows.filter(~F.col("base_failed")).select("g_lang", "g_own").distinct(), "names")
    of_lang = final.join(names.select(F.col("g_lang").alias("g")).distinct(), "g").withColumn("up", F.lit("*"))
    of_lang = _averaged(of_lang, every)
    own = _averaged(final.join(names.select(F.col("g_own").alias("g"), F.col("g_lang").alias("up")), "g"), of_lang)
    both = own.join(of_lang.select(F.col("g").alias("up"), F.col("mean").alias("mean_up"), F.col("cov").alias("cov_up")), "up")
    judging = _inverted(both.select("g", "share", F.col("mean").alias("mean_own"), F.col("cov").alias("cov_own"), "mean_up", "cov_up"), ["_own", "_up"])
    share = F.col("share")
    judged = rows.join(held(judging.withColumnRenamed("g", "g_own")), "g_own", "left").withColumn("distance", share * _distance("_own") + (1 - share) * _distance("_up"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", *DIMS)
