"""Quality rules: fixed limits, and robust outlier rejection for each language and source.

Every document gets a vector of transformed statistics.  A minimum-covariance-
determinant estimate (the mean and covariance of that share of a group's rows whose
covariance is smallest) describes what is usual for its language and source, and a
document whose squared Mahalanobis distance passes a chi-square point is rejected.

The estimate starts from the group's medians-by-histogram and repeats concentration
steps: keep the closest share of the rows, take their mean and covariance, measure
again.  A step needs two aggregations and no sort: the closest rows are those below a
histogram bin edge.  Statistics are rounded to whole steps of 2**-10, so all sums are
sums of integers; results don't depend on how rows are dealt out.  A group's estimate
is drawn towards its language's by ``PRIOR`` rows, so groups of any size have one.

Definitions: a null text has no words; null languages and sources form groups of their
own; repeated rows are judged each on its own; an empty table gives an empty table.
Only the named columns are read, so further columns can't clash with the results.
"""

from functools import reduce
from math import erf, exp, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.sources.staging import materialize

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Share of a group's rows that its estimate rests on.
SHARE = 0.75
STEPS = 3
#: Rows of its language that every group's estimate is mixed with.
PRIOR = 50
#: Rejected beyond this squared distance: the chi-square point that a vector of five normal
#: statistics passes once in a thousand.
CUT = 20.515
#: Rows of a group this many doublings beyond its language's share are never close: a group
#: may be as small as one odd row.
REACH = 4
SCALE = 1024
#: Added to the variances of the transformed statistics: what counts as one usual deviation where
#: a group hardly varies.  For repeats that is a tenth of the words, for repeated lines a factor of
#: 1.65 in their number plus one, for symbols 0.03 % of the characters.  With ``CUT`` each statistic
#: can reject by itself: from about 46 % repeated words, 9 repeated lines or 0.65 % symbols on.
FLOORS = (0.05, 0.05, 0.02, 0.25, 0.04)
#: Bins of a squared distance or a deviation for each doubling.
BINS = 32

STATS = ("s_length", "s_chars", "s_symbols", "s_lines", "s_repeats")
N = len(STATS)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]


def _chi_square(x: float, more: bool = False) -> float:
    """Chance that the sum of five squared normal values is at most ``x``; of seven with ``more``."""
    five = erf(sqrt(x / 2)) - sqrt(2 * x / pi) * exp(-x / 2) * (1 + x / 3)
    return five - sqrt(2 / pi) * x**2.5 * exp(-x / 2) / 15 if more else five


def consistency(share: float) -> float:
    """What the covariance of the closest ``share`` of normal rows is to be multiplied by to be that of all rows."""
    low, high = 0.0, 100.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle) < share else (low, middle)
    return share / _chi_square(low, more=True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for the row."""
    return F.transform(F.array(value), body)[0]


def _neighbours(sorted_values: Column, same) -> Column:
    """Both members of every two neighbours for which ``same`` holds."""
    n = F.size(sorted_values)
    pairs = F.zip_with(
        F.slice(sorted_values, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(sorted_values, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(same(a, b), F.array(a, b)),
    )
    return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))


POSITION_BITS = 31


def repeated_window_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are sorted as hash bits above the position.  Windows that share hash bits
    are then compared by their words, so the count is exact.
    """

    def window(w: Column, p: Column) -> Column:
        return F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))

    def count(w: Column) -> Column:
        n = F.size(w)
        keys = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long")),
            )
        )
        near = _let(keys, lambda k: _neighbours(k, lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)))
        places = F.array_distinct(F.transform(near, lambda k: k.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")))
        texts = F.sort_array(F.transform(places, lambda p: F.struct(window(w, p).alias("t"), p.alias("p"))))
        equal = _let(texts, lambda t: _neighbours(t, lambda a, b: a["t"] == b["t"]))
        covered = F.flatten(F.transform(equal, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
        return F.when(n < 4, F.lit(0)).otherwise(F.size(F.array_distinct(covered)))

    return _let(words, count).cast("long")


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: bool = False) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row.

    ``carry`` adds the input row itself as the column ``row``.
    """
    rows = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row") if carry else F.lit(None).alias("row"),
        F.col(key).alias("id"),
        F.col(lang).alias("lang"),
        F.col(source).alias("source"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    t = F.col("text")
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words")))
    repeated = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    carried = ["row"] if carry else []
    return rows.select(
        *carried,
        "id",
        "lang",
        "source",
        counted.alias("counted"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated.cast("long").alias("n_dup_lines"),
    ).select(*carried, "id", "lang", "source", "counted.n_words", "word_chars", "n_symbols", "n_dup_lines", "counted.n_repeat_words")


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)


def vectors(stats: DataFrame) -> DataFrame:
    """The rows with their transformed statistics in whole steps."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = {
        "s_length": F.log1p(F.col("n_words")),
        "s_chars": 4 * F.log1p(F.col("word_chars") / n),
        "s_symbols": 8 * F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "s_lines": F.log1p(F.col("n_dup_lines")),
        "s_repeats": 2 * F.col("n_repeat_words") / n,
    }
    return stats.withColumns({k: F.round(v * SCALE).cast("long") for k, v in values.items()})


def _bin(value: Column) -> Column:
    """Number of the histogram bin; bins are as wide relative to the value everywhere."""
    return F.floor(F.log2(1 + value) * BINS).cast("int")


def _level(rows: DataFrame, value: Column, share: float, groups: list[str]) -> DataFrame:
    """For every group the first bin up to which ``share`` of its rows lie."""
    counts = rows.groupBy(*groups, _bin(value).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*groups).orderBy("bin")
    whole = Window.partitionBy(*groups)
    reached = counts.select(*groups, "bin", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("total"))
    return reached.where(F.col("upto") >= F.col("total") * share).groupBy(*groups).agg(F.min("bin").alias("edge"))


def _with_group(rows: DataFrame, small: DataFrame, groups: list[str]) -> DataFrame:
    renamed = small.withColumnsRenamed({g: f"r_{g}" for g in groups})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"r_{g}")) for g in groups])
    return rows.join(renamed, same).drop(*[f"r_{g}" for g in groups])


def _sums(rows: DataFrame) -> DataFrame:
    """Integer sums over the rows marked as close, for every group; a mean and a covariance follow from them."""
    wide = "decimal(38,0)"

    def total(value: Column, kind: str) -> Column:
        return F.sum(F.when(F.col("close"), value).otherwise(F.lit(0)).cast(kind)).cast(wide)

    return rows.groupBy("lang", "source").agg(
        F.count_if("close").alias("n"),
        *[total(F.col(s), "decimal(18,0)").alias(f"m{i}") for i, s in enumerate(STATS)],
        *[total(F.col(STATS[i]) * F.col(STATS[j]), "decimal(19,0)").alias(f"c{i}{j}") for i, j in PAIRS],
    )


def _estimate(sums: DataFrame, share: float) -> DataFrame:
    """Mean, and the triangular factor of the covariance, for every group; ``PRIOR`` rows of the language are mixed in.

    The covariance of the close rows is scaled up to that of all rows, then the floors are added.
    """
    factor = consistency(share)
    names = ["n", *[f"m{i}" for i in range(N)], *[f"c{i}{j}" for i, j in PAIRS]]
    language = sums.groupBy("lang").agg(*[F.sum(c).alias(f"l_{c}") for c in names]).withColumnRenamed("lang", "r_lang")
    both = sums.join(language, F.col("lang").eqNullSafe(F.col("r_lang")))
    part = F.lit(float(PRIOR)) / F.greatest(F.col("l_n"), F.lit(1))
    total = F.col("n") + F.lit(float(PRIOR))
    steps = float(SCALE)
    mixed = {c: (F.col(c).cast("double") + part * F.col(f"l_{c}").cast("double")) / total for c in names[1:]}
    moments = both.select("lang", "source", *[v.alias(c) for c, v in mixed.items()])
    moments = moments.select(
        "lang",
        "source",
        *[(F.col(f"m{i}") / steps).alias(f"mu{i}") for i in range(N)],
        *[
            (factor * (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) / (steps * steps) + (FLOORS[i] if i == j else 0.0)).alias(f"v{i}{j}")
            for i, j in PAIRS
        ],
    )
    for j in range(N):
        inner = sum((F.col(f"f{j}{k}") * F.col(f"f{j}{k}") for k in range(j)), F.lit(0.0))
        moments = moments.withColumn(f"f{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - inner, F.lit(FLOORS[j] / 2))))
        below = {}
        for i in range(j + 1, N):
            inner = sum((F.col(f"f{i}{k}") * F.col(f"f{j}{k}") for k in range(j)), F.lit(0.0))
            below[f"f{i}{j}"] = (F.col(f"v{i}{j}") - inner) / F.col(f"f{j}{j}")
        if below:
            moments = moments.withColumns(below)
    return moments.select("lang", "source", *[f"mu{i}" for i in range(N)], *[f"f{i}{j}" for i, j in PAIRS])


def _distance(rows: DataFrame, name: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i in range(N):
        inner = sum((F.col(f"f{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"z{i}", (F.col(STATS[i]) / float(SCALE) - F.col(f"mu{i}") - inner) / F.col(f"f{i}{i}"))
    rows = rows.withColumn(name, F.round(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, N)), F.col("z0") * F.col("z0")), 6))
    return rows.drop(*[f"z{i}" for i in range(N)], *[f"mu{i}" for i in range(N)], *[f"f{i}{j}" for i, j in PAIRS])


def _start(rows: DataFrame) -> DataFrame:
    """The share of each group's rows that lie closest to its medians, summed up over the statistics.

    Medians and median deviations come from histograms, one statistic a row.
    """
    long = rows.select("lang", "source", F.posexplode(F.array(*STATS)).alias("k", "x"))
    middle = _level(long, F.col("x") / 16.0, 0.5, ["lang", "source", "k"])
    centre = F.pow(F.lit(2.0), (F.col("edge") + 0.5) / BINS) - 1
    off = _with_group(long, middle, ["lang", "source", "k"]).select("lang", "source", "k", F.abs(F.col("x") / 16.0 - centre).alias("off"))
    spread = _level(off, F.col("off"), 0.5, ["lang", "source", "k"])
    width = F.pow(F.lit(2.0), (F.col("edge") + 1.0) / BINS) - 1
    scales = (
        _with_group(middle.withColumn("centre", centre).drop("edge"), spread, ["lang", "source", "k"])
        .groupBy("lang", "source")
        .agg(*[F.max(F.when(F.col("k") == i, F.struct(F.col("centre").alias("c"), F.greatest(width, F.lit(3.2)).alias("w")))).alias(f"k{i}") for i in range(N)])
    )
    far = sum((F.pow((F.col(s) / 16.0 - F.col(f"k{i}.c")) / F.col(f"k{i}.w"), 2) for i, s in enumerate(STATS)), F.lit(0.0))
    return _with_group(rows, scales, ["lang", "source"]).withColumn("d2", F.round(far, 6)).drop(*[f"k{i}" for i in range(N)])


def fit(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Robust mean and covariance factor of every (lang, source)."""
    measured = _start(rows)
    model = None
    for step in range(steps):
        group = _level(measured, F.col("d2"), share, ["lang", "source"])
        language = _level(measured, F.col("d2"), share, ["lang"]).withColumnRenamed("edge", "far")
        marked = _with_group(_with_group(measured, group, ["lang", "source"]), language, ["lang"])
        close = _bin(F.col("d2")) <= F.least(F.col("edge"), F.col("far") + REACH * BINS)
        model = materialize(_estimate(_sums(marked.withColumn("close", close)), share), f"quality-{step}")
        if step + 1 < steps:
            measured = _distance(_with_group(rows, model, ["lang", "source"]), "d2")
    return model


def _judged(df: DataFrame, key: str, text: str, lang: str, source: str, cut: float, carry: bool) -> DataFrame:
    """Statistics are worked out once and stored; all steps after that read numbers only."""
    stats = text_statistics(df, key, text, lang, source, carry)
    stats = materialize(vectors(stats).withColumn("base_failed", base_failed()), "quality-statistics", compression="zstd")
    model = fit(stats.where(~F.col("base_failed")).select("lang", "source", *STATS))
    same = F.col("lang").eqNullSafe(F.col("r_lang")) & F.col("source").eqNullSafe(F.col("r_source"))
    measured = stats.join(model.withColumnsRenamed({"lang": "r_lang", "source": "r_source"}), same, "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return _distance(measured, "distance").withColumn("kept", kept)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = _judged(df, key, text, lang, source, cut, carry=False)
    return judged.select(F.col("id").alias(key), *counts, "base_failed", "kept", "distance")


def keep_good(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT) -> DataFrame:
    """The rows that are not rejected, as they were; they travel with their statistics, so none is looked up again."""
    return _judged(df, key, text, lang, source, cut, carry=True).where("kept").select("row.*")
