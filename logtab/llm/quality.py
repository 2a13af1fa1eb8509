"""Quality rules: fixed rules, then robust multivariate outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import SPACE, byte_texts, materialise, row_key, same, settled, small_batches, without

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
MARKS = "!?"

# Transformed statistics and, for each, the least standard deviation that an
# estimate may have.  In clean prose some statistics hardly vary at all; the
# floor keeps a single odd character from looking infinitely far away.
FEATURES = {"word_length": 0.08, "symbols": 0.25, "marks": 0.25, "repeats": 0.10, "capitals": 0.05, "variety": 0.03}
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

COVERAGE = 0.75
C_STEPS = 6
MIN_GROUP = 100
INLIER = 0.975
TAIL = 1e-12
BINS_PER_OCTAVE = 4
GRID = 100


def text_stats(raw: bytes) -> tuple:
    """Counts of one text (UTF-8): words, characters in words, symbols,
    repeated lines, words in repeated 3-word windows, marks, A-Z capitals and
    distinct words."""
    words, text = raw.split(), raw.decode()
    word_chars = len(text) - sum(map(text.count, SPACE))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeat = 0
    if len(words) > 3:
        pairs = codes[:-1] * len(ids) + codes[1:]
        if len(ids) >= 1 << 20:  # keep the next product within 64 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, at, count = np.unique(pairs[:-1] * len(ids) + codes[2:], return_inverse=True, return_counts=True)
        twice = count[at] > 1  # window i holds words i..i+2
        held = np.zeros(len(words), bool)
        for shift in range(3):
            held[shift:shift + len(twice)] |= twice
        repeat = int(held.sum())
    letters = np.frombuffer(raw, np.uint8)
    capitals = int(((letters >= 65) & (letters <= 90)).sum())
    return (len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
            sum(map(text.count, MARKS)), capitals, len(ids))



COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_distinct")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """``(id, key, lang, source)``, the counts of every row's whole text, and
    ``base_failed``; a null text counts as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            counts = np.array([text_stats(t) for t in byte_texts(b.column(4))], np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch([*b.columns[:4], *map(pa.array, counts.T)], names=["id", "key", "lang", "source", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col).cast("string")).alias("key"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).cast("string").alias("text"))
    schema = "id long, key long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed)


def transformed() -> list[Column]:
    """The statistics' transforms, in the order of ``FEATURES``: logarithms
    of sizes and rates, arcsines of shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))

    def share(part: str, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.col(part) / whole, F.lit(1.0))))

    values = [F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_marks") / words),
              share("n_repeat_words", words), share("n_capitals", chars),
              F.log(F.greatest("n_distinct", F.lit(1))) / F.log(F.greatest("n_words", F.lit(2)))]
    return [v.cast("double").alias(f"f{i}") for i, v in enumerate(values)]


# --- chi-squared, as scipy is not at hand ------------------------------------

def chi2_tail(x: float, k: int) -> float:
    """P(X > x) for an even number ``k`` of degrees of freedom."""
    if k % 2:
        raise ValueError("even degrees of freedom only")
    terms = [1.0]
    for i in range(1, k // 2):
        terms.append(terms[-1] * x / 2 / i)
    return math.exp(-x / 2) * sum(terms)


def chi2_point(tail: float, k: int) -> float:
    """The x with P(X > x) = ``tail``."""
    lo, hi = 0.0, 1.0
    while chi2_tail(hi, k) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, k) > tail else (lo, mid)
    return hi


# --- models: one row per cell ---------------------------------------------------

CELL = ("level", "c_lang", "c_source")
CELL_SCHEMA = "level int, c_lang string, c_source string"
MODEL_SCHEMA = (CELL_SCHEMA + ", " + ", ".join(f"m{i} double" for i in range(P))
                + ", " + ", ".join(f"q{i}_{j} double" for i, j in PAIRS))


def assign_cells(stats: DataFrame, min_group: int) -> DataFrame:
    """Add each row's cell: its language and source; where fewer than
    ``min_group`` rows pass the fixed rules there, all such small groups of
    the language together; where they too are few, the rest of all
    languages.  Where even that rest is too small, the cell is the row's
    whole language (level 3) or, if that is small as well, the whole table
    (level 4): such cells are fitted on rows of other cells too
    (``fitted_rows``)."""
    group = materialise(stats.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n")), "quality-groups")
    small = F.when(F.col("n") < min_group, F.col("n"))
    by_lang = group.groupBy(F.col("lang").alias("p_lang")).agg(F.sum(small).alias("pooled"), F.sum("n").alias("of_lang"))
    rest = by_lang.where(F.col("pooled") < min_group).agg(F.sum("pooled").alias("left"))
    sized = group.join(by_lang, F.col("lang").eqNullSafe(F.col("p_lang"))).join(rest)
    level = (F.when(F.col("n") >= min_group, 0).when(F.col("pooled") >= min_group, 1).when(F.col("left") >= min_group, 2)
             .when(F.col("of_lang") >= min_group, 3).otherwise(4))
    cells = materialise(sized.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), level.alias("level")), "quality-cells")
    met = stats.join(cells, same((F.col("lang"), F.col("g_lang")), (F.col("source"), F.col("g_source"))))
    return met.drop("g_lang", "g_source").withColumn(
        "c_lang", F.when(F.col("level").isin(0, 1, 3), F.col("lang"))).withColumn("c_source", F.when(F.col("level") < 1, F.col("source")))


def fitted_rows(placed: DataFrame) -> DataFrame:
    """``(cell, f0...)``: the rows that each cell's model is fitted on, all
    that pass the fixed rules.  Cells of levels 0 to 2 have rows of their
    own; those of levels 3 and 4 take every row of the language or table."""
    good = placed.where(~F.col("base_failed"))
    values = [f"f{i}" for i in range(P)]
    wide = placed.where(F.col("level") > 2).select(*[F.col(c).alias(f"__{c}") for c in CELL]).distinct()
    none = F.lit(None).cast("string")
    either = F.explode(F.array(F.struct(F.lit(3).alias("level"), F.col("lang").alias("c_lang"), none.alias("c_source")),
                               F.struct(F.lit(4).alias("level"), none.alias("c_lang"), none.alias("c_source"))))
    lent = good.select(either.alias("cell"), *values).select("cell.*", *values).join(
        wide, same(*[(F.col(c), F.col(f"__{c}")) for c in CELL]), "left_semi")
    return good.where(F.col("level") < 3).select(*CELL, *values).union(lent)


def first_models(rows: DataFrame) -> DataFrame:
    """Starting models: medians and median absolute deviations of each
    statistic, from exact counts on a grid of 1/100."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.round(F.col(f"f{i}") * GRID).cast("long").alias("at"))
                                 for i in range(P)])).alias("v")
    counts = rows.select(*CELL, values).groupBy(*CELL, "v.dim", "v.at").agg(F.count(F.lit(1)).alias("n"))

    def median(at: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(at, kind="stable")
        total = np.cumsum(n[order])
        return float(at[order][np.searchsorted(total, (total[-1] + 1) // 2)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, dev = np.zeros(P), np.zeros(P)
        for i, part in pdf.groupby("dim"):
            at, n = part["at"].to_numpy(float), part["n"].to_numpy()
            mean[i] = median(at, n)
            dev[i] = 1.4826 * median(np.abs(at - mean[i]), n)
        cov = np.diag((dev / GRID) ** 2)
        return pd.DataFrame([[*_cell(pdf), *_model(mean / GRID, cov)]], columns=_columns())

    return counts.groupBy(*CELL).applyInPandas(run, MODEL_SCHEMA)


def _cell(pdf: pd.DataFrame) -> list:
    return [pdf[c].iloc[0] for c in CELL]


def _columns() -> list[str]:
    return [*CELL, *[f"m{i}" for i in range(P)], *[f"q{i}_{j}" for i, j in PAIRS]]


def _model(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    """Mean and inverse covariance, variances raised to their floors; rounded
    so that the order of summation does not show."""
    floors = np.array(list(FEATURES.values())) ** 2
    cov = cov + np.diag(np.maximum(floors - np.diag(cov), 0))
    inverse = np.linalg.inv(cov)
    return [*np.round(mean, 7), *[float(f"{inverse[i, j]:.7g}") for i, j in PAIRS]]


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its model."""
    off = [F.col(f"f{i}") - F.col(f"m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(f"q{i}_{j}") * off[i] * off[j]
    return F.when(total < 0, 0.0).otherwise(total)  # null without a model


def next_models(rows: DataFrame, models: DataFrame, coverage: float | None, inside: float | None = None) -> DataFrame:
    """One concentration step: mean and covariance of the closest rows.

    Rows are summed per cell and distance bin (a quarter of an octave), so a
    cell comes together as a few hundred sums whatever its size.  The subset
    is the smallest run of whole bins with ``coverage`` of the cell, or, if
    ``inside`` is given, all rows within that distance.  The covariance is
    scaled to be consistent at the normal distribution.
    """
    d2 = rows.join(models.withColumnsRenamed({c: f"__{c}" for c in CELL}),
                   same(*[(F.col(c), F.col(f"__{c}")) for c in CELL])).withColumn("d2", distance())
    if inside is not None:
        step = F.when(F.col("d2") <= inside, 0).otherwise(1)
    else:
        step = F.floor(BINS_PER_OCTAVE * F.log2(F.greatest("d2", F.lit(1e-6)))).cast("int")
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"x{i}_{j}") for i, j in PAIRS]
    binned = d2.groupBy(*CELL, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), *sums)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        total = pdf["n"].cumsum().to_numpy()
        upto = 1 if inside is not None else int(np.searchsorted(total, coverage * total[-1])) + 1
        part, n = pdf.iloc[:upto], float(total[upto - 1])
        mean = np.array([part[f"s{i}"].sum() for i in range(P)]) / n
        cov = np.zeros((P, P))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = part[f"x{i}_{j}"].sum() / n - mean[i] * mean[j]
        share = min(n / total[-1], 1.0) if inside is None else 1 - chi2_tail(inside, P)
        if share < 1:
            cov *= share / (1 - chi2_tail(chi2_point(1 - share, P), P + 2))
        return pd.DataFrame([[*_cell(pdf), *_model(mean, cov)]], columns=_columns())

    return binned.groupBy(*CELL).applyInPandas(run, MODEL_SCHEMA)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source", min_group: int = MIN_GROUP, coverage: float = COVERAGE,
           tail: float = TAIL) -> DataFrame:
    """``(id, key, counts..., base_failed, distance, kept)`` per row of ``docs``.

    Fixed rules first: fewer than ``MIN_WORDS`` words, or over half of the
    words in 3-word windows that occur twice or more, fail.  The others'
    transformed statistics are fitted per language and source by the minimum
    covariance determinant method: starting at medians and absolute
    deviations, ``C_STEPS`` concentration steps settle on the ``coverage``
    share of closest rows, one reweighting step then uses all inliers.  A row
    whose squared Mahalanobis distance exceeds the chi-squared point of
    ``tail`` is rejected.  The tail is far out because short texts scatter
    more than long ones.

    Every row counts; rows reach the driver or a single task nowhere.  Small
    groups are pooled (``assign_cells``); what is left over and still small
    gets the model of all rows of its language or of the table, so every row
    that passes the fixed rules has a distance.  Only in a table where fewer
    than ``min_group`` rows pass them in all there is nothing to fit on: its
    rows are not judged further (distance null, kept).  Null languages and
    sources are groups of their own.
    """
    stats = materialise(statistics(docs, id_col, text_col, lang_col, source_col), "quality-stats")
    placed = materialise(assign_cells(stats, min_group).select("*", *transformed()), "quality-rows")
    fit = materialise(fitted_rows(placed), "quality-fit")
    many = fit.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_group).drop("n")
    models = materialise(first_models(fit).alias("m").join(
        many.withColumnsRenamed({c: f"__{c}" for c in CELL}), same(*[(F.col(c), F.col(f"__{c}")) for c in CELL]), "left_semi"), "quality-model")
    for _ in range(C_STEPS):
        models = materialise(next_models(fit, models, coverage), "quality-model")
    models = materialise(next_models(fit, models, None, chi2_point(1 - INLIER, P)), "quality-model")
    met = placed.join(models.withColumnsRenamed({c: f"__{c}" for c in CELL}),
                      same(*[(F.col(c), F.col(f"__{c}")) for c in CELL]), "left")
    far = F.when(~F.col("base_failed"), distance())
    return met.select("id", "key", *COUNTS, "base_failed", far.alias("distance"),
                      (~F.col("base_failed") & F.coalesce(far <= chi2_point(tail, P), F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, unchanged.  Rows are told
    apart by id and text; rows that repeat both share one verdict."""
    bad = settled(lambda: materialise(
        judged(docs, id_col, text_col, **options).where("not kept").select("id", "key").distinct(), "quality-bad"))
    return without(docs, lambda c: [c(id_col).cast("long"), row_key(c(text_col).cast("string"))], bad)
