"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import byte_texts, materialise, row_key, same, settled, small_batches, without

TOPICS = 8
TOPIC_LETTERS = 6
KEEP = 0.9
TOLERANCE = 1e-4
MAX_SWEEPS = 50
EXPONENTS = {"source": 0.7, "lang": 0.7, "topic": 0.5}


def topic_word(text: bytes) -> bytes:
    """The most frequent word of at least ``TOPIC_LETTERS`` bytes (ties: the
    smallest), A-Z lower-cased; empty if there is none."""
    counts = Counter(w for w in text.lower().split() if len(w) >= TOPIC_LETTERS)
    if not counts:
        return b""
    most = max(counts.values())
    return min(w for w, n in counts.items() if n == most)


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source", topics: int = TOPICS) -> DataFrame:
    """``(id, key, source, lang, topic, tokens)`` of every row: ``tokens`` is
    the number of words, ``topic`` the bucket (of ``topics``) of the text's
    topic word, a stand-in for a topic model's label; -1 without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = byte_texts(b.column(4))
            yield pa.record_batch(
                [*b.columns[:4], pa.array(map(topic_word, texts), pa.binary()).cast(pa.string()),
                 pa.array([len(t.split()) for t in texts], pa.int64())],
                names=["id", "key", "source", "lang", "word", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col).cast("string")).alias("key"),
                       F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, "id long, key long, source string, lang string, word string, tokens long")
    topic = F.when(F.col("word") == "", -1).otherwise(F.pmod(F.xxhash64("word"), F.lit(topics))).cast("int")
    return found.select("id", "key", "source", "lang", topic.alias("topic"), "tokens")


def tempered(rows: DataFrame, dim: str, exponent: float, tokens: str = "tokens") -> DataFrame:
    """Target ``(value, target)``: each category's token share to the power
    ``exponent`` (1 keeps the shares, 0 makes them equal), not normalised."""
    sums = rows.groupBy(F.col(dim).alias("value")).agg(F.sum(tokens).cast("double").alias("n")).where("n > 0")
    return sums.select("value", F.pow("n", F.lit(exponent)).alias("target"))


def rake(rows: DataFrame, targets: Mapping[str, DataFrame], tokens: str = "tokens",
         tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """``(dims..., tokens, weight)`` per cell of the dimensions of
    ``targets``: weights that, multiplied by the tokens, have the targets'
    shares as marginals (and sum to the tokens there are).

    Iterative proportional fitting: each dimension in turn scales its
    categories to their targets, until no category's share is off by more
    than ``tolerance`` of its target or ``max_sweeps`` have passed (targets
    that no weights can meet).  Rows are summed to cells once; the sweeps
    work on the table of cells, in Spark, and only the largest error reaches
    the driver.  Targets are normalised over the categories present; a
    category without a target gets weight zero.  Null is a category.
    """
    dims = list(targets)
    cells = materialise(rows.groupBy(*dims).agg(F.sum(tokens).cast("double").alias("tokens")).where("tokens > 0")
                        .withColumn("weight", F.lit(1.0)), "mix-cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    goals = {}
    for d in dims:
        present = cells.groupBy(F.col(d).alias("there")).agg(F.count(F.lit(1)).alias("n"))
        met = targets[d].join(present, F.col("value").eqNullSafe(F.col("there")), "left_semi")
        goals[d] = materialise(met.select(F.col("value").alias("__value"), "target"), "mix-target")
        scale = goals[d].agg(F.sum("target")).first()[0]
        if total and not scale:
            raise ValueError(f"no positive target for any category of {d}")
        goals[d] = goals[d].withColumn("target", F.col("target") * F.lit(total / (scale or 1.0)))
    for _ in range(max_sweeps):
        cells = cells.withColumn("off", F.lit(0.0))
        for d in dims:
            now = cells.groupBy(F.col(d).alias("__now")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            factor = now.join(goals[d], same((F.col("__now"), F.col("__value"))), "left").select(
                F.col("__now").alias("__value"),
                F.when(F.col("now") > 0, F.coalesce("target", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("factor"))
            off = F.when(F.col("factor") > 0, F.abs(1 / F.col("factor") - 1)).otherwise(0.0)
            cells = materialise(cells.join(factor, same((F.col(d), F.col("__value")))).select(
                *dims, "tokens", (F.col("weight") * F.col("factor")).alias("weight"), F.greatest("off", off).alias("off")), "mix-cells")
        worst = cells.agg(F.max("off")).first()[0] or 0.0
        cells = cells.drop("off")
        if worst <= tolerance:
            break
    return cells


def calibrate(cells: DataFrame, keep: float) -> float:
    """The factor that makes ``min(1, factor * weight)`` keep the share
    ``keep`` of all tokens in expectation.  Each round sums the cells that
    are already certain and rescales the others; the certain ones only grow,
    so it ends when their number stands still."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    factor, certain = 0.0, -1
    while True:
        sure = F.col("weight") * F.lit(factor) >= 1
        row = cells.where("weight > 0").agg(
            F.count_if(sure).alias("n"), F.sum(F.when(sure, F.col("tokens")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(sure, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("free")).first()
        if row.n == certain or not row.free:
            return factor
        certain = row.n
        factor = max(factor, (keep * total - row.fixed) / row.free)


def probabilities(rows: DataFrame, targets: Mapping[str, DataFrame], keep: float = KEEP, tokens: str = "tokens",
                  repeats: bool = False, **options) -> DataFrame:
    """``(dims..., probability)`` of every cell: see ``rake``, ``calibrate``.

    With ``repeats``, the expected number of copies of each row instead, above
    1 where the targets ask for more than there is; as the weights sum to the
    tokens there are, they hold the share ``keep`` of them.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep must lie in (0, 1]")
    cells = rake(rows, targets, tokens, **options)
    if repeats:
        return cells.select(*targets, (F.col("weight") * F.lit(keep)).alias("probability"))
    factor = calibrate(cells, keep)
    return cells.select(*targets, F.least(F.col("weight") * F.lit(factor), F.lit(1.0)).alias("probability"))


def draw(seed: int, *parts: str) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") * F.lit(2.0 ** -53)


def mixed(rows: DataFrame, exponents: Mapping[str, float] = EXPONENTS, keep: float = KEEP, seed: int = 42,
          targets: Mapping[str, DataFrame] | None = None, repeats: bool = False, **options) -> DataFrame:
    """``rows`` (a ``profile``, or any table with ``id``, ``key``, ``tokens``
    and the dimensions) with ``probability`` and ``kept``, the number of
    copies drawn (0: the row goes).

    Targets are tempered token shares unless given.  Each row is drawn by a
    hash of its id and text, so the draw depends neither on the layout nor
    on a retried task; rows that repeat both share one draw.  With
    ``repeats``, ``probability`` is the expected number of copies: its whole
    part is certain, the fraction is drawn, and the expected tokens have the
    marginals that ``rake`` reached.  Without, no row is drawn twice, and
    categories of which there is too little stay below their targets.  Rows without
    tokens weigh nothing in any marginal: they are kept with the share
    ``keep``.
    """
    targets = targets or {d: tempered(rows, d, e) for d, e in exponents.items()}
    p = materialise(probabilities(rows, targets, keep, repeats=repeats, **options), "mix-probability")
    renamed = p.withColumnsRenamed({d: f"__{d}" for d in targets})
    met = rows.join(renamed, same(*[(F.col(d), F.col(f"__{d}")) for d in targets]), "left")
    chance = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(keep))
    sure = F.floor("probability")
    return (met.select(*rows.columns, chance.alias("probability"))
            .withColumn("kept", (sure + (draw(seed, "id", "key") < F.col("probability") - sure).cast("int")).cast("int")))


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, **options) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` draws, unchanged, each as often as
    it is drawn (more than once only with the option ``repeats``)."""
    names = ["id", "key", "lang", "source"]

    def drawn() -> DataFrame:
        rows = materialise(profile(docs, id_col, text_col), "mix-profile")
        copies = mixed(rows, keep=keep, **options).select(*names, "kept").where("kept <> 1").distinct()
        return materialise(copies, "mix-drawn")

    def keys(c) -> list[Column]:
        return [c(id_col).cast("long"), row_key(c(text_col).cast("string")), c("lang").cast("string"), c("source").cast("string")]

    # most rows are drawn once and stay where they are
    other = settled(drawn)
    once = without(docs, keys, other.select(*names))
    if other.where("kept > 1").isEmpty():
        return once
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = keys(lambda c: F.col(f"c{docs.columns.index(c)}"))
    often = other.where("kept > 1").withColumnsRenamed({n: f"__{n}" for n in [*names, "kept"]})
    met = named.join(often, same(*[(k, F.col(f"__{n}")) for k, n in zip(own, names)]))
    met = met.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__kept")))).select(*named.columns)
    return once.union(met.toDF(*docs.columns))
