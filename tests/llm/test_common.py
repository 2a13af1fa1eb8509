"""Shared helpers, and stages over columns of any name."""

from pyspark.sql import functions as F

import corpus_pipeline
from logtab.llm import common
from logtab.plans import storage


def test_without_is_a_null_safe_anti_join(spark):
    rows = [(1, "a"), (1, "b"), (None, "a"), (None, None), (2, None), (2, None), (3, "c")]
    docs = spark.createDataFrame(rows, "id long, `__k0` string").repartition(3)
    gone = spark.createDataFrame([(1, "a"), (None, None), (2, None), (9, "z")], "x long, y string")
    left = common.without(docs, lambda c: [c("id"), c("__k0")], gone)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "b"), (None, "a"), (3, "c")], key=str)
    assert common.without(docs, lambda c: [c("id"), c("__k0")], gone.limit(0)).count() == len(rows)


def test_settled_keeps_the_last_table_alone(spark):
    made = []

    def build():
        first = common.materialise(spark.range(5), "first")
        made.append(first.inputFiles()[0].rsplit("/", 1)[0])
        return common.materialise(first.select((F.col("id") * 2).alias("n")), "second")

    out = common.settled(build)
    assert sorted(r.n for r in out.collect()) == [0, 2, 4, 6, 8] and not storage.exists(spark, made[0])


def test_stages_take_columns_of_any_name(spark):
    words = " ".join(f"word{i}" for i in range(80))
    names = ["n_near", "n_repeats", "__id", "__key", "__kept", "__maybe", "__hash", "__lang", "id", "key", "kept", "c0", "removed", "fp"]
    rows = [(i, f"{words} {i} {'x' * i}\nshared line of some length here", "en", "s", 5, *range(len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{n}` int" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[5:] == names and 0 < docs.count() <= 6
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
