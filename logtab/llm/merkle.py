"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf; the leaves of a source form a tree of ``fanout``
children per node, and the trees' subroots form one more tree above them.  A
level of the tree is one pivot: conditional aggregates spread the children of
each parent into ``fanout`` slot columns.  All columns concatenated give the
parent's digest; without its own column they are a child's siblings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import materialise, same

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
STEP = "struct<before:binary,after:binary>"


def hexed(digest: Column) -> Column:
    """Digests are kept as bytes and hashed as lowercase hex text."""
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return hashed(F.concat(*[field(c) for c in fields]))


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (from 0, by ``order`` within the group, nulls first) and
    ``n`` (rows of the group), whatever the size of a group.

    Rows are range-partitioned by group and order, so a large group spreads
    over many partitions, and written with their chunk and index in it.  Only
    one row per chunk and group then takes part in the running sums.
    """
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = materialise(dealt.select(
        "*", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("at")), "merkle-order")
    keys = [F.col(g) for g in group]
    chunks = dealt.groupBy(*keys, "chunk").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    totals = dealt.groupBy(*keys).agg(F.count("*").alias("n"))
    # one row per chunk of a group: a group's running sum is over its chunks
    before = ("coalesce(sum(here) over (partition by {} order by chunk rows between unbounded preceding and 1 preceding), 0)"
              .format(", ".join([f"`{g}`" for g in group]) or "1"))
    chunks = chunks.select(*group, "chunk", "first", F.expr(before).alias("before"))
    if not group:
        placed = dealt.join(chunks, "chunk")
        n = totals.first()["n"]
        return placed.withColumn("n", F.lit(n)).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop(
            "chunk", "at", "first", "before")
    spots = chunks.alias("c").join(totals.alias("t"), same(*[(F.col(f"c.`{g}`"), F.col(f"t.`{g}`")) for g in group]))
    spots = spots.select("c.*", "t.n").alias("s")
    on = same(*[(F.col(f"d.`{g}`"), F.col(f"s.`{g}`")) for g in group]) & (F.col("d.chunk") == F.col("s.chunk"))
    return (dealt.alias("d").join(spots, on)
            .select(*[F.col(f"d.`{c}`") for c in rows.columns], "s.n",
                    (F.col("s.before") + F.col("d.at") - F.col("s.first")).alias("pos")))


def pivoted(nodes: DataFrame, group: Sequence[str], fanout: int, payload: Sequence[str] = ()) -> DataFrame:
    """One row per parent: ``fanout`` slot columns, each a struct of the
    child's digest and payload, null where the run is shorter."""
    child = F.struct("digest", *payload)
    slots = [F.max(F.when(F.col("pos") % fanout == i, child)).alias(f"slot{i}") for i in range(fanout)]
    parent = F.expr(f"pos div {fanout}").alias("parent")
    return (nodes.where("n > 1").groupBy(*[F.col(g) for g in group], parent)
            .agg(*slots, F.max("n").alias("n")))


def digests(fanout: int, without: int | None = None) -> list[Column]:
    """The slots' digests in order, empty where there is no child."""
    return [F.coalesce(F.col(f"slot{i}.digest"), F.lit(b"")) for i in range(fanout) if i != without]


def build(nodes: DataFrame, group: Sequence[str], fanout: int, label: str, payload: Sequence[str] = ()
          ) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``nodes`` (group, pos, n, digest): a table of slots
    per level, lowest first, and the groups' top digests
    (group, level, digest).  One table per level is written; the driver gets
    the largest group's size, which tells how many levels there are."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    tops = [nodes.where("n = 1").select(*group, F.lit(0).alias("level"), "digest")]
    while largest > 1:
        slots = materialise(pivoted(nodes, group, fanout, payload if not levels else ()), f"merkle-{label}{len(levels)}")
        levels.append(slots)
        text = F.concat(*[hexed(d) for d in digests(fanout)])
        nodes = slots.select(*group, F.col("parent").alias("pos"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
                             hashed(text).alias("digest"))
        tops.append(nodes.where("n = 1").select(*group, F.lit(len(levels)).alias("level"), "digest"))
        largest = -(-largest // fanout)
    return levels, reduce(DataFrame.union, tops)


def children(parents: DataFrame, keep: Sequence[str], fanout: int, payload: Sequence[str] = ()) -> DataFrame:
    """Rows of slots with their parent's ``proof`` become one row per child,
    whose proof starts with its own level: what stands before and after it."""
    made = []
    for i in range(fanout):
        side = digests(fanout)
        step = F.struct(F.concat(F.lit(b""), *side[:i]).alias("before"), F.concat(F.lit(b""), *side[i + 1:]).alias("after"))
        made.append(F.struct((F.col("parent") * fanout + i).alias("pos"), F.col(f"slot{i}.digest").alias("digest"),
                             F.concat(F.array(step.cast(STEP)), F.col("proof")).alias("proof"),
                             *[F.col(f"slot{i}.{p}").alias(p) for p in payload]))
    present = F.filter(F.array(*made), lambda c: c["digest"].isNotNull())
    return parents.select(*keep, F.explode(present).alias("c")).select(*keep, "c.*")


def proofs(levels: list[DataFrame], tops: DataFrame, group: Sequence[str], carried: Sequence[str], fanout: int,
           payload: Sequence[str], bottom: DataFrame) -> DataFrame:
    """Every bottom node with its ``proof``, the steps from its own level to
    the top.  ``tops`` are the groups' top nodes (group, level, proof and the
    columns in ``carried``).  Each level's slots meet their parents' proofs in
    one join; a parent's row makes all its children."""
    def start(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select(*group, F.lit(0).cast("long").alias("pos"), "proof", *carried)

    above = start(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        slots, up = levels[level].alias("s"), above.alias("u")
        on = same(*[(F.col(f"s.`{g}`"), F.col(f"u.`{g}`")) for g in group]) & (F.col("s.parent") == F.col("u.pos"))
        met = slots.join(up, on).select("s.*", "u.proof", *[F.col(f"u.`{c}`") for c in carried])
        below = children(met, [*group, *carried], fanout, payload if level == 0 else ())
        if level:
            above = below.select(*group, "pos", "proof", *carried).unionByName(start(level))
            if (len(levels) - level) % 4 == 0:  # cut the lineage of a tall tree
                above = materialise(above, f"merkle-proof{level}")
        else:
            below = below.select("digest", *payload, "proof", *carried)
    on = same(*[(F.col(f"b.`{g}`"), F.col(f"t.`{g}`")) for g in group]) & (F.col("b.pos") == F.col("t.pos"))
    alone = bottom.where("n = 1").alias("b").join(start(0).alias("t"), on)
    alone = alone.select("b.digest", *[F.col(f"b.`{p}`") for p in payload], "t.proof", *[F.col(f"t.`{c}`") for c in carried])
    return below.unionByName(alone) if levels else alone


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest gives with its proof."""
    return F.aggregate(proof, digest, lambda acc, step: hashed(
        F.concat(hexed(step["before"]), hexed(acc), hexed(step["after"]))))


def manifest(docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", source_col: str = "source",
             fields: Sequence[str] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """Merkle manifest of ``docs``: per row ``id``, ``leaf``, ``subroot`` (of
    its source's tree), ``root``, ``proof`` (steps ``before``/``after``, the
    siblings' digests, from the leaf's level to the root; a run of one has
    neither), ``candidate`` (the leaf of the row with its text replaced by
    ``changed``, by default the leaf itself) and ``folded_root`` (the root
    that the candidate gives with the original siblings).  Digests are bytes.

    Leaves ascend by id within a source, and sources by their UTF-8 bytes,
    null ids and null sources first; rows of equal id ascend by their leaf.
    Repeated rows are leaves of their own.  A null field is hashed as ``-``,
    an empty text as ``0:``.  A source of one row has its leaf as subroot, a
    table of one source its subroot as root, and an empty table no rows.
    Columns of ``docs`` that are not in ``fields`` play no part.

    Groups are ranked and hashed in runs of ``fanout``, so a source that
    holds most rows is spread like any other.  One table per level is
    written; the driver gets the root, and two sizes.
    """
    cols = {f: docs[f] for f in fields}
    new = cols["text"] if changed is None else changed
    rows = docs.select(
        cols[id_col].alias("id"), cols[source_col].cast("string").alias("source"), leaf(list(cols.values())).alias("digest"),
        leaf([new if f == "text" else c for f, c in cols.items()]).alias("candidate"))
    leaves = positions(materialise(rows, "merkle-leaves"), ["source"], ["id", "digest", "candidate"])
    low, subroots = build(leaves, ["source"], fanout, "leaf", ["id", "candidate"])
    subroots = materialise(subroots, "merkle-subroots")
    upper = positions(subroots, [], ["source"])
    high, top = build(upper, [], fanout, "source", ["source", "level"])
    root = top.first()
    proof = proofs(high, top.select("level", F.array().cast(f"array<{STEP}>").alias("proof")), [], [], fanout,
                   ["source", "level"], upper)
    tops = materialise(proof.select("source", "level", F.col("digest").alias("subroot"), "proof"), "merkle-tops")
    done = proofs(low, tops, ["source"], ["subroot"], fanout, ["id", "candidate"], leaves)
    return done.select("id", F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("binary").alias("root"),
                       "proof", "candidate", folded(F.col("candidate"), F.col("proof")).alias("folded_root"))


def siblings(proof: Column) -> Column:
    """Hex text of all siblings, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), "")
