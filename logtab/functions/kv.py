"""Free-form key/value extraction into ``map<string,string>``.

A pair grammar is a regex with two groups (key, value) scanned left to right
over the text, non-overlapping, exactly like Python's ``re.findall``; Spark's
``regexp_extract_all`` runs the same ``Matcher.find`` loop.

Record semantics follow a Python dict built by successive assignment and then
re-keyed by ``str.strip()``:

* a key keeps the position of its first assignment and the value of its last;
* after stripping, two keys that became equal collapse, the one at the later
  position winning.

Both steps are built from array functions only, so they stay in the JVM and
need no session configuration (``mapKeyDedupPolicy``).  ``record_map`` is the
exact single-expression form; ``with_record_maps`` adds a generated-code fast
path for rows whose keys need no dedupe, and sorts each line's pairs once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.functions.text import FLAGS, WS, strip

# Joins keys for the one-regex strip; a key holding it only sends the row
# down the exact (slow) path.
_SEP = "\u0001"
# Joined keys of printable ASCII without blanks at their ends, run by run: far
# cheaper on long keys than looking for blanks at each character.
_TRIM = f"^(?:[!-~]+|{_SEP}+(?! )| +(?![ {_SEP}]))*+$"


def pairs(text: Column, pattern: str) -> tuple[Column, Column]:
    """All (key, value) matches of ``pattern`` in ``text`` as two aligned arrays."""
    return F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)


def _with_base(keys: Column, vals: Column, base_names: list[str] | None):
    if not base_names:
        return keys, vals
    return (F.concat(F.array(*[F.lit(n) for n in base_names]), keys),
            F.concat(F.array(*[F.lit(None).cast("string") for _ in base_names]), vals))


def _runs(keys: Column, vals: Column) -> Column:
    """(key, position, value) entries sorted by key, then position."""
    entries = F.transform(F.arrays_zip(keys.alias("k"), vals.alias("v")),
                          lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v")))
    return F.sort_array(entries)


def _last_of_runs(runs: Column) -> Column:
    """One (first position, key, last value) entry per key, by position:
    among entries sorted by key and position, a run of equal keys starts
    where the key before differs and ends where the key after does."""
    def edge(step: int) -> Column:
        return F.filter(runs, lambda e, i: ~e["k"].eqNullSafe(F.get(runs, i + step)["k"]))

    ends = F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"))
    return F.sort_array(F.transform(ends, lambda r: F.struct(r["first"]["i"].alias("i"), r["first"]["k"].alias("k"), r["last"]["v"].alias("v"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is read.
    (As a column of its own it would cost each row one copy more.)"""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mapped(entries: Column) -> Column:
    """Entries of ``_last_of_runs`` as a map in their order."""
    return F.map_from_arrays(entries["k"], entries["v"])


def record_map(keys: Column, vals: Column, base_names: list[str] | None = None) -> Column:
    """Parameter map of one record from raw aligned (keys, values) arrays.

    ``base_names`` are the header fields a record starts with.  They take part
    in the ordering (a parameter named like a base field keeps the base
    field's early position) and are dropped again afterwards, so the map only
    holds entries whose final value came from the parameter text.

    As one expression this is for few pairs: Spark evaluates the sorted
    arrays anew where they are used.  ``with_record_maps`` computes each once.
    """
    once = _last_of_runs(_runs(*_with_base(keys, vals, base_names)))
    m = _mapped(_last_of_runs(_runs(F.transform(once["k"], strip), once["v"])))
    return F.map_filter(m, lambda k, v: v.isNotNull()) if base_names else m


def stripped_keys(keys: Column) -> Column:
    """``transform(keys, strip)`` without a lambda: one regex over the keys
    joined by ``_SEP``, where they need it at all.  A key holding ``_SEP`` itself yields extra elements,
    which ``record_map_stages`` detects by size."""
    joined = F.concat(F.lit(_SEP), F.array_join(keys, _SEP), F.lit(_SEP))
    trimmed = F.regexp_replace(joined, f"{FLAGS}(?<={_SEP})[{WS}]+|[{WS}]+(?={_SEP})", "")
    inner = F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)
    return F.when((F.size(keys) == 0) | joined.rlike(_TRIM), keys).otherwise(F.split(inner, _SEP))


def record_map_stages(specs: dict[str, tuple[Column, Column, list[str] | None]], raw: frozenset[str] = frozenset(),
                      ref: Callable[[str], Column] = F.col, known: dict[str, tuple[Column, Column]] | None = None
                      ) -> Iterator[dict[str, Column]]:
    """Build one ``record_map`` per ``{out: (keys, vals, base_names)}``; the
    outs in ``raw`` keep their keys as they are.  Where ``known`` has an out's
    keys and values (few and long, else null), those stand for the first two.

    Yields one projection after the other, ``{name: Column}``, the last one
    holding the map expression per ``out``; a step reads the columns of those
    before it through ``ref``, so it must be taken when they are there.
    ``map_helpers`` names what can be dropped afterwards.

    When the stripped keys are distinct and name no base field (the common
    case) the map is simply ``map_from_arrays(stripped keys, values)``, all in
    generated code.  Only other rows are deduped exactly: their entries are
    sorted by key and position, and each run of a key gives its first position
    and last value, so the work grows with ``n log n`` of a line's pairs.
    """
    t = {out: f"{out}__" for out in specs}
    base = {out: spec[2] for out, spec in specs.items()}
    known = known or {}

    def first(o: str) -> dict[str, Column]:
        k, v, _ = specs[o]
        if o not in known:
            return {"k0": k, "v0": v}
        k1, v1 = known[o]
        # keys of different hashes differ, at less cost than by a set of them
        hashes = F.array_distinct(F.transform(k1, lambda key: F.xxhash64(key)))
        return {"k0": F.coalesce(k1, k), "v0": F.coalesce(v1, v), "z0": k1 if o in raw else F.transform(k1, strip),
                "u0": F.size(hashes) == F.size(k1)}

    yield {t[o] + n: c for o in specs for n, c in first(o).items()}

    def stripped(o: str) -> Column:
        found = ref(t[o] + "k0") if o in raw else stripped_keys(ref(t[o] + "k0"))
        return F.coalesce(ref(t[o] + "z0"), found) if o in known else found

    yield {t[o] + "s0": stripped(o) for o in specs}

    def simple(o: str) -> Column:
        k0, s0 = ref(t[o] + "k0"), ref(t[o] + "s0")
        distinct = F.size(F.array_distinct(s0)) == F.size(k0)
        if o in known:
            distinct = F.when(ref(t[o] + "u0") & (s0 == k0), F.lit(True)).otherwise(distinct)
        ok = (F.size(s0) == F.size(k0)) & distinct
        for name in base[o] or ():
            ok = ok & ~F.array_contains(s0, name)
        return F.coalesce(ok, F.lit(True))  # null keys (rows of another grammar) count as simple

    yield {t[o] + "ok": simple(o) for o in specs}
    maps = {}
    for o in specs:
        def deduped(d: Column) -> Column:
            runs = _runs(d["k"] if o in raw else F.transform(d["k"], strip), d["v"])
            return _let(runs, lambda q: _let(_last_of_runs(q), _mapped))

        m = _let(_runs(*_with_base(ref(t[o] + "k0"), ref(t[o] + "v0"), base[o])), lambda r: _let(_last_of_runs(r), deduped))
        if base[o]:
            m = F.map_filter(m, lambda k, v: v.isNotNull())
        s0, v0, ok = ref(t[o] + "s0"), ref(t[o] + "v0"), ref(t[o] + "ok")
        maps[o] = F.when(ok, F.map_from_arrays(s0, v0)).otherwise(m)
        if o in known:  # binary keys are compared, not hashed whole
            ordered = F.map_from_arrays(s0.cast("array<binary>"), v0).cast("map<string,string>")
            maps[o] = F.when(ok & ref(t[o] + "u0"), ordered).otherwise(maps[o])
    yield maps


def map_helpers(outs: Iterable[str]) -> list[str]:
    """Names of the columns that ``record_map_stages`` adds on its way."""
    return [f"{o}__{n}" for o in outs for n in ("k0", "v0", "z0", "u0", "s0", "ok")]


def with_record_maps(df: DataFrame, specs: dict[str, tuple[Column, Column, list[str] | None]]) -> DataFrame:
    """Apply ``record_map_stages`` to ``df``, adding one map column per spec."""
    for cols in record_map_stages(specs):
        df = df.withColumns(cols)
    return df.drop(*map_helpers(specs))
