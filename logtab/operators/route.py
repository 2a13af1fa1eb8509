"""First-match routing of log lines to grammars, with a reject channel.

``parse`` turns a DataFrame of lines into the *narrow* form: every input
column is kept, plus

* ``parser``  - the name of the first grammar that recognised the line, or ``'na'``;
* one struct column per grammar, named after it, holding the base fields and
  a ``params`` map (null on rows of other grammars);
* ``reject``  - the stripped line on ``'na'`` rows, else null.

The plan is a single chain of projections with no Python worker for the
built-in grammars, and no shuffle unless the caller asks for one
(``min_partitions``); building it starts no job.  A grammar's expensive scan only runs
on lines no earlier grammar took, and each scan result is materialised once.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logtab.functions.dates import BAD_DATE_MODES
from logtab.functions.kv import map_helpers, record_map_stages
from logtab.functions.text import strip
from logtab.operators.parsers import DEFAULT_PARSERS, LogParser, PythonLogParser

REJECT = "na"
_ids = itertools.count()


def check_parsers(parsers: Sequence[LogParser]) -> list[LogParser]:
    names = [p.name for p in parsers]
    if not names:
        raise ValueError("at least one parser is required")
    dup = {n for n in names if names.count(n) > 1}
    if dup:
        raise ValueError(f"duplicate parser names: {sorted(dup)}")
    if REJECT in names:
        raise ValueError(f"parser name {REJECT!r} is reserved for unrecognised lines")
    bad = [n for n in names if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n) or n.startswith("__")]
    if bad:
        raise ValueError(f"parser names must be identifiers (they name columns): {bad}")
    return list(parsers)


def parse(df: DataFrame, col: str = "value", parsers: Sequence[LogParser] = DEFAULT_PARSERS,
          year: int = 2020, on_bad_date: str = "fail", observation: Observation | None = None,
          min_partitions: int | None = None, params: bool | Sequence[LogParser | str] = True,
          bad: str | None = None) -> DataFrame:
    """Route and parse the lines in ``df[col]`` (see module doc).

    ``on_bad_date``: a header that matches but names an impossible date
    (``Feb 30``, hour 24, ...) either fails the job (``'fail'``, the default),
    is treated as not matching that grammar (``'reject'``), or keeps the row
    with null date fields (``'null'``).

    The result carries an ``observe`` node counting lines per route (read
    them from ``observation.get`` after an action).  It also keeps Catalyst
    from pushing filters on ``parser`` below the parse, which would inline
    and re-run every grammar's regexes inside the filter.

    Parsing is CPU-bound per line.  For an input that arrives in few
    partitions (a gzip log cannot be split, a small file is one partition)
    pass ``min_partitions`` to deal the lines round-robin over that many
    first; by default nothing is shuffled.

    ``params`` names the grammars whose parameters are extracted (``False``:
    none, ``True``: all); the others' ``params`` are null.  Callers that need
    only routes and header fields, or one grammar, save the others' pair
    regexes: the observe node keeps Catalyst from pruning them by itself.

    ``bad`` names a boolean column of lines that no grammar may take (see
    ``read_lines``); they are rejects.

    Grammars that name a ``token`` are only tried on lines that hold it: each
    line is cut into tokens once, however many grammars there are.
    """
    parsers = check_parsers(parsers)
    if on_bad_date not in BAD_DATE_MODES:
        raise ValueError(f"on_bad_date must be one of {BAD_DATE_MODES}")
    clash = {p.name for p in parsers} | {"parser", "reject"}
    clash &= set(df.columns)
    if clash:
        raise ValueError(f"input already has columns {sorted(clash)}")
    keep = list(df.columns)
    if min_partitions and not df.isStreaming:
        df = df.repartition(min_partitions)
    named = {p.name for p in parsers} if params is True else {p if isinstance(p, str) else p.name for p in params or ()}
    unknown = named - {p.name for p in parsers}
    if unknown:
        raise ValueError(f"params of grammars that are not parsed: {sorted(unknown)}")
    app = df.sparkSession.sparkContext.applicationId
    for stage in _column_stages(tuple(parsers), col, year, on_bad_date, app, frozenset(named), bad):
        df = df.withColumns(stage) if isinstance(stage, dict) else df.drop(*stage)
    df = df.select(*keep, "parser", *[p.name for p in parsers], "reject")
    # The observe node closes the parse: any filter a caller puts on the
    # result (on ``parser`` or on record fields) stops here instead of being
    # pushed down with every regex and map expression inlined into it.
    counts = [F.count_if(F.col("parser") == n).alias(n) for n in [p.name for p in parsers] + [REJECT]]
    if df.isStreaming and observation is None:  # an Observation object cannot watch a stream
        return df.observe(f"logtab_routes_{next(_ids)}", *counts)
    return df.observe(observation or Observation(f"logtab_routes_{next(_ids)}"), *counts)


@functools.lru_cache(maxsize=64)
def _column_stages(parsers: tuple[LogParser, ...], col: str, year: int, on_bad_date: str, app: str, with_params: frozenset[str],
                   bad: str | None) -> list[dict[str, Column] | list[str]]:
    """``_stages`` over columns.  Column expressions are unresolved and
    reusable, so the chain is built once per grammar list and settings (per
    application) rather than with thousands of JVM calls on every ``parse``."""
    many = bool(indexed_tokens(parsers))  # a projection per grammar would make a plan of hundreds
    return list(_stages(parsers, F.col(col), year, on_bad_date, with_params, F.col, None if bad is None else F.col(bad), many))


def _stages(parsers: Sequence[LogParser], line: Column, year: int, on_bad_date: str, with_params: frozenset[str],
            ref: Callable[[str], Column], bad: Column | None = None, together: bool = False, cut: bool = True
            ) -> Iterator[dict[str, Column] | list[str]]:
    """The projection chain of ``parse``: ``{name: Column}`` to add (each one
    projection) or names to drop.  A step reads the columns of those before
    it through ``ref``, so it must be taken when they are there.  With
    ``together``, all grammars are tried in the same few steps, however many
    they are, instead of each on what the ones before it left.  Without
    ``cut``, long parameter texts are read as short ones."""
    dates: list[tuple[Column, Column]] = []
    steps: list[Column] = []
    taken = bad  # true once an earlier grammar took the line
    tokens = indexed_tokens(parsers)
    if tokens:
        yield {"__tokens": line_tokens(line, tokens)}

    def scan(p: LogParser) -> Column:
        # the scan sees null for lines an earlier grammar took, or that lack
        # its token (cheap for regexes, and keeps Python parsers from doing
        # the work at all)
        tried = None if taken is None else ~taken
        if tokens and p.token:
            has = F.array_contains(ref("__tokens"), p.token)
            tried = has if tried is None else tried & has
        return p.scan(line if tried is None else F.when(tried, line))

    if together:
        yield {f"__s{i}": scan(p) for i, p in enumerate(parsers)}
        yield {f"__f{i}": p.fields(line, ref(f"__s{i}")) for i, p in enumerate(parsers)}
        yield {f"__ok{i}": F.when(ref(f"__f{i}").isNotNull(), p.date(ref(f"__f{i}"), year)[0]) for i, p in enumerate(parsers)}
    for i, p in enumerate(parsers):
        s, f, ok = f"__s{i}", f"__f{i}", f"__ok{i}"
        if not together:
            yield {s: scan(p)}
            yield {f: p.fields(line, ref(s))}
            yield [s]
        d_ok, compact, iso = p.date(ref(f), year)
        if not together:
            yield {ok: F.when(ref(f).isNotNull(), d_ok)}
        if compact is not None:
            compact, iso = F.when(ref(ok), compact), F.when(ref(ok), iso)
        dates.append((compact, iso))
        hit = ref(f).isNotNull()
        if on_bad_date == "fail":
            msg = F.concat(F.lit(f"{p.name}: impossible date in line: "), line)
            steps.append(F.when(hit & ~ref(ok), F.raise_error(msg).cast("int")).when(hit, F.lit(i)))
        elif on_bad_date == "reject":
            hit = hit & ref(ok)
            steps.append(F.when(hit, F.lit(i)))
        else:
            steps.append(F.when(hit, F.lit(i)))
        taken = hit if taken is None else (taken | hit)

    # one projection decides the route and derives parser and reject from
    # it; the reject text is taken here so that, when the caller drops the
    # raw line, Catalyst can prune it from every later projection
    decided = F.coalesce(*steps) if len(steps) > 1 else steps[0]
    names = F.array(*[F.lit(p.name) for p in parsers], F.lit(REJECT))
    yield {"__route": decided,
           "parser": F.element_at(names, F.coalesce(decided, F.lit(len(parsers))) + 1),
           "reject": F.when(decided.isNull(), strip(line))}

    route = ref("__route")
    chosen = [(i, p) for i, p in enumerate(parsers) if p.name in with_params and p.has_pairs]
    cuts = {i: c for i, c in ((i, p.cut(ref(f"__f{i}"))) for i, p in chosen if cut) if c is not None}
    if cuts:  # pairs of long texts, where they can be cut
        yield {f"__c{i}": F.when(route == i, c) for i, c in cuts.items()}
        # the others' pairs are read here, so that no text is carried on
        read = {i: parsers[i].pairs(ref(f"__f{i}")) for i in cuts}
        yield ({f"__{n}{i}": F.when((route == i) & ref(f"__c{i}").isNull(), c) for i, kv in read.items() for n, c in zip("pw", kv)}
               | {f"__f{i}": parsers[i].without_pairs(ref(f"__f{i}")) for i in cuts})
        found = {i: parsers[i].cut_pairs(ref(f"__c{i}")) for i in cuts}
        yield {f"__{n}{i}": c for i, kv in found.items() for n, c in zip("kv", kv)}
    specs, raw, known = {}, set(), {}
    for i, p in chosen:
        mine, out = route == i, f"__m{i}"
        if i in cuts:
            keys, vals = (F.coalesce(ref(f"__{n}{i}"), c) for n, c in zip("pw", p.joined_pairs(ref(f"__c{i}"))))
        else:
            keys, vals = p.pairs(ref(f"__f{i}"))
        specs[out] = (F.when(mine, keys), F.when(mine, vals), p.base_names)
        if i in cuts:
            known[out] = (ref(f"__k{i}"), ref(f"__v{i}"))
        if not p.strip_keys:
            raw.add(out)
    if specs:
        yield from record_map_stages(specs, frozenset(raw), ref, known)
    none, empty = F.lit(None).cast("map<string,string>"), F.create_map().cast("map<string,string>")
    structs = {}
    for i, p in enumerate(parsers):
        compact, iso = dates[i]
        values = p.base(ref(f"__f{i}"), compact, iso)
        params = ref(f"__m{i}") if f"__m{i}" in specs else empty if p.name in with_params else none
        struct = F.struct(*[v.cast(t).alias(n) for v, (n, t) in zip(values, p.base_fields)], params.alias("params"))
        structs[p.name] = F.when(route == i, struct)
    yield structs
    yield [*specs, *map_helpers(specs), *[f"__{n}{i}" for i in cuts for n in "cpwkv"]]


# --- which grammars a line can be --------------------------------------------

# From this many grammars with a token on, lines are cut into tokens once.
INDEX_FROM = 4
TOKEN_CHARS = "A-Za-z0-9_%-"


def indexed_tokens(parsers: Sequence[LogParser]) -> list[str]:
    """The literal tokens by which grammars are looked up (none for a short
    list, where cutting lines into tokens would cost more than it saves)."""
    tokens = sorted({p.token for p in parsers if p.token})
    bad = [t for t in tokens if not re.fullmatch(f"[{TOKEN_CHARS}]+", t)]
    if bad:
        raise ValueError(f"a grammar's token must consist of letters, digits, '_', '%' and '-': {bad}")
    return tokens if sum(bool(p.token) for p in parsers) >= INDEX_FROM else []


def line_tokens(line: Column, tokens: Sequence[str]) -> Column:
    """Those of ``tokens`` that stand in the line as whole tokens."""
    words = F.split(line, f"[^{TOKEN_CHARS}]+")
    # a hash set made once; array_intersect would make one of all tokens for each line
    return F.array_distinct(F.filter(words, lambda w: w.isin(*tokens)))


def candidate_parsers(line: Column, parsers: Sequence[LogParser]) -> Column:
    """Names of the grammars whose header is tried on a line that no earlier
    grammar takes: those whose token it has, and those that name none."""
    tokens = sorted({p.token for p in parsers if p.token})
    always = [i for i, p in enumerate(parsers) if not p.token]
    names = F.lit([p.name for p in parsers])
    if not tokens:
        return names
    # a line looks up the tokens it has, whatever the number of grammars
    places = F.create_map(*[c for t in tokens for c in (F.lit(t), F.lit([i for i, p in enumerate(parsers) if p.token == t]))])
    mine = F.flatten(F.transform(line_tokens(line, tokens), lambda t: places[t]))
    found = F.concat(F.lit(always).cast("array<int>"), F.coalesce(mine, F.array().cast("array<int>")))
    return F.transform(F.array_sort(found), lambda i: F.get(names, i))


# --- a whole parse as one expression ------------------------------------------

def parse_column(line: Column | str, parsers: Sequence[LogParser] = DEFAULT_PARSERS, year: int = 2020,
                 on_bad_date: str = "fail", params: bool = True) -> Column:
    """The parse of one line as a single expression, for ``select``, views
    and SQL over them: a struct of ``parser``, one struct per grammar, and
    ``reject``, as the columns of ``parse``.

    Every step is bound once, as the variable of a one-element transform;
    there are as many steps whatever the number of grammars.  They are
    interpreted rather than compiled, and each grammar scans every line that
    has its token: whole tables are parsed faster by ``parse``.  Grammars in
    Python cannot be part of an expression.
    """
    parsers = check_parsers(parsers)
    if on_bad_date not in BAD_DATE_MODES:
        raise ValueError(f"on_bad_date must be one of {BAD_DATE_MODES}")
    python = [p.name for p in parsers if isinstance(p, PythonLogParser)]
    if python:
        raise ValueError(f"grammars in Python cannot be part of an expression: {python}")
    known: dict[str, Column] = {}
    names = ["parser", *[p.name for p in parsers], "reject"]

    def rest(steps: Iterator) -> Column:
        step = next((s for s in steps if isinstance(s, dict)), None)
        if step is None:
            return F.struct(*[known[n].alias(n) for n in names])

        def bound(s: Column) -> Column:
            known.update({n: s[n] for n in step})
            return rest(steps)

        return only(F.transform(F.array(F.struct(*[c.alias(n) for n, c in step.items()])), bound))

    def only(a: Column) -> Column:
        # not ``get``, which asks for the array's type on every line: a walk
        # through all steps inside it
        return F.element_at(a, 1)

    def start(s: Column) -> Column:
        chosen = frozenset(p.name for p in parsers) if params else frozenset()
        return rest(_stages(parsers, s, year, on_bad_date, chosen, known.__getitem__, together=True, cut=False))

    return only(F.transform(F.array(F.col(line) if isinstance(line, str) else line), start))


def records(narrow: DataFrame, parser: LogParser | str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of one grammar as flat columns: ``keep`` + base fields + ``params``."""
    name = parser if isinstance(parser, str) else parser.name
    return narrow.where(F.col("parser") == name).select(*keep, f"{name}.*")


def rejects(narrow: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Unrecognised lines, stripped, as column ``value``."""
    return narrow.where(F.col("parser") == REJECT).select(*keep, F.col("reject").alias("value"))


def parse_one(spark, line: str, parsers: Sequence[LogParser] = DEFAULT_PARSERS, **kw) -> tuple[str, dict]:
    """Parse a single line (interactive use and tests): ``(parser, record)``
    where the record holds the base fields plus the params map, or
    ``('na', {'value': stripped line})``."""
    r = parse(spark.createDataFrame([(line,)], "value string"), parsers=parsers, **kw).first()
    if r.parser == REJECT:
        return REJECT, {"value": r.reject}
    return r.parser, r[r.parser].asDict()
