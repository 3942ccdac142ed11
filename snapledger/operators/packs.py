"""Rule packs: row rules and set rules as data, compiled into one scan and one keyed fold.

Every input row is turned into a few entries: one with the row rules it fails, and one for each key that set rules
group by, with the set rules it counts for. Set rules that share a key share its entry and its aggregation. Entries
fold by (run, slot, key) on the map side before any of them moves, so a hot key is one entry per task. Whoever only
counts (`totals`) reads that fold and builds no message.

Messages may show the first rows of a group. For these the fold goes by (run, slot, key, block of rows) first, which
keeps a bounded list per block, and a ranked pass keeps the first blocks of a key; no task gathers a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKING, WARNING, INVESTIGATION = "blocking", "warning", "investigation"
FINDING_COLUMNS = ("run_id", "check_name", "record_key", "severity_class", "message", "position")
MAX_ROWS_SHOWN = 20  # row numbers in a message; `rules.duplicate_members` has them all
BLOCK_ROWS = 4096
ROWS = 0  # slot of the entries about single rows; set rules' keys have the slots from 1
MAX_RULES = 62  # of either kind: a rule is a bit of a long

Group = dict[str, Column]


@dataclass(frozen=True)
class RowRule:
    """A named test of one row; `fails` gives a boolean column that is never NULL."""

    name: str
    severity: str
    fails: Callable[[], Column]
    message: Callable[[Column], Column]

    @property
    def blocking(self) -> bool:
        return self.severity == BLOCKING


@dataclass(frozen=True)
class SetRule:
    """A named test of the rows of one run that share a key.

    `key` is SQL over the input columns, `where` picks the rows that count (never NULL; a NULL key doesn't count).
    `measures` are (name, how, SQL) with how one of sum, min, max; every group also has `key`, `n` (rows that count)
    and `first` (the least of their row numbers), and `rows`, text with the first MAX_ROWS_SHOWN of them, for the
    message of a rule that `shows_rows`. A group for which `fails` holds is one finding at its first row, and where
    the rule is blocking, all its rows that count are invalid.
    """

    name: str
    severity: str
    key: str
    where: Callable[[], Column]
    fails: Callable[[Group], Column]
    message: Callable[[Group], Column]
    measures: tuple[tuple[str, str, str], ...] = ()
    shows_rows: bool = False

    @property
    def blocking(self) -> bool:
        return self.severity == BLOCKING


@dataclass(frozen=True)
class Pack:
    """The rules that are applied to a snapshot."""

    row_rules: tuple[RowRule, ...] = ()
    set_rules: tuple[SetRule, ...] = ()

    def __post_init__(self) -> None:
        names = [r.name for r in self.rules]
        if len(set(names)) != len(names):
            raise ValueError("rules of a pack need different names")
        if max(len(self.row_rules), len(self.set_rules)) > MAX_RULES:
            raise ValueError(f"a pack has room for {MAX_RULES} rules of a kind")
        reserved = {"key", "n", "first", "rows"}
        for r in self.set_rules:
            if any(how not in _MERGED or name in reserved for name, how, _ in r.measures):
                raise ValueError(f"{r.name}: a measure is a sum, min or max with a name of its own")

    @property
    def rules(self) -> tuple[RowRule | SetRule, ...]:
        return (*self.row_rules, *self.set_rules)

    @property
    def keys(self) -> list[str]:
        """Keys of the set rules; a rule's slot is its key's place here, from 1."""
        return list(dict.fromkeys(r.key for r in self.set_rules))

    def slot(self, rule: SetRule) -> int:
        return 1 + self.keys.index(rule.key)

    def with_rules(self, *rules: RowRule | SetRule) -> Pack:
        """This pack and more rules."""
        return replace(
            self, row_rules=self.row_rules + tuple(r for r in rules if isinstance(r, RowRule)),
            set_rules=self.set_rules + tuple(r for r in rules if isinstance(r, SetRule)))


_MERGED = {"sum": F.sum, "min": F.min, "max": F.max}


def _bits(tests: list[Column]) -> Column:
    """A long with bit i set where test i holds."""
    return reduce(lambda a, b: a + b, (F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0)).cast("bigint")


def _has(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


def _entries(rows: DataFrame, pack: Pack, group: Sequence[str], each_row: bool) -> DataFrame:
    """(group, row, bad, measures' values, slot, key, bits): what the rows say to the rules.

    The row entry's bits are the row rules that fail. With `each_row` it has the row number as key and is left out for
    rows without faults; else its key are the bits, so that rows with equal faults fold. Rows whose `header_ok` is
    false, if there is such a column, are only counted.
    """
    judged = F.col("header_ok") if "header_ok" in rows.columns else F.lit(True)
    blocking = sum(1 << i for i, r in enumerate(pack.row_rules) if r.blocking)
    values = {f"v{i}_{name}": F.expr(sql) for i, r in enumerate(pack.set_rules) for name, _, sql in r.measures}
    scopes = {}
    for slot, key in enumerate(pack.keys, start=1):
        own = [judged & r.where() if r.key == key else F.lit(False) for r in pack.set_rules]
        scopes |= {f"k{slot}": F.expr(key).cast("string"), f"s{slot}": _bits(own)}
    base = rows.select(
        *group, F.col("source_row_number").alias("row"),
        F.when(judged, _bits([r.fails() for r in pack.row_rules])).otherwise(F.lit(0)).cast("bigint").alias("hits"),
        *[c.alias(name) for name, c in (values | scopes).items()],
    )
    hits, row = F.col("hits"), F.col("row")
    entries = [F.struct(F.lit(ROWS).alias("slot"), (row if each_row else hits).cast("string").alias("key"), hits.alias("bits"))]
    if each_row:
        entries = [F.when(hits != 0, entries[0])]
    for slot in range(1, len(pack.keys) + 1):
        key, bits = F.col(f"k{slot}"), F.col(f"s{slot}")
        entries.append(F.when((bits != 0) & key.isNotNull(), F.struct(F.lit(slot).alias("slot"), key.alias("key"), bits.alias("bits"))))
    bad = hits.bitwiseAND(F.lit(blocking).cast("bigint")) != 0
    spread = base.select(*group, "row", bad.alias("bad"), *values, F.explode(F.array(*entries)).alias("e")).where("e is not null")
    return spread.select(*group, "row", "bad", *values, "e.*")


def _folds(pack: Pack) -> dict[str, tuple[str, Column]]:
    """Column -> (how to merge, aggregation of entries) of all set rules."""
    out = {}
    for i, r in enumerate(pack.set_rules):
        mine = (F.col("slot") == pack.slot(r)) & _has(F.col("bits"), i)
        out[f"n{i}"] = ("sum", F.count_if(mine))
        out[f"first{i}"] = ("min", F.min(F.when(mine, F.col("row"))))
        if r.blocking:
            out[f"clean{i}"] = ("sum", F.count_if(mine & ~F.col("bad")))
        for name, how, _ in r.measures:
            out[f"m{i}_{name}"] = (how, _MERGED[how](F.when(mine, F.col(f"v{i}_{name}"))))
    return out


def _group(pack: Pack, i: int) -> Group:
    r = pack.set_rules[i]
    shown = {"rows": F.array_join(F.col(f"rows{i}").cast("array<string>"), ", ")} if r.shows_rows else {}
    return {"key": F.col("key"), "n": F.col(f"n{i}"), "first": F.col(f"first{i}")} | {m: F.col(f"m{i}_{m}") for m, _, _ in r.measures} | shown


def _fails(pack: Pack, i: int) -> Column:
    r = pack.set_rules[i]
    return F.coalesce((F.col("slot") == pack.slot(r)) & (F.col(f"n{i}") > 0) & r.fails(_group(pack, i)), F.lit(False))


# -- Findings -------------------------------------------------------------------------------------------------------


def _shown(rows: DataFrame, pack: Pack) -> DataFrame:
    """The fold with the first rows of groups whose rule shows them; only groups that fail, and rows with faults."""
    folds = _folds(pack)
    lists = {
        f"rows{i}": F.when((F.col("slot") == pack.slot(r)) & _has(F.col("bits"), i), F.col("row"))
        for i, r in enumerate(pack.set_rules) if r.shows_rows
    }
    entries = _entries(rows, pack, ["run_id"], each_row=True)
    keys = ["run_id", "slot", "key"]
    failing = reduce(lambda a, b: a | b, (_fails(pack, i) for i in range(len(pack.set_rules))), F.col("slot") == ROWS)
    hits = F.max(F.when(F.col("slot") == ROWS, F.col("bits")))
    if not lists:
        return entries.groupBy(*keys).agg(hits.alias("hits"), *[c.alias(k) for k, (_, c) in folds.items()]).where(failing)
    block = (F.col("row") / F.lit(BLOCK_ROWS)).cast("bigint")
    parts = entries.groupBy(*keys, block.alias("block")).agg(
        hits.alias("hits"), *[c.alias(k) for k, (_, c) in folds.items()],
        *[F.slice(F.array_sort(F.collect_list(c)), 1, MAX_ROWS_SHOWN).alias(k) for k, c in lists.items()])
    whole = Window.partitionBy(*keys)
    merged = {k: _MERGED[how](k).over(whole).alias(k) for k, (how, _) in folds.items()}
    ranked = parts.select(*keys, "hits", *lists, *merged.values(), F.row_number().over(whole.orderBy("block")).alias("place"))
    few = ranked.where((F.col("place") <= MAX_ROWS_SHOWN) & failing)
    return few.groupBy(*keys).agg(
        F.max("hits").alias("hits"), *[F.max(k).alias(k) for k in folds],
        *[F.slice(F.array_sort(F.flatten(F.collect_list(k))), 1, MAX_ROWS_SHOWN).alias(k) for k in lists])


def findings(rows: DataFrame, pack: Pack) -> DataFrame:
    """Findings of all rules of a pack, from one scan; `rows` are rows of runs with a usable header."""
    def hit(rule: RowRule | SetRule, test: Column, message: Column, position: Column) -> Column:
        return F.when(test, F.struct(
            F.lit(rule.name).alias("check_name"), F.col("key").alias("record_key"), F.lit(rule.severity).alias("severity_class"),
            message.alias("message"), position.cast("bigint").alias("position")))

    row = F.col("key").cast("int")
    hits = [hit(r, (F.col("slot") == ROWS) & _has(F.col("hits"), i), r.message(row), row) for i, r in enumerate(pack.row_rules)]
    hits += [hit(r, _fails(pack, i), r.message(_group(pack, i)), F.col(f"first{i}")) for i, r in enumerate(pack.set_rules)]
    if not hits:
        raise ValueError("a pack needs rules")
    found = _shown(rows, pack).select("run_id", F.explode(F.array(*hits)).alias("hit")).where("hit is not null")
    return found.select("run_id", "hit.*").select(*FINDING_COLUMNS)


def failing_groups(rows: DataFrame, rule: SetRule) -> DataFrame:
    """(run_id, key, n, first, first_rows): the groups that fail one rule that shows rows."""
    return _shown(rows, Pack(set_rules=(rule,))).where(F.col("slot") != ROWS).select(
        "run_id", "key", F.col("n0").alias("n"), F.col("first0").alias("first"), F.col("rows0").alias("first_rows"))


# -- Counts ---------------------------------------------------------------------------------------------------------


def _marked(rows: DataFrame, pack: Pack, group: Sequence[str]) -> tuple[DataFrame, Pack]:
    """Rows and a pack whose blocking set rules but the first are row rules, too.

    A row may be in failing groups of several blocking rules, and is invalid once. The groups of one rule come with the
    fold; those of the others, which are few, are joined to the rows before.
    """
    others = [r for r in pack.set_rules if r.blocking][1:]
    marks = []
    for place, r in enumerate(others):
        alone, mark = Pack(set_rules=(r,)), f"_in_failing_{place}"
        failing = _entries(rows, alone, group, each_row=False).where(F.col("slot") != ROWS).groupBy(*group, "slot", "key").agg(
            *[c.alias(k) for k, (_, c) in _folds(alone).items()]).where(_fails(alone, 0))
        failing = failing.select(*group, F.col("key").alias("_key"), F.lit(True).alias("_failing"))
        keyed = rows.withColumn("_key", F.expr(r.key).cast("string")).join(failing, [*group, "_key"], "left")
        rows = keyed.withColumn(mark, F.coalesce(F.col("_failing") & r.where(), F.lit(False))).drop("_key", "_failing")
        marks.append(RowRule(f"{r.name} rows", BLOCKING, lambda mark=mark: F.col(mark), lambda row: row))
    return rows, replace(pack, row_rules=(*pack.row_rules, *marks)) if marks else pack


def totals(rows: DataFrame, pack: Pack, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per group: source_row_count, invalid_row_count, and the findings of each rule in pack order (c0, c1, ...).

    One scan, one fold by key and one of its small result; a row is invalid once, however many blocking rules it or
    its groups fail.
    """
    marked, wide = _marked(rows, pack, group)
    fold = _entries(marked, wide, group, each_row=False).groupBy(*group, "slot", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), *[c.alias(k) for k, (_, c) in _folds(wide).items()])
    of_rows = F.col("slot") == ROWS
    bits = F.when(of_rows, F.col("key").cast("bigint")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    by_row = [F.sum(F.when(of_rows & _has(bits, i), F.col("n")).otherwise(zero)) for i in range(len(pack.row_rules))]
    by_set = [F.count_if(_fails(wide, i)) for i in range(len(pack.set_rules))]
    first = next((i for i, r in enumerate(pack.set_rules) if r.blocking), None)
    more = F.lit(0) if first is None else F.when(_fails(wide, first), F.col(f"clean{first}")).otherwise(zero)
    return fold.groupBy(*group).agg(
        F.sum(F.when(of_rows, F.col("n")).otherwise(zero)).alias("source_row_count"),
        F.sum(F.when(of_rows, F.col("bad")).otherwise(more)).cast("bigint").alias("invalid_row_count"),
        *[c.alias(f"c{i}") for i, c in enumerate([*by_row, *by_set])])


def counts_of(summed: DataFrame, pack: Pack) -> DataFrame:
    """(run_id, check_name, severity_class, findings) from `totals` by run; rules without findings have no row."""
    each = F.array(*[
        F.struct(F.lit(r.name).alias("check_name"), F.lit(r.severity).alias("severity_class"), F.col(f"c{i}").alias("findings"))
        for i, r in enumerate(pack.rules)
    ])
    return summed.select("run_id", F.inline(each)).where("findings > 0")


def severities_of(pack: Pack) -> dict[str, Column]:
    """Severity -> findings of that severity, over the columns of `totals`."""
    return {
        s: reduce(lambda a, b: a + b, [F.col(f"c{i}") for i, r in enumerate(pack.rules) if r.severity == s], F.lit(0).cast("bigint"))
        for s in (BLOCKING, WARNING, INVESTIGATION)
    }
