"""Cheapest repair of a conversation's turn structure, in Spark SQL expressions alone.

A conversation shall read system (or not), then user and assistant in turns, or be
empty. Window functions mark each turn's fault; the turns of a conversation are
collected in order and folded by ``aggregate()``, which carries the cheapest (cost,
audit) for each of four states: nothing yet, after system, after user, after assistant.
``least`` takes the cheaper one, of equals the one whose audit comes first.

Conversations of more than ``LONG`` turns are not collected: their turns are numbered by
ranges, folded in lots of ``LONG`` from each of the four states, and the lots' results
are composed; their texts meet in one row only in the result, which is one row for a
conversation.

Order is by turn (nulls first); of equal turns by role, then text. Null roles and texts
count as one space, a null conversation is one like any other. Repeated rows are rows of
their own. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import ranked
from ._common import drop, split_by, stage

#: Turns that are collected into one row at most.
LONG = 1024
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Pairs of role initials that may follow one another.
PAIRS = ("su", "ua", "au")
#: Characters that make no text.
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = ("start", "system", "user", "assistant")
_TURN = ("at", "initial", "fault", "role", "text")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _steps(kind: str) -> str:
    return "struct<" + ", ".join(f"{s}: struct<{kind}>" for s in _STATES) + ">"


def _after(path: Column, edit: str, cost: Column | int) -> Column:
    """``path`` and one more edit; null if there is no path."""
    return F.when(path.isNotNull(), F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], F.lit(edit)).alias("audit")))


def _inserted(acc: Column) -> Column:
    """Paths after insertions: a user wherever one may come, then an assistant; longer ones would only go round."""
    paths = [acc[s] for s in _STATES]
    user = F.least(paths[USER], *[_after(paths[s], "I", INSERT) for s in (START, SYSTEM, ASSISTANT)])
    both = lambda u: F.struct(paths[START].alias("start"), paths[SYSTEM].alias("system"), u.alias("user"), F.least(paths[ASSISTANT], _after(u, "I", INSERT)).alias("assistant"))
    return _let(user, both)


def _edited(acc: Column, turn: Column) -> Column:
    """Paths after one turn is kept, given another role or deleted."""
    kept = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    whole = ~turn["fault"].isin("blank", "duplicate")

    def of(p: Column) -> Column:
        before_user = F.least(p["start"], p["system"], p["assistant"])
        keep = lambda path, initial: F.when(whole & (turn["initial"] == initial), _after(path, "K", kept))
        rerole = lambda path: F.when(whole, _after(path, "R", kept + REROLE))
        return _let(before_user, lambda b: F.struct(
            _after(p["start"], "D", DELETE).alias("start"),
            F.least(_after(p["system"], "D", DELETE), keep(p["start"], "s")).alias("system"),
            F.least(_after(p["user"], "D", DELETE), keep(b, "u"), rerole(b)).alias("user"),
            F.least(_after(p["assistant"], "D", DELETE), keep(p["user"], "a"), rerole(p["user"])).alias("assistant"),
        ))

    return _let(_inserted(acc), of)


def _fold(turns: Column, start: int) -> Column:
    """Cheapest paths through ``turns`` from one state to each."""
    kind = "cost: bigint, audit: string"
    none, zero = F.lit(None).cast(f"struct<{kind}>"), F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    init = F.struct(*[(zero if k == start else none).alias(s) for k, s in enumerate(_STATES)])
    return F.aggregate(turns, init.cast(_steps(kind)), _edited)


def _best(acc: Column) -> Column:
    return _let(_inserted(acc), lambda p: F.least(p["start"], p["assistant"]))


def _applied(turns: Column, audit: Column, start: Column) -> Column:
    """Roles and texts after the edits of ``audit``, from state ``start``."""
    one = F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text")))
    init = F.struct(F.lit(0).alias("next"), (start != USER).alias("user"), F.slice(one, 1, 0).alias("out"))

    def step(acc: Column, edit: Column) -> Column:
        turn = F.get(turns, acc["next"])
        role = F.when(edit == "K", turn["role"]).when(acc["user"], "user").otherwise("assistant")
        row = F.struct(role.alias("role"), F.when(edit == "I", "").otherwise(turn["text"]).alias("text"))
        return F.struct(
            (acc["next"] + (edit != "I").cast("int")).alias("next"),
            F.when(edit == "D", acc["user"]).when((edit == "K") & (turn["initial"] == "s"), True).otherwise(~acc["user"]).alias("user"),
            F.when(edit == "D", acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"),
        )

    letters = F.when(F.length(audit) > 0, F.split(audit, "")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(letters, init, step, lambda acc: acc["out"])


def _marked(rows: DataFrame) -> DataFrame:
    """Initial, whether a turn is blank and whether it is cut off."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("blank", last == "").withColumn("open", ~last.isin(".", "!", "?"))


def _with_fault(rows: DataFrame, repeated: Column) -> DataFrame:
    """First fault that holds, and whether the initial may follow the one before (``last_initial``, null at the begin)."""
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate").when(F.col("open"), "truncated").otherwise("")
    return rows.withColumn("fault", fault).withColumn("illegal", F.col("last_initial").isNotNull() & ~F.concat("last_initial", "initial").isin(*PAIRS))


def _counts() -> list[Column]:
    faults = [F.sum((F.col("fault") == f).cast("bigint")).alias(f) for f in ("blank", "duplicate", "truncated")]
    return [*faults, F.sum(F.col("illegal").cast("bigint")).alias("illegal"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum((F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).cast("bigint")).alias("turns")]


def _collected() -> Column:
    return F.sort_array(F.collect_list(F.struct(*_TURN))).alias("collected")


_GAPS = "coalesce(high - low + 1 - turns, 0L) AS gaps"
_RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit into a row: one exchange by conversation serves the windows and the fold."""
    by = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.repartition("conv_id").withColumn("at", F.row_number().over(by)).withColumn("last_initial", F.lag("initial").over(by)).withColumn("last_turn", F.lag("turn").over(by))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    whole = _with_fault(rows, earlier).groupBy("conv_id").agg(*_counts(), _collected())

    def repaired(turns: Column) -> Column:
        return _let(_best(_fold(turns, START)), lambda best: F.struct(best["cost"].alias("cost"), best["audit"].alias("audit"), _applied(turns, best["audit"], F.lit(START)).alias("repaired")))

    return whole.withColumn("best", _let(F.col("collected"), repaired)).selectExpr("conv_id", _GAPS, "blank", "duplicate", "truncated", "illegal", "best.*")


def _composed(lots: Column) -> Column:
    """Cheapest way through the lots of a conversation: cost, audit and each lot's begin and edits (the last is no lot but what is inserted at the end)."""
    kind = "cost: bigint, audit: string, parts: array<struct<lot: bigint, begin: int, edits: string>>"
    none = F.lit(None).cast(f"struct<{kind}>")
    zero = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.array().alias("parts")).cast(f"struct<{kind}>")
    joined = lambda path, more, lot, k: F.when(path.isNotNull() & more.isNotNull(), F.struct(
        (path["cost"] + more["cost"]).alias("cost"), F.concat(path["audit"], more["audit"]).alias("audit"),
        F.concat(path["parts"], F.array(F.struct(lot.alias("lot"), F.lit(k).alias("begin"), more["audit"].alias("edits")))).alias("parts"),
    ))
    step = lambda acc, x: F.struct(*[F.least(*[joined(acc[s], x[f"from_{s}"][t], x["lot"], k) for k, s in enumerate(_STATES)]).alias(t) for t in _STATES])
    init = F.struct(*[(none if k else zero).alias(s) for k, s in enumerate(_STATES)])
    more = lambda audit: F.struct(F.lit(INSERT * len(audit)).cast("bigint").alias("cost"), F.lit(audit).alias("audit"))
    end = lambda acc: F.least(*[joined(acc[s], more(audit), F.lit(None).cast("bigint"), k) for k, (s, audit) in enumerate(zip(_STATES, ("", "II", "I", ""), strict=True))])
    return F.aggregate(lots, init, step, end)


def _long(rows: DataFrame, most: int) -> DataFrame:
    """Conversations of any length: turns numbered by ranges, lots of ``most`` turns."""
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("-"), F.col("conv_id").cast("string")), F.lit("")))
    n = ranked(rows, F.asc("key"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), start=0).withColumnRenamed("n", "at")
    before = n.select((F.col("at") + 1).alias("at"), F.col("key").alias("last_key"), F.col("initial").alias("last_initial"), F.col("turn").alias("last_turn"))
    first = n.groupBy("key", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    known = n.join(before, "at", "left").join(first, "at", "left")
    own = F.col("last_key") == F.col("key")
    known = known.withColumn("last_initial", F.when(own, F.col("last_initial"))).withColumn("last_turn", F.when(own, F.col("last_turn")))
    lots = _with_fault(known, F.col("first").isNull()).groupBy("key", F.floor(F.col("at") / most).alias("lot")).agg(F.first("conv_id").alias("conv_id"), *_counts(), _collected())
    ways = lambda turns: F.struct(*[_fold(turns, k).alias(f"from_{s}") for k, s in enumerate(_STATES)])
    lots = lots.withColumn("ways", _let(F.col("collected"), ways)).select("*", "ways.*").drop("ways")
    lots, _ = stage(lots, "lots")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    whole = lots.groupBy("key").agg(F.first("conv_id").alias("conv_id"), *sums, F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct("lot", *[f"from_{s}" for s in _STATES]))).alias("way"))
    whole, _ = stage(whole.withColumn("best", _composed(F.col("way"))).drop("way"), "ways")
    parts = whole.select("key", F.posexplode("best.parts").alias("part", "_p")).select("key", "part", "_p.*")
    done = parts.join(lots.select("key", "lot", "collected"), ["key", "lot"], "left")
    empty = F.array().cast("array<struct<at: bigint, initial: string, fault: string, role: string, text: string>>")
    done = done.withColumn("out", _let(F.coalesce("collected", empty), lambda t: _applied(t, F.col("edits"), F.col("begin"))))
    texts = done.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "out"))).alias("outs"))
    joined = whole.join(texts, "key")
    return joined.selectExpr("conv_id", _GAPS, "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", "flatten(outs.out) AS repaired")


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = LONG,
) -> DataFrame:
    """A row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    ``gaps``: turn numbers missing between the least and the greatest. ``blank``,
    ``duplicate`` (role and text came before), ``truncated`` (ends without one of
    ``.!?``): turns whose first fault that is. ``illegal``: neighbours whose initials are
    none of ``PAIRS``. ``audit``: of the cheapest edits the initials: Keep, Rerole (3),
    Delete (4; a must for blank and duplicate turns), Insert (3; an empty turn), a
    truncated turn that stays costs 3 more; of equal costs the least string.
    ``repaired``: array of (role, text).
    """
    text_of = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = _marked(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")))
    long, path = stage(rows.groupBy("conv_id").count().where(F.col("count") > most).select("conv_id"), "long")
    if long.isEmpty():
        drop(turns.sparkSession, path)
        return _short(rows).select(*_RESULT)
    some, others = split_by(rows, long, "conv_id")
    return _short(others).select(*_RESULT).unionByName(_long(some, most).select(*_RESULT))
