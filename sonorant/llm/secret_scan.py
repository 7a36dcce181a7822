"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong patterns are always reported. Weak candidates (user or key identifiers,
long mixed blobs, endpoints) mean little alone, so they are interval-joined with
the other parts of the same scope, a paragraph of a text: an identifier or an
endpoint counts only with a secret part beside it in the scope, a blob only with an
identifier or an endpoint. All parts of a kind are leftmost and non-overlapping; a
weak candidate that overlaps a strong span is dropped.

The join is a sweep over a text's parts in order: a part stands wholly before or behind a
candidate exactly if the least end of such parts in the scope is not beyond the candidate's
start, or their greatest start not before its end; a strong span overlaps it if one that began
reaches into it or the next one begins within it. So no pairs are made, however far apart parts are.

Spans depend on the text alone: each distinct text is worked on once and joined
back to all rows that hold it. A null or empty text has no span. Repeated rows and
ties get the same spans; extra columns stay, whatever their names. An empty table
gives no rows. Patterns read a text in time linear in its length, however long.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import salted_join

# kind, pattern, least length, group the length is that of; in the order of equal starts
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = [("assign", ASSIGN, 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]{24,}", 24, 0)]
WEAK = [
    ("ident", r"""(?<![A-Za-z0-9_])(?i:(?:[a-z0-9_]*_)?(?:(?:access|account|client|key|user)_?(?:key_?)?id|user(?:name)?|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 3, 1),
    ("blob", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", 32, 0),  # with a digit, which is asked for later: a look ahead would read long runs again and again
    ("endpoint", r"""(?<![A-Za-z0-9_])(?:(?:https?|ftp|amqp|redis|mongodb|mysql|postgres(?:ql)?|s3)://[^\s"'<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_]))""", 7, 0),
]
BREAK = r"\n[\x20\t\r]*\n"
KINDS = [k for k, *_ in STRONG + WEAK]
#: The part that a span of a kind plays, and the parts that must be near for a weak one.
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "id", "ident": "id", "endpoint": "where"}
NEEDS = {"ident": ["secret"], "endpoint": ["secret"], "blob": ["id", "where"]}


def _suspect(text: Column) -> Column:
    """Whether any pattern can match; null for a null text."""
    low = F.lower(text)
    assign = (F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))) & text.rlike(ASSIGN)
    return (
        assign | F.contains(text, F.lit("AKIA")) | text.rlike(r"[0-9a-f]{24}") | text.rlike(WEAK[1][1])
        | ((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(WEAK[0][1])) | text.rlike(WEAK[2][1])
    )


def _matches(texts: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Every match: ``(key, kind, pos, part, gap)``, ``gap`` being the text between the match before and this one."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return texts.where(F.col("text").rlike(pattern)).select(
        "key", F.lit(kind).alias("kind"),
        F.posexplode(F.arrays_zip(found.alias("part"), F.slice(F.split("text", pattern, -1), 1, F.size(found)).alias("gap"))).alias("pos", "m"),
    ).select("key", "kind", "pos", "m.part", F.length("m.gap").cast("bigint").alias("gap"))


def text_spans(texts: DataFrame) -> DataFrame:
    """``(key, spans)`` of distinct ``texts(key, text)`` that have any; spans as array of (start, rank, end, kind)."""
    parts = None
    for kind, pattern, *_ in [*STRONG, *WEAK, ("break", BREAK, 0, 0)]:
        more = _matches(texts, kind, pattern)
        parts = more if parts is None else parts.unionByName(more)
    size = F.length("part").cast("bigint")
    run = Window.partitionBy("key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap") + size).over(run)).withColumn("start", F.col("end") - size)
    enough = F.lit(True)
    for kind, pattern, least, group in STRONG + WEAK:
        if group:
            enough = F.when(F.col("kind") == kind, F.length(F.regexp_extract("part", pattern, group)) >= least).otherwise(enough)
        elif kind in ("access", "endpoint"):
            enough = F.when(F.col("kind") == kind, size >= least).otherwise(enough)
        elif kind == "blob":
            enough = F.when(F.col("kind") == kind, F.col("part").rlike("[0-9]")).otherwise(enough)
    scope = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    spans = (
        placed.where(enough).withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(scope)).where("kind <> 'break'")
        .select("key", "kind", "scope", "start", "end", rank.alias("rank"), role[F.col("kind")].alias("role"))
    )
    strong = F.col("rank") <= len(STRONG)
    text, own = Window.partitionBy("key").orderBy("start"), Window.partitionBy("key", "scope")
    reach = F.max(F.when(strong, F.col("end"))).over(text.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(strong, F.col("start"))).over(text.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    hidden = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    beside = lambda r: F.coalesce(F.min(F.when(F.col("role") == r, F.col("end"))).over(own) <= F.col("start"), F.lit(False)) | F.coalesce(F.max(F.when(F.col("role") == r, F.col("start"))).over(own) >= F.col("end"), F.lit(False))
    joined_ = spans.withColumn("hidden", hidden).withColumns({f"by_{r}": beside(r) for r in sorted({r for rs in NEEDS.values() for r in rs})})
    linked = F.lit(False)
    for kind, roles in NEEDS.items():
        linked = linked | ((F.col("kind") == kind) & reduce(or_, [F.col(f"by_{r}") for r in roles]))
    final = joined_.where(strong | (linked & ~F.col("hidden")))
    return final.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))  # bounded by one text


_NONE = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """``(row, text, spans)``: each row as it was, its text and spans. Rows without a suspect pass by the join, copies of a text are dealt out."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(text_col).alias("text"))
    suspect = F.coalesce(_suspect(F.col("text")), F.lit(False))
    keyed = rows.where(suspect).withColumn("key", F.sha2("text", 256))
    found = text_spans(keyed.select("key", "text").dropDuplicates(["key"]))
    some = salted_join(keyed, found, ["key"], "left").select("row", "text", F.coalesce("spans", F.array().cast(_NONE)).alias("spans"))
    return some.unionByName(rows.where(~suspect).withColumn("spans", F.array().cast(_NONE)))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` (in place of a column of that name), in the order of start, then kind as listed."""
    done = _scanned(docs, text_col)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "spans"], "spans")


def cleaned(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with its columns alone, secrets replaced in the text; ``length_col`` gets the new length."""
    new = {text_col: F.col("clean")} | ({length_col: F.length("clean").cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    done = _scanned(docs, text_col).select("row", redacted(F.col("text"), F.col("spans")).alias("clean"))
    return done.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        spans, zero,
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when((s["start"] < acc["at"]), acc["out"]).otherwise(
                F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).alias("out"),
        )),
    )
    rest = F.substring(text, (cut["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(cut["out"], rest))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
