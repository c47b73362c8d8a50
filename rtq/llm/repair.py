"""Conversation structure repair (operator 13): Knuth's lightest derivation.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Rows
are kept, re-roled, deleted or preceded by an inserted empty turn; the cheapest
repair wins, ties by the least audit (one letter an edit, in order).

Deduction system.  Item [i, j, p, q] says: rows i..j turn grammar state p into
q; its weight is (cost, audit).  Axioms are single edits, the rule joins two
adjacent items by adding costs and appending audits.  Appending never makes an
item lighter and keeps the order of two weights of one item, so it is monotone
and superior: the agenda pops the lightest open item and it is final (Knuth's
generalisation of Dijkstra).  It stops when the goal items are final.

Spark does the work in bounded groups.  Rows are dealt and sorted by range on
(conversation, turn, role, text), so a conversation of any length lies in runs
over many tasks; ``CHUNK`` rows of a run are derived at once for all four entry
states, and chunks of one conversation are joined ``FAN`` at a time by the same
agenda, in rounds.  Only sort keys, digests and marks go through these steps.
Texts move once, at the end, to be merged with their edits in sorted order.
The digest of a repaired conversation is one running SHA-256, so that last
stream over one conversation's texts is one task of bounded memory.

Defined cases: nulls in role and text count as one space (a blank row, no legal
role); a null turn sorts first and is ignored by ``gaps``; rows of one turn are
ordered by role, text (its first 64 characters, then its SHA-256); a null
conv_id is a conversation of its own; an empty role has no legal initial and is
never kept; a repeated row is a duplicate; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rtq.llm.queries import register, table
from rtq.session import cut_lineage

CHUNK_BITS, FAN = 8, 16
BLANKS = " \t\n\v\f\r"
#: Grammar of role initials: state and initial to state; 0 and 3 accept.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPT = range(4), (0, 3)
#: Edits by the role they leave.  Letters sort like the audit's D, I, K, R; state
#: and letter class give the role, so the finer letters never decide a tie.
DELETE, KEEP, REROLE, INSERT = "D", {"s": "K", "u": "L", "a": "M"}, {"a": "R", "u": "S"}, {"a": "I", "u": "J"}
AUDIT_FROM, AUDIT_TO = "JLMS", "IKKR"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3

Weight = tuple[int, str]


def lightest(size: int, axioms: dict[tuple[int, int], list[tuple[int, str, int, int]]], entry: int) -> list[Weight | None]:
    """Weights of the goal items [0, size, entry, q] for every state q, by the
    agenda; ``axioms`` lists (cost, audit, j, r) for items [i, j, q, r] by (i, q)."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    final: dict[tuple[int, int], Weight] = {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = cost, audit
        for more, letters, j, r in axioms.get((i, q), ()):
            if (j, r) not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, j, r))
    return [final.get((size, q)) for q in STATES]


@lru_cache(maxsize=20000)
def derive(marks: str) -> tuple[tuple[Weight | None, ...], ...]:
    """Goal weights of a run of rows, by entry and exit state.  A mark is ``x`` (must
    go), or the role's initial (``o``: none legal), in capitals if truncated."""
    axioms: dict[tuple[int, int], list[tuple[int, str, int, int]]] = {}
    for i in range(len(marks) + 1):
        for q in STATES:
            out = axioms.setdefault((i, q), [])
            steps = [(role, r) for (p, role), r in STEP.items() if p == q]
            out.extend((COST_INSERT, INSERT[role], i, r) for role, r in steps if role in INSERT)
            if i == len(marks):
                continue
            mark = marks[i]
            out.append((COST_DELETE, DELETE, i + 1, q))
            if mark == "x":
                continue
            extra = COST_TRUNCATED if mark.isupper() else 0
            for role, r in steps:
                if mark.lower() == role:
                    out.append((extra, KEEP[role], i + 1, r))
                if role in REROLE:
                    out.append((extra + COST_REROLE, REROLE[role], i + 1, r))
    return tuple(tuple(lightest(len(marks), axioms, p)) for p in STATES)


def join_runs(runs: list[tuple[tuple[Weight | None, ...], ...]]) -> tuple[tuple[Weight | None, ...], ...]:
    """Goal weights of adjacent runs taken together."""
    axioms = {(i, p): [(w[0], w[1], i + 1, q) for q, w in enumerate(run[p]) if w] for i, run in enumerate(runs) for p in STATES}
    return tuple(tuple(lightest(len(runs), axioms, p)) for p in STATES)


_GOAL = StructType([StructField("costs", ArrayType(LongType())), StructField("audits", ArrayType(StringType()))])


def _flat(goal: tuple[tuple[Weight | None, ...], ...]) -> tuple[list[int | None], list[str | None]]:
    cells = [w for row in goal for w in row]
    return [w and w[0] for w in cells], [w and w[1] for w in cells]


def _square(costs: list[int | None], audits: list[str | None]) -> tuple[tuple[Weight | None, ...], ...]:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(cells[4 * p: 4 * p + 4]) for p in STATES)


@F.pandas_udf(_GOAL)
def _derive(marks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_flat(derive(m)) for m in marks], columns=["costs", "audits"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_flat(join_runs([_square(r["costs"], r["audits"]) for r in runs])) for runs in batch.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("idx"), pa.array([c for c, _ in out], pa.list_(pa.int64())),
             pa.array([a for _, a in out], pa.list_(pa.string()))], ["conv", "idx", "costs", "audits"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place and edits: the inserts before it, its own edit and, on the last row, those after it."""
    each = re.compile(r"[IJ]*[DKLMRS](?:[IJ]*\Z)?")
    for batch in batches:
        pos: list[int] = []
        edit: list[str] = []
        for runs, audit in zip(batch.column("runs").to_pylist(), batch.column("audit").to_pylist(), strict=True):
            found = each.finditer(audit)
            for run in runs:
                for p in range(run["lo"], run["lo"] + run["n"]):
                    pos.append(p)
                    edit.append(next(found).group())
                    if len(pos) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(edit, pa.string())], ["pos", "edit"])
                        pos, edit = [], []
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(edit, pa.string())], ["pos", "edit"])


class _Out:
    """Messages of a batch."""

    def __init__(self, conv_type: pa.DataType):
        self.schema = pa.schema([("conv", conv_type), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.chars = 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 4
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return out


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; of equal keys, texts (all equal) before edits.  One text is held."""
    out, current, seq, role, text = None, object(), 0, "", ""
    for batch in batches:
        out = out or _Out(batch.schema.field("conv").type)
        columns = [batch.column(c).to_pylist() for c in ("conv", "role", "text", "edit")]
        for conv, r, t, edit in zip(*columns, strict=True):
            if edit is None:
                role, text = r, t
                continue
            if conv != current:
                current, seq = conv, 0
            for letter in edit:
                if letter == DELETE:
                    continue
                if letter in "IJ":
                    out.rows.append((conv, seq, "user" if letter == "J" else "assistant", ""))
                else:
                    out.rows.append((conv, seq, {"S": "user", "R": "assistant"}.get(letter, role), text))
                    out.chars += len(text)
                seq += 1
            if out.chars > 4_000_000 or len(out.rows) > 20_000:
                yield out.batch()
        if out.rows:
            yield out.batch()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of ``role:text`` lines, one running hash per conversation."""
    last: list = []
    state = None
    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        done_conv, done_hash = [], []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            line = f"{role}:{text}".encode()
            if last and last[0] == conv:
                state.update(b"\n" + line)
                continue
            if last:
                done_conv.append(last[0])
                done_hash.append(state.hexdigest())
            last, state = [conv], hashlib.sha256(line)
        yield pa.RecordBatch.from_arrays([pa.array(done_conv, kind), pa.array(done_hash, pa.string())], ["conv", "repaired_sha256"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array(last, kind), pa.array([state.hexdigest()], pa.string())], ["conv", "repaired_sha256"])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv"].eqNullSafe(b["conv"])


_ORDER = ("conv", "turn", "role", "head", "digest")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows without their texts in one global order: sort key, marks, place ``pos`` and task ``part``."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select(
        "conv", "turn", "role", F.substring("text", 1, 64).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"),
        F.substring("role", 1, 1).alias("ini"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open"),
        F.monotonically_increasing_id().alias("tie"))
    keys = [F.col(c).asc_nulls_first() for c in (*_ORDER, "tie")]
    out = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    return cut_lineage(out.withColumns({"pos": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "repair-order")


def marked(order: DataFrame) -> DataFrame:
    """Adds ``fault`` (blank, duplicate, truncated or null) and ``mark``.  A row whose
    role and text were seen is found by the least place of each, joined on places."""
    first = order.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    slim = order.select("conv", "turn", "pos", "part", "ini", "blank", "open").join(first, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("open"), "truncated")
    legal = F.when(F.col("ini").isin("s", "u", "a"), F.col("ini")).otherwise("o")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(legal)).otherwise(legal)
    return slim.withColumn("fault", fault).withColumn("mark", mark).withColumn("chunk", F.shiftright("pos", CHUNK_BITS))


def chunks(rows: DataFrame) -> DataFrame:
    """At most 2^CHUNK_BITS adjacent rows of a conversation each, with its goal weights and index ``idx`` of ``total``."""
    row = F.struct("pos", "mark", F.col("ini").alias("ini"))
    got = rows.groupBy("conv", "part", "chunk").agg(
        F.sort_array(F.collect_list(row)).alias("r"),
        *(F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")))
    # The initials as the conversation has them: an empty one keeps its place.
    pair = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.concat(F.col("r")[i - 1]["ini"], F.col("r")[i]["ini"]))
    pairs = F.when(F.size("r") > 1, pair).otherwise(F.array().cast("array<string>"))
    got = got.select(
        "conv", "part", "chunk", *(F.coalesce(f, F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.col("r")[0]["pos"].alias("lo"), F.size("r").cast("long").alias("n"), F.array_join("r.mark", "").alias("marks"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.col("r")[0]["ini"].alias("head_ini"), F.element_at("r", -1)["ini"].alias("tail_ini"))
    runs = got.groupBy("conv", "part").agg(F.min("chunk").alias("first"), F.count("*").alias("runs"))
    by = Window.partitionBy("conv").orderBy("part")
    runs = runs.withColumn("before", F.sum("runs").over(by) - F.col("runs")).withColumn("total", F.sum("runs").over(Window.partitionBy("conv")))
    found = got.alias("g").join(runs.alias("r"), F.col("g.conv").eqNullSafe(F.col("r.conv")) & (F.col("g.part") == F.col("r.part")))
    out = found.select("g.*", (F.col("r.before") + F.col("g.chunk") - F.col("r.first")).alias("idx"), "r.total")
    return out.withColumn("w", _derive("marks")).select(*[c for c in out.columns if c != "marks"], "w.costs", "w.audits")


class Repaired(NamedTuple):
    conversations: DataFrame  # conv, gaps, blank, duplicate, truncated, illegal, cost, audit
    messages: DataFrame  # conv, seq, role, text; one conversation's rows are adjacent in one task, in order


def repair(rows: DataFrame) -> Repaired:
    """Cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text)."""
    rows = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    order = ordered(rows)
    runs = cut_lineage(chunks(marked(order)), "repair-chunks")

    level = runs.select("conv", "idx", "total", "costs", "audits")
    solved = level.where(F.col("total") == 1).drop("total")
    open_runs = level.where(F.col("total") > 1).drop("total")
    longest = runs.agg(F.max("total")).first()[0] or 1
    while longest > 1:
        groups = open_runs.groupBy("conv", F.shiftright("idx", FAN.bit_length() - 1).alias("up"))
        groups = groups.agg(F.sort_array(F.collect_list(F.struct("idx", "costs", "audits"))).alias("runs")).select("conv", F.col("up").alias("idx"), "runs")
        open_runs = groups.mapInArrow(_join, open_runs.schema)
        longest = -(-longest // FAN)
        if longest > 1:
            open_runs = cut_lineage(open_runs, "repair-level")
    best = F.filter(F.array(*(F.struct(F.col("costs")[q].alias("cost"), F.col("audits")[q].alias("audit")) for q in ACCEPT)),
                    lambda w: w["cost"].isNotNull())
    goal = F.array_min(best)
    goals = cut_lineage(solved.unionByName(open_runs).select("conv", goal.alias("g")).select("conv", "g.cost", "g.audit"), "repair-goals")

    ahead = F.lag("tail_ini").over(Window.partitionBy("conv").orderBy("idx"))
    joined = F.concat("ahead", "head_ini")
    sums = runs.withColumn("ahead", ahead).withColumn("seam", F.when(~joined.isin("su", "ua", "au"), 1).otherwise(0))
    sums = sums.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.col("seam")).alias("illegal"))
    turns = order.where(F.col("turn").isNotNull()).groupBy("conv", "turn").count().groupBy("conv")
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    facts = sums.join(turns, _same(sums, turns), "left").select(sums["*"], F.coalesce(turns["gaps"], F.lit(0)).alias("gaps"))
    conversations = facts.join(goals, _same(facts, goals)).select(
        facts["conv"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.translate("audit", AUDIT_FROM, AUDIT_TO).alias("audit"))

    spread = runs.groupBy("conv", "part").agg(F.min("lo").alias("lo"), F.sum("n").alias("n"))
    spread = spread.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("runs"))
    plan = goals.join(spread, _same(goals, spread)).select("runs", "audit").mapInArrow(_edits, "pos long, edit string")
    keyed = order.select(*_ORDER, "pos").join(plan, "pos")
    texts = rows.select("conv", "turn", "role", F.substring("text", 1, 64).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"),
                        F.lit(None).cast("long").alias("pos"), "text", F.lit(None).cast("string").alias("edit"))
    both = texts.unionByName(keyed.withColumn("text", F.lit(None).cast("string")))
    both = both.repartition("conv").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in (*_ORDER, "pos")))
    kind = rows.schema["conv"].dataType.simpleString()
    messages = both.select("conv", "role", "text", "edit").mapInArrow(_messages, f"conv {kind}, seq long, role string, text string")
    return Repaired(conversations, messages)


def damage(rows: DataFrame) -> DataFrame:
    """Rows as a faulty export leaves them: by crc32(`conv_id:turn`) % 20 a row is
    dropped (0), emptied (1), loses its ends of sentences (2), is repeated (3) or
    becomes the user's (4).  Nulls count as one space."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                      F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                      F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "copy")


@register("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damage(source))
    kind = source.schema["conv_id"].dataType.simpleString()
    hashes = done.messages.mapInArrow(_hashes, f"conv {kind}, repaired_sha256 string")
    all_ids = source.select(F.col("conv_id").alias("conv")).distinct()
    found = all_ids.join(done.conversations, _same(all_ids, done.conversations), "left").drop(done.conversations["conv"])
    found = found.join(hashes, _same(found, hashes), "left").drop(hashes["conv"])
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
