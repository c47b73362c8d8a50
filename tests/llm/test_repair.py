"""Operator 13 against brute force: every legal edit of short conversations, and a
plain relaxation over whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rtq.llm import repair
from rtq.llm.queries import QUERIES

from conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def options(row, fault):
    """(cost, letter, resulting message or None)"""
    out = [(4, "D", None)]
    if fault not in ("blank", "duplicate"):
        more = 3 if fault == "truncated" else 0
        out += [(more, "K", (row[2], row[3])), (more + 3, "R", ("user", row[3])), (more + 3, "R", ("assistant", row[3]))]
    return out


def relaxed(rows, marks):
    """Least (cost, audit, messages) by state, row by row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(best):
        for _ in range(8):
            for state, (cost, audit, said) in list(best.items()):
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    new = (cost + 3, audit + "I", said + [(role, "")])
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    best = inserts({"": (0, "", [])})
    for row, mark in zip(rows, marks, strict=True):
        after = {}
        for state, (cost, audit, said) in best.items():
            for more, letter, message in options(row, mark):
                to = state if message is None else step.get((state, message[0][:1]))
                new = (cost + more, audit + letter, said + ([message] if message else []))
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        best = inserts(after)
    return min((v for k, v in best.items() if k in ("", "a")), key=lambda v: v[:2])


def exhaustive(rows, marks):
    """All edits with at most two inserts at each place."""
    gaps = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    found = []
    for picks in itertools.product(*(options(r, m) for r, m in zip(rows, marks, strict=True))):
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(p[0] for p in picks) + 3 * sum(map(len, fill))
            audit, said = "", []
            for i, put in enumerate(fill):
                audit += "I" * len(put)
                said += [(r, "") for r in put]
                if i < len(rows):
                    audit += picks[i][1]
                    said += [picks[i][2]] if picks[i][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said)) and all(r for r, _ in said):
                found.append((cost, audit, said))
    return min(found, key=lambda v: v[:2])


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damaged(rows):
        by[r[0]].append(r)
    out = {}
    for conv, got in by.items():
        got.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(got)
        cost, audit, said = relaxed(got, marks)
        turns = {r[1] for r in got if r[1] is not None}
        pairs = zip(got, got[1:])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def run(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("conv", "pos", "part", "cost", "edit", "mark")})
    monkeypatch.setattr(repair, "table", lambda *a: frame)
    return {r[0]: tuple(r[1:]) for r in QUERIES["op13_conversation_repair"](spark, "").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_agenda_is_exhaustive_search(seed):
    rng = random.Random(seed)
    for _ in range(5):
        rows = [(1, i, rng.choice(["system", "user", "assistant", "tool", "", " "]), rng.choice(["Yes.", "no", "", "So?"])) for i in range(rng.randint(0, 3))]
        marks = faults(rows)
        best = exhaustive(rows, marks)
        assert relaxed(rows, marks)[:2] == best[:2]
        initial = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "o" for r in rows]
        code = "".join("x" if m in ("blank", "duplicate") else c.upper() if m else c for c, m in zip(initial, marks, strict=True))
        goal = min(w for q, w in enumerate(repair.derive(code)[0]) if w and q in repair.ACCEPT)
        assert (goal[0], goal[1].translate(str.maketrans(repair.AUDIT_FROM, repair.AUDIT_TO))) == best[:2]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_conversation_repair"](spark, SF001).collect()}
    assert got == expected(rows)


def test_odd_rows_and_long_conversations(spark, monkeypatch):
    """Nulls, empty roles, ties, repeated rows, one conversation over many runs."""
    rng = random.Random(5)
    rows = [(None, 1, "user", "A."), (None, None, None, None), (7, None, "user", "B?"), (7, None, "user", "B?"), (8, 3, "", "x."), (8, 3, "bot", "y."),
            (8, 9, "assistant", "\t\n"), (9, 0, "user", "é" * 20000 + "."), (9, 1, "assistant", ""), (9, 1, "assistant", "ok!")]
    rows += [(5, i, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Yes.", f"n{i}", f"So {i}?"])) for i in range(90)]
    rows += [(6, 4, "user", "same.")] * 40
    monkeypatch.setattr(repair, "CHUNK_BITS", 2)
    monkeypatch.setattr(repair, "FAN", 2)
    assert run(spark, rows, monkeypatch) == expected(rows)


def test_dropped_and_empty(spark, monkeypatch):
    gone = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "A.")], monkeypatch) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, [], monkeypatch) == {}


def test_messages_are_the_repaired_conversation(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi again."), (1, 2, "user", "")], SCHEMA)
    got = repair.repair(rows).messages.orderBy("seq").collect()
    assert [(r.role, r.text) for r in got] == [("user", "Hi."), ("assistant", "Hi again.")]
