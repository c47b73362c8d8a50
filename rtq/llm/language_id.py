"""Language ID (operator 7): cross-parsing entropy with suffix automata.

Spark counts the words of every labelled row; the most frequent ones of a language,
a bounded text, become a suffix automaton.  A text is parsed greedily into the
longest phrases that occur in a language's words; phrases times log2(their length)
over letters estimates the bits a character costs, and the language with the least wins.

Texts are lower-cased letter codes, everything else is one blank per run.  They
are parsed in blocks of ``BLOCK`` codes (a phrase ends at a block's end), so
many blocks advance together by table look-ups and a very long text costs no
more than many short ones; it is encoded a slice at a time.  The driver builds
the automata and broadcasts their edges, a few bytes per sample character; a
worker only lays them out for look-ups.

``accepted`` rejects texts without a letter, and texts that cost far more bits a
character than labelled texts do under a model that did not count them (another
script, junk).  That limit is learned per language and is not applied to texts of under
``LEAST_CODES`` codes, whose cost says little; without labelled rows nothing is
known, so nothing is rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
letter that no language has is a phrase of its own; ties go to the first language
by code point; with one learned language its score is 1; with none all texts
are ``und``; repeated rows are predicted one by one; an empty table gives no
rows; ``identify`` keeps other columns, its own replace those of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from rtq.llm.queries import free_name, register, table
from rtq.session import cut_lineage

#: Characters of frequent words kept per language: as many as so many texts of so many characters.
TRAIN_ROWS, TRAIN_CHARS = 40, 1500
#: Tasks that rank the words of a language first.
RANK_TASKS = 64
#: Letters of a counted word, at most.
WORD_LETTERS = 16
#: Codes a text is cut into for parsing.
BLOCK = 256
#: Characters parsed together.
SLICE_CHARS = 1 << 21
UND = "und"
#: A text may cost so many times the bits of the costliest labelled texts of its language
#: (all but one in a thousand cost no more),
HEADROOM, COSTLIEST = 2.0, 0.999
#: unless it has fewer codes than this.
LEAST_CODES = 200
#: Automata with more cells than this are searched by key instead of laid out as a table.
DENSE_CELLS = 1 << 25

RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType()),
                     StructField("codes", LongType())])


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def labelled(docs: DataFrame) -> DataFrame:
    """``(lang, text, half)`` of the labelled rows outside the held-out fold, dealt to two halves."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    return rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).alias("half"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``(lang, word, n0, n1)``: how often each half holds a word, over whole texts.
    Runs of letters without a blank are cut to words of ``WORD_LETTERS``."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"(\\p{{L}}{{1,{WORD_LETTERS}}})"), F.lit(1))
    each = rows.select("lang", "half", F.explode(words).alias("word"))
    return each.groupBy("lang", "word").agg(F.sum(1 - F.col("half")).alias("n0"), F.sum("half").alias("n1"))


def frequent_words(counts: DataFrame, n: Column, size: int) -> dict[str, str]:
    """The words with the greatest counts ``n`` of each language, ``size`` characters of them."""
    most, order = max(1, size // 2), [F.desc("n"), "word"]
    ranked = counts.select("lang", "word", n.alias("n"), F.pmod(F.xxhash64("word"), F.lit(RANK_TASKS)).alias("part")).where("n > 0")
    # The last rank reads what its parts leave, however many words a language has.
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= most)
    got = ranked.select("lang", "word", "r").collect()
    out: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["r"])):
        left = room.setdefault(r["lang"], size)
        if left > 0:
            out.setdefault(r["lang"], []).append(r["word"])
            room[r["lang"]] = left - len(r["word"]) - 1
    return {k: " ".join(v) for k, v in out.items()}


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """What is learned of every language: its most frequent words over all labelled
    rows, as many characters as ``rows`` texts of ``chars``."""
    return frequent_words(word_counts(labelled(docs)), F.col("n0") + F.col("n1"), rows * chars)


class Learned(NamedTuple):
    sample: dict[str, str]
    limits: dict[str, float]  # bits a character, by language


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Learned:
    """The frequent words of every language, and the bits a text may cost.  Every
    labelled row has a part in both: it is priced by the words of the half it is not in."""
    known, size = labelled(docs), rows * chars
    counts = cut_lineage(word_counts(known), "word-counts")
    sample = frequent_words(counts, F.col("n0") + F.col("n1"), size)
    priced = []
    for half in (0, 1):
        other = frequent_words(counts, F.col(f"n{1 - half}"), size)
        texts = known.where((F.col("half") == half) & F.col("lang").isin(*other) if other else F.lit(False))
        out, name = _predicted(texts, other, "text")
        priced.append(out.select("lang", F.col(name)["bits"].alias("bits"), F.col(name)["codes"].alias("codes")))
    cost = priced[0].unionByName(priced[1]).where(F.col("codes") >= LEAST_CODES).groupBy("lang").agg(
        F.percentile_approx("bits", F.lit(COSTLIEST), F.lit(10000)).alias("bits"))
    limits = {r["lang"]: HEADROOM * r["bits"] for r in cost.collect()}
    widest = max(limits.values(), default=float("inf"))  # for languages of which one half knows nothing
    return Learned(sample, {lang: limits.get(lang, widest) for lang in sample})


def suffix_automaton(codes: list[int], alphabet: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges (state * alphabet + code, ascending, and target state) of the automaton
    of all substrings of ``codes``, and its number of states; state 0 is the start."""
    length, link, step, last = [0], [-1], [{}], 0
    for c in codes:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    edges = np.fromiter((x for s, d in enumerate(step) for c, t in d.items() for x in (s * alphabet + c, t)), np.int64).reshape(-1, 2)
    edges = edges[np.argsort(edges[:, 0])]
    return edges[:, 0].copy(), edges[:, 1].astype(np.int32), len(step)


class Automata(NamedTuple):
    """What the driver sends: edges of all languages in one state space."""
    langs: list[str]
    size: int  # codes: 0 unknown letter, 1 blank, letters from 2 on
    code: np.ndarray  # of every code point
    start: list[int]  # first state times size, by language
    log: list[float]
    keys: np.ndarray  # state * size + code, ascending
    targets: np.ndarray  # target state * size; 0: none
    states: int


def _codes(text: str, code: np.ndarray) -> np.ndarray:
    c = code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 1) | (c[:-1] != 1)
    return c[keep]


def automata(sample: dict[str, str]) -> Automata:
    langs = sorted(sample)
    letters = sorted({c for t in sample.values() for c in t.lower() if c.isalpha()})[:0xFFF0]
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    code = np.where(is_letter, 0, 1).astype(np.uint16)
    known = {c: i + 2 for i, c in enumerate(letters)}
    for i in np.flatnonzero(is_letter):
        c = known.get(chr(i).lower())
        if c:
            code[i] = c
    size, start, log, keys, targets, base = len(letters) + 2, [], [], [], [], 0
    for lang in langs:
        codes = _codes(sample[lang], code)
        # An unknown letter cannot occur in the sample itself.
        k, t, n = suffix_automaton(codes.tolist(), size)
        keys.append(k + base * size)
        targets.append((t.astype(np.int64) + base) * size)
        start.append(base * size)
        log.append(float(np.log2(max(2, len(codes)))))
        base += n
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    keys, targets = join(keys), join(targets)
    small = np.int32 if base * size < 1 << 31 else np.int64
    return Automata(langs, size, code, start, log, keys.astype(small), targets.astype(small), base)


class Parser:
    """Look-ups over the automata of all languages."""

    def __init__(self, model: dict[str, str] | Automata):
        self.model = model = model if isinstance(model, Automata) else automata(model)
        self.langs, self.table, self.laid = model.langs, None, -1
        self.ends = [*model.start[1:], model.states * model.size]
        if model.states * model.size <= DENSE_CELLS:
            self.table = np.zeros(max((b - a for a, b in zip(model.start, self.ends, strict=False)), default=1), np.int32)

    def lay(self, lang: int) -> None:
        """The table holds one language at a time: they are looked up one after the other."""
        if self.table is None or self.laid == lang:
            return
        keys, start = self.model.keys, self.model.start[lang]
        a, b = np.searchsorted(keys, [start, self.ends[lang]])
        self.table[:] = 0
        self.table[keys[a:b] - start] = self.model.targets[a:b]
        self.laid = lang

    def step(self, at: np.ndarray) -> np.ndarray:
        """Target of each state * size + code of the laid language, 0 for none."""
        if self.table is not None:
            return self.table[at - at.dtype.type(self.model.start[self.laid])]
        keys = self.model.keys
        i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[i] == at, self.model.targets[i], 0)

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray, lang: int) -> np.ndarray:
        """Phrases of each block; ``blocks`` is position x block, lengths descending."""
        self.lay(lang)
        start = self.model.keys.dtype.type(self.model.start[lang])
        state = np.full(blocks.shape[1], start)
        count = np.zeros(blocks.shape[1], np.int32)
        active = np.searchsorted(-lengths, -np.arange(1, len(blocks) + 1), "right")
        for pos in range(len(blocks)):
            n = active[pos]
            if not n:
                break
            s, c = state[:n], blocks[pos, :n]
            nxt = self.step(s + c)
            fail = np.flatnonzero(nxt == 0)
            if len(fail):
                again = self.step(start + c[fail].astype(state.dtype))
                count[fail] += (s[fail] != start).astype(np.int32) + (again == 0)
                nxt[fail] = np.where(again == 0, start, again)
            state[:n] = nxt
        return count + (state != start)

    def pieces(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, codes); a long text comes in whole blocks, a slice at a time."""
        for i, t in enumerate(texts):
            rest = np.zeros(0, np.uint16)
            for a in range(0, len(t or ""), SLICE_CHARS):
                c = _codes(t[a: a + SLICE_CHARS], self.model.code)
                if len(rest) and len(c) and rest[-1] == 1 and c[0] == 1:
                    c = c[1:]
                c = np.concatenate([rest, c]) if len(rest) else c
                whole = len(c) if a + SLICE_CHARS >= len(t) else (len(c) - 1) // BLOCK * BLOCK
                if whole:
                    yield i, c[:whole]
                rest = c[whole:]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, lead over the second one, bits a character)"""
        return [r[:3] for r in self.predict_all(texts)]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """As ``predict``, and the number of codes."""
        n, lettered = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        count = np.zeros((len(self.langs), len(texts)))
        held: list[tuple[int, np.ndarray]] = []
        total = 0
        for i, c in self.pieces(texts):
            n[i] += len(c)
            lettered[i] |= bool((c != 1).any())
            if self.langs:
                held.append((i, c))
                total += len(c)
            if total >= SLICE_CHARS:
                self._add(held, count)
                held, total = [], 0
        if held:
            self._add(held, count)
        if not self.langs:
            return [(UND, 0.0, 0.0, int(x)) for x in n]
        bits = count * np.array(self.model.log)[:, None] / np.maximum(n, 1)
        best = bits.argmin(axis=0)
        low = bits[best, np.arange(len(texts))]
        score = np.ones(len(texts))
        if len(self.langs) > 1:
            second = np.partition(bits, 1, axis=0)[1]
            score = np.where(second > 0, (second - low) / np.maximum(second, 1e-12), 0.0)
        return [(self.langs[b], float(s), float(x), int(k)) if yes else (UND, 0.0, 0.0, int(k))
                for b, s, x, k, yes in zip(best, score, low, n, lettered, strict=True)]

    def _add(self, held: list[tuple[int, np.ndarray]], count: np.ndarray) -> None:
        """Adds the phrases of pieces to the count of their texts, by language."""
        text = np.array([i for i, _ in held])
        size = np.array([len(p) for _, p in held])
        n_blocks = (size + BLOCK - 1) // BLOCK
        owner = np.repeat(np.arange(len(held)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        lengths = np.minimum(BLOCK, size[owner] - nth * BLOCK)
        flat = np.zeros(len(owner) * BLOCK, np.uint16)
        offset = (np.cumsum(n_blocks) - n_blocks) * BLOCK
        for (_, p), o in zip(held, offset, strict=True):
            flat[o: o + len(p)] = p
        order = np.argsort(-lengths, kind="stable")
        blocks = np.ascontiguousarray(flat.reshape(-1, BLOCK)[order].T)
        for k in range(len(self.langs)):
            count[k] += np.bincount(text[owner[order]], weights=self.phrases(blocks, lengths[order], k), minlength=count.shape[1])


_PARSERS: dict[str, Parser] = {}


def _parser(key: str, sent: Broadcast) -> Parser:
    """The laid-out automata of a broadcast, once per Python worker (one is kept)."""
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(sent.value)
    return _PARSERS[key]


OWN = ("lang_pred", "score", "bits", "codes")


def _predicted(docs: DataFrame, sample: dict[str, str], text: str) -> tuple[DataFrame, str]:
    """``docs`` with one struct column of results whose name is free.  Spark repeats a
    deterministic function for a filter on its result, with another worker a task; not this one."""
    sent, key = docs.sparkSession.sparkContext.broadcast(automata(sample)), uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_parser(key, sent).predict_all(texts.tolist()), columns=list(OWN))

    name = free_name(docs.columns)
    return docs.withColumn(name, predict.asNondeterministic()(F.col(text))), name


def identify(docs: DataFrame, sample: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (lead over the second language, 0 to 1)
    and ``bits`` (estimated cost of a character)."""
    out, name = _predicted(docs, sample, text)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in OWN[:3]), *(F.col(name)[c].alias(c) for c in OWN[:3]))


def accepted(docs: DataFrame, learned: Learned, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a letter that cost no more than their language's limit."""
    if not learned.sample:
        return docs
    out, name = _predicted(docs, learned.sample, text)
    p = F.col(name)
    limit = F.lit(float("inf"))
    for lang, bits in learned.limits.items():
        limit = F.when(p["lang_pred"] == lang, F.lit(bits)).otherwise(limit)
    return out.where((p["lang_pred"] != UND) & ((p["codes"] < LEAST_CODES) | (p["bits"] <= limit))).drop(name)


@register("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), training_sample(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"),
                      F.round("bits", 6).alias("bits"))
