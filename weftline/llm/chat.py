"""Chat transcripts to canonical turns: a hidden Markov model over lines names the speakers.

States are the roles. A line is observed by its speaker marker and its words, and the
first line of a row, or after a marker, also by the length and the number of lines of
what follows up to the next marker. Viterbi decoding runs over the lines of a
conversation in turn order, so that lines without a marker get their role from their
shape and their neighbours. The model's tables are counts of a bounded sample of labelled
rows on top of prior counts (PRIOR of the tables below); without labels the prior stands.

Conversations of more than LONG rows are decoded in blocks: each block becomes a max-plus
matrix between its ends, the matrices of a conversation fix the roles at the block ends,
and the blocks are then decoded between these, with the same result as in one piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, table

ROLES = ("system", "user", "assistant")
#: Rows of a conversation that are decoded in one piece, two's power of a block's turns, parts of a block by hash.
LONG, BLOCK_BITS, PARTS = 5_000, 9, 4_096
NAMES = {
    "system": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "prompter": 1, "customer": 1, "q": 1, "question": 1, "instruction": 1, "input": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "chatgpt": 2, "model": 2, "agent": 2, "a": 2, "answer": 2, "response": 2, "output": 2,
}
_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:<\|im_start\|>\s*({_NAME})\b\s*|<\|({_NAME})\|>\s*|\[({_NAME})\]\s*:?\s*|(?:#+\s*|\*\*|>+\s*|-\s+)?({_NAME})\s*(?:\*\*)?\s*[:：](?:\*\*)?\s?)", re.I)
ENDS = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>|</s>|<\|endoftext\|>)\s*$")
#: Conversations of a fit and rows each of these may have; prior rows that the tables below count for.
FIT, FIT_ROWS, PRIOR = 2_000, 100, 8
#: Starts, changes between rows or marked parts, and changes within these, by role (system, user, assistant).
STARTS, CHANGE, STAY = np.array([0.3, 0.6, 0.1]), np.array([[0.05, 0.85, 0.10], [0.03, 0.12, 0.85], [0.02, 0.86, 0.12]]), np.array([[0.998, 0.001, 0.001], [0.001, 0.998, 0.001], [0.001, 0.001, 0.998]])
MARKED = np.log([[0.996, 0.002, 0.002], [0.002, 0.996, 0.002], [0.002, 0.002, 0.996]])
#: Classes of a part's length (powers of two) and of its lines.
LENGTHS, LINES = 24, 9
#: Line features and their likelihoods by role (system, user, assistant).
FEATURES = [
    (re.compile(r"^\s*(?:you are|you're an?|act as|always|never|your task)\b", re.I), (0.30, 0.03, 0.01)),
    (re.compile(r"\?\s*$"), (0.02, 0.30, 0.08)),
    (re.compile(r"^\s*(?:please|can you|could you|how (?:do|can|to)|what|why|write|give me|help|i want|i need)\b", re.I), (0.03, 0.25, 0.03)),
    (re.compile(r"^\s*(?:sure|certainly|of course|here(?:'s| is| are)|i'm sorry|as an ai|let me|great question)\b", re.I), (0.01, 0.02, 0.25)),
    (re.compile(r"^\s*(?:[-*•]|\d+[.)])\s"), (0.10, 0.05, 0.20)),
    (re.compile(r"^\s*```"), (0.01, 0.04, 0.12)),
]


def lines_of(text: str | None, hint: str | None) -> list[tuple[int | None, str]]:
    """(marked role or None, line without its marker) of a row; the row's own role marks its first line."""
    out: list[tuple[int | None, str]] = []
    given = NAMES.get((hint or "").strip().lower())
    for i, line in enumerate((text or "").split("\n")):
        role = given if i == 0 else None
        if m := MARKER.match(line):
            role, line = NAMES[next(g for g in m.groups() if g).lower()], line[m.end() :]
        out.append((role, ENDS.sub("", line) if "|>" in line or "</s>" in line else line))
    return out


@dataclass
class Model:
    """Log probabilities: starts (role), change and stay (role, next role), has and lacks (feature, role), length and lines (class, role)."""

    starts: np.ndarray
    change: np.ndarray
    stay: np.ndarray
    has: np.ndarray
    lacks: np.ndarray
    length: np.ndarray
    lines: np.ndarray


def model_of(counts: dict[tuple[str, int, int], int]) -> Model:
    """Tables from counts by (table, row, column) and the prior: PRIOR rows a role of the tables above, half a row a class of length or lines."""

    def table_of(name: str, prior: np.ndarray) -> np.ndarray:
        out = prior.astype(float)
        for (t, i, j), n in counts.items():
            if t == name:
                out[i, j] += n
        return out

    def by_row(x: np.ndarray) -> np.ndarray:
        return np.log(x / x.sum(axis=1, keepdims=True))

    def by_column(x: np.ndarray) -> np.ndarray:
        return np.log(x / x.sum(axis=0, keepdims=True))

    has = table_of("has", PRIOR * np.array([p for _, p in FEATURES]))
    of = table_of("line", np.full((1, 3), float(PRIOR)))
    return Model(
        by_row(table_of("start", PRIOR * STARTS[None, :]))[0], by_row(table_of("change", PRIOR * CHANGE)), by_row(table_of("stay", PRIOR * STAY)),
        np.log(has / of), np.log1p(-has / of), by_column(table_of("length", np.full((LENGTHS, 3), 0.5))), by_column(table_of("lines", np.full((LINES, 3), 0.5))),
    )


def shape(part: list[str]) -> tuple[int, int]:
    """Classes of length and lines of a part."""
    return min(LENGTHS, sum(map(len, part)).bit_length() + 1) - 1, min(LINES, len(part)) - 1


def emission(role: int | None, line: str, model: Model, part: list[str] | None = None) -> np.ndarray:
    """Log likelihoods of a line by role; ``part``: the lines that begin with it, if it begins a part."""
    e = MARKED[:, role].copy() if role is not None else np.zeros(3)
    for k, (pattern, _) in enumerate(FEATURES):
        e += (model.has if pattern.search(line) else model.lacks)[k]
    if part is not None:
        length, lines = shape(part)
        e += model.length[length] + model.lines[lines]
    return e


def observed(rows: list[tuple[str | None, str | None]], model: Model) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int | None, str]]]:
    """Emissions and transition kinds (1: a row or a marked line begins) of all lines, and (row, mark, line) of each."""
    flat = [(r, role, line, i == 0 or role is not None) for r, (hint, text) in enumerate(rows) for i, (role, line) in enumerate(lines_of(text, hint))]
    begins = [i for i, x in enumerate(flat) if x[3]]
    ends = dict(zip(begins, [*begins[1:], len(flat)], strict=True))
    held, e = None, []
    for i, (_, role, line, first) in enumerate(flat):
        held = role if first else held  # up to the next marker of the row
        e.append(emission(held, line, model, [x[2] for x in flat[i : ends[i]]] if first else None))
    return np.stack(e), np.array([x[3] for x in flat]), [(r, role, line) for r, role, line, _ in flat]


def transfer(e: np.ndarray, change: np.ndarray, model: Model) -> np.ndarray:
    """Max-plus matrix from the state before the lines (the fourth: none, they begin the conversation) to that of the last one."""
    m = None
    for row, new in zip(e, change, strict=True):
        step = (model.change if new else model.stay) + row[None, :]
        m = np.vstack([step, model.starts + row]) if m is None else (m[:, :, None] + step[None, :, :]).max(axis=1)
    return m


def viterbi(e: np.ndarray, change: np.ndarray, model: Model, before: np.ndarray | None = None, end: int | None = None) -> list[int]:
    """Best states; ``before``: scores of the states ahead of the first line and of there being none, ``end``: the last state if it is fixed. Ties go to the lower state."""
    back = np.zeros(e.shape, np.int64)
    a = model.starts + e[0] if before is None else None
    for i in range(len(e)):
        if i == 0 and a is not None:
            continue
        moves = model.change if change[i] else model.stay
        step = before[:, None] + np.vstack([moves, model.starts]) if i == 0 else a[:, None] + moves
        back[i] = step.argmax(axis=0)
        a = step.max(axis=0) + e[i]
    s = int(a.argmax()) if end is None else end
    out = [s]
    for i in range(len(e) - 1, 0, -1):
        s = int(back[i][s])
        out.append(s)
    return out[::-1]


def segments(states: list[int], flat: list[tuple[int, int | None, str]]) -> Iterator[tuple[int, int, str, str]]:
    """(row, part, role, content) of the runs of lines of one row and role; a marked line begins a new part."""
    last: tuple[int, int] | None = None
    part, lines = 0, []

    def done():
        return (last[0], part, ROLES[last[1]], "\n".join(lines).strip())

    for s, (row, mark, line) in zip(states, flat, strict=True):
        if last is not None and (row, s) == last and not (mark is not None and lines):
            lines.append(line)
            continue
        if last is not None:
            yield done()
            part = part + 1 if row == last[0] else 0
        last, lines = (row, s), [line]
    if last is not None:
        yield done()


OUT = "conv_id long, turn long, part int, role string, content string"


def _batch(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "part", "role", "content"])


def _conversations(batches: Iterator[pa.RecordBatch], use) -> Iterator[None]:
    """Call ``use(conv_id, [(turn, role, text)])`` for each conversation of rows that come sorted; None after each batch and at the end. Columns: conv_id, turn, role, text."""
    conv, rows = None, []
    for batch in batches:
        for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if rows and c != conv:
                use(conv, rows)
                rows = []
            conv = c
            rows.append((turn, role, text))
        yield None
    if rows:
        use(conv, rows)
    yield None


def _whole(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def close(conv, rows) -> None:
            e, change, flat = observed([(r, t) for _, r, t in rows], model)
            found.extend((conv, rows[i][0], part, role, content) for i, part, role, content in segments(viterbi(e, change, model), flat))

        for _ in _conversations(batches, close):
            yield _batch(found)
            found.clear()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(table, i, j, n) of the rows of conversations that name a known role. Within a row the role changes at markers only."""
    seen: Counter[tuple[str, int, int]] = Counter()

    def count(_conv, rows) -> None:
        last = None
        for at, (_, hint, text) in enumerate(rows):
            known = NAMES.get((hint or "").strip().lower())
            lines = lines_of(text, hint)
            if known is None or any(role is not None for role, _ in lines[1:]):
                last = None
                continue
            if at == 0:
                seen["start", 0, known] += 1
            elif last is not None:
                seen["change", last, known] += 1
            seen["stay", known, known] += len(lines) - 1
            for _, line in lines:
                seen["line", 0, known] += 1
                for k, (pattern, _) in enumerate(FEATURES):
                    seen["has", k, known] += bool(pattern.search(line))
            length, n = shape([line for _, line in lines])
            seen["length", length, known] += 1
            seen["lines", n, known] += 1
            last = known

    for _ in _conversations(batches, count):
        pass
    cols = list(zip(*((*k, n) for k, n in seen.items() if n), strict=True)) if any(seen.values()) else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["t", "i", "j", "n"])


def _in_order(rows: DataFrame) -> DataFrame:
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "h").select("conv_id", "turn", "role", "text")


def _slim(conversations: DataFrame, use_roles: bool = True) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), (F.col("role") if use_roles else F.lit(None)).cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("role", "text") if use_roles else F.xxhash64("text"))


def fit(conversations: DataFrame, most: int = FIT, rows_each: int = FIT_ROWS) -> Model:
    """A model from rows whose role column names a known role: ``most`` conversations of ``rows_each`` rows or fewer, the first by hash. Null conv_ids are left out; without such rows the prior stands."""
    rows = _slim(conversations).where("conv_id is not null")
    few = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") <= rows_each).select("conv_id")
    chosen = stored(few.withColumn("o", F.xxhash64("conv_id")).orderBy("o", "conv_id").limit(most).select("conv_id"))
    counted = map_batches(_in_order(rows.join(F.broadcast(chosen), "conv_id")), _counts, "t string, i int, j int, n long")
    return model_of({(r["t"], r["i"], r["j"]): r["n"] for r in counted.groupBy("t", "i", "j").agg(F.sum("n").alias("n")).collect()})  # one row a cell of the tables


def parse_transcripts(conversations: DataFrame, use_roles: bool = True, model: Model | None = None) -> DataFrame:
    """(conv_id, turn, part, role, content, rendered): canonical turns of every row.

    A row may hold several speakers (parts). A row's role column, if it names one and
    ``use_roles`` is set, marks its lines up to the first marker, and a marker those up to
    the next one; all others are left to the model (the prior, if none is given). Null and
    empty texts are turns of empty content; null conv_ids form one conversation; rows of
    equal turn follow by hash of their content, null turns come first; repeated rows are all
    returned; texts of any length are read whole; other columns, whatever their names,
    aren't read; an empty table gives no rows.
    """
    model = model or model_of({})
    rows = _slim(conversations, use_roles)
    long = stored(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("conv_id"))
    some = not long.isEmpty()
    short = rows.join(long, rows["conv_id"].eqNullSafe(long["conv_id"]), "left_anti") if some else rows
    out = map_batches(_in_order(short), _whole(model), OUT)
    if some:
        out = out.unionByName(_in_blocks(rows.join(long, rows["conv_id"].eqNullSafe(long["conv_id"]), "left_semi"), model))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("<|end|>\n")))


def _in_blocks(rows: DataFrame, model: Model) -> DataFrame:
    """Long conversations, by blocks of turns; blocks of more than LONG rows are split by turn and hash, in the order of both."""
    rows = rows.withColumn("b", F.expr(f"shiftright(coalesce(turn, {-(1 << 62)}), {BLOCK_BITS})"))
    full = stored(rows.groupBy("conv_id", "b").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("conv_id", "b", F.lit(True).alias("split")))
    rows = rows.alias("r").join(F.broadcast(full.alias("f")) if full.count() < 10_000 else full.alias("f"), F.expr("r.conv_id <=> f.conv_id and r.b = f.b"), "left").select("r.*", "split")
    rows = rows.withColumn("sub", F.when(F.col("split"), F.expr(f"coalesce(turn, 0) & {(1 << BLOCK_BITS) - 1}") * PARTS + F.floor((F.col("h") / 2.0**64 + 0.5) * (PARTS - 1)).cast("long")).otherwise(F.lit(0)))

    def ordered(t: pa.Table) -> pa.Table:
        return t.sort_by([("turn", "ascending"), ("h", "ascending")])

    def matrices(t: pa.Table) -> pa.Table:
        t = ordered(t)
        e, change, _ = observed(list(zip(t["role"].to_pylist(), t["text"].to_pylist(), strict=True)), model)
        return pa.table({"conv_id": t["conv_id"].slice(0, 1), "b": t["b"].slice(0, 1), "sub": t["sub"].slice(0, 1), "m": pa.array([transfer(e, change, model).ravel().tolist()], pa.list_(pa.float64()))})

    def ends(t: pa.Table) -> pa.Table:
        t = t.sort_by([("b", "ascending"), ("sub", "ascending")])
        ms = [np.array(m).reshape(4, 3) for m in t["m"].to_pylist()]
        a, before, back = np.array([-np.inf, -np.inf, -np.inf, 0.0]), [], []
        for m in ms:
            before.append(a.tolist())
            step = a[:, None] + m
            back.append(step.argmax(axis=0))
            a = np.append(step.max(axis=0), -np.inf)
        s, end = int(a.argmax()), []
        for k in range(len(ms) - 1, -1, -1):
            end.append(s)
            s = int(back[k][s])
        return pa.table({"conv_id": t["conv_id"], "b": t["b"], "sub": t["sub"], "before": pa.array(before, pa.list_(pa.float64())), "end": pa.array(end[::-1], pa.int32())})

    def decode(t: pa.Table, k: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_batches([_batch([])])
        t = ordered(t)
        e, change, flat = observed(list(zip(t["role"].to_pylist(), t["text"].to_pylist(), strict=True)), model)
        states = viterbi(e, change, model, np.array(k["before"][0].as_py()), k["end"][0].as_py())
        conv, turns = t["conv_id"][0].as_py(), t["turn"].to_pylist()
        return pa.Table.from_batches([_batch([(conv, turns[i], part, role, content) for i, part, role, content in segments(states, flat)])])

    keys = ["conv_id", "b", "sub"]
    rows = rows.select(*keys, "turn", "role", "text", "h")
    m = rows.groupBy(*keys).applyInArrow(matrices, "conv_id long, b long, sub long, m array<double>")
    fixed = stored(m.groupBy("conv_id").applyInArrow(ends, "conv_id long, b long, sub long, before array<double>, end int"))
    return rows.groupBy(*keys).cogroup(fixed.groupBy(*keys)).applyInArrow(decode, OUT)


def held_out() -> Column:
    """Conversations that no model is fitted on: crc32 of conv_id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all conversations recovered from their texts alone, one row a part: conv_id, turn, part, role, rendered, held_out.

    The role column is read for the fit only, of conversations that aren't held out; edge cases are those of :func:`parse_transcripts`.
    """
    rows = table(spark, sf_dir, "conversations")
    model = fit(rows.where(~held_out()))
    return parse_transcripts(rows, use_roles=False, model=model).select("conv_id", "turn", "part", "role", "rendered", held_out().alias("held_out"))
