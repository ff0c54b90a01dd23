"""Repair of conversation structure by a lazily determinised weighted automaton.

Edits turn the rows of a conversation into a sequence of roles `(s?(ua)+)?`. The weighted automaton of
all edits has four states (nothing yet, after system, after user, after assistant). What the rest of a
conversation costs from each of them is a vector; less its least entry it is a state of the
determinised automaton. States and steps are made when first met and kept in a transition table, so
reading a row is one look-up that gives the next state and the cost added. The scan runs from the last
row to the first and so knows what is to come; the trace then runs against it, along arcs that the
costs hold tight, and takes the letter least in ASCII: the audit.

Conversations may be of any size. Rows are put in order by ranges, and each task reads the runs that it
got (at most RUN rows each) from each possible end: a matrix of costs. Runs of one conversation are
then chained by these matrices from the last to the first, which tells each run what follows it; runs
are traced apart from each other, from each state they may begin in; the last pass reads a
conversation's runs and texts in order, a batch at a time, follows the states and hashes. This pass
reads one conversation in one task, as a hash does not split; it holds the letters, which it returns.

Order: rows of a conversation go by turn (nulls first), rows of one turn by the MD5 of role and text;
equal rows are adjacent and counted once with their number.

Edge cases: a null conv_id is a conversation of its own; a null role or text is one space; a null or
empty role is none of system, user, assistant and can only be changed or deleted; texts of any length
are read whole; repeated rows are duplicates; a conversation of which no row is left has zeros and an
empty audit; an empty table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, tidy

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space.
_SPACE = "\t\n\x0b\x0c\r "
RUN = 1 << 16
_NONE = float("inf")
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A user follows 0, 1 and 3, an assistant 2.
_NEXT = (2, 2, 3, 2)
_STOPS = (0, 3)
#: A row as a byte: role (0 system, 1 user, 2 assistant, 3 other), 4 if truncated, 8 if it must go.
_KEEPS = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}


class Determinised:
    """The determinised automaton, made as far as it is met."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.steps: list[list] = []  # of a state, by byte: state before the row and cost added
        self.arcs: list[list] = []  # of a state, by byte: letters and state after the row, by state before it

    def state(self, vector: list[float]) -> tuple[int, float]:
        """Number of the vector less its least entry, and that entry; insertions are worked in."""
        v = list(vector)
        for _ in range(3):
            v = [min(v[q], INSERT + v[_NEXT[q]]) for q in range(4)]
        low = min(v)
        key = tuple(x - low for x in v)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
            self.steps.append([None] * 16)
            self.arcs.append([None] * 16)
        return self.number[key], low

    @staticmethod
    def edits(row: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Letter, cost and state after it of what may be done with a row; deletion first, as in ASCII."""
        yield "D", DELETE, q
        if not row & 8:
            more = TRUNCATED if row & 4 else 0
            if (row & 3, q) in _KEEPS:
                yield "K", more, _KEEPS[row & 3, q]
            yield "R", REROLE + more, _NEXT[q]

    def step(self, after: int, row: int) -> tuple[int, float]:
        got = self.steps[after][row]
        if got is None:
            v = self.vectors[after]
            got = self.steps[after][row] = self.state([min(cost + v[to] for _, cost, to in self.edits(row, q)) for q in range(4)])
        return got

    def arc(self, after: int, row: int) -> list[tuple[str, int]]:
        """Of each state before a row: the least letters that end with this row, and the state after it."""
        got = self.arcs[after][row]
        if got is None:
            before, added = self.step(after, row)
            v, w = self.vectors[before], self.vectors[after]
            got = []
            for q in range(4):
                letters = ""
                while True:
                    tight = [(x, to) for x, cost, to in self.edits(row, q) if cost + w[to] == added + v[q]]
                    if INSERT + v[_NEXT[q]] == v[q]:
                        tight.append(("I", _NEXT[q]))
                    x, to = min(tight)
                    letters, q = letters + x, to
                    if x != "I":
                        break
                got.append((letters, q))
            self.arcs[after][row] = got
        return got

    def scan(self, rows: bytes, end: int) -> tuple[list[int], float]:
        """States after each row, the last first, and what is before all; the cost added."""
        states, total = [end], 0.0
        for row in reversed(rows):
            end, added = self.steps[end][row] or self.step(end, row)
            total += added
            states.append(end)
        return states, total

    def matrix(self, rows: bytes) -> list[float]:
        """Least cost from each state before the rows (outer) to each state after them (inner)."""
        columns = []
        for j in range(4):
            first, low = self.state([0.0 if q == j else _NONE for q in range(4)])
            states, total = self.scan(rows, first)
            columns.append([low + total + x for x in self.vectors[states[-1]]])
        return [columns[j][q] for q in range(4) for j in range(4)]

    def trace(self, rows: bytes, end: list[float], starts: tuple[int, ...]) -> list[tuple[str, int]]:
        """Letters and last state of the cheapest, ASCII-least edits from each of `starts`."""
        states, _ = self.scan(rows, self.state(end)[0])
        states.reverse()
        out = []
        for q in starts:
            letters = []
            for i, row in enumerate(rows):
                x, q = (self.arcs[states[i + 1]][row] or self.arc(states[i + 1], row))[q]
                letters.append(x)
            out.append(("".join(letters), q))
        return out


#: What the rest costs after the last row.
STOP = [0.0 if q in _STOPS else _NONE for q in range(4)]
_MATRIX = pa.list_(pa.float64())


def _illegal(roles: np.ndarray) -> int:
    """Neighbours that are neither system and user, user and assistant, nor assistant and user."""
    a, b = roles[:-1], roles[1:]
    return int(len(a) - (((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))).sum())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _give(schema: pa.Schema, rows: Iterator[dict], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + len(r.get("rows") or b"")
        if len(held) >= most or size >= 1 << 23:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@tidy
def _runs(batches: Iterator[pa.RecordBatch], key: pa.DataType, run: int = RUN) -> Iterator[pa.RecordBatch]:
    """Runs of ordered rows, each of one conversation, with their matrices."""
    machine, part = Determinised(), TaskContext.get().partitionId()
    schema = pa.schema([("cn", pa.bool_()), ("c", key), ("part", pa.int32()), ("k", pa.int32()), ("rows", pa.binary()), ("opens", pa.bool_()), ("matrix", _MATRIX)])

    def made() -> Iterator[dict]:
        now, held, k, seen = None, bytearray(), 0, False

        def close() -> dict:
            rows = bytes(held[:run])
            del held[:run]
            return {"cn": now[0], "c": now[1], "part": part, "k": k, "rows": rows, "opens": seen and k == 0, "matrix": machine.matrix(rows)}

        for r in _rows(batches):
            if (r["cn"], r["c"]) != now:
                if now is not None:
                    if held:
                        yield close()
                    seen = True  # what follows another conversation in a task begins here
                now, k = (r["cn"], r["c"]), 0
                held.clear()
            held.append(r["row"])
            left = r["n"] - 1
            while left > 0 or len(held) >= run:
                take = min(left, run)
                held.extend(bytes([r["row"] & 3 | 8]) * take)
                left -= take
                if len(held) >= run:
                    yield close()
                    k += 1
        if now is not None and held:
            yield close()

    yield from _give(schema, made())


@tidy
def _chain(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Runs of a conversation, the last first: what follows each costs `end`, all from it on `all`."""
    schema = pa.schema([("cn", pa.bool_()), ("c", key), ("part", pa.int32()), ("k", pa.int32()), ("rows", pa.binary()), ("opens", pa.bool_()), ("end", _MATRIX), ("all", pa.float64())])

    def made() -> Iterator[dict]:
        now, end = None, STOP
        for r in _rows(batches):
            if (r["cn"], r["c"]) != now:
                now, end = (r["cn"], r["c"]), STOP
            m = r.pop("matrix")
            before = [min(m[4 * q + j] + end[j] for j in range(4)) for q in range(4)]
            yield r | {"end": end, "all": before[0]}
            end = before

    yield from _give(schema, made())


@tidy
def _traced(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Letters and last state of each run from each state that it may begin in (only 0 if it opens a conversation)."""
    machine = Determinised()
    schema = pa.schema([("cn", pa.bool_()), ("c", key), ("part", pa.int32()), ("k", pa.int32()), ("letters", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())),
                        ("all", pa.float64()), ("first", pa.int32()), ("last", pa.int32()), ("pairs", pa.int64())])

    def made() -> Iterator[dict]:
        for r in _rows(batches):
            rows, roles = r["rows"], np.frombuffer(r["rows"], np.uint8) & 3
            found = machine.trace(rows, r["end"], (0,) if r["opens"] else (0, 1, 2, 3))
            yield {"cn": r["cn"], "c": r["c"], "part": r["part"], "k": r["k"], "letters": [x for x, _ in found], "exits": [q for _, q in found],
                   "all": r["all"], "first": int(roles[0]), "last": int(roles[-1]), "pairs": _illegal(roles)}

    yield from _give(schema, made())


class _Repaired:
    """One conversation in the last pass: letters first, then texts in order."""

    def __init__(self, row: dict):
        self.out = {k: row[k] for k in ("cn", "c", "gaps", "blank", "duplicate", "truncated")} | {"illegal": 0, "cost": 0}
        self.letters: list[str] = []
        self.state, self.last = 0, None

    def run(self, r: dict) -> None:
        if self.last is None:
            self.out["cost"] = int(r["all"])
        else:
            self.out["illegal"] += _illegal(np.array([self.last, r["first"]]))
        self.out["illegal"] += r["pairs"]
        at = self.state if len(r["letters"]) > 1 else 0
        self.letters.append(r["letters"][at])
        self.state, self.last = r["exits"][at], r["last"]

    def begin(self) -> None:
        tail = ""
        if self.last is not None:
            while self.state not in _STOPS:
                tail, self.state = tail + "I", _NEXT[self.state]
        self.audit = "".join(self.letters) + tail
        self.at, self.state, self.hash, self.any = 0, 0, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(f"{role}:".encode())
        self.hash.update(text.encode())

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _NEXT[self.state]
            self.put("user" if self.state == 2 else "assistant", "")
            self.at += 1

    def row(self, r: dict) -> None:
        for _ in range(r["n"]):
            self.inserts()
            x = self.audit[self.at]
            self.at += 1
            if x == "R":
                self.state = _NEXT[self.state]
                self.put("user" if self.state == 2 else "assistant", r["text"])
            elif x == "K":
                self.state = 1 if r["role"].startswith("s") else _NEXT[self.state]
                self.put(r["role"], r["text"])

    def done(self) -> dict:
        self.inserts()
        return self.out | {"audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


@tidy
def _repaired(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("cn", pa.bool_()), ("c", key), *[(k, pa.int64()) for k in longs], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def made() -> Iterator[dict]:
        now: _Repaired | None = None
        texts = False
        for r in _rows(batches):
            if r["kind"] == 0:
                if now is not None:
                    if not texts:
                        now.begin()
                    yield now.done()
                now, texts = _Repaired(r), False
            elif r["kind"] == 1:
                now.run(r)
            else:
                if not texts:
                    now.begin()
                    texts = True
                now.row(r)
        if now is not None:
            if not texts:
                now.begin()
            yield now.done()

    yield from _give(schema, made())


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(cn, c, tn, t, role, text, n): each row after the damage that its id and turn draw, n times (0: dropped);
    cn and tn say whether id and turn are there."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text = F.when(drawn == 1, "").when(drawn == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    zero = F.lit("0").cast(rows.schema[conv_col].dataType)
    turn = F.col(turn_col).cast("long")
    return rows.select(
        F.col(conv_col).isNotNull().alias("cn"), F.coalesce(F.col(conv_col), zero).alias("c"), turn.isNotNull().alias("tn"), F.coalesce(turn, F.lit(0)).alias("t"),
        F.when(drawn == 4, "user").otherwise(said(role_col)).alias("role"), text.alias("text"), F.when(drawn == 0, 0).when(drawn == 3, 2).otherwise(1).alias("n"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation in rows(cn, c, tn, t, role, text, n) as of damage()."""
    spark, conv = rows.sparkSession, ["cn", "c"]
    kind = rows.schema["c"].dataType
    name, arrow = kind.simpleString(), pa.string() if kind.simpleString() == "string" else pa.int64() if kind.simpleString() == "bigint" else pa.int32()
    parts = shuffle_partitions(spark)
    keyed = rows.withColumn("digest", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    some = keyed.where("n > 0").select(*conv, "tn", "t", "digest", "n", role.alias("role"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    once = some.groupBy(*conv, "tn", "t", "digest").agg(F.sum("n").alias("n"), F.max("role").alias("role"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    first = once.groupBy(*conv, "digest").agg(F.min(F.struct("tn", "t")).alias("f")).select(*conv, "f.tn", "f.t", "digest", F.lit(True).alias("first"))
    marked = once.withColumn("first", F.lit(False)).unionByName(first, allowMissingColumns=True).groupBy(*conv, "tn", "t", "digest").agg(
        F.sum("n").alias("n"), F.max("role").alias("role"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first")
    )
    gone = F.col("blank") | ~F.col("first")
    byte = F.col("role") + F.when(gone, 8).when(F.col("cut"), 4).otherwise(0)
    marked = materialize(marked.select(*conv, "tn", "t", "digest", "n", byte.cast("int").alias("row"), "blank", "first", "cut"), "turns")

    ordered = marked.select(*conv, "tn", "t", "digest", "n", "row").repartitionByRange(parts, *conv, "tn", "t", "digest").sortWithinPartitions(*conv, "tn", "t", "digest")
    base = f"cn boolean, c {name}, part int, k int"
    runs = materialize(ordered.mapInArrow(partial(_runs, key=arrow), f"{base}, rows binary, opens boolean, matrix array<double>"), "runs")
    last = runs.repartition(parts, *conv).sortWithinPartitions("cn", "c", F.desc("part"), F.desc("k"))
    chained = last.mapInArrow(partial(_chain, key=arrow), f"{base}, rows binary, opens boolean, end array<double>, all double")
    traced = chained.repartition(parts, *conv, "part", "k").mapInArrow(partial(_traced, key=arrow), f"{base}, letters array<string>, exits array<int>, all double, first int, last int, pairs bigint")

    there = F.col("n") > 0
    turn = F.when(F.col("tn") & there, F.col("t"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    counted = marked.select(*conv, "tn", "t", "n", "blank", "first", "cut").unionByName(rows.select(*conv).distinct().withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)
    stats = counted.groupBy(*conv).agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"), total(F.when(F.col("blank"), F.col("n"))).alias("blank"),
        total(F.when(~F.col("blank"), F.col("n") - F.col("first").cast("int"))).alias("duplicate"), total((~F.col("blank") & F.col("first") & F.col("cut")).cast("int")).alias("truncated"),
    )
    every = stats.withColumn("kind", F.lit(0)).unionByName(traced.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(
        keyed.where("n > 0").withColumn("kind", F.lit(2)), allowMissingColumns=True
    )
    sent = every.repartition(parts, *conv).sortWithinPartitions(*conv, "kind", "part", "k", "tn", "t", "digest").drop("digest", "tn", "t", "part", "k")
    out = sent.mapInArrow(partial(_repaired, key=arrow), f"cn boolean, c {name}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    return out.select(F.when(F.col("cn"), F.col("c")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_lazy_determinisation(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
