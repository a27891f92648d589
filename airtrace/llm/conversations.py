"""Conversation repair by secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn; a window on the same
partitioning marks rows seen earlier, so a task needs no memory of them. The
rows then stream through ``mapInPandas``, which carries the state of a dynamic
program across Arrow batches: for each of four output states (nothing yet, after
a system row, after a user row, after an assistant row) the lowest cost of the
edits so far, the rank of the edits among those of the other states, and a
running digest of the repaired text. Nothing else is kept of a row but its four
backpointers, a byte each. Conversations of up to ``BLOCK_ROWS`` rows are traced
back at once; those of giant ones are spilled as rows of a table, ``BLOCK_ROWS``
backpointers a row, and traced in a second stream that runs from last block to
first and carries one state.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2; the only one for a
blank or repeated row), Insert an empty user or assistant row (5); a truncated
row that is not deleted adds 5. The repaired role initials are
``(s?(ua)+)?``. Of equally cheap edits the audit that sorts first wins: audits
up to a row end in that row's letter, so none is a prefix of another and the
order of two never changes once it is settled.

Defined results: a null text, role or key counts as one blank; null turns come
first; rows of one turn are in order of role and text; rows of a null
conversation form one conversation; a role that starts with another letter can
only be changed or deleted; a conversation whose rows are all dropped is
returned with zeros, an empty audit and the digest of the empty string; an empty
table gives no rows. One conversation is one task's stream in bounded memory,
however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tables import SPACES

BLOCK_ROWS = 1 << 18
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (START, ASSISTANT)
#: State after a user or assistant row that is added in a state, and the role of that row.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Edits up to and including a row: inserts, then the row's own letter; ascending. A backpointer is state * 16 + number.
TOKENS = sorted("I" * k + letter for k in range(3) for letter in "DKR")
TAILS = ["", "I", "II"]
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id {kind}, block int, done boolean, audit string, pointers binary, state int, " + ", ".join(f"{c} long" for c in STATS) + ", digest string"


def prepared(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, dropped``: the columns with nulls as one blank and no row dropped yet."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults by ``crc32('conv_id:turn') % 20``: dropped, emptied, cut, repeated or given another role."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    # Rows of one turn keep the order of the given texts, so that a repeated row follows its original.
    order = F.struct(F.col("role").alias("r"), F.col("text").alias("t"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (fault == 0).alias("dropped"), order.alias("given"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows by conversation in order, with ``fault`` (blank, duplicate, truncated or empty); dropped rows come last."""
    given = F.col("given") if "given" in rows.columns else F.struct(F.col("role").alias("r"), F.col("text").alias("t"))
    core = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    digest = F.sha2("text", 256)
    placed = rows.select("conv_id", "turn", "role", "text", "dropped", given.alias("given"), "copy", core.alias("last"), digest.alias("sum")).repartition("conv_id")
    order = [F.col("dropped"), F.asc_nulls_first("turn"), F.col("given"), F.col("copy")]
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "sum").orderBy(*order)) > 1
    fault = F.when(F.col("last") == "", "blank").when(earlier, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    marked = placed.select("*", fault.alias("fault"))
    return marked.sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "role", "text", "dropped", "fault")


def _options(state: int, initial: str, fault: str) -> Iterator[tuple[int, int, int]]:
    """Token number, next state and cost of everything that can be done with a row."""
    for inserts in range(3):
        if inserts:
            state = NEXT[state]
        for letter in "DKR":
            token = TOKENS.index("I" * inserts + letter)
            cost = INSERT * inserts + (CUT if fault == "truncated" and letter != "D" else 0)
            if letter == "D":
                yield token, state, cost + DELETE
            elif fault in ("blank", "duplicate"):
                continue
            elif letter == "R":
                yield token, NEXT[state], cost + REROLE
            elif initial == "s" and state == START and not inserts:
                yield token, SYSTEM, cost + KEEP
            elif initial in ("u", "a") and NEXT[state] == (USER if initial == "u" else ASSISTANT):
                yield token, NEXT[state], cost + KEEP


@lru_cache(maxsize=4096)
def _step(costs: tuple, ranks: tuple, initial: str, fault: str) -> tuple[int, tuple, tuple, bytes]:
    """One row: base cost, relative costs, ranks and backpointers of the four states (-1: out of reach)."""
    best: dict[int, tuple] = {}
    for state, (cost, rank) in enumerate(zip(costs, ranks)):
        if cost >= 0:
            for token, after, more in _options(state, initial, fault):
                found = (cost + more, rank, token, state)
                if after not in best or found < best[after]:
                    best[after] = found
    # What is open after an assistant row is open at the start and after a system row too, at most one system row apart.
    limit = {START: DELETE, SYSTEM: 0}
    if ASSISTANT in best:
        for state, slack in limit.items():
            if state in best and best[state][0] > best[ASSISTANT][0] + slack:
                del best[state]
    base = min(f[0] for f in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    new = tuple(best[s][0] - base if s in best else -1 for s in range(4))
    rank = tuple(order.index(s) if s in best else -1 for s in range(4))
    return base, new, rank, bytes(best[s][3] * 16 + best[s][2] if s in best else 255 for s in range(4))


def _finish(costs: tuple, ranks: tuple) -> tuple[int, int, str]:
    """Cost, state before and inserts of the cheapest ending."""
    found = []
    for state, cost in enumerate(costs):
        after = state
        for tail in TAILS:
            if cost >= 0 and after in ACCEPT:
                found.append((cost + INSERT * len(tail), ranks[state], tail, state))
            after = NEXT[after]
    cost, _, tail, state = min(found)
    return cost, state, tail


def trace(pointers: bytes, state: int) -> tuple[str, int]:
    """Follow backpointers from the last row to the first: the letters, and the state before the first row."""
    out = []
    for i in range(len(pointers) - 4, -1, -4):
        one = pointers[i + state]
        out.append(TOKENS[one & 15])
        state = one >> 4
    return "".join(reversed(out)), state


class Digest:
    """Running SHA-256 of ``role:text`` lines joined by newlines."""

    def __init__(self):
        self.sum, self.any = hashlib.sha256(), False

    def copy(self) -> Digest:
        new = Digest()
        new.sum, new.any = self.sum.copy(), self.any
        return new

    def add(self, role: str, text: str) -> None:
        self.sum.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True


def _played(digest: Digest, state: int, edits: str, role: str, text: str) -> Digest:
    """The digest after the edits of one row, started from a state."""
    if edits == "D":
        return digest
    new = digest.copy()
    for letter in edits:
        if letter == "K":
            new.add(role, text)
        elif letter != "D":
            state = NEXT[state]
            new.add(ROLE[state], text if letter == "R" else "")
    return new


class Conversation:
    """State of the conversation that is being streamed."""

    def __init__(self, mark: str, conv_id: str | None):
        self.mark, self.key, self.base, self.block = mark, conv_id, 0, 0
        self.costs, self.ranks = (0, -1, -1, -1), (0, -1, -1, -1)
        self.digests: list[Digest | None] = [Digest(), None, None, None]
        self.pointers = bytearray()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if fault:
            self.faults[fault] += 1
        more, self.costs, self.ranks, step = _step(self.costs, self.ranks, initial, fault)
        self.base += more
        self.pointers += step
        self.digests = [None if p == 255 else _played(self.digests[p >> 4], p >> 4, TOKENS[p & 15], role, text) for p in step]

    def spilled(self) -> tuple:
        row = (self.key, self.block, False, None, bytes(self.pointers), None, *[None] * len(STATS), None)
        self.pointers.clear()
        self.block += 1
        return row

    def result(self) -> tuple:
        more, state, tail = _finish(self.costs, self.ranks)
        digest = _played(self.digests[state], state, tail, "", "") if tail else self.digests[state]
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        stats = (gaps, *self.faults.values(), self.illegal, self.base + more, digest.sum.hexdigest())
        if not self.block:
            return (self.key, 0, True, trace(bytes(self.pointers), state)[0] + tail, None, None, *stats)
        return (self.key, self.block, True, tail, bytes(self.pointers), state, *stats)


def _stream(schema_names: list[str], block_rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: Conversation | None = None
        for pdf in frames:
            out = []
            columns = (pdf[c].tolist() for c in ("key", "conv_id", "turn", "role", "text", "dropped", "fault"))
            known = pdf["turn"].notna().tolist()
            for (key, conv, turn, role, text, dropped, fault), has in zip(zip(*columns), known):
                if open_ is None or key != open_.mark:
                    if open_ is not None:
                        out.append(open_.result())
                    open_ = Conversation(key, conv)
                if not dropped:
                    open_.add(int(turn) if has else None, role, text, fault)
                    if len(open_.pointers) >= 4 * block_rows:
                        out.append(open_.spilled())
            yield pd.DataFrame(out, columns=schema_names)
        if open_ is not None:
            yield pd.DataFrame([open_.result()], columns=schema_names)

    return run


def _traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of giant conversations, last first, to their letters."""
    state = None
    for pdf in frames:
        out = []
        for key, block, done, tail, pointers, end in zip(*(pdf[c].tolist() for c in ("key", "block", "done", "audit", "pointers", "state"))):
            if done:
                state = int(end)
            letters, state = trace(pointers, state)
            out.append((key, block, letters + (tail if done else "")))
        yield pd.DataFrame(out, columns=["key", "block", "part"])


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("key")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``prepared`` or ``damaged`` rows: the faults, the cheapest repair and its digest.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    # A text key keeps integer ids out of floating point where some are null.
    keyed = _marked(rows).select(_key(), F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "dropped", "fault")
    schema = RESULT.format(kind="string")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    found = materialize(keyed.mapInPandas(_stream(names, block_rows), schema), "repairs")
    whole = found.where("done and pointers is null")
    blocks = found.where("pointers is not null").select(_key(), "block", "done", "audit", "pointers", F.coalesce("state", F.lit(-1)).alias("state"))
    parts = blocks.repartition("key").sortWithinPartitions("key", F.desc("block")).mapInPandas(_traced, "key string, block int, part string")
    audits = parts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "").alias("audit"))
    giant = found.where("done and pointers is not null").drop("audit").withColumn("key", _key()).join(audits, "key")
    columns = [F.col("conv_id").cast(kind).alias("conv_id"), *STATS, "audit", F.col("digest").alias("repaired_sha256")]
    return whole.select(*columns).unionByName(giant.select(*columns))


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit`` of the repaired conversations: the audit's letters joined to the rows they edit."""
    kept = _marked(rows).where(~F.col("dropped"))
    order = Window.partitionBy("conv_id").orderBy(F.monotonically_increasing_id())
    numbered = kept.select("conv_id", "role", "text", F.row_number().over(order).alias("row"))
    letters = found.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    past = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = letters.select(
        "conv_id", "edit",
        F.when(F.col("edit") != "I", F.count_if(F.col("edit") != "I").over(past)).alias("row"),
        (F.count_if(F.col("edit") != "D").over(past) - 1).alias("position"),
    ).where("edit <> 'D'")
    joined = placed.join(numbered, placed["conv_id"].eqNullSafe(numbered["conv_id"]) & (placed["row"] == numbered["row"]), "left")
    whole = joined.select(placed["conv_id"], "position", "edit", F.col("role").alias("_role"), F.coalesce("text", F.lit("")).alias("text"))
    first = Window.partitionBy("conv_id")
    system = F.max((F.col("position") == 0) & (F.col("edit") == "K") & F.col("_role").startswith("s")).over(first)
    turn = F.col("position") - F.when(system, 1).otherwise(0)
    role = F.when(F.col("edit") == "K", F.col("_role")).when(turn % 2 == 0, "user").otherwise("assistant")
    return whole.select("conv_id", "position", role.alias("role"), "text", "edit")

