"""Conversation structure repair by a run-length min-plus dynamic program.

A conversation should read ``(s?(ua)+)?`` in role initials.  Rows can be kept, reroled, deleted
or preceded by inserted rows, each at a cost.  With the four states of that expression
(nothing yet, system, user, assistant) a row is a 4 x 4 min-plus matrix: entry (p, q) is the
cheapest way from state p to q by inserts and one edit of the row.  Rows with the same role
initial and fault are the same *symbol* and have the same matrix.

1. The rows of a conversation are numbered in order (the skew-safe scan) and cut into pieces of
   ``PIECE`` rows, so that no task needs all of a long conversation.
2. Equal consecutive symbols of a piece collapse to a run.  A run of n rows advances by the
   powers M^(2^k) of its symbol's matrix, which a task computes once and caches.
3. The pieces' matrices, one small row each, are folded from the last to the first: the cheapest
   cost from each state at each piece border to the end of the conversation.
4. Every piece is unrolled on its own from each of the four states: at each row the ASCII-least
   initial among the choices that keep the cheapest cost.  The next state follows from the
   initial, so the least first choice gives the least audit.
5. Folding the pieces from the first to the last picks each one's real start, its audit and its
   first row's role.  The repaired rows of a conversation stream through one task in order,
   because SHA-256 has to see them so; nothing but a batch of rows and the audit is held.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, non_empty, partitions, runs, small, table
from cohortlens.operators.scan import keyed_scan

PIECE = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60  # no way
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)  # states in which a conversation may end
ADDED = (USER, USER, ASSISTANT, USER)  # state after an inserted or reroled row
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
         (ASSISTANT, "u"): USER}
SPACE = " \t\n\x0b\x0c\r"
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE = "b", "d"  # symbols of rows that must go; others: initial, upper case if truncated, o for any other


def _times(a, b):
    """Min-plus product of 4 x 4 matrices."""
    return tuple(tuple(min(FAR, *(a[p][r] + b[r][q] for r in range(4))) for q in range(4)) for p in range(4))


def _apply(a, w):
    """Cheapest cost from each state through matrix ``a`` and then ``w``."""
    return tuple(min(FAR, *(a[p][q] + w[q] for q in range(4))) for p in range(4))


ONE = tuple(tuple(0 if p == q else FAR for q in range(4)) for p in range(4))


def _inserted():
    step = tuple(tuple(INSERT if q == ADDED[p] else ONE[p][q] for q in range(4)) for p in range(4))
    return _times(step, _times(step, step))


INSERTS = _inserted()  # any number of inserts: after three every state was met
LAST = tuple(min(INSERTS[p][e] for e in ENDS) for p in range(4))  # cost to the end when no row is left


def choices(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits of one row."""
    yield "D", DELETE, state
    if symbol in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if symbol.isupper() else 0
    if (state, symbol.lower()) in AFTER:
        yield "K", KEEP + extra, AFTER[state, symbol.lower()]
    yield "R", REROLE + extra, ADDED[state]


@functools.cache
def power(symbol: str, k: int):
    """Matrix of 2^k rows with this symbol."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    row = [[FAR] * 4 for _ in range(4)]
    for p in range(4):
        for _, cost, q in choices(symbol, p):
            row[p][q] = min(row[p][q], cost)
    return _times(INSERTS, row)


def collapse(symbols: str) -> list[tuple[str, int]]:
    """Runs of equal consecutive symbols."""
    if not symbols:
        return []
    a = np.array(list(symbols))
    cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
    edges = [0, *cuts.tolist(), len(a)]
    return [(symbols[i], j - i) for i, j in zip(edges, edges[1:], strict=False)]


def matrix(run_list: list[tuple[str, int]]):
    out = ONE
    for symbol, n in run_list:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(out, power(symbol, k))
    return out


def before(run: tuple[str, int], w):
    """Cost from each state before a run, ``w`` being the cost after it."""
    symbol, n = run
    for k in range(n.bit_length()):
        if n >> k & 1:
            w = _apply(power(symbol, k), w)
    return w


def _pick(options, best: int):
    """The ASCII-least option (initial, cost to the end, next) that reaches the cheapest cost."""
    return min(o for o in options if o[1] == best)


def unroll(run_list: list[tuple[str, int]], w, state: int, last: bool) -> tuple[str, int]:
    """(audit, end state) of the cheapest edits of these runs from ``state``, ASCII-least.

    ``w``: cost after the runs from each state; ``last``: rows may be inserted after them too.
    """
    ahead = [w]
    for run in reversed(run_list):
        ahead.append(before(run, ahead[-1]))
    ahead.reverse()
    if ahead[0][state] >= FAR:
        return "", -1
    out = []
    for (symbol, n), end in zip(run_list, ahead[1:], strict=True):
        costs = [end]
        one = power(symbol, 0)
        for _ in range(n):
            costs.append(_apply(one, costs[-1]))
        for i in range(n, 0, -1):
            now, then, taken = costs[i], costs[i - 1], "I"
            while taken == "I":
                taken, _, state = _pick(
                    [(c, cost + then[q], q) for c, cost, q in choices(symbol, state)]
                    + [("I", INSERT + now[ADDED[state]], ADDED[state])], now[state])
                out.append(taken)
    while last and w[state]:
        state = ADDED[state]
        out.append("I")
    return "".join(out), state


def audit(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    run_list = collapse(symbols)
    w = LAST
    for run in reversed(run_list):
        w = before(run, w)
    return w[START], unroll(run_list, LAST, START, True)[0]


def _initial(c: str) -> str:
    return c if c in ("s", "u", "a") else "o"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a piece in order -> piece row: symbols, matrix, counts of faults and of illegal neighbours."""
    for part in runs(batches, ["conv", "piece"]):
        fault, first = part.column("fault").to_pylist(), part.column("initial").to_pylist()
        symbols = "".join(
            BLANK if f == "blank" else DUPLICATE if f == "duplicate" else _initial(c).upper() if f == "truncated"
            else _initial(c) for f, c in zip(fault, first, strict=True))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        one = part.slice(0, 1)
        yield pa.RecordBatch.from_arrays([
            one.column("conv").combine_chunks(), one.column("piece").combine_chunks(), pa.array([symbols]),
            pa.array([np.array(matrix(collapse(symbols)), "<i8").tobytes()], pa.binary()),
            *(pa.array([fault.count(k)], pa.int64()) for k in ("blank", "duplicate", "truncated")),
            pa.array([illegal], pa.int64()), pa.array([first[0]]), pa.array([first[-1]])],
            names=["conv", "piece", "symbols", "matrix", "blank", "duplicate", "truncated", "illegal", "head", "tail"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation from last to first -> the same rows with the costs before and after each."""
    conv, w, begun = None, LAST, False
    for b in non_empty(batches):
        starts, ends, final = [], [], []
        for c, m in zip(b.column("conv").to_pylist(), b.column("matrix").to_pylist(), strict=True):
            final.append(not begun or c != conv)
            if final[-1]:
                conv, w, begun = c, LAST, True
            ends.append(np.array(w, "<i8").tobytes())
            w = _apply(np.frombuffer(m, "<i8").reshape(4, 4).tolist(), w)
            starts.append(w[START])
        yield pa.RecordBatch.from_arrays(
            [*(b.column(n) for n in ("conv", "piece", "symbols", "illegal", "head", "tail")), pa.array(ends, pa.binary()),
             pa.array(starts, pa.int64()), pa.array(final, pa.bool_())],
            names=["conv", "piece", "symbols", "illegal", "head", "tail", "ends", "cost", "final"])


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece on its own: its audit and its last state from each state that it may start in."""
    for b in small(batches, 64):
        audits, states = [], []
        for symbols, w, final in zip(b.column("symbols").to_pylist(), b.column("ends").to_pylist(),
                                     b.column("final").to_pylist(), strict=True):
            got = [unroll(collapse(symbols), np.frombuffer(w, "<i8").tolist(), p, final) for p in range(4)]
            audits.append([a for a, _ in got])
            states.append([s for _, s in got])
        yield pa.RecordBatch.from_arrays(
            [*(b.column(n) for n in ("conv", "piece", "illegal", "head", "tail", "cost")),
             pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))],
            names=["conv", "piece", "illegal", "head", "tail", "cost", "audits", "states"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation from first to last -> audit, start state, cost (first piece only), illegal neighbours."""
    conv, state, tail, begun = None, START, None, False
    for b in non_empty(batches):
        out = {k: [] for k in ("state", "audit", "cost", "illegal")}
        for r in b.to_pylist():
            new = not begun or r["conv"] != conv
            if new:
                conv, state, begun = r["conv"], START, True
            out["illegal"].append(r["illegal"] + (not new and tail + r["head"] not in ("su", "ua", "au")))
            out["state"].append(state)
            out["audit"].append(r["audits"][state])
            out["cost"].append(r["cost"] if new else 0)
            state, tail = r["states"][state], r["tail"]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("piece"), pa.array(out["state"], pa.int32()), pa.array(out["audit"], pa.string()),
             pa.array(out["cost"], pa.int64()), pa.array(out["illegal"], pa.int64())],
            names=["conv", "piece", "state", "audit", "cost", "illegal"])


class _Writer:
    """Digest and audit of one conversation whose pieces and rows arrive in order."""

    def __init__(self, conv):
        self.conv, self.sha, self.audits, self.empty = conv, hashlib.sha256(), [], True
        self.left, self.state = iter(()), START

    def piece(self, text: str, state: int):
        self.close()
        self.audits.append(text)
        self.left, self.state = iter(text), state

    def row(self, role: str, text: str):
        for edit in self.left:
            if edit == "I":
                self._added()
                continue
            if edit == "K":
                self.state = AFTER[self.state, role[:1]]
                self._line(role, text)
            elif edit == "R":
                self.state = ADDED[self.state]
                self._line(ROLE[self.state], text)
            return

    def close(self):
        """Rows inserted after the last row of a piece."""
        for _ in self.left:
            self._added()

    def _added(self):
        self.state = ADDED[self.state]
        self._line(ROLE[self.state], "")

    def _line(self, role: str, text: str):
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: its pieces, each before its rows, in order -> conv, audit, repaired_sha256."""
    now, done = None, []

    def flush():
        out = pa.RecordBatch.from_arrays([
            pa.array([w.conv for w in done], pa.int64()), pa.array(["".join(w.audits) for w in done], pa.string()),
            pa.array([w.sha.hexdigest() for w in done], pa.string())], names=["conv", "audit", "repaired_sha256"])
        done.clear()
        return out

    for b in small(batches, 1024):
        for conv, rank, role, text, state in zip(*(b.column(n).to_pylist() for n in (
                "conv", "rank", "role", "text", "state")), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    now.close()
                    done.append(now)
                now = _Writer(conv)
            if rank == 0:
                now.piece(text, state)
            else:
                now.row(role, text)
        if len(done) >= 256:
            yield flush()
    if now is not None:
        now.close()
        done.append(now)
    if done:
        yield flush()


DAMAGE = 20  # of so many remainders, 0 to 4 damage a row


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text after the fixed damage; null roles and texts are one space.

    By crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties its
    text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats the row, 4 makes it a user's.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % DAMAGE
    text = F.coalesce("text", space)
    return (rows.withColumn("kind", kind).where("kind <> 0")
            .select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                    F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", ""))
                    .otherwise(text).alias("text"),
                    F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def repair(rows: DataFrame, piece: int | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text; no null role or text).

    conv, blank, duplicate, truncated (rows by their first fault), illegal (neighbours whose
    role initials are not su, ua or au), cost, audit (initials of the cheapest edits, ASCII-least)
    and repaired_sha256 (of the repaired ``role:text`` lines).

    Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their
    text.  Rows without conv are one conversation.  A role's initial is its first character; an
    empty role has none and can only be reroled or deleted.  Repeated rows are duplicates.
    Columns besides the four are ignored; no rows give no rows.
    """
    piece = piece or PIECE
    whole = rows.select("conv", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
                        F.col("turn").isNotNull().alias("timed"))
    ranked = keyed_scan(whole, "conv", ["timed", "turn", "role", "digest"], "rank")
    ranked = materialize(ranked.withColumn("piece", F.floor((F.col("rank") - 1) / piece)).drop("timed"), "turns")

    bare = F.rtrim("text", F.lit(SPACE))  # what is left ends in the last character that counts
    marked = ranked.select("conv", "piece", "rank", "role", "digest", F.substring("role", 1, 1).alias("initial"),
                           (F.length(bare) == 0).alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("whole"))
    same = ["conv", "role", "digest"]
    first = marked.groupBy(*same).agg(F.min("rank").alias("first")).select(
        F.struct(*same).alias("same"), "first")
    fault = (F.when(F.col("blank"), "blank").when(F.col("rank") > F.col("first"), "duplicate")
             .when(~F.col("whole"), "truncated"))
    marked = (marked.join(first, F.struct(*same) == F.col("same"))
              .select("conv", "piece", "rank", "initial", fault.alias("fault")))
    pieces = materialize(_by(marked, ["conv", "piece"], "conv", "piece", "rank").mapInArrow(
        _pieces, "conv bigint, piece bigint, symbols string, matrix binary, blank bigint, duplicate bigint, "
        "truncated bigint, illegal bigint, head string, tail string"), "pieces")
    folded = _by(pieces, ["conv"], "conv", F.desc("piece")).mapInArrow(
        _backward, "conv bigint, piece bigint, symbols string, illegal bigint, head string, tail string, "
        "ends binary, cost bigint, final boolean")
    options = folded.repartition(partitions(rows.sparkSession), "conv", "piece").mapInArrow(
        _unrolled, "conv bigint, piece bigint, illegal bigint, head string, tail string, cost bigint, "
        "audits array<string>, states array<int>")
    chosen = materialize(_by(options, ["conv"], "conv", "piece").mapInArrow(
        _forward, "conv bigint, piece bigint, state int, audit string, cost bigint, illegal bigint"), "audits")

    lines = ranked.select("conv", "piece", "rank", "role", "text", F.lit(0).alias("state")).unionByName(
        chosen.select("conv", "piece", F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("role"),
                      F.col("audit").alias("text"), "state"))
    written = _by(lines, ["conv"], "conv", "piece", "rank").mapInArrow(
        _digests, "conv bigint, audit string, repaired_sha256 string")
    counts = pieces.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    costs = chosen.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    for part in (counts, costs):
        part = part.withColumnRenamed("conv", "of")
        written = written.join(part, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return written


def _by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    # the rows are small for the work on them: a count of partitions keeps them from being merged by size
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*order)


def op12(spark, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations`` after the fixed damage, repaired.

    gaps: missing turn numbers between the least and the largest turn left (0 if all are null).  A
    conversation of which no row is left has zeros, an empty audit and the empty text's hash.
    """
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(source)
    fixed = repair(rows)
    gaps = rows.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).withColumnRenamed("conv", "of")
    every = source.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = (every.join(fixed, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
           .join(gaps, F.col("conv_id").eqNullSafe(F.col("of")), "left"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
