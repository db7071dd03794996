"""Repair of conversations by cheapest edits.

Rows get a fault and a symbol: the initial of their role with what keeping them costs, or "must go". The least cost of
finishing from each of four states (nothing yet, after a system row, a user row, an assistant row) is a vector of four
numbers, and up to a common summand only a few such vectors occur. Four-Russians tables hold, for every vector and every
block of ``BLOCK`` symbols, the vector before the block and the summand, so rows are processed from the end a block at
a time by lookup. The cheapest edits themselves are found from the front: each block is expanded backward from the vector
behind it, and the first edit by ASCII that keeps the least cost is taken.

A conversation may be of any length. Its rows lie in pieces; a piece is a map from the vector behind it to the one
before it and from the state before it to the one behind, pieces are chained by these maps, and then traced by themselves.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalspark.staging import stage

# fixed values: costs of the edits, roles, and the blanks and sentence ends of the contract
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, END = r"[\x20\x09-\x0D]", r"[.!?]"
ROLES = {"u": "user", "a": "assistant"}
#: states: nothing yet, after s, after u, after a; by initial the state after it
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FAR = 1 << 20
BLOCK = 4
#: symbols: 0 must go; 1 to 4 initial s, u, a or another; 5 to 8 the same, truncated
SYMBOLS = 9
INITIALS = ("s", "u", "a", "")


def before_row(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Least cost of finishing from each state in front of a row, by that behind it."""
    cost = [DELETE + c for c in after]
    if symbol:
        extra = TRUNCATED * (symbol > 4)
        initial = INITIALS[(symbol - 1) % 4]
        for state in range(4):
            for role in ROLES:
                if NEXT[role][state] is not None:
                    cost[state] = min(cost[state], REROLE + extra + after[NEXT[role][state]])
            if initial and NEXT[initial][state] is not None:
                cost[state] = min(cost[state], extra + after[NEXT[initial][state]])
    return inserted(cost)


def inserted(cost: list[int]) -> tuple[int, ...]:
    """The same with rows inserted in front; three in a row are never needed."""
    for _ in range(2):
        cost = [min([cost[s], *(INSERT + cost[NEXT[r][s]] for r in ROLES if NEXT[r][s] is not None)]) for s in range(4)]
    return tuple(cost)


#: behind the last row: nothing or an assistant row may be the end
FINISH = inserted([0, FAR, FAR, 0])


@dataclass(frozen=True)
class Tables:
    """Vectors less their first number; by the vector behind and a symbol (``one``) or block of them (``block``) the
    vector before, the summand and, by the state before, the state behind."""

    vectors: tuple[tuple[int, ...], ...]
    one: np.ndarray
    one_cost: np.ndarray
    one_state: np.ndarray
    block: np.ndarray
    block_cost: np.ndarray
    block_state: np.ndarray


@functools.cache
def tables() -> Tables:
    norm = lambda v: tuple(x - v[0] for x in v)
    number, todo, rows = {norm(FINISH): 0}, [norm(FINISH)], []
    while todo:
        vector, row = todo.pop(0), []
        for symbol in range(SYMBOLS):
            cost = before_row(vector, symbol)
            if norm(cost) not in number:
                number[norm(cost)] = len(number)
                todo.append(norm(cost))
            row.append((number[norm(cost)], cost[0]))
        rows.append(row)
    steps = np.array(rows, np.int64)
    one, cost, vectors = steps[..., 0], steps[..., 1], tuple(number)
    state = np.array([[[row_edits(v, s, x)[1] for x in range(4)] for s in range(SYMBOLS)] for v in vectors])
    # a block's number has the symbol of its first row as the highest digit; its rows are taken from the last
    n = len(vectors)
    block, block_cost, block_state = np.arange(n)[:, None], np.zeros((n, 1), np.int64), np.tile(np.arange(4), (n, 1, 1))
    for _ in range(BLOCK):
        behind = np.broadcast_to(block_state[:, None], (n, SYMBOLS, *block_state.shape[1:]))
        block_state = np.take_along_axis(behind, state[block].transpose(0, 2, 1, 3), axis=3).reshape(n, -1, 4)
        block_cost = (block_cost[:, None, :] + cost[block].transpose(0, 2, 1)).reshape(n, -1)
        block = one[block].transpose(0, 2, 1).reshape(n, -1)
    return Tables(vectors, one, cost, state, block, block_cost, block_state)


_PLACE = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first rows that fill no block, and the numbers of the blocks behind them."""
    rest = len(symbols) % BLOCK
    return symbols[:rest], symbols[rest:].reshape(-1, BLOCK).astype(np.int64) @ _PLACE


def boundaries(symbols: np.ndarray, vector: int) -> tuple[list[int], int]:
    """Vectors at the block boundaries from the front (the last is ``vector``), the first before all rows, and the summand."""
    t = tables()
    rest, numbers = blocks(symbols)
    at, total = [vector], 0
    for b in numbers[::-1].tolist():
        total += int(t.block_cost[at[-1], b])
        at.append(int(t.block[at[-1], b]))
    for s in rest[::-1].tolist():
        total += int(t.one_cost[at[-1], s])
        at.append(int(t.one[at[-1], s]))
    return at[::-1], total


def options(symbol: int | None, state: int, after: tuple[int, ...], here: int):
    """Edits at a row (None: behind the last) by ASCII as (edit, next state, cost then left) that keep the cost ``here``."""
    extra = TRUNCATED * (symbol is not None and symbol > 4)
    if symbol is not None and DELETE + after[state] == here:
        yield "D", state
    for role in ROLES:
        to = NEXT[role][state]
        if to is not None and INSERT + (before_row(after, symbol) if symbol is not None else after)[to] == here:
            yield "I", to
    if symbol:
        initial = INITIALS[(symbol - 1) % 4]
        to = NEXT[initial][state] if initial else None
        if to is not None and extra + after[to] == here:
            yield "K", to
        for role in ROLES:
            to = NEXT[role][state]
            if to is not None and REROLE + extra + after[to] == here:
                yield "R", to


@functools.cache
def row_edits(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """Edits at a row in front of which ``state`` holds and behind which the vector is ``after``; the state behind it."""
    out = ""
    before = before_row(after, symbol)
    while True:
        edit, state = next(options(symbol, state, after, before[state]))
        out += edit
        if edit != "I":
            return out, state


@functools.cache
def closing(state: int) -> str:
    """Rows inserted behind the last one."""
    out = ""
    while FINISH[state]:
        edit, state = next(options(None, state, FINISH, FINISH[state]))
        out += edit
    return out


def trace(symbols: np.ndarray, vector: int, state: int) -> tuple[list[str], int]:
    """Edits of every row, and the state behind the last."""
    t, (at, _) = tables(), boundaries(symbols, vector)
    rest = len(symbols) % BLOCK
    cuts = [*range(rest + 1), *range(rest + BLOCK, len(symbols) + 1, BLOCK)]
    out = []
    for lo, hi, behind in zip(cuts, cuts[1:], at[1:]):
        inner = [behind]  # the block expanded backward
        for s in symbols[lo + 1:hi][::-1]:
            inner.append(int(t.one[inner[-1], s]))
        for s, v in zip(symbols[lo:hi], inner[::-1]):
            edits, state = row_edits(t.vectors[v], int(s), state)
            out.append(edits)
    return out, state


def piece_map(symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """By the vector behind a piece: the vector before it, the summand, and by state before it the state behind it."""
    t = tables()
    rest, numbers = blocks(symbols)
    at, total, states = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64), np.tile(np.arange(4), (len(t.vectors), 1))
    for keys, to, cost, state in ((numbers, t.block, t.block_cost, t.block_state), (rest, t.one, t.one_cost, t.one_state)):
        for k in keys[::-1]:
            states = np.take_along_axis(states, state[at, k], axis=1)
            total, at = total + cost[at, k], to[at, k]
    return at.tolist(), total.tolist(), states.ravel().tolist()


# --- on Spark


def damaged(rows: DataFrame) -> DataFrame:
    """Test damage of (conv, turn, role, text) by crc32 of ``conv:turn``; nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.where(kind != 0).select(
        "conv", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, END, "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def cells(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number, their fault and symbol.

    A row equal to one of an earlier turn is a duplicate, and so are all equal rows of a turn but the first.
    """
    each = stage(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
                 .withColumn("same", F.sha2(F.concat_ws("\u0000", F.length("role").cast("string"), "role", "text").cast("binary"), 256)))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # only rows that stand in several turns have a first turn to look up
    firsts = each.groupBy(F.col("conv").alias("__conv"), F.col("same").alias("__same")).agg(F.min(order).alias("first"), F.count("*").alias("turns")) \
        .where("turns > 1")
    marked = each.join(firsts, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("same") == F.col("__same")), "left")
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){BLANK}*$", 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    later = F.coalesce(order > F.col("first"), F.lit(False))
    fault = F.when(blank, "blank").when(later, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(place + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    return marked.withColumn("fault", fault).withColumn("symbol", symbol.cast("int")) \
        .select("conv", "turn", "role", "text", "copies", "fault", "symbol")


def in_pieces(most_rows: int, most_bytes: int):
    """Numbers the sorted rows of a task in pieces of one conversation."""
    def run(batches):
        task = TaskContext.get().partitionId() << 32
        last, count, at, size = object(), -1, 0, 0
        for batch in batches:
            piece, place = [], []
            for conv, text in zip(batch.column("row").field("conv").to_pylist(), batch.column("row").field("text")):
                n = len(text.as_buffer()) if text.is_valid else 0
                if count < 0 or conv != last or at + 1 >= most_rows or size + n > most_bytes:
                    last, count, at, size = conv, count + 1, -1, 0
                at, size = at + 1, size + n
                piece.append(task + count), place.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(piece, pa.int64()), pa.array(place, pa.int32())], ["row", "piece", "place"])
    return run


def mapped(batches):
    """Maps of the pieces, with their first and last initials and the illegal neighbours inside."""
    for pdf in batches:
        out = []
        for key, piece, seq in zip(pdf["key"], pdf["piece"], pdf["seq"]):
            symbols = np.fromiter((x["symbol"] for x in seq), np.int64, len(seq))
            roles = [x["initial"] for x in seq]
            apart = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])) + sum(x["copies"] - 1 for x in seq)
            before, total, states = piece_map(symbols)
            out.append((key, piece, before, total, states, roles[0], roles[-1], apart))
        yield pd.DataFrame(out, columns=["key", "piece", "before", "total", "states", "first", "last", "apart"])


def chained(batches):
    """Vector behind and state before every piece, cost and illegal neighbours of its conversation.

    Pieces come sorted by conversation and place; those of one conversation are held together, some numbers each.
    """
    def told(pieces):
        n, at, state = len(pieces), 0, 0
        vectors, entered, cost = [0] * n, [], FINISH[0]
        for i in range(n - 1, -1, -1):
            vectors[i] = at
            cost, at = cost + int(pieces[i].total[at]), int(pieces[i].before[at])
        for p, v in zip(pieces, vectors):
            entered.append(state)
            state = int(p.states[4 * v + state])
        illegal = sum(p.apart for p in pieces) + sum(p.last + q.first not in ("su", "ua", "au") for p, q in zip(pieces, pieces[1:]))
        return [(p.piece, v, s, i == n - 1, cost, illegal) for i, (p, v, s) in enumerate(zip(pieces, vectors, entered))]

    pieces = []
    for pdf in batches:
        out = []
        for p in pdf.itertuples(index=False):
            if pieces and p.key != pieces[0].key:
                out += told(pieces)
                pieces = []
            pieces.append(p)
        yield pd.DataFrame(out, columns=_CHAIN)
    yield pd.DataFrame(told(pieces) if pieces else [], columns=_CHAIN)


_CHAIN = ["piece", "vector", "state", "end", "least", "illegal"]


def rewritten(batches):
    """Edits of the pieces' rows: (row, edits, roles) where roles are those of the rows that come out of it."""
    for pdf in batches:
        out = []
        for piece, seq, vector, state, end in zip(pdf["piece"], pdf["seq"], pdf["vector"], pdf["state"], pdf["end"]):
            edits, behind = trace(np.fromiter((x["symbol"] for x in seq), np.int64, len(seq)), int(vector), int(state))
            for k, (x, e) in enumerate(zip(seq, edits)):
                at, roles = int(state), []
                for edit in e:
                    if edit == "K":
                        roles.append(None)
                        at = NEXT[x["initial"]][at]
                    elif edit != "D":
                        name = "a" if at == 2 else "u"
                        roles.append(ROLES[name])
                        at = NEXT[name][at]
                state = at
                more = closing(state) if end and k == len(seq) - 1 else ""
                for _ in more:
                    name = "a" if at == 2 else "u"
                    roles.append(ROLES[name])
                    at = NEXT[name][at]
                out.append((piece, k, e, more, roles))
        yield pd.DataFrame(out, columns=["piece", "place", "edits", "more", "roles"])


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


@dataclass
class Repair:
    """Edits of every row (``rows``: conv, piece, place, turn, role, text, copies, fault, edits, more, roles) and sums by conversation."""

    rows: DataFrame
    sums: DataFrame
    ids: DataFrame


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           damage: bool = False, most_rows: int = 4096, most_bytes: int = 8 << 20) -> Repair:
    """Cheapest edits that make every conversation's role initials ``(s?(ua)+)?``.

    Rows go by turn (null first), then role and text; equal rows of a turn are adjacent. Blank rows and duplicates go (4
    each), other rows are kept (0), get the role user or assistant (3) or go (4), empty rows of these roles may be
    inserted anywhere (3), and a truncated row that stays costs 3 more. Among the cheapest the edits least by ASCII count.
    Null roles and texts count as one space, rows without a conversation are one conversation, an empty table gives
    empty frames, other columns are ignored. Pieces hold at most ``most_rows`` rows and about ``most_bytes`` of text unless a
    single text is longer.
    """
    named = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    space = F.lit(" ")
    rows = damaged(named) if damage else named.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                                      F.lit(1).cast("bigint").alias("copies"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    # ranges are found from a sample of the keys, so these hold only the beginning of a text
    sort = cells(rows).repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text").select(F.struct("*").alias("row"))
    schema = T.StructType([T.StructField("row", _kind(sort, "row")), T.StructField("piece", T.LongType()), T.StructField("place", T.IntegerType())])
    ordered = stage(sort.mapInArrow(in_pieces(most_rows, most_bytes), schema).select("row.*", "piece", "place"))
    step = F.struct("place", "symbol", F.substring("role", 1, 1).alias("initial"), "copies")
    pieces = stage(ordered.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(step)).alias("seq")))
    # pandas would read a number of a conversation beside a missing one as a float
    maps = pieces.select(F.to_json(F.struct("conv")).alias("key"), "piece", "seq").mapInPandas(
        mapped, "key string, piece bigint, before array<int>, total array<bigint>, states array<int>, first string, last string, apart bigint")
    chain = stage(maps.repartition("key").sortWithinPartitions("key", "piece").mapInPandas(
        chained, "piece bigint, vector int, state int, end boolean, least bigint, illegal bigint"))
    edits = pieces.select("piece", "seq").join(chain.select("piece", "vector", "state", "end"), "piece").select("piece", "seq", "vector", "state", "end") \
        .mapInPandas(rewritten, "piece bigint, place int, edits string, more string, roles array<string>")
    out = ordered.join(edits, ["piece", "place"]).select("conv", "piece", "place", "turn", "role", "text", "copies", "fault", "edits", "more", "roles")
    sums = ordered.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).otherwise(F.col("copies") - F.when(F.col("fault") == "duplicate", 0).otherwise(1))).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"),
        # a cell's further copies go as well
        (F.sum("copies") - F.count("*")).alias("further"))
    told = chain.where("end").join(pieces.select("piece", F.col("conv").alias("__conv")), "piece").select("__conv", "least", "illegal")
    sums = sums.join(told, F.col("conv").eqNullSafe(F.col("__conv"))).select(
        "conv", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        (F.col("least") + DELETE * F.col("further")).alias("cost"))
    return Repair(out, sums, named.select("conv").distinct())


def repaired_rows(fixed: Repair) -> DataFrame:
    """The repaired conversations: conv, piece, place, nth (these order the rows), role and text."""
    many = fixed.rows.select("conv", "piece", "place", "role", "text", "edits", F.posexplode("roles").alias("nth", "given"))
    own = (F.col("nth") == F.length("edits") - 1) & ~F.col("edits").endswith("D")
    return many.select("conv", "piece", "place", "nth", F.coalesce("given", "role").alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def digests(fixed_rows: DataFrame) -> DataFrame:
    """Audit and SHA-256 of every conversation.

    The hash of a conversation is by its definition taken from first to last; one task streams its rows and holds one batch.
    """
    kind = _kind(fixed_rows, "conv")
    rows = fixed_rows.repartition("conv").sortWithinPartitions("conv", "piece", "place") \
        .select(F.struct("conv").alias("key"), "role", "text", "copies", "edits", "more", "roles")

    def run(batches):
        now, open_ = None, False

        def told():
            return pa.RecordBatch.from_arrays([pa.array([now], batch_kind), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["key", "audit", "repaired_sha256"])
        for batch in batches:
            batch_kind = batch.column("key").type
            for key, *row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if not open_ or key != now:
                    if open_:
                        yield told()
                    now, open_, audit, sha, lead = key, True, [], hashlib.sha256(), b""
                role, text, copies, edits, more, roles = row
                audit.append(edits + "D" * (copies - 1) + more)
                for given, edit in zip(roles, (edits + more).replace("D", "")):
                    line = (given or role) + ":" + (text if edit != "I" else "")
                    sha.update(lead + line.encode())
                    lead = b"\n"
        if open_:
            yield told()

    out = rows.mapInArrow(run, T.StructType([T.StructField("key", T.StructType([T.StructField("conv", kind)])), T.StructField("audit", T.StringType()),
                                             T.StructField("repaired_sha256", T.StringType())]))
    return out.select("key.conv", "audit", "repaired_sha256")


def summary(fixed: Repair) -> DataFrame:
    """One row per original conversation: conv_id, gaps, faults, illegal, cost, audit and digest of the repaired rows.

    A conversation of which no row is left has zeros, an empty audit and the digest of nothing.
    """
    side = lambda df, name: df.withColumnRenamed("conv", name)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = side(fixed.ids, "conv_id").join(side(fixed.sums, "c1"), same("conv_id", "c1"), "left") \
        .join(side(digests(fixed.rows), "c2"), same("conv_id", "c2"), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
