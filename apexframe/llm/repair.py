"""Conversation repair: the lightest sequence of edits that gives a well-formed conversation, by Knuth's agenda.

An item (i, q) says that the first i rows are edited so that what is kept leaves the roles in state q; keep, rerole, delete and insert are
deductions that lead to further items. An item's weight is (cost, audit), the audit being the initials of its edits. Each deduction adds to the cost and
appends to the audit, so no conclusion is lighter than what it comes from, and the agenda pops items in the order of their final weights.

Conversations of at most BLOCK_ROWS rows are repaired where their rows meet. A longer one is never gathered: its rows get places by ranges, each
block of rows gets the lightest weights from any state to any other (one agenda for each first state), and blocks are joined level by level, by the same
agenda over blocks instead of rows. Two edit sequences of one block with equal costs differ in some letter before either ends (an excess of
inserts would cost more), so weights stay in order whatever is appended. Only the SHA-256 of the repaired text, sequential by its nature, streams a long
conversation through one task, block after block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import lookup, positions, stored, text_key

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a block, and blocks that are joined at once.
BLOCK_ROWS = 256
FANIN = 64
#: States of the roles so far: nothing, system, user, assistant; well-formed conversations end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: State reached by a role's initial, and the role that an inserted or reroled row takes.
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

Weight = tuple[int, str]
Deduction = tuple[int, int, int, str]  # steps ahead, state, cost, letters


def agenda(length: int, start: int, deductions: Callable[[int, int], Iterable[Deduction]], ends: tuple[int, ...] = (), most: int = 4) -> dict[int, Weight]:
    """Lightest weights of the items (length, state) from (0, ``start``): of ``most`` states, or until one of ``ends``, the goal, is final."""
    heap, final, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == length:
            found[q] = (cost, audit)
            if q in ends or len(found) == most:
                break
        for ahead, to, more, letters in deductions(i, q):
            if (i + ahead, to) not in final:
                heapq.heappush(heap, (cost + more, audit + letters, i + ahead, to))
    return found


def row_deductions(codes: str) -> Callable[[int, int], Iterator[Deduction]]:
    """Edits of rows. A row's code is its role's initial (upper case: truncated), or ``-`` if it must be deleted."""

    def deduce(i: int, q: int) -> Iterator[Deduction]:
        yield 0, _TURN[q], INSERT, "I"
        if i == len(codes):
            return
        yield 1, q, DELETE, "D"
        code = codes[i]
        if code != "-":
            extra = TRUNCATED if code.isupper() else 0
            if (to := _NEXT.get((q, code.lower()))) is not None:
                yield 1, to, KEEP + extra, "K"
            yield 1, _TURN[q], REROLE + extra, "R"

    return deduce


def block_deductions(blocks: list[dict[tuple[int, int], Weight]]) -> Callable[[int, int], Iterator[Deduction]]:
    """Blocks as steps: from a state to any that the block leads to."""

    def deduce(i: int, q: int) -> Iterator[Deduction]:
        for to in range(4):
            if i < len(blocks) and (weight := blocks[i].get((q, to))):
                yield 1, to, *weight

    return deduce


def table_of(length: int, deductions: Callable[[int, int], Iterable[Deduction]]) -> dict[tuple[int, int], Weight]:
    """Lightest weights from each state to each other."""
    return {(p, q): w for p in range(4) for q, w in agenda(length, p, deductions).items()}


def pieces_of(audit: str, rows: int, size: int) -> Iterator[tuple[int, str, int]]:
    """(block, its letters, phase) of an audit of ``rows`` rows: inserts go with the row after them. Phase: rows kept before, less one if a system row leads."""
    kept, system, at, done, block = 0, (len(audit) - audit.count("D")) % 2, 0, 0, 0
    while done < rows:
        end, want = at, min(size, rows - done)
        while want:
            want -= audit[end] != "I"
            end += 1
        done += min(size, rows - done)
        if done == rows:
            end = len(audit)
        piece = audit[at:end]
        yield block, piece, kept - system
        kept, at, block = kept + len(piece) - piece.count("D"), end, block + 1


def repaired_lines(rows: Iterable[tuple[str, str]], letters: str, phase: int) -> Iterator[str]:
    """``role:text`` of what an audit keeps and inserts."""
    rows = iter(rows)
    for letter in letters:
        turn = "assistant" if phase % 2 else "user"
        if letter == "I":
            yield f"{turn}:"
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            yield f"{turn if letter == 'R' else role}:{text}"
        phase += 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _illegal(before: str, initial: str) -> bool:
    return before + initial not in ("su", "ua", "au")


def code_of(role: str, must_go: bool, truncated: bool) -> str:
    """See :func:`row_deductions`; a role that starts with none of s, u and a is ``x``, which nothing keeps."""
    if must_go:
        return "-"
    code = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return code.upper() if truncated else code


_SHORT = pa.schema([("key", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repair_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of rows (key, role, text, blank, open), in order."""

    def results() -> Iterator[tuple]:
        for key, group in groupby(_rows(batches), itemgetter(0)):
            rows, seen, codes, faults, illegal = [], set(), [], [0, 0, 0], 0
            for _, role, text, blank, unended in group:
                duplicate = (role, text) in seen
                seen.add((role, text))
                fault = 0 if blank else 1 if duplicate else 2 if unended else None
                if fault is not None:
                    faults[fault] += 1
                illegal += bool(rows) and _illegal(rows[-1][0][:1], role[:1])
                codes.append(code_of(role, fault in (0, 1), fault == 2))
                rows.append((role, text))
            ((cost, audit),) = [w for q, w in agenda(len(codes), START, row_deductions("".join(codes)), ENDS).items() if q in ENDS]
            lines = "\n".join(repaired_lines(rows, audit, -((len(audit) - audit.count("D")) % 2)))
            yield key, *faults, illegal, cost, audit, hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()

    yield from _batches(results(), _SHORT)


_TABLE = pa.schema([("key", pa.string()), ("block", pa.int64()), ("table", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
_TABLE_DDL = "key string, block long, table array<struct<p:int,q:int,cost:long,audit:string>>"


def _listed(table: dict[tuple[int, int], Weight]) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in table.items()]


def _block_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(((key, block, _listed(table_of(len(codes), row_deductions(codes)))) for key, block, codes in _rows(batches)), _TABLE, 16)


def _joined_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def joined() -> Iterator[tuple]:
        for key, block, tables in _rows(batches):
            blocks = [{(w["p"], w["q"]): (w["cost"], w["audit"]) for w in t["table"]} for t in tables]
            yield key, block, _listed(table_of(len(blocks), block_deductions(blocks)))

    yield from _batches(joined(), _TABLE, 1)


_PIECE = pa.schema([("key", pa.string()), ("block", pa.int64()), ("letters", pa.string()), ("phase", pa.int64())])


def _pieces(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((key, *piece) for key, rows, audit in _rows(batches) for piece in pieces_of(audit, rows, size)), _PIECE)

    return cut


_TEXT = pa.schema([("key", pa.string()), ("illegal", pa.int64()), ("repaired_sha256", pa.string())])


def _stream_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, pos, role, text) in order; before each block's rows comes its piece of the audit (pos -1, phase, letters)."""

    def results() -> Iterator[tuple]:
        for key, whole in groupby(_rows(batches), itemgetter(0)):
            digest, first, before, illegal = hashlib.sha256(), True, None, 0
            for _, rows in groupby(whole, itemgetter(1)):
                _, _, _, phase, letters = next(rows)
                block = [(role, text) for _, _, _, role, text in rows]
                for role, _ in block:
                    illegal += before is not None and _illegal(before, role[:1])
                    before = role[:1]
                for line in repaired_lines(block, letters, int(phase)):
                    digest.update(("" if first else "\n").encode() + line.encode("utf-8", "surrogatepass"))
                    first = False
            yield key, illegal, digest.hexdigest()

    yield from _batches(results(), _TEXT)


def damaged(rows: DataFrame) -> DataFrame:
    """Planted damage on rows (key, conv, turn, role, text): a hash of ``conv:turn`` says what is dropped, emptied, cut, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(space("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _faults(rows: DataFrame) -> DataFrame:
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.withColumn("blank", blank).withColumn("unended", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))


def _repair_long(rows: DataFrame) -> DataFrame:
    """As :func:`_repair_short`, for conversations of any number of rows."""
    placed = positions(rows, ["key"], ["turn", "role", "text"]).withColumn("block", F.expr(f"pos DIV {BLOCK_ROWS}"))
    said = text_key(F.concat(F.length("key").cast("string"), F.lit(":"), "key", F.length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = stored(placed.withColumn("said", said), "long-conversations")
    first = placed.groupBy("said").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    known = lookup(placed.select("key", "n", "pos", "block", "role", "blank", "unended", "said"), stored(first, "said-again"), "said", "times", ["pos"])
    again = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    known = known.withColumn("duplicate", again & ~F.col("blank")).withColumn("truncated", F.col("unended") & ~again & ~F.col("blank"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    code = F.when(F.col("blank") | F.col("duplicate"), "-").when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    known = stored(known.select("key", "n", "pos", "block", "blank", "duplicate", "truncated", code.alias("code")), "long-codes")
    counts = known.groupBy("key", "n").agg(*(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")))

    codes = known.groupBy("key", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x.code), "").alias("codes"))
    tables = stored(codes.mapInArrow(_block_tables, _TABLE_DDL), "block-tables")
    blocks = -(-(counts.agg(F.max("n")).first()[0] or 0) // BLOCK_ROWS)
    while blocks > 1:
        wide = tables.groupBy("key", F.expr(f"block DIV {FANIN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "table"))).alias("tables"))  # FANIN at most
        tables = stored(wide.select("key", F.col("up").alias("block"), "tables").mapInArrow(_joined_tables, _TABLE_DDL), "block-tables")
        blocks = -(-blocks // FANIN)
    goal = F.array_min(F.transform(F.filter("table", lambda w: (w.p == START) & w.q.isin(*ENDS)), lambda w: F.struct(w.cost, w.audit)))
    audits = tables.select("key", goal.alias("goal")).select("key", F.col("goal.cost").alias("cost"), F.col("goal.audit").alias("audit"))
    audits = stored(audits.join(counts, "key"), "audits")

    pieces = audits.select("key", "n", "audit").mapInArrow(_pieces(BLOCK_ROWS), "key string, block long, letters string, phase long")
    stream = placed.select("key", "block", "pos", "role", "text").unionByName(pieces.select("key", "block", F.lit(-1).cast("long").alias("pos"), F.col("phase").cast("string").alias("role"), F.col("letters").alias("text")))
    texts = stream.repartition("key").sortWithinPartitions("key", "block", "pos").mapInArrow(_stream_text, "key string, illegal long, repaired_sha256 string")
    return audits.join(texts, "key").select(*_SHORT.names)


def repair_conversations(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for every conversation there is before ``damage``.

    Edge cases: null roles and texts are one space; rows of a conversation are in order of turn (nulls first), then role and text; a null conversation is one of
    its own; a role that starts with none of s, u and a (an empty one too) can't be kept as it is; a conversation without rows after the damage has
    zeros, an empty audit and the digest of no bytes; an empty table gives an empty result; other columns are ignored.
    """
    name = lambda c: F.col(f"`{c}`")
    key = F.coalesce(F.concat(F.lit("="), name(conv_col).cast("string")), F.lit(""))
    given = conversations.select(key.alias("key"), name(conv_col).alias("conv"), name(turn_col).cast("long").alias("turn"), name(role_col).alias("role"), name(text_col).alias("text"))
    rows = _faults(damage(given)).select("key", "turn", "role", "text", "blank", "unended")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps")), "conversation-sizes")
    long = stored(sizes.where(F.col("rows") > BLOCK_ROWS).select("key", "rows", F.lit(True).alias("long")), "long-ones")
    split = lookup(rows, long, "key", "rows", ["turn", "text"])
    short = split.where("long is null").select("key", "turn", "role", "text", "blank", "unended").repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    done = short.select("key", "role", "text", "blank", "unended").mapInArrow(_repair_short, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    if long.take(1):
        done = done.unionByName(_repair_long(split.where("long").drop("long")))
    every = given.groupBy("key").agg(F.first("conv").alias("conv"))
    joined = every.join(sizes, "key", "left").join(done, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("conv").alias(conv_col), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
