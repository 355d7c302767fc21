"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A row's first fault counts: blank (nothing but spaces), duplicate (a row of
the same role and text stands before it), truncated (its last character that
is no space doesn't end a sentence).  Rows are kept (cost 0), given the role user or
assistant (1), deleted (2; blank and duplicate ones must be), or an empty user
or assistant turn is put in anywhere (5); a truncated row that stays adds 5.
What is left is nothing, or turns of user and assistant by turns behind one
optional system turn, judged by the roles' first letters.  The audit names
the edits of least cost by their first letters, in order (K, R, D, I), and of
all such the one that is least in ASCII.

The search is a depth-first branch and bound over (row, last role) with an
explicit stack.  A suffix bound, computed from the last row back, says what
the rest costs at least from each such node; branches are taken by that bound,
then by letter, and dropped when it exceeds the incumbent's cost or ties with
an audit that isn't less.  The bound is met, so equal-cost prefixes reach a
node in ASCII order, and a node's dominance table drops any later one that
costs no less.  Time and memory are linear in the rows of a conversation.

Only a letter a row goes through the search: texts are moved once, sorted by
conversation, and edited as they stream by, so a task holds no conversation.

Defined results: rows are ordered by turn (null first), then by a digest of
role and text; whole repeats count as duplicates.  A null role or text is one
space.  Rows without conv_id are one conversation.  A role whose first letter
is not s, u or a can't be kept; an empty one neither.  No rows, no result.
Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reelweave.llm.folders import Folder

SPACE = r"\x20\x09-\x0D"
CHUNK = 256
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT, OTHER = range(5)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The role that may be put in behind a role, and that a row may be given there.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_BATCH = 1000


def _follows(state: int, role: int) -> bool:
    return role == _NEXT[state] or (state == START and role == SYSTEM)


# a row's letter: first letter of the role (s, u, a, x), as a capital where the fault forces deletion or the row is cut off
_NO_FAULT, _BLANK, _DUPLICATE, _TRUNCATED = "suax", "bcde", "fghi", "SUAX"


def _meaning(letter: str) -> tuple[int, str]:
    for fault, letters in (("", _NO_FAULT), ("blank", _BLANK), ("duplicate", _DUPLICATE), ("truncated", _TRUNCATED)):
        at = letters.find(letter)
        if at >= 0:
            return (SYSTEM, USER, ASSISTANT, OTHER)[at], fault
    raise ValueError(letter)


_MEANING = {x: _meaning(x) for x in _NO_FAULT + _BLANK + _DUPLICATE + _TRUNCATED}
_FAR = 1 << 60


def _moves(state: int, role: int, fault: str) -> list[tuple[str, int, int]]:
    """Edits of a row behind ``state``: letter, cost, new state."""
    out = [("D", DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = CUT_OFF if fault == "truncated" else 0
        if role != OTHER and _follows(state, role):
            out.append(("K", more, role))
        out.append(("R", RETYPE + more, _NEXT[state]))
    return out


def suffix_bounds(rows: str) -> list[list[int]]:
    """What the rows from i on cost at least behind each role."""
    bounds: list[list[int]] = [[]] * (len(rows) + 1)
    least = [0, _FAR, _FAR, 0]
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            role, fault = _MEANING[rows[i]]
            least = [min(cost + bounds[i + 1][after] for _, cost, after in _moves(state, role, fault)) for state in range(4)]
        u, a = min(least[USER], INSERT + least[ASSISTANT]), min(least[ASSISTANT], INSERT + least[USER])
        bounds[i] = [min(least[START], INSERT + u), min(least[SYSTEM], INSERT + u), u, a]
    return bounds


def search(rows: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    bounds, n = suffix_bounds(rows), len(rows)
    best_cost, best_audit = _FAR, b""
    path = bytearray()
    table: dict[tuple[int, int], int] = {(0, START): 0}  # the least cost that reached a node

    def branches(i: int, state: int, cost: int) -> list[tuple[int, str, int, int, int]]:
        out = [(cost + INSERT + bounds[i][_NEXT[state]], "I", i, _NEXT[state], cost + INSERT)]
        if i < n:
            role, fault = _MEANING[rows[i]]
            out += [(cost + c + bounds[i + 1][after], letter, i + 1, after, cost + c) for letter, c, after in _moves(state, role, fault)]
        return sorted(out, reverse=True)  # the last is taken first

    stack = [branches(0, START, 0)]
    if n == 0:
        return 0, ""
    while stack:
        if not stack[-1]:
            stack.pop()
            if path:
                path.pop()
            continue
        total, letter, i, state, cost = stack[-1].pop()
        if total > best_cost:
            stack[-1].clear()  # the others cost no less
            continue
        path.append(ord(letter))
        if total == best_cost and bytes(path) >= best_audit[:len(path)]:
            path.pop()
            continue
        if table.get((i, state), _FAR) <= cost:
            path.pop()
            continue
        table[i, state] = cost
        if i == n and state in (START, ASSISTANT) and cost <= best_cost:
            best_cost, best_audit = cost, bytes(path)
        stack.append(branches(i, state, cost))
    return best_cost, best_audit.decode()


def _row_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def _clean(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    out = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return out.withColumn("digest", _row_digest(F.col("role"), F.col("text")))


def _letters(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, again, letter: what the search needs of each row."""
    first = F.substring("role", 1, 1)
    at = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(4)
    fault = (F.when(~F.rlike("text", F.lit(f"[^{SPACE}]")), F.lit(_BLANK))
             .when(F.rlike("text", F.lit(f"[.!?][{SPACE}]*\\z")), F.lit(_NO_FAULT)).otherwise(F.lit(_TRUNCATED)))
    slim = rows.select("conv_id", "turn", "digest", at.alias("at"), fault.alias("fault"))
    seen = F.row_number().over(W.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    slim = slim.withColumn("again", seen)
    letters = F.when(F.col("again") & (F.col("fault") != _BLANK), F.lit(_DUPLICATE)).otherwise(F.col("fault"))
    return slim.select("conv_id", "turn", "digest", "again", F.substr(letters, F.col("at"), F.lit(1)).alias("letter"))


_AUDIT = pa.schema([("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, letters in zip(batch.column("conv_id").to_pylist(), batch.column("letters").to_pylist(), strict=True):
            cost, audit = search(letters)
            roles = [_MEANING[x][0] for x in letters]
            faults = [sum(letters.count(x) for x in some) for some in (_BLANK, _DUPLICATE, _TRUNCATED)]
            out.append((conv, *faults, sum(p not in _LEGAL for p in zip(roles, roles[1:], strict=False)), cost, audit))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _AUDIT, strict=True)] if out else [pa.array([], t.type) for t in _AUDIT], schema=_AUDIT)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; ``rows``: conv_id, turn, role, text."""
    letters = _letters(_clean(rows))
    # conversations meet as finished chunks of turns, a letter a row
    row = F.sort_array(F.collect_list(F.struct("turn", "digest", "again", "letter")))
    chunks = letters.groupBy("conv_id", F.expr(f"turn div {CHUNK}").alias("chunk")).agg(
        F.array_join(row["letter"], "").alias("letters"), F.size(F.collect_set("turn")).cast("bigint").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    wide = "decimal(38,0)"
    gaps = F.max("high").cast(wide) - F.min("low").cast(wide) + 1 - F.sum("turns")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps the small table spread for the search
    whole = chunks.repartition(parts, "conv_id").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("chunk", "letters")))["letters"], "").alias("letters"),
                                         F.coalesce(gaps.try_cast("bigint"), F.lit(0)).alias("gaps"))
    written = Folder(rows.sparkSession, "structure").write(whole, "letters")
    found = written.select("conv_id", "letters").mapInArrow(_audit, "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
    same = found["conv_id"].eqNullSafe(written["conv_id"])
    return written.join(found, same).select(written["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


_TURN = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited rows; a conversation's audit comes before its rows."""
    out: list[tuple] = []
    conv, audit, at, state, position = None, "", 0, START, 0

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal state, position
        state, position = _LETTER[role[0]], position + 1
        out.append((conv, position, edit, role, text))

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            emit("I", _NAMES[_NEXT[state]], "")
            at += 1

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _TURN, strict=True)], schema=_TURN)
        out.clear()
        return batch

    for batch in batches:
        for key, found, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if found is not None:
                insert()
                conv, audit, at, state, position = key, found, 0, START, 0
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit != "D":
                emit(edit, role if edit == "K" else _NAMES[_NEXT[state]], text)
            if len(out) >= _BATCH:
                yield flush()
    insert()
    if out:
        yield flush()


def repair(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, position (from 1), edit, role, text of the repaired turns; a conversation's stand together in order within a partition.

    ``audited``: what ``audits`` says of the same rows, written.
    """
    none = F.lit(None).cast("string")
    texts = _clean(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", none.alias("audit"), "role", "text")
    heads = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("digest"), "audit", none.alias("role"), none.alias("text"))
    sorted_ = heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "digest")
    return sorted_.select("conv_id", "audit", "role", "text").mapInArrow(_apply, "conv_id bigint, position bigint, edit string, role string, text string")


_SHA = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    state = None
    for batch in batches:
        out = []
        for conv, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
            if position == 1:
                if state is not None:
                    out.append((state[0], state[1].hexdigest()))
                state = conv, hashlib.sha256()
            state[1].update(("\n" if position > 1 else "").encode() + f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _SHA, strict=True)], schema=_SHA)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].hexdigest()])], schema=_SHA)


def digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """What ``audits`` says of each conv_id of ``ids``, and the digest of its repaired turns; zeros where it has no rows."""
    spark = rows.sparkSession
    audited = Folder(spark, "structure").write(audits(rows), "audits")
    hashed = repair(rows, audited).mapInArrow(_hash, "conv_id bigint, repaired_sha256 string")
    all_ids = ids.select(F.col("conv_id").alias("id")).distinct()
    out = all_ids.join(audited, F.col("id").eqNullSafe(audited["conv_id"]), "left").drop("conv_id")
    out = out.join(hashed, F.col("id").eqNullSafe(hashed["conv_id"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with every fault that is repaired here, chosen by the checksum of ``conv_id:turn``; nulls are one space.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    out = rows.select("conv_id", "turn", kind.alias("_kind"), role.alias("role"), text.alias("text")).filter("_kind <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                     F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "_kind")
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.withColumn("_n", twice).drop("_kind", "_n")
