"""Operator 12, conversation structure repair: cheapest edits by Dial's bucket-queue shortest paths.

A conversation's rows, in order of their turns, are a path through a small automaton that accepts the role
initials ``(s?(ua)+)?``. A node is (row, state); keeping, re-roling, deleting a row and inserting a turn are arcs
of small integer costs, so distances to the end are settled by a queue of buckets, one a distance. From the
first node the walk takes, of all tight arcs (cost plus distance beyond equals the distance), the one of the
ASCII-least letter: that is the audit.

Rows are dealt out by ranges of (conversation, turn), so a conversation may cross tasks however long it is.
One that lies whole in a task and within ``ROWS`` rows is repaired there at once. Others are cut into chunks of
bounded size, and a chunk is four states in, four states out:
  1. rows seen in an earlier chunk are found by the smallest place of their digest,
  2. each chunk gives the distances from every state at its begin to every state at its end,
  3. a backward pass over the chunks (sixteen numbers each) gives the distances at every chunk's end,
  4. each chunk walks from every state to learn where it leaves, and a forward pass picks the real one,
  5. each chunk walks once more and hands on its edits; a pass in order streams them into audit and hash.
No task holds more than one chunk's texts at a time. The audit and the hash of a conversation are one value by
their definition; the hash is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, stash
from .tokenizer_files import text_batches

#: Rows and characters that a chunk holds at most (one row at least).
ROWS, CHARS = 4096, 1 << 20
#: Kinds of rows: fine, and the first fault of the others.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after the system's turn, after a user's, after an assistant's. The turn due next leads on.
NEXT = (2, 2, 3, 2)
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = ("user", "user", "assistant", "user")
BEFORE = ((), (), (0, 1, 3), (2,))  # states that NEXT leads to each state from
FAR = 1 << 60
#: What inserted turns at the end cost from each state, and how many they are.
TAIL_COST, TAIL = (0, 6, 3, 0), (0, 2, 1, 0)
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def distances(initials: list[str], kinds: bytes, end: list[int]) -> list[list[int]]:
    """Cost from every (row, state) to the end, by Dial's buckets; ``end`` are the costs from the states behind the last row.

    An insertion behind the last row belongs to what ``end`` counts."""
    n = len(kinds)
    dist = [[FAR] * 4 for _ in range(n + 1)]
    least = min(end)
    buckets: list[list[tuple[int, int]]] = []

    def reach(i: int, s: int, d: int) -> None:
        if d < dist[i][s]:
            dist[i][s] = d
            while len(buckets) <= d - least:
                buckets.append([])
            buckets[d - least].append((i, s))

    for s, d in enumerate(end):
        if d < FAR:
            reach(n, s, d)
    at = 0
    while at < len(buckets):
        d = at + least
        for i, s in buckets[at]:  # grows meanwhile by rows that are kept at no cost
            if dist[i][s] != d:
                continue  # settled nearer before
            if i < n:
                for p in BEFORE[s]:
                    reach(i, p, d + 3)
            if i:
                kind, initial = kinds[i - 1], initials[i - 1]
                reach(i - 1, s, d + 4)
                if kind in (FINE, TRUNCATED):
                    extra = 3 if kind == TRUNCATED else 0
                    for p in BEFORE[s]:
                        reach(i - 1, p, d + 3 + extra)
                    for p in range(4):
                        if KEEPS[p].get(initial) == s:
                            reach(i - 1, p, d + extra)
        buckets[at] = []
        at += 1
    return dist


def walk(initials: list[str], kinds: bytes, dist: list[list[int]], state: int) -> tuple[str, int]:
    """The ASCII-least tight edits from the first row on, and the state behind the last row."""
    n, i, out = len(kinds), 0, []
    while i < n:
        here, extra = dist[i][state], 3 if kinds[i] == TRUNCATED else 0
        kept = KEEPS[state].get(initials[i])
        if 4 + dist[i + 1][state] == here:
            out.append("D")
            i += 1
        elif 3 + dist[i][NEXT[state]] == here:
            out.append("I")
            state = NEXT[state]
        elif kinds[i] in (FINE, TRUNCATED) and kept is not None and extra + dist[i + 1][kept] == here:
            out.append("K")
            state, i = kept, i + 1
        else:
            out.append("R")
            state, i = NEXT[state], i + 1
    return "".join(out), state


def repaired(edits: str, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of every turn that the edits leave."""
    i = 0
    for edit in edits:
        if edit != "D":
            yield (edit, roles[i] if edit == "K" else DUE[state], "" if edit == "I" else texts[i])
            state = KEEPS[state][roles[i][:1]] if edit == "K" else NEXT[state]
        i += edit != "I"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv_id, turn, role, text, times: rows damaged by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (times 0), 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats the row (times 2), 4 makes it a
    user's. A null is one space, in the key as well as in role and text; conv_id and turn stay null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        (F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


class Rows:
    """A conversation's rows so far, or those of one chunk of it."""

    def __init__(self, conv):
        self.conv, self.open = conv, False
        self.empty()

    def empty(self) -> None:
        self.roles, self.texts, self.turns = [], [], []
        self.kinds, self.digests, self.seen, self.chars = bytearray(), [], {}, 0

    def add(self, turn, role: str, text: str) -> None:
        plain = text.strip(SPACES)
        said = (role, text)
        if not plain:
            kind = BLANK
        elif said in self.seen:
            kind = DUPLICATE
        else:
            kind = FINE if plain[-1] in ".!?" else TRUNCATED
        self.seen.setdefault(said, len(self.kinds))
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None:
            self.turns.append(turn)
        self.chars += len(role) + len(text)

    def full(self, most: int) -> bool:
        return len(self.kinds) >= most or self.chars >= CHARS

    def initials(self) -> list[str]:
        return [r[:1] for r in self.roles]

    def keys(self) -> list[tuple[bytes, int]]:
        """Digest and place of what is said first here; the conversation is part of the digest."""
        conv = repr(self.conv).encode()
        return [(hashlib.sha256(b"%d:%d:" % (len(conv), len(r.encode())) + conv + (r + t).encode()).digest(), at) for (r, t), at in self.seen.items()]


def _totals(rows: Rows) -> dict:
    turns = rows.turns
    return {
        "gaps": turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0,
        "blank": rows.kinds.count(BLANK),
        "duplicate": rows.kinds.count(DUPLICATE),
        "truncated": rows.kinds.count(TRUNCATED),
        "illegal": illegal_pairs(rows.initials()),
    }


def _whole(rows: Rows, as_turns: bool) -> dict:
    """A whole conversation's result."""
    initials, kinds = rows.initials(), bytes(rows.kinds)
    dist = distances(initials, kinds, list(TAIL_COST))
    edits, state = walk(initials, kinds, dist, 0)
    edits += "I" * TAIL[state]
    turns = list(repaired(edits, rows.roles, rows.texts, 0))
    out = _totals(rows) | {"whole": True, "conv_id": rows.conv, "cost": dist[0][0], "audit": edits}
    if as_turns:
        return out | {"turns": [{"edit": e, "role": r, "text": t} for e, r, t in turns]}
    return out | {"repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode()).hexdigest()}


def _chunk(rows: Rows) -> dict:
    keys = rows.keys()
    return {
        "whole": False,
        "conv_id": rows.conv,
        "roles": rows.roles,
        "texts": rows.texts,
        "kinds": bytes(rows.kinds),
        "digests": [d for d, _ in keys],
        "places": [p for _, p in keys],
        "first_turn": rows.turns[0] if rows.turns else None,
        "last_turn": rows.turns[-1] if rows.turns else None,
        "n_turns": len(set(rows.turns)),
    }


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "array<struct<edit:string,role:string,text:string>>"
CHUNK = "roles array<string>, texts array<string>, kinds binary, digests array<binary>, places array<int>, first_turn long, last_turn long, n_turns long"


def _arrow(kind: str, conv=None):
    """An Arrow schema of a DDL string; ``conv`` is the type of conv_id, if it holds one."""
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "conv": conv}
    types |= {f"array<{k}>": pa.list_(v) for k, v in types.items() if v is not None}
    types[TURNS] = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    return pa.schema([(name, types[t]) for name, t in (x.split(" ", 1) for x in kind.split(", "))])


def _batches(rows: Iterator[dict], schema, most: int = 500, chars: int = 4 << 20):
    """Record batches of bounded size."""
    import pyarrow as pa

    held, size, some = [], 0, False
    for r in rows:
        held.append(r)
        size += sum(map(len, r.get("texts") or ())) + sum(len(t["text"]) for t in r.get("turns") or ()) + len(r.get("piece") or b"") + len(r.get("audit") or "")
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size, some = [], 0, True
    if held or not some:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _segments(batches, as_turns: bool, most: int) -> Iterator[dict]:
    """Whole conversations and chunks of the others, from rows in order. A task's first and last one may go on elsewhere."""
    from pyspark import TaskContext

    base, number, held, first = TaskContext.get().partitionId() << 40, 0, None, True

    def close(last: bool) -> Iterator[dict]:
        nonlocal number
        yield (_chunk(held) if held.open or last else _whole(held, as_turns)) | {"chunk": base + number}
        number += 1

    for batch in batches:
        for conv, turn, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times"))):
            if held is None or conv != held.conv:
                if held is not None:
                    yield from close(False)
                held = Rows(conv)
                held.open, first = first, False
            for _ in range(times):
                if held.full(most):
                    held.open = True
                    yield from close(False)
                    held.empty()
                held.add(turn, role, text)
    if held is not None:
        yield from close(True)


def _mapped(df: DataFrame, f, kind: str) -> DataFrame:
    """``df`` through ``f`` (an iterator of batches to one of dicts); ``conv`` in ``kind`` is the type of conv_id."""
    conv = df.schema["conv_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _batches(f(batches), _arrow(kind, to_arrow_type(conv)))

    return df.mapInArrow(run, kind.replace("conv_id conv,", f"conv_id {conv.simpleString()},"))


def _each(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # one at a time: chunks are large
            yield batch.slice(i, 1).to_pylist()[0]


def _marked(row: dict) -> bytes:
    kinds = bytearray(row["kinds"])
    for at in row["again"] or ():
        if kinds[at] != BLANK:
            kinds[at] = DUPLICATE
    return bytes(kinds)


def _transfers(batches) -> Iterator[dict]:
    for row in _each(batches):
        kinds, initials = _marked(row), row["initials"]
        columns = [distances(initials, kinds, [0 if t == end else FAR for t in range(4)])[0] for end in range(4)]
        yield {"conv_id": row["conv_id"], "chunk": row["chunk"], "transfer": [columns[t][s] for s in range(4) for t in range(4)]}


def _ends(batches) -> Iterator[dict]:
    """Backward: rows come with the last chunk of a conversation first."""
    conv, end, begun = None, None, False
    for row in _each(batches):
        if not begun or row["conv_id"] != conv:
            conv, end, begun = row["conv_id"], list(TAIL_COST), True
        m = row["transfer"]
        here = [min(FAR, *(m[4 * s + t] + end[t] for t in range(4))) for s in range(4)]
        yield {"conv_id": conv, "chunk": row["chunk"], "end": end, "begin": here}
        end = here


def _exits(batches) -> Iterator[dict]:
    for row in _each(batches):
        kinds, initials = _marked(row), row["initials"]
        dist = distances(initials, kinds, row["end"])
        yield {
            "conv_id": row["conv_id"], "chunk": row["chunk"], "begin": row["begin"], "end": row["end"],
            "exits": [walk(initials, kinds, dist, s)[1] if dist[0][s] < FAR else s for s in range(4)],
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None, "illegal": illegal_pairs(initials),
            "blank": kinds.count(BLANK), "duplicate": kinds.count(DUPLICATE), "truncated": kinds.count(TRUNCATED),
            "first_turn": row["first_turn"], "last_turn": row["last_turn"], "n_turns": row["n_turns"],
        }


def _entries(batches) -> Iterator[dict]:
    """Forward: the state at every chunk's begin, and counts so far; those of the last chunk are the conversation's."""
    conv, begun = None, False
    for row in _each(batches):
        if not begun or row["conv_id"] != conv:
            conv, begun, state, last, low, high, n = row["conv_id"], True, 0, None, None, None, 0
            sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0) | {"cost": row["begin"][0]}
        for c in ("blank", "duplicate", "truncated", "illegal"):
            sums[c] += row[c]
        if row["first"] is not None:
            sums["illegal"] += last is not None and last + row["first"] not in LEGAL
            last = row["last"]
        if row["first_turn"] is not None:
            n += row["n_turns"] - (row["first_turn"] == high)
            low, high = row["first_turn"] if low is None else low, row["last_turn"]
        gaps = high - low + 1 - n if low is not None else 0
        yield sums | {"conv_id": conv, "chunk": row["chunk"], "state": state, "end": row["end"], "gaps": gaps}
        state = row["exits"][state]


def _pieces(batches, as_turns: bool) -> Iterator[dict]:
    for row in _each(batches):
        kinds, initials = _marked(row), [r[:1] for r in row["roles"]]
        edits, state = walk(initials, kinds, distances(initials, kinds, row["end"]), row["state"])
        turns = list(repaired(edits, row["roles"], row["texts"], row["state"]))
        out = {c: row[c] for c in ("conv_id", "chunk", *COUNTS)} | {"audit": edits, "left": state}
        if as_turns:
            yield out | {"turns": [{"edit": e, "role": r, "text": t} for e, r, t in turns]}
        else:
            yield out | {"n_out": len(turns), "piece": "\n".join(f"{r}:{t}" for _, r, t in turns).encode()}


def _joined(batches, as_turns: bool) -> Iterator[dict]:
    """Pieces in order, streamed into one result a conversation; or turns, with those that end it."""

    def finish() -> Iterator[dict]:
        left = held["left"]
        tail = DUE[1:3] if TAIL[left] == 2 else DUE[2:3] * TAIL[left]  # a user's and an assistant's turn, or the latter
        if as_turns:
            yield {"conv_id": held["conv_id"], "chunk": held["chunk"] + 1, "turns": [{"edit": "I", "role": r, "text": ""} for r in tail]}
            return
        lines = [*([""] if some and tail else []), *(f"{r}:" for r in tail)]
        digest.update("\n".join(lines).encode())
        counts = {c: held[c] for c in ("conv_id", *COUNTS)}
        yield counts | {"audit": "".join(audit) + "I" * len(tail), "repaired_sha256": digest.hexdigest()}

    held = None
    for row in _each(batches):
        if held is None or row["conv_id"] != held["conv_id"]:
            if held is not None:
                yield from finish()
            some, digest, audit = False, hashlib.sha256(), []
        held = row
        if as_turns:
            yield {"conv_id": row["conv_id"], "chunk": row["chunk"], "turns": row["turns"]}
            continue
        audit.append(row["audit"])
        if row["n_out"]:
            digest.update((b"\n" if some else b"") + row["piece"])
            some = True
    if held is not None:
        yield from finish()


def _cut(rows: DataFrame, as_turns: bool, most: int) -> DataFrame:
    """Stored: whole conversations' results and chunks of the others, in order of their number."""
    rows = rows.withColumns({"hash": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "hash", "uid"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "times")
    kind = f"whole boolean, conv_id conv, chunk long, {RESULT}, turns {TURNS}, {CHUNK}"
    return stash(_mapped(dealt, lambda b: _segments(b, as_turns, most), kind), "conversations")


def _in_order(df: DataFrame, descending: bool = False) -> DataFrame:
    """A conversation's chunks in one stream, in order."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk") if descending else F.asc("chunk"))


def _repaired_chunks(cut: DataFrame, as_turns: bool) -> DataFrame:
    chunks = cut.where("not whole")
    said = chunks.select("chunk", F.explode(F.arrays_zip("digests", "places")).alias("x")).select("chunk", "x.*")
    first = said.groupBy("digests").agg(F.min("chunk").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = said.join(first, "digests").where("chunk > first").groupBy("chunk").agg(F.collect_list("places").alias("again"))  # at most ROWS a chunk
    again = stash(again, "said-again")
    marked = chunks.drop("digests", "places").join(again, "chunk", "left")
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials")
    narrow = stash(marked.select("conv_id", "chunk", initials, "kinds", "again", "first_turn", "last_turn", "n_turns"), "chunks")
    transfers = _mapped(narrow, _transfers, "conv_id conv, chunk long, transfer array<long>")
    ends = stash(_mapped(_in_order(transfers, descending=True), _ends, "conv_id conv, chunk long, end array<long>, begin array<long>"), "chunk-ends")
    kind = (
        "conv_id conv, chunk long, begin array<long>, end array<long>, exits array<int>, first string, last string, illegal long, "
        "blank long, duplicate long, truncated long, first_turn long, last_turn long, n_turns long"
    )
    exits = _mapped(narrow.join(ends.drop("conv_id"), "chunk"), _exits, kind)
    kind = "conv_id conv, chunk long, state int, end array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    entries = stash(_mapped(_in_order(exits), _entries, kind), "chunk-entries")
    rows = marked.select("chunk", "roles", "texts", "kinds", "again").join(entries, "chunk")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    made = f"turns {TURNS}" if as_turns else "n_out long, piece binary"
    pieces = _mapped(rows, lambda b: _pieces(b, as_turns), f"conv_id conv, chunk long, {counts}, audit string, left int, {made}")
    kind = f"conv_id conv, chunk long, turns {TURNS}" if as_turns else f"conv_id conv, {RESULT}"
    return _mapped(_in_order(pieces), lambda b: _joined(b, as_turns), kind)


def _prepared(rows: DataFrame, conv_col: str, turn_col: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    times: Column = F.col("times") if "times" in rows.columns else F.lit(1)
    text_batches(rows.sparkSession)
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space("role"), space("text"), times.cast("int").alias("times"))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", chunk_rows: int = ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` have conv_id, turn, role and text, and may have times (how often a row stands there; 0 keeps a
    conversation's name alone). Rows go by turn, null turns first, ties by role and then a hash of the text. A null role
    or text is one space; a null conv_id is a conversation of its own. A role's initial is its first character, whatever
    the role; an empty role has none and has to be given a new one or go. A conversation without rows has
    zeros, an empty audit and the hash of nothing. Of an audit's ties the ASCII-least stands. Texts are read
    whole. An empty table gives an empty result; other columns are not read.
    """
    cut = _cut(_prepared(rows, conv_col, turn_col), False, chunk_rows)
    names = ["conv_id", *(x.split(" ")[0] for x in RESULT.split(", "))]
    return cut.where("whole").select(*names).unionByName(_repaired_chunks(cut, False).select(*names))


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", chunk_rows: int = ROWS) -> DataFrame:
    """The repaired conversations: conv_id, chunk, place (both together give the order), edit (K, R or I), role, text."""
    cut = _cut(_prepared(rows, conv_col, turn_col), True, chunk_rows)
    names = ["conv_id", "chunk", "turns"]
    found = cut.where("whole").select(*names).unionByName(_repaired_chunks(cut, True).select(*names))
    return found.select("conv_id", "chunk", F.posexplode("turns").alias("place", "t")).select("conv_id", "chunk", "place", "t.edit", "t.role", "t.text")
