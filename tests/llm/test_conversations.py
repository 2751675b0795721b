"""Conversation repair against every edit script of small cases, a plain version of the whole query, and odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomtext.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, kinds string, uid string, hash string, whole string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "k", "u", "h", "w") for r in rows], SCHEMA)


def cheapest(rows):
    """Cost, audit and turns by trying edits in order of (cost, audit), whole words of initials held to the pattern."""
    shape = lambda w: "" if w == "" else w[-1] if w[-1] != "s" else "s"
    ok = re.compile(r"s?(ua)*u?|")
    queue = [(0, "", 0, "", ())]
    done = {}
    while queue:
        queue.sort()
        cost, audit, i, word, turns = queue.pop(0)
        key = (i, shape(word))
        if key in done and done[key] <= (cost, audit):
            continue
        done[key] = (cost, audit)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", word):
            return cost, audit, turns
        steps = [(3, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, kind = rows[i]
            extra = 3 if kind == "truncated" else 0
            steps.append((4, "D", i + 1, "", ()))
            if kind in ("fine", "truncated"):
                steps.append((extra, "K", i + 1, role[:1], (f"{role}:{text}",)))
                steps += [(3 + extra, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, e, j, letter, said in steps:
            grown = word + letter
            if (letter or e == "D") and ok.fullmatch(grown):
                queue.append((cost + c, audit + e, j, grown, turns + said))
    raise AssertionError("some script always exists")


def plain_rows(rows):
    """What damage leaves, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        sp = lambda x: " " if x is None else str(x)
        fault, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        held += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return out


def plain(rows):
    out = {}
    for conv, held in plain_rows(rows).items():
        seen, kinds = set(), []
        for _, role, text in held:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "fine" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        cost, audit, said = cheapest([(r, t, k) for (_, r, t), k in zip(held, kinds)])
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def made(seed, conversations, most):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "why?", "cut off", "", " \t", "Yes.", "a.b", None, "more text. ", "two\nlines."]
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", "super", None]
    return [
        (None if c == 3 else c, rng.choice([None, t, t, t, t + 2]) if c % 5 == 0 else t * (1 + (c % 7 == 1)), rng.choice(roles), rng.choice(words) if rng.random() < 0.4 else f"text {rng.randint(0, 9)}.")
        for c in range(conversations)
        for t in range(rng.randint(1, most))
    ]


def by_turn_alone(rows):
    """Rows whose order their turn and role tell; ties beyond go by a hash."""
    seen = set()
    return [r for r in rows if (k := (r[0], r[1], " " if r[2] is None else r[2])) not in seen and not seen.add(k)]


def found(df):
    rows = df.collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("chunk_rows", [C.ROWS, 2])
def test_as_a_plain_version_finds_it(spark, chunk_rows):
    rows = by_turn_alone(made(7, 150, 9))
    # A row that damage makes a user's may tie with a user's of the same turn.
    ties = {}
    for conv, held in plain_rows(rows).items():
        keys = [(t, r) for t, r, x in set(held)]
        if len(keys) != len(set(keys)):
            ties[conv] = True
    rows = [r for r in rows if r[0] not in ties]
    got = found(C.repair_conversations(C.damaged(table(spark, rows)), chunk_rows=chunk_rows))
    want = plain(rows)
    assert got == want and len(got) > 100
    assert {c for _, a in ((k, v[6]) for k, v in want.items()) for c in a} == set("DIKR")


def test_small_cases_by_every_script():
    """Distances and walk against the plain search over all rows of three, and in two pieces."""
    letters = [("s", C.FINE), ("u", C.FINE), ("a", C.FINE), ("t", C.FINE), ("u", C.TRUNCATED), ("a", C.TRUNCATED), ("u", C.BLANK)]
    names = {C.FINE: "fine", C.BLANK: "blank", C.TRUNCATED: "truncated"}
    for n in range(4):
        for case in itertools.product(letters, repeat=n):
            initials, kinds = [i for i, _ in case], bytes(k for _, k in case)
            dist = C.distances(initials, kinds, list(C.TAIL_COST))
            edits, state = C.walk(initials, kinds, dist, 0)
            want = cheapest([(i, "x", names[k]) for i, k in case])
            assert (dist[0][0], edits + "I" * C.TAIL[state]) == want[:2]


def test_one_conversation_over_many_tasks(spark):
    """Chunks of every size give what one piece gives, with faults, repeats and turns across their edges."""
    rng = random.Random(11)
    rows = [(1, t // 2 * 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "cut", "", f"t{t}.", f"t{t}."])) for t in range(400)]
    rows += [(2, 1, "user", "Hi."), (None, None, None, None)]
    df = table(spark, rows).repartition(7)
    whole = found(C.repair_conversations(df.coalesce(1).repartition(1)))
    for most in (1, 3, 50):
        assert found(C.repair_conversations(df, chunk_rows=most)) == whole
    held = C.repaired_turns(df, chunk_rows=3).orderBy("chunk", "place").collect()
    mine = [f"{r.role}:{r.text}" for r in held if r.conv_id == 1]
    assert hashlib.sha256("\n".join(mine).encode()).hexdigest() == whole[1][7]
    assert "".join(r.edit for r in held if r.conv_id == 1) == whole[1][6].replace("D", "")


def test_empty_and_dropped(spark):
    none = C.repair_conversations(C.damaged(table(spark, []).limit(0)))
    assert none.count() == 0 and none.columns[0] == "conv_id"
    gone = [(c, t, "user", "Hi.") for c in range(200) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = found(C.repair_conversations(C.damaged(table(spark, gone))))
    assert set(got) == {c for c, *_ in gone} and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repeated_rows_and_long_texts(spark):
    long = "word " * 600_000
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 1, "assistant", long + ".")]
    got = found(C.repair_conversations(table(spark, rows)))
    want = hashlib.sha256(f"user:{long}\nassistant:{long}.".encode()).hexdigest()
    assert got[1] == (0, 0, 2, 1, 2, 11, "KDKD", want)


def test_damage_reads_other_identifier_types(spark):
    rows = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    got = C.repair_conversations(rows.withColumn("conv_id", F.col("conv_id"))).collect()
    assert [(r.conv_id, r.audit, r.cost) for r in got] == [("a", "KK", 0)]
