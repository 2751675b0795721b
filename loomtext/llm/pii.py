"""Operator 3, personal data: fixed base rules and bootstrapped contextual extraction.

One pass over the texts finds the base spans (the seeds) and, outside them, candidates: spans of digits
and separators that have a kind's form, among them those that a base rule swallowed and dropped. Seeds
and candidates induce lexical patterns: their shape with the characters on either side, the word before
and the word after. Spark scores the graph of patterns and instances (distinct values) in rounds: a
pattern's confidence is the mean confidence of its instances, lessened if few seeds support it; seeds
count 1, candidates that fail their kind's check 0 (for cards each weighs as the numbers that pass the
check digit by chance), other candidates their best pattern's confidence. A candidate that a confident
pattern holds becomes a seed of the next round, so its other patterns gain support and lead to further
candidates: a word finds numbers of a new shape, the shape finds them beside other words.

After the last round a candidate is a span if one of its patterns is confident and has enough seeds, or if
several nearly are. Wide candidates take part: numbers at an end of a run of digits without a base rule's
form (phones without +, cards with other separators), and addresses that write @ or dots as words. They
weigh a quarter in a pattern's mean, for no check tells them from other numbers.

Texts are read once. Patterns reach occurrences through a salted lookup, so a pattern that a third of
all occurrences have meets no single task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, small_side, spread_lookup, stash, text_or_empty
from .tokenizer_files import text_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]{7,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
#: Runs in which candidates lie: digits with up to three separators between them.
RUN = re.compile(r"\+?[0-9](?:[\x20().-]{0,3}[0-9])+")
DIGITS = re.compile(r"[0-9]+")
NEXT_WORD = re.compile(r"\s*(\S{0,65})")
#: Addresses with @ or dots written out; possessive and tied to a word's start, so that long words cost linear time.
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({<]\x20?(?:@|at|AT)\x20?[\])}>]\x20?|\x20(?:@|at|AT)\x20)"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({<]?(?:\.|dot|DOT)[\])}>]?\x20)[A-Za-z0-9-]++)+"
)
#: Of numbers that are no cards, one in ten passes the check digit: each failed one stands for this many passed ones.
BY_CHANCE = 1 / 9
FIND = "array<struct<kind:int,start:int,stop:int,value:string,role:int,shape:string,before:string,after:string>>"
#: Roles of an occurrence: 3 seed, 2 candidate, 1 wide candidate, 0 candidate that fails its kind's check.
SEED, OPEN, WIDE, FAILED = 3, 2, 1, 0
#: A wide candidate's weight in a pattern's mean.
WIDE_WEIGHT = 0.25
#: Characters of a neighbouring word at most; a longer run of characters is no word and counts as LONG.
WORD_CHARS, LONG = 64, "<long>"
#: Patterns that tell nothing: no word, or none that is one.
NO_WORD = ("before:", "after:", f"before:{LONG}", f"after:{LONG}")
#: Several patterns accept together if they are this sure, each alone that sure.
TOGETHER, ALONE = 0.95, 0.6


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the rule, found from each @ outwards, so that long words cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers; each run of digits and dots is cut once."""
    for run in DOTTED.finditer(text):
        parts: list[tuple[int, int]] = []
        last = None
        for d in DIGITS.finditer(text, run.start(), run.end()):
            if last is not None and d.start() - last != 1:
                parts = []
            parts.append(d.span())
            last = d.end()
            if len(parts) == 4:
                yield parts[0][0], parts[3][1]
                parts, last = [], None


def valid(kind: int, value: str) -> bool:
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    digits = NOT_DIGITS.sub("", value)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' matches that pass their checks, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(a, 1, b) for a, b in addresses(text) if valid(1, text[a:b])]
    for kind, rule in ((2, CARD), (3, PHONE)):
        out += [(m.start(), kind, m.end()) for m in rule.finditer(text) if valid(kind, m.group())]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of other spans with a kind's form that overlap no base span."""
    at = 0
    taken = sorted((s, e) for s, _, e in taken)
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        while at < len(taken) and taken[at][1] <= run.start():
            at += 1
        first = at
        parts = [d.span() for d in DIGITS.finditer(text, run.start(), run.end())]
        for i, (start, _) in enumerate(parts):
            plus = start > 0 and text[start - 1] == "+"
            begin, n, dotted, spaced = start - plus, 0, True, True
            while first < len(taken) and taken[first][1] <= begin:
                first += 1
            wall = taken[first][0] if first < len(taken) else len(text) + 1
            for j in range(i, len(parts)):
                n += parts[j][1] - parts[j][0]
                end = parts[j][1]
                if n > 19 or end > wall:
                    break
                if j > i:
                    gap = text[parts[j - 1][1] : parts[j][0]]
                    dotted, spaced = dotted and gap == ".", spaced and gap in (" ", "-")
                if plus:
                    if j > i and 9 <= n <= 15:
                        yield 3, begin, end
                elif dotted and j > i:
                    if j - i == 3:
                        yield 1, begin, end
                elif spaced and n >= 12:
                    yield 2, begin, end


def wide_candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of spans at an end of a run, in no base rule's form, that overlap no base span.

    Only the run as a whole may fail its kind's check: the other spans of a run are no evidence.
    """
    taken = sorted((s, e) for s, _, e in taken)
    starts = [s for s, _ in taken]

    def free(start: int, end: int) -> bool:
        at = bisect_left(starts, end)
        return at == 0 or taken[at - 1][1] <= start

    if "at" in text or "AT" in text or "@" in text:
        yield from ((0, *m.span()) for m in SPELLED.finditer(text) if free(*m.span()))
    for run in RUN.finditer(text):
        if run.end() - run.start() < 9 or run.group().startswith("+"):
            continue
        parts = [d.span() for d in DIGITS.finditer(text, run.start(), run.end())]
        last = len(parts) - 1
        ends = {(0, j) for j in range(min(last + 1, 19))} | {(i, last) for i in range(max(0, last - 18), last + 1)}
        for i, j in sorted(ends):
            start, end = parts[i][0], parts[j][1]
            n = sum(b - a for a, b in parts[i : j + 1])
            if start and text[start - 1] == "(" and ")" in text[start:end]:
                start -= 1
            if not 9 <= n <= 19 or text[start - 1 : start] == "+" or not free(start, end):
                continue
            gaps = {text[a[1] : b[0]] for a, b in zip(parts[i:j], parts[i + 1 : j + 1], strict=True)}
            whole = i == 0 and j == last
            if n <= 15 and not (gaps == {"."} and j - i == 3):
                yield 3, start, end
            if n >= 12 and gaps - {" ", "-"} and (whole or valid(2, text[start:end])):
                yield 2, start, end


def side(c: str) -> str:
    """The class of a neighbouring character; none counts as space."""
    if not c or c.isspace():
        return "_"
    return "a" if c.isalpha() else "9" if c.isdigit() else c


def shape_of(kind: int, value: str) -> str:
    if kind == 0:
        return re.sub(r"[A-Za-z0-9]+", "a", value.split("@")[0]) + "@"
    return "9.9.9.9" if kind == 1 else DIGITS.sub(lambda m: f"{len(m.group())}d", value)


def word_before(text: str, at: int) -> str:
    """The word that ends last before a place, white space between them skipped."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    start = at
    while start > 0 and not text[start - 1].isspace():
        start -= 1
        if at - start > WORD_CHARS:
            return LONG
    return DIGITS.sub("9", text[start:at].lower())


def word_after(text: str, at: int) -> str:
    """The word that begins first after a place, white space between them skipped."""
    found = NEXT_WORD.match(text, at).group(1)
    return LONG if len(found) > WORD_CHARS else DIGITS.sub("9", found.lower())


def occurrence(text: str, kind: int, start: int, end: int, role: int) -> dict:
    value = text[start:end]
    return {
        "kind": kind,
        "start": start,
        "stop": end,
        "value": value.lower() if kind == 0 else NOT_DIGITS.sub(".", value).strip(".") if kind == 1 else NOT_DIGITS.sub("", value),
        "role": role,
        "shape": f"{side(text[start - 1 : start])}{shape_of(kind, value)}{side(text[end : end + 1])}",
        "before": word_before(text, start),
        "after": word_after(text, end),
    }


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    base = base_spans(text)
    finds = [occurrence(text, k, s, e, SEED) for s, k, e in base]
    seen = sorted({c for c in candidates(text, base)})
    finds += [occurrence(text, k, s, e, OPEN if valid(k, text[s:e]) else FAILED) for k, s, e in seen]
    wide = sorted(set(wide_candidates(text, base)).difference(seen))
    finds += [occurrence(text, k, s, e, WIDE if valid(k, text[s:e]) else FAILED) for k, s, e in wide]
    return base, finds


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pattern_scores(edges: DataFrame, rounds: int, min_confidence: float = 0.8, min_seeds: int = 3) -> DataFrame:
    """kind, pattern, confidence, n_seeds after ``rounds`` rounds over the edges (kind, instance, pattern, role, salt).

    Seeds are the instances of the role and, from the second round on, those that a pattern with
    ``min_confidence`` and ``min_seeds`` held in the round before.
    """
    if rounds < 1:
        raise ValueError("rounds has to be 1 at least")
    role = F.col("role")
    fixed = F.when(role == SEED, 1.0).when(role == FAILED, 0.0)
    weight = F.when((role == FAILED) & (F.col("kind") == KINDS.index("card")), BY_CHANCE).when(role == WIDE, WIDE_WEIGHT).otherwise(1.0)
    scored, before = edges.withColumn("r", F.coalesce(fixed, F.lit(0.0))).withColumn("found", F.lit(False)), None
    for turn in range(rounds):
        gained = F.sum(F.when((role == WIDE) & ~F.col("found"), F.col("r") * WIDE_WEIGHT).otherwise(F.col("r")))
        weighed = F.when(F.col("found"), 1.0).otherwise(weight)
        patterns = scored.groupBy("kind", "pattern").agg(
            (gained / F.sum(weighed)).alias("mean"), F.sum(((role == SEED) | F.col("found")).cast("long")).alias("n_seeds")
        )
        patterns = stash(
            patterns.select("kind", "pattern", "n_seeds", (F.col("mean") * F.col("n_seeds") / (F.col("n_seeds") + 1)).alias("confidence")),
            "patterns",
        )
        if before is not None:
            forget(before)
        before = patterns
        if turn == rounds - 1:
            return patterns
        known = spread_lookup(edges, patterns.hint("merge"), ["kind", "pattern"], "salt")
        sure = (F.col("confidence") >= min_confidence) & (F.col("n_seeds") >= min_seeds) & ~F.col("pattern").isin(*NO_WORD)
        best = known.groupBy("kind", "instance").agg(F.max("confidence").alias("best"), F.max(sure).alias("sure"))
        scored = known.select("kind", "instance", "pattern", "role").join(best.hint("merge"), ["kind", "instance"])
        scored = scored.withColumn("found", role.isin(OPEN, WIDE) & F.col("sure"))
        scored = scored.withColumn("r", F.when(F.col("found"), 1.0).otherwise(F.coalesce(fixed, F.col("best"), F.lit(0.0))))


def find_personal_data(
    docs: DataFrame,
    rounds: int = 3,
    min_confidence: float = 0.8,
    min_seeds: int = 3,
    salts: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of base spans; ``spans`` holds these and the added ones, which overlap
    neither base spans nor each other (of overlapping ones the leftmost, then the longest stays). A null
    text counts as empty: no spans and the digest of no bytes. Identifiers, null and repeated ones too,
    pass through, and texts are read whole. Without seeds nothing is added. An empty table gives an empty
    result; other columns are not read.
    """
    import pyarrow as pa

    text_batches(docs.sparkSession)
    struct = pa.struct(
        [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("role", pa.int32()), ("shape", pa.string()), ("before", pa.string()), ("after", pa.string())]
    )

    def run(batches):
        for batch in batches:
            counts, digests, spans, finds = [], [], [], []
            for text in batch.column("text").to_pylist():
                base, found = scan(text)
                told = joined(base)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
                digests.append(hashlib.sha256(told.encode()).hexdigest())
                spans.append(told)
                finds.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_uid"),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(finds, pa.list_(struct)),
                ],
                names=["doc_id", "row_uid", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "finds"],
            )

    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_uid"), text_or_empty(text_col).alias("text")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = stash(
        narrow.mapInArrow(run, f"doc_id {kind}, row_uid long, {counts}, base_sha256 string, base string, finds {FIND}"), "finds"
    )
    finds = rows.where(F.size("finds") > 0).select("row_uid", F.explode("finds").alias("f")).select("row_uid", "f.*")
    shape = F.concat(F.lit("shape:"), "shape")
    patterns = F.array(shape, F.concat(F.lit("before:"), "before"), F.concat(F.lit("after:"), "after"))
    instance = F.xxhash64("value")
    edges = (
        finds.select("kind", instance.alias("instance"), F.explode(patterns).alias("pattern"), "role")
        .groupBy("kind", "instance", "pattern")
        .agg(F.max("role").alias("role"))
        .withColumn("salt", F.pmod("instance", F.lit(salts)))
    )
    edges = stash(edges, "pattern-edges")
    scores = pattern_scores(edges, rounds, min_confidence, min_seeds)
    told = scores.where(~F.col("pattern").isin(*NO_WORD) & (F.col("confidence") >= ALONE) & (F.col("n_seeds") >= min_seeds))
    open_finds = finds.where(F.col("role").isin(OPEN, WIDE)).select(
        "row_uid", "kind", "start", "stop", F.explode(patterns).alias("pattern"), F.pmod("row_uid", F.lit(salts)).alias("salt")
    )
    told = small_side(told.select("kind", "pattern", "confidence"), "told-patterns")
    forget(edges)
    forget(scores)
    sure = spread_lookup(open_finds, told, ["kind", "pattern"], "salt").where("confidence is not null")
    doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
    accepted = sure.groupBy("row_uid", "kind", "start", "stop").agg(F.max("confidence").alias("best"), (1 - doubt).alias("together"))
    accepted = accepted.where((F.col("best") >= min_confidence) | (F.col("together") >= TOGETHER))
    # Leftmost, then longest, without overlaps: a fold over the few accepted spans of one document.
    names = F.array(*map(F.lit, KINDS))
    added = accepted.groupBy("row_uid").agg(
        F.array_sort(F.collect_set(F.struct("start", (-F.col("stop")).alias("less"), "kind"))).alias("a")
    )
    fold = F.expr(
        "aggregate(a, cast(array() as array<struct<start:int,less:int,kind:int>>), "
        "(kept, x) -> if(size(kept) = 0 or x.start >= -element_at(kept, -1).less, concat(kept, array(x)), kept))"
    )
    added = added.select("row_uid", fold.alias("added"))
    told = F.transform(
        "added",
        lambda x: F.struct(
            x["start"].alias("start"),
            x["kind"].alias("kind"),
            F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), (-x["less"]).cast("string")).alias("told"),
        ),
    )
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(
            F.split(x, ":")[1].cast("int").alias("start"),
            (F.array_position(names, F.split(x, ":")[0]) - 1).cast("int").alias("kind"),
            x.alias("told"),
        ),
    )
    both = F.array_join(F.transform(F.array_sort(F.concat(base, told)), lambda x: x["told"]), ",")
    return rows.drop("finds").join(added.hint("merge"), "row_uid", "left").select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        "base_sha256",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(both).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
