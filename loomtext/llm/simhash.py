"""Operator 8, SimHash near-duplicates: a hierarchical index over fingerprints in Gray order.

Fingerprints are folded to distinct ones. Two fingerprints within ``most`` differing bits agree on one
of ``most + 1`` blocks of bits, so each goes to one group for every block. A group larger than
``group_rows`` is dealt on once more by blocks of the bits that its key leaves free; what is larger even
then is a crowd of close fingerprints, which is cut into runs, and only those outside the crowd's main
component meet all of it. No pair is lost.

Inside a task every group is a tree. Its fingerprints are sorted by Gray rank; runs of neighbours are
factored into upper nodes, each with the masked bit pattern its members share. A self-join walks down
from the roots: the differences between two nodes' patterns are a lower bound for all their members, so
a pair of nodes beyond ``most`` is pruned as a whole; where even the free bits can't lead beyond it, all
members are linked at once; where both nodes lie in one component already, nothing is left to find.
Each group gives links to one member of every component in it, at most one a fingerprint, and never all
its pairs. Links become components by large-star and small-star rounds over stashed tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, one_column, own_columns, pieces, small_side, spread_lookup, stash, text_or_empty
from .tokenizer_files import text_batches

BITS = 64
#: Children of a node of the tree.
FAN = 16
#: Node pairs that are looked at together, and rows of groups that a worker holds together.
STEP, HELD_ROWS = 100_000, 16_384
ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def shingle_hashes(data: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of lower-cased words, repeats included, in blocks."""
    held: list[bytes] = []
    made = 0
    digest = xxhash.xxh64_intdigest
    for piece in pieces(data.lower(), 1_000_000):  # bytes.lower() and bytes.split() know ASCII alone
        held += piece.split()
        n = len(held) - words + 1
        if n > 0:
            spans = map(b" ".join, zip(*(held[i:] for i in range(words)), strict=False))
            yield np.fromiter((digest(x, 42) for x in spans), dtype=np.uint64, count=n)
            made += n
            held = held[n:]
    if not made and held:
        yield np.array([digest(b" ".join(held), 42)], dtype=np.uint64)


def fingerprint(data: bytes, words: int = 3) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; 0 without words."""
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for h in shingle_hashes(data, words):
        total += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part (input partition), fp (the fingerprint's 64 bits as a long)."""
    import pyarrow as pa

    text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), words) for x in batch.column("text")]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(fp, pa.int64())], names=["doc_id", "part", "fp"]
            )

    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.spark_partition_id().alias("part"),
        F.encode(text_or_empty(text_col), "UTF-8").alias("text"),
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, part int, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray-code order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row of its component) after linking rows a and b."""
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, high[apart], low[apart])
        label = roots(label)
    return label


def joining(label: np.ndarray, a: np.ndarray, b: np.ndarray, more: int = 0) -> np.ndarray:
    """Of the pairs, one after the other, those that join two components, and those of rows with fewer than ``more``
    pairs: pairs x 2."""
    up: dict[int, int] = {}
    held: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    kept = []
    for i, (x, y, p, q) in enumerate(zip(label[a].tolist(), label[b].tolist(), a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y or max(held.get(p, 0), held.get(q, 0)) < more:
            if x != y:
                up[max(x, y)] = min(x, y)
            held[p], held[q] = held.get(p, 0) + 1, held.get(q, 0) + 1
            kept.append(i)
    return np.c_[a[kept], b[kept]]


class GrayTree:
    """The trees of several groups together; rows are sorted by group and Gray rank."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.levels = [(fp, np.full(len(fp), ALL), np.arange(len(fp)), np.arange(1, len(fp) + 1))]
        starts = []
        while True:
            new = np.r_[True, group[1:] != group[:-1]]
            at = np.arange(len(group))
            inside = at - np.maximum.accumulate(np.where(new, at, 0))
            first = np.flatnonzero(inside % FAN == 0)
            starts.append(first)
            if len(first) == len(group) and len(starts) > 1:
                starts.pop()
                break
            value, mask, low, high = self.levels[-1]
            one = np.bitwise_and.reduceat(value & mask, first)
            zero = np.bitwise_and.reduceat(~value & mask, first)
            self.levels.append((one, one | zero, low[first], high[np.r_[first[1:], len(group)] - 1]))
            group = group[first]
        self.kids = [(s, np.r_[s[1:], n]) for s, n in zip(starts, [len(x[0]) for x in self.levels[:-1]], strict=True)]

    def links(self, most: int, accept: Callable | None = None, label: np.ndarray | None = None, pairs: list | None = None, more: int = 0) -> np.ndarray:
        """Labels of the components at ``most`` differing bits or fewer; ``accept`` (rows a, rows b) may refuse links.

        ``label`` are components that are known before; ``pairs`` takes in the accepted pairs that
        join two of them, and of those found together with them up to ``more`` a row."""
        label = np.arange(len(self.levels[0][0])) if label is None else label
        top = len(self.levels) - 1
        every = np.arange(len(self.levels[top][0]))
        work = [(top, every, every, False)]  # pairs of nodes of a level, and whether they are known to be near
        while work:
            level, a, b, known = work.pop()
            size = STEP // (FAN * FAN) if known else STEP
            if len(a) > size:
                work += [(level, a[i : i + size], b[i : i + size], known) for i in range(0, len(a), size)][::-1]
                continue
            if not known:
                value, mask, _, _ = self.levels[level]
                shared = mask[a] & mask[b]
                least = np.bitwise_count((value[a] ^ value[b]) & shared).astype(np.int64)
                near = least <= most
                if level == 0:
                    near &= label[a] != label[b] if accept else a != b
                    a, b = a[near], b[near]
                    if accept:
                        good = accept(a, b)
                        a, b = a[good], b[good]
                        if pairs is not None:
                            pairs.append(joining(label, a, b, more))
                    label = unite(label, a, b)
                    continue
                a, b, least, shared = a[near], b[near], least[near], shared[near]
                # ``accept`` wants to be asked for every pair; else near nodes may be near as a whole.
                whole = np.zeros(len(a), dtype=bool) if accept else least + (BITS - np.bitwise_count(shared)).astype(np.int64) <= most
                label = self.unite_nodes(level, label, a[whole], b[whole])
                if len(a) > whole.sum():
                    work.append((level, a[~whole], b[~whole], True))
                continue
            rest = ~self.settled(level, label, a, b)
            a, b = a[rest], b[rest]
            if not len(a):
                continue
            first, last_kid = self.kids[level - 1]
            na, nb = (last_kid - first)[a], (last_kid - first)[b]
            size = na * nb
            pair = np.repeat(np.arange(len(a)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x = first[a][pair] + k // nb[pair]
            y = first[b][pair] + k % nb[pair]
            ordered = (a != b)[pair] | (x <= y)
            work.append((level - 1, x[ordered], y[ordered], False))
        return label

    def settled(self, level: int, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes whose rows are all in one component: the smallest and the largest label are the same."""
        _, _, low, high = self.levels[level]
        used, back = np.unique(np.r_[a, b], return_inverse=True)
        ends = np.c_[low[used], high[used]].ravel()
        ends = ends[:-1] if len(ends) and ends[-1] == len(label) else ends
        least = np.minimum.reduceat(label, ends)[::2]
        even, name = (least == np.maximum.reduceat(label, ends)[::2])[back], least[back]
        n = len(a)
        return even[:n] & even[n:] & (name[:n] == name[n:])

    def unite_nodes(self, level: int, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, _, low, high = self.levels[level]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rows = np.r_[low[x] : high[x], low[y] : high[y]]
            label = unite(label, rows[:1].repeat(len(rows)), rows)
        return label


def group_links(key: np.ndarray, fp: np.ndarray, most: int, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, the component's first node) among rows that share a key; nodes are the fingerprints if not given."""
    node = fp if node is None else node
    order = np.lexsort((gray_rank(fp), key))
    key, fp, node = key[order], fp[order], node[order]
    label = GrayTree(key, fp).links(most) if len(fp) else np.zeros(0, dtype=np.int64)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return node[linked], node[label[linked]]


def group_pairs(key: np.ndarray, fp: np.ndarray, most: int, node: np.ndarray, yes: list, no: list, wide: np.ndarray, most_wide: int, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that share a key, at ``most`` differing bits and ``most_wide`` wide ones, which join components.

    A node and its ``yes`` (a list of nodes) are joined before; pairs with one of its ``no`` aren't asked for."""
    none = np.zeros(0, dtype=np.int64)
    if not len(fp):
        return none, none
    order = np.lexsort((gray_rank(fp), key))
    key, fp, node, wide = key[order], fp[order], node[order], wide[order]
    lists = lambda x: {i: frozenset(x[j]) for i, j in enumerate(order.tolist()) if x[j] is not None and len(x[j])}
    yes, no = lists(yes), lists(no)
    at: dict[int, list[int]] = {}
    for i, x in enumerate(node.tolist()):
        at.setdefault(x, []).append(i)
    known = [(rows[0], j) for rows in at.values() for j in rows[1:]] + [(i, at[x][0]) for i, of in yes.items() for x in of if x in at]
    label = np.arange(len(node))
    if known:
        known = np.array(known, dtype=np.int64)
        label = unite(label, known[:, 0], known[:, 1])
    steps = lambda a: [slice(i, i + 8192) for i in range(0, len(a), 8192)]

    def accept(a, b):
        apart = [np.bitwise_count(wide[a[s]] ^ wide[b[s]]).sum(axis=1, dtype=np.int64) for s in steps(a)]
        near = np.concatenate([none, *apart]) <= most_wide
        if no:
            for i in np.flatnonzero(near).tolist():
                near[i] = int(node[b[i]]) not in no.get(int(a[i]), ())
        return near

    pairs: list[np.ndarray] = []
    GrayTree(key, fp).links(most, accept, label, pairs, more)
    found = np.concatenate([np.zeros((0, 2), dtype=np.int64), *pairs])
    return node[found[:, 0]], node[found[:, 1]]


def blocks(free: list[int], parts: int) -> list[list[int]]:
    """The bit positions ``free`` in ``parts`` runs of about equal length."""
    cut = [len(free) * i // parts for i in range(parts + 1)]
    return [free[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


#: How often groups are dealt on by blocks of bits: at most (most + 1) ** LEVELS rows a fingerprint.
LEVELS = 2


def _gray_order(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, as a long (its upper half counts below its lower one)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _grouped_links(rows: DataFrame, keys: list[str], most: int, most_wide: int | None, chunk: int | None = None, extra: int = 0) -> DataFrame:
    """Links among rows that share the keys; partitions hold whole groups, sorted. With ``chunk``, groups are cut
    into runs of that many rows, of which each begins with the last one's last row."""
    import pyarrow as pa

    def arrays(batch):
        out = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "fp")]
        if most_wide is not None:
            yes, no = (np.empty(batch.num_rows, dtype=object) for _ in range(2))
            yes[:], no[:] = (batch.column(c).to_pylist() for c in ("yes", "no"))
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            out += [yes, no, wide]
        return tuple(out)

    def found(key, node, fp, *more):
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        if chunk:
            at = np.arange(len(group))
            inside = at - np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
            again = np.flatnonzero((inside % chunk == 0) & (inside > 0))  # a row that opens a run also ends the one before
            place = np.sort(np.r_[at, again], kind="stable")
            first = np.r_[True, place[1:] != place[:-1]]
            group = np.cumsum(np.r_[True, (group[place][1:] != group[place][:-1]) | ~first[1:]])
            node, fp, more = node[place], fp[place], [x[place] for x in more]
        if more:
            a, b = group_pairs(group, fp.view(np.uint64), most, node, *more, most_wide, extra)
        else:
            a, b = group_links(group, fp.view(np.uint64), most, node)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if batch.num_rows:
                held.append(arrays(batch))
            if sum(len(x[0]) for x in held) > HELD_ROWS:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                new = np.flatnonzero(np.r_[True, whole[0][1:] != whole[0][:-1]])
                cut = int(new[-1])  # the last group may go on
                if not cut and chunk:
                    cut = len(whole[0]) - 1
                if cut:
                    yield found(*(x[:cut] for x in whole))
                    back = int(bool(chunk) and cut > new[-1])
                    held = [tuple(x[cut - back :] for x in whole)]
                else:
                    held = [tuple(whole)]
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))

    carried = ["key", "node", "fp", *(["yes", "no", "wide"] if most_wide is not None else [])]
    keyed = rows.withColumn("key", F.xxhash64(*keys))  # two groups of one key are but one larger group
    if chunk:
        keyed = keyed.withColumn("at", _gray_order(F.col("fp")))
        dealt = keyed.repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    else:
        dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.select(*carried).mapInArrow(run, "a long, b long")


def _crowded_links(rows: DataFrame, most: int, group_rows: int, most_wide: int | None, extra: int = 0) -> DataFrame:
    """Links among groups (path, value) beyond ``group_rows`` rows, which dealing by bits no longer parts.

    Runs of neighbours in Gray order link first. Then the rows outside their group's largest component
    ("strays") meet all rows of the group, in tiles of bounded size; two rows of one component need not meet.
    Work grows with the rows and with the strays times the rows, so a crowd of linked copies costs little.
    """
    rows = stash(rows, "crowded")
    first = stash(_grouped_links(rows, ["path", "value"], most, most_wide, group_rows, extra), "crowded-links")
    known = rows.select(F.col("node").alias("a"), F.explode("yes").alias("b")).distinct() if most_wide is not None else first.limit(0)
    stars = stash(components(first.unionByName(known)), "crowded-stars").withColumnRenamed("root", "own")
    rooted = rows.join(stars, "node", "left").withColumn("own", F.coalesce("own", "node"))
    rooted = stash(rooted.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64))), "crowded-rooted")
    sizes = rooted.groupBy("path", "value", "own").agg(F.count("*").alias("n"))
    main = sizes.groupBy("path", "value").agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    tiles = lambda n: F.ceil(n / F.lit(float(group_rows))).cast("int")
    main = main.where("n > most").select(
        "path", "value", "main", tiles(F.col("n")).alias("row_tiles"), tiles(F.col("n") - F.col("most")).alias("stray_tiles")
    )
    main = stash(main, "crowded-main")
    if main.isEmpty():
        return first
    rooted = spread_lookup(rooted, main, ["path", "value"], "salt").where("main is not null")
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_rows = rooted.withColumn("i", place(1, F.col("row_tiles"))).withColumn("j", every("stray_tiles"))
    strays = rooted.where("own <> main").withColumn("j", place(2, F.col("stray_tiles"))).withColumn("i", every("row_tiles"))
    names = [*rows.columns, "i", "j"]
    # A stray that meets itself in its own tile is one row too many, no more.
    both = as_rows.select(*names).unionByName(strays.select(*names))
    return first.unionByName(_grouped_links(both, ["path", "value", "i", "j"], most, most_wide, extra=extra))


def similar_links(distinct: DataFrame, most: int = 3, group_rows: int = 8192, most_wide: int | None = None, extra: int = 0) -> DataFrame:
    """Links (a, b) between the nodes of ``distinct`` (columns node, fp): their components are those of all
    pairs at ``most`` differing bits or fewer. Every link is such a chain; none of the pairs is missing.
    With ``most_wide``, the column ``wide`` has to be that close as well, and pairs that join components come instead:
    those of the list ``yes`` are a node's links so far, and those of ``no`` are left out as its partners. ``extra`` is how many pairs
    a node may give beyond these, so that what is left comes to its end in fewer rounds."""
    carried = ["node", "fp", *(["yes", "no", "wide"] if most_wide is not None else [])]
    # Each path of blocks leaves these bits free; with a column ``side`` (0 or 1) two indexes run at once.
    paths = {0: list(range(BITS))} | ({-1: list(range(BITS))} if "side" in distinct.columns else {})
    start = -F.col("side") if "side" in distinct.columns else F.lit(0)
    rows = distinct.select(start.cast("int").alias("path"), F.lit(0).cast("long").alias("value"), *carried)
    links, next_path = None, 1
    for level in range(1, LEVELS + 1):
        dealt, deeper = [], {}
        for path, free in paths.items():
            for own in blocks(free, most + 1):
                deeper[next_path] = [b for b in free if b not in own]
                dealt.append((path, next_path, _mask(own)))
                next_path += 1
        # The value of a path is all bits that its blocks fix, so it names a group together with the path.
        sends = F.create_map(
            *[
                x
                for path in paths
                for x in (
                    F.lit(path),
                    F.array(*[F.struct(F.lit(to).alias("to"), F.lit(m).cast("long").alias("mask")) for at, to, m in dealt if at == path]),
                )
            ]
        )
        rows = rows.withColumn("send", F.explode(sends[F.col("path")])).select(
            F.col("send.to").alias("path"),
            F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("send.mask"))).alias("value"),
            *carried,
        )
        sizes = stash(rows.groupBy("path", "value").count().where(F.col("count") > group_rows), "large-groups")
        none = sizes.isEmpty()
        found = _grouped_links(rows if none else rows.join(sizes, ["path", "value"], "left_anti"), ["path", "value"], most, most_wide, extra=extra)
        links = found if links is None else links.unionByName(found)
        if none:
            return links
        rows = rows.join(sizes.select("path", "value"), ["path", "value"], "left_semi")
        used = {r.path for r in sizes.select("path").distinct().collect()}  # at most the number of paths
        paths = {p: f for p, f in deeper.items() if p in used}
    return links.unionByName(_crowded_links(rows, most, group_rows, most_wide, extra))


def components(links: DataFrame, salts: int = 64) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the links a, b.

    Large-star and small-star rounds on stashed tables until no link changes. A node with many links is
    aggregated before the exchange, and what it learns goes back to its links by (node, salt).
    """
    salt = F.pmod(F.xxhash64("v"), F.lit(salts)).alias("salt")
    edges = stash(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).select("u", "v", salt)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = spread_lookup(both, least, ["u"], "salt").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct().select("u", "v", salt)
        # small-star: all smaller neighbours, and the node itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_lookup(large, low, ["u"], "salt")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stash(small.where("u <> v").distinct(), "links")
        # Done when every node has one link and no node is both a root and a member: a set of stars.
        state = after.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        chained = after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        forget(edges)
        edges = after
        if state <= 1 and chained:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def component_names(distinct: DataFrame, links: DataFrame, salts: int = 64) -> DataFrame:
    """node, component_id of the nodes of ``distinct`` (node, least: its smallest identifier) under the links."""
    stars = stash(components(links), "stars")
    rows = distinct.select("node", "least").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stash(rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts))), "rooted")
    smallest = rows.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_lookup(rows, smallest, ["root"], "salt").select("node", "component_id")
    return named


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    most: int = 3,
    group_rows: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, fp.

    Fingerprints link at ``most`` or fewer differing bits; component_id is the smallest identifier that
    links reach. A null text counts as empty; a text without words has fingerprint zero and links like
    any other. A null identifier passes through and is never a component_id, unless a component has no
    other. Equal texts and repeated identifiers give rows of their own. Words are cut at ASCII white
    space and only A-Z are lower-cased. An empty table gives an empty result; other columns are not read.
    """
    rows = stash(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "distinct-fingerprints")
    named = component_names(distinct, similar_links(distinct.select("node", "fp"), most, group_rows)).withColumnRenamed("node", "fp")
    return spread_lookup(rows, named, ["fp"], "part").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"
    )


#: Words of 64 bits in a wide fingerprint.
WIDE = 32
_MIX = np.random.default_rng(21).integers(0, 2**64, size=(2, WIDE + 2), dtype=np.uint64)
_TIMES = _MIX[0] | np.uint64(1)


def spread_bits(h: np.ndarray, first: int, count: int) -> np.ndarray:
    """rows x ``count`` independent 64-bit hashes of each hash, the ones from number ``first`` on."""
    x = (h[:, None] ^ _MIX[1, first : first + count]) * _TIMES[first : first + count]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58_476D_1CE4_E5B9)
    return x ^ (x >> np.uint64(32))


def majority(hashes: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` words of a fingerprint of distinct hashes: a bit is 1 if it is set in over half of the spread hashes.

    Bits are summed in planes: 255 rows become 8 words of binary digits by carry-save addition, so a row
    costs a few word operations a word rather than 64 additions.
    """
    total = np.zeros((count, 64), dtype=np.int64)
    for s in range(0, len(hashes), 8192):
        rows = spread_bits(hashes[s : s + 8192], first, count)
        weight = 1
        while len(rows):
            carried = []
            while len(rows) > 2:
                n = len(rows) // 3
                a, b, c, rest = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n], rows[3 * n :]
                half = a ^ b
                carried.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rest])
            for row in rows:
                total += weight * np.unpackbits(row.astype(">u8").view(np.uint8).reshape(count, 8), axis=1).astype(np.int64)
            rows = np.concatenate(carried) if carried else rows[:0]
            weight *= 2
    return np.packbits(total * 2 > len(hashes), axis=1).view(">u8").ravel().astype(np.uint64)


def wide_distance(least: float) -> int:
    """Differing bits of wide fingerprints at a Jaccard similarity of ``least``, for sets of equal size.

    Two such sets meet at the cosine 2J / (1 + J); a bit differs with the probability of angle / pi.
    """
    return int(WIDE * BITS * np.arccos(2 * least / (1 + least)) / np.pi)


def text_fingerprints(data: bytes, words: int) -> tuple[int, int, bytes]:
    """Two 64-bit fingerprints of a text's distinct words and the wide one of its distinct shingles."""
    out = []
    for n, first, count in ((1, 0, 2), (words, 2, WIDE)):
        found = [np.unique(h) for h in shingle_hashes(data, n)]
        found = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        out.append(majority(found, first, count))
    return int(out[0][0]), int(out[0][1]), out[1].tobytes()


def wide_fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, part (input partition), said (the text's hash), fp and fp2 (of distinct words), wide (of distinct shingles), node (their hash)."""
    import pyarrow as pa

    text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [text_fingerprints(x.as_buffer().to_pybytes(), words) for x in batch.column("text")]
            fps = [pa.array(np.array([f[i] for f in found], dtype=np.uint64).view(np.int64), pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "part", "said")), *fps, pa.array([f[2] for f in found], pa.binary())],
                names=["doc_id", "part", "said", "fp", "fp2", "wide"],
            )

    narrow = _texts(docs, text_col, F.col(id_col).alias("doc_id"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = narrow.mapInArrow(run, f"doc_id {kind}, part int, said binary, fp long, fp2 long, wide binary")
    return rows.withColumn("node", F.xxhash64("fp", "fp2", "wide"))


def _texts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    text = text_or_empty(text_col)
    said = F.unhex(F.sha2(text, 256)).alias("said")
    return docs.select(*more, F.spark_partition_id().alias("part"), said, F.encode(text, "UTF-8").alias("text"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, text_col: str) -> DataFrame:
    """node, shingles (sorted distinct hashes of 64 bits) of the nodes in ``wanted`` (node, said): whole texts, read once more.

    Texts that are wanted stay where they are if the list of their hashes is small, and else meet it by (part, hash)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sets = []
            for x in batch.column("text"):
                found = [np.unique(h) for h in shingle_hashes(x.as_buffer().to_pybytes(), words)]
                sets.append((np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    texts = _texts(docs, text_col)
    pairs = texts.select("part", "said").groupBy("part", "said").agg(F.lit(1).alias("one")).drop("one").join(wanted, "said")
    met = texts.join(small_side(pairs, "wanted-texts"), ["part", "said"])
    return met.select("node", "text").mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def alike_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b, alike: whether the exact Jaccard similarity of both nodes' sets is ``least`` or more."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            told = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                told.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(told, pa.bool_())], names=["a", "b", "alike"])

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, alike boolean")


def similar_documents(
    docs: DataFrame,
    words: int = 5,
    least: float = 0.8,
    margin: float = 0.04,
    most: int = 6,
    group_rows: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, component_id, the smallest identifier that links reach.

    Documents link if the exact Jaccard similarity of the sets of their ``words``-word shingles is ``least`` or more and
    they meet as candidates. Candidates meet by the Gray-order index of two 64-bit fingerprints of their distinct words,
    at ``most`` differing bits of either: a light edit touches ``words`` shingles but one or two words, so these lie close
    where those of the shingles don't. Of these, wide fingerprints of 2,048 bits tell the similarity with a standard
    error of about 0.015, and pairs that they put more than ``margin`` below ``least`` are left out.

    The index runs on 64-bit fingerprints alone first, which finds the documents that have a neighbour. Then it runs in
    rounds with the wide fingerprints of these: each gives pairs that join a group's components, and a few more a
    node, which are verified by the sets of both texts. True ones are joined from then on, false ones are not asked for again. A
    pair that a round leaves out is one that others had joined; so a round without a false pair is the last.

    Words are cut at ASCII white space and only A-Z are lower-cased; a text of fewer words is one shingle; texts
    without words (null ones, too) are alike. Null identifiers pass through and name no component that has
    another. Texts of the same sets are one entry of the index. An empty table gives an empty result; other
    columns are not read.
    """
    rows = stash(wide_fingerprints(docs, words, id_col, text_col), "wide-fingerprints")
    distinct = rows.groupBy("node").agg(
        F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("fp", "fp2", "wide", "said"))
    )
    distinct = stash(distinct, "distinct-fingerprints")
    either = ["fp", "fp2"]
    both = lambda df, *more: df.select("node", *more, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("fp")) for i, c in enumerate(("fp", "fp2"))])).alias("x")).select("node", *more, "x.*")
    seen = stash(similar_links(both(distinct), most, group_rows).select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-nodes")
    held = stash(distinct.join(seen, "node", "left_semi"), "near-fingerprints")
    forget(seen)
    sets = stash(shingle_sets(docs, held.select("node", "said"), words, text_col), "shingle-sets")
    nobody = F.array().cast("array<long>")
    held = held.select("node", "fp", "fp2", "wide", nobody.alias("yes"), nobody.alias("no"))
    limit, joined, extra = wide_distance(least - margin), None, 4
    while True:
        found = similar_links(both(held, "wide", "yes", "no"), most, group_rows, limit, extra).where("a <> b")
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        judged = stash(alike_pairs(pairs, sets, least), "judged-pairs")
        ends = judged.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("x"), "alike"), F.struct(F.col("b").alias("node"), F.col("a").alias("x"), "alike"))).alias("e"))
        told = ends.select("e.*").groupBy("node").agg(  # partners of one round
            F.collect_list(F.when(F.col("alike"), F.col("x"))).alias("more_yes"), F.collect_list(F.when(~F.col("alike"), F.col("x"))).alias("more_no")
        )
        wrong = judged.where("not alike").isEmpty()
        good = judged.where("alike").select("a", "b")
        joined = good if joined is None else joined.unionByName(good)
        if wrong:
            break  # what pairs hid was joined by true ones
        grown = lambda c: F.concat(c, F.coalesce(f"more_{c}", nobody)).alias(c)
        # A node without a link that gave no pair has none left: whatever joins it to another would have come.
        left = held.join(told, "node", "left").where(F.col("more_yes").isNotNull() | (F.size("yes") > 0))
        held = stash(left.select("node", "fp", "fp2", "wide", grown("yes"), grown("no")), "near-fingerprints")
        extra *= 4  # most nodes are settled by the first rounds; the rest give more pairs each time
    none = distinct.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    named = component_names(distinct, none if joined is None else joined)
    forget(sets)
    return spread_lookup(rows.select("doc_id", "part", "node"), named, ["node"], "part").select("doc_id", "component_id")


def keep_named(docs: DataFrame, ruled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller identifier; own columns, whatever their names.

    ``ruled`` is a stashed table of doc_id and component_id.
    Of a component one row stays: the one whose identifier is the component's. A row without identifier
    stays only if its component has no identifier at all. Rows that repeat a staying identifier stay once
    for each different text. Only narrow rows of dropped identifiers meet the texts: they are broadcast up
    to a measured size, and else merged by identifier, which has no hot key.
    """
    name = F.col("doc_id").alias("gone")
    # An identifier stays if one of its rows is the component's.
    stay = ruled.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count()
    again = stash(stay.where("count > 1").select(name), "repeated")
    gone = ruled.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(name).distinct()
    gone = gone.join(stay.select(F.col("doc_id").alias("stays")), F.col("gone").eqNullSafe(F.col("stays")), "left_anti")
    rows = one_column(docs)  # no column of the caller's can clash with one of ours
    match = F.col("row")[id_col].eqNullSafe(F.col("gone"))
    kept = rows.join(small_side(gone, "gone"), match, "left_anti")
    if again.isEmpty():
        return own_columns(kept, docs)
    one = kept.join(again, match, "left_semi").withColumns({"own_id": F.col("row")[id_col], "own_text": F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))})
    one = one.dropDuplicates(["own_id", "own_text"]).select("row")
    return own_columns(kept.join(again, match, "left_anti").unionByName(one), docs)


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """The rows of ``docs`` that keep_named leaves by the components of similar_documents."""
    ruled = stash(similar_documents(docs, words, least, id_col=id_col, text_col=text_col, **settings), "components")
    return keep_named(docs, ruled, id_col, text_col)
