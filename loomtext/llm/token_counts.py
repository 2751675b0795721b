"""Operator 5, token counts: rank-synchronous merging over ragged numpy arrays.

A batch's pre-tokens lie end to end in one array of symbol ids, with their lengths beside it. In every
step each sequence finds the lowest rank among its neighbouring pairs, and all sequences apply their
pair at the same time; sequences without a pair leave with the number of their symbols. Counts of words
already seen are kept in a bounded dictionary, so the arrays hold new words only.

A sequence applies all occurrences of its pair at once where that equals one-by-one merging (no merge
that uses the pair's symbol has a lower rank than the pair) and else the leftmost one alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty
from .tokenizer_files import byte_characters, text_batches, vocabulary

NEVER = np.int64(1 << 40)
#: Words whose counts one worker holds at a time.
HELD_WORDS = 400_000


#: Words of these characters alone are in normal form, and lower-case and classify alike in any Unicode version.
PLAIN = re.compile("[!-~¡-¬®-Įı-ſ]+")


def plain_pattern(spec: dict) -> regex.Pattern | None:
    """The file's pre-token pattern, if its normaliser composes, joins white space and lower-cases, and no more."""
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
        return None
    if not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    return regex.compile(steps[0]["pattern"]["Regex"])


class RaggedMerger:
    """Merges batches of pre-tokens by the ranks of a BPE vocabulary with word-end symbols."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.base = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.key_rank = key[order], order.astype(np.int64)
        first_use = np.full(self.base, NEVER)
        ranks = np.arange(len(pairs), dtype=np.int64)
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        self.safe = first_use[self.made] > ranks
        letters = byte_characters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols survive in each word (the UTF-8 bytes of a pre-token, at least one)."""
        out = np.zeros(len(words), dtype=np.int64)
        if not words:
            return out
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(size) - 1
        sym = self.inner[points]
        sym[ends] = self.final[points[ends]]
        who = np.arange(len(words))
        seq = np.repeat(np.arange(len(words)), size)
        if (sym < 0).any():  # symbols outside the vocabulary give no token
            seq, sym = seq[sym >= 0], sym[sym >= 0]
            size = np.bincount(seq, minlength=len(words))
        rank = np.full(len(sym), NEVER)
        same = np.flatnonzero(seq[:-1] == seq[1:])
        rank[same] = self.rank_of(sym[same], sym[same + 1])
        while True:
            alive = np.zeros(len(size), dtype=bool)
            lowest = np.full(len(size), NEVER)
            full = np.flatnonzero(size)
            if len(full):
                lowest[full] = np.minimum.reduceat(rank, (np.cumsum(size) - size)[full])
            alive = lowest < NEVER
            out[who[~alive]] = size[~alive]
            if not alive.any():
                return out
            if not alive.all():  # finished sequences leave
                keep = alive[seq]
                sym, rank = sym[keep], rank[keep]
                who, size, lowest = who[alive], size[alive], lowest[alive]
                seq = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(rank == lowest[seq])
            first = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
            run = np.r_[True, hit[1:] != hit[:-1] + 1] | first
            at = np.arange(len(hit))
            odd = (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 1
            hit = hit[~odd & (first | self.safe[rank[hit]])]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            new = np.cumsum(keep)[hit] - 1
            size = size - np.bincount(seq[hit], minlength=len(size))
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            dirty = np.unique(np.r_[new, new[new > 0] - 1])
            rank[dirty] = NEVER
            dirty = dirty[dirty < len(sym) - 1]
            dirty = dirty[seq[dirty] == seq[dirty + 1]]
            rank[dirty] = self.rank_of(sym[dirty], sym[dirty + 1])


class WordCounter:
    """Token counts of texts by a ``tokenizers`` file with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.merger = RaggedMerger(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.held: dict[str, int] = {"": 0}
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.plain = plain_pattern(spec)

    def pre_tokens(self, word: str) -> list[bytes]:
        """The word's pre-tokens in UTF-8, by the library, or by its pattern for words of PLAIN alone."""
        if self.plain and PLAIN.fullmatch(word):
            return [x.encode() for x in self.plain.findall(word.lower())]
        normal = self.library.normalizer.normalize_str(word) if self.library.normalizer else word
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, words: list[str]) -> None:
        """Counts new words, all in one ragged batch."""
        owner, parts, extra = [], [], [0] * len(words)
        for i, word in enumerate(words):
            bits = self.special.split(word) if self.special and "<" in word else [word]
            extra[i] = len(bits) // 2  # every second one is a special string, a token of its own
            for bit in bits[::2]:
                for x in self.pre_tokens(bit) if bit else ():
                    owner.append(i)
                    parts.append(x)
        distinct = {x: k for k, x in enumerate(dict.fromkeys(parts))}
        sizes = self.merger.counts(list(distinct))
        total = np.array(extra, dtype=np.int64)
        if parts:
            np.add.at(total, owner, sizes[[distinct[x] for x in parts]])
        self.held.update(zip(words, total.tolist()))

    def count(self, texts: Iterable[str]) -> list[int]:
        # Pre-tokens never hold white space, so words between these four characters count on their own.
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.held) > HELD_WORDS:
            self.held = {"": 0}
        held = self.held
        new = list({w for words in split for w in words if w not in held})
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        return [sum(map(held.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    """One counter a worker process."""
    return WordCounter(path)


def by_size(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Consecutive groups of texts of about ``most`` characters together."""
    group, total = [], 0
    for t in texts:
        group.append(t)
        total += len(t)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty: 0 bytes, 0 tokens. Identifiers, null and repeated ones too, pass
    through. Special strings inside a text are single tokens, as the library has it by default. Texts
    are processed whole, however long. An empty table gives an empty result; other columns are not read.
    """
    import pyarrow as pa

    path = path or vocabulary("word_bpe_49k.json")
    text_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            texts, n = batch.column("text").to_pylist(), []
            for group in by_size(texts):
                n += counter(path).count(group)
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(n, type=pa.int64())], names=[*columns, "n_tokens"]
            )

    text = text_or_empty(text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
