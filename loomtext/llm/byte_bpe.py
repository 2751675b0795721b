"""Operator 10, byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file becomes a ``tokenizers`` model: bytes map to printable characters, every split of a token
into two tokens is a merge (in rank order), and whole pre-tokens that are tokens stay so. For every batch
the distinct segments (a run of non-space characters with the one white-space character before it, or the
rest of a run of white space; no pre-token crosses these) are matched against the pattern, and all matches
that are new go through the library in one call. A character stands for one byte there, so the library's
offsets are byte offsets: they have to cover the match, and tell the tokens that end inside a character.
Bounded dictionaries keep what was found. Decoding maps ids to characters, reverses the byte table and
joins bytes before any UTF-8 reading, so characters that are split over tokens come back whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty
from .token_counts import by_size
from .tokenizer_files import byte_characters, text_batches, vocabulary

#: White space as the pattern's \s has it (Unicode White_Space).
WHITE = "\t-\r \x85\xa0  -     　"
SEGMENT = re.compile(f"[{WHITE}]+(?![^{WHITE}])|[{WHITE}]?[^{WHITE}]+")
#: Segments and matches whose ids one worker holds at a time.
HELD_SEGMENTS, HELD_PIECES = 300_000, 60_000


#: Of a match or a segment: its ids as text, the bytes that they decode to, their number, tokens that end inside a character.
Told = tuple


class ByteCodec:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        letters = byte_characters()
        self.letters = {i: c for i, c in enumerate(letters)}  # str.translate's table of the bytes as Latin-1 reads them
        spell = lambda token: token.decode("latin-1").translate(self.letters)
        merges = [
            (spell(token[:i]), spell(token[i:]))
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.library = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {r: bytes(byte_of[c] for c in spell(t)) for t, r in ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.told_of = {r: (self.text_of[r], t, 1, 0) for r, t in self.bytes_of.items()}
        self.inner = frozenset(r for r, t in self.bytes_of.items() if t[0] & 0xC0 == 0x80)
        self.pattern = regex.compile(pattern)
        self.space = letters[0x20]
        self.pieces: dict[str, Told] = {}
        self.held: dict[str, Told] = {}

    def spelled(self, pieces: list[str], data: list[bytes]) -> list[str]:
        """The characters that stand for the pieces' bytes, one each."""
        letters, space = self.letters, self.space
        return [
            p.replace(" ", space) if p.isascii() and p.isprintable() else d.decode("latin-1").translate(letters) for p, d in zip(pieces, data, strict=True)
        ]

    def ends(self, data: bytes, encoded) -> list[int]:
        """Where each token ends in the piece's bytes, by the library's offsets, which have to cover them."""
        out = [end for _, end in encoded.offsets]
        if not out or out[-1] != len(data):
            raise ValueError("the vocabulary does not cover all bytes")
        return out

    def told(self, pieces: list[str]) -> list[Told]:
        """What is told of matches of the pattern, by one call of the library.

        A token that begins with the rest of a character follows one that ends inside it; the library is asked
        for offsets, which cost as much again, for the matches that have such tokens alone.
        """
        told_of, inner, bytes_of, text_of = self.told_of, self.inner, self.bytes_of, self.text_of
        raw = [p.encode() for p in pieces]
        spelled = self.spelled(pieces, raw)
        found = [x.ids for x in self.library.encode_batch_fast(spelled, add_special_tokens=False)]
        odd = [i for i, ids in enumerate(found) if not inner.isdisjoint(ids)]
        out = [
            told_of[ids[0]] if len(ids) == 1 else (",".join([text_of[k] for k in ids]), b"".join([bytes_of[k] for k in ids]), len(ids), 0) for ids in found
        ]
        for i, x in zip(odd, self.library.encode_batch([spelled[i] for i in odd], add_special_tokens=False), strict=True):
            split = sum(e < len(raw[i]) and raw[i][e] & 0xC0 == 0x80 for e in self.ends(raw[i], x))
            out[i] = (*out[i][:3], split)
        if [x[1] for x in out] != raw:
            raise ValueError("the vocabulary does not cover all bytes")
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text and where each token ends in the matches' UTF-8 bytes."""
        matches = [self.pattern.findall(t) for t in texts]
        distinct = list({p for found in matches for p in found})
        raw = [p.encode() for p in distinct]
        encoded = self.library.encode_batch(self.spelled(distinct, raw), add_special_tokens=False)
        known = {p: (x.ids, self.ends(d, x)) for p, d, x in zip(distinct, raw, encoded, strict=True)}
        out = []
        for found in matches:
            ids, ends, at = [], [], 0
            for p in found:
                own, places = known[p]
                ids += own
                ends += [at + e for e in places]
                at = ends[-1]
            out.append((ids, ends))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0][0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; bytes that are no UTF-8 (a character cut off at either end) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def trim(self) -> None:
        """Keeps the dictionaries bounded."""
        if len(self.held) > HELD_SEGMENTS:
            self.held = {}
        if len(self.pieces) > HELD_PIECES:
            self.pieces = {}

    def learn_segments(self, segments: list[str]) -> None:
        """Holds what is told of new segments. One that is a single match stands for this match as well; others are
        marked by a fifth value, and their matches are held on their own."""
        matches = [self.pattern.findall(x) for x in segments]
        pieces, held, known, new = self.pieces, self.held, {}, []
        for p in {p for found in matches for p in found}:
            told = pieces.get(p) or held.get(p)
            if told and len(told) == 4:
                known[p] = told
            else:
                new.append(p)
        known.update(zip(new, self.told(new), strict=True))
        for segment, found in zip(segments, matches, strict=True):
            if len(found) == 1 and found[0] == segment:
                held[segment] = known[segment]
            else:
                own = [known[p] for p in found]
                pieces.update(zip(found, own, strict=True))
                texts, data, n, split = zip(*own, strict=True) if own else ((), (), (), ())
                held[segment] = ",".join(texts), b"".join(data), sum(n), sum(split), True

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded bytes, tokens that end inside a character."""
        self.trim()
        held, out = self.held, []
        parts = [SEGMENT.findall(t) for t in texts]
        new = list(set().union(*parts).difference(held))
        for i in range(0, len(new), 5_000):
            self.learn_segments(new[i : i + 5_000])
        for found in parts:
            # Stops at the fourth value, where the shortest end; documents of marked segments alone have a fifth.
            texts, data, n, split = tuple(zip(*map(held.__getitem__, found), strict=False))[:4] if found else ((), (), (), ())
            ids = hashlib.sha256(",".join(filter(None, texts)).encode())
            out.append((sum(n), ids.hexdigest(), hashlib.sha256(b"".join(data)).hexdigest(), sum(split)))
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteCodec:
    """One codec a worker process."""
    return ByteCodec(path, pattern)


def _setting(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or vocabulary("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def round_trip(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that end inside a character).

    A null text counts as empty: no ids, so the digests are those of no bytes. Identifiers, null and
    repeated ones too, pass through. Strings of special tokens are ordinary text. Texts are processed
    whole. An empty table gives an empty result; other columns are not read.
    """
    import pyarrow as pa

    path, pattern = _setting(path, pattern)
    text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for group in by_size(batch.column("text").to_pylist(), 2_000_000):
                rows += codec(path, pattern).digests(group)
            n, ids, data, split = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string()), pa.array(split, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")


def encode(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The ids themselves: doc_id, ids, byte_ends (each token's end in the UTF-8 text). Nulls as in round_trip."""
    import pyarrow as pa

    path, pattern = _setting(path, pattern)
    text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = []
            for group in by_size(batch.column("text").to_pylist(), 2_000_000):
                found += codec(path, pattern).encode_all(group)
            ids, ends = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int64()))],
                names=["doc_id", "ids", "byte_ends"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>, byte_ends array<long>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, decoded (bytes) of rows with ``ids``; a null array decodes to no bytes."""
    import pyarrow as pa

    path, pattern = _setting(path, pattern)

    def run(batches):
        for batch in batches:
            data = [codec(path, pattern).decode_bytes(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")
