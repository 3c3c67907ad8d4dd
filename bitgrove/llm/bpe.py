"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols keep their first position for life. Leaf i of the tree holds rank and position of
the pair that starts at symbol i, and each inner node the smaller of its two, so the root is the
leftmost pair of lowest rank. A merge changes three leaves (its own, its left neighbour's, the swallowed
symbol's), each a logarithmic update; the work ends when the root is empty. A pre-token of n bytes
costs O(n log n) whatever its length. Results for short pre-tokens are remembered, within a bound.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, map_arrow, table

#: The pre-token pattern of byte-level BPE vocabularies of this format.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Remembered pre-tokens and the longest that is remembered: a bound on memory, results don't depend on it.
REMEMBERED, LONGEST = 400_000, 64
#: Rows that are encoded before their result leaves the worker, and their characters at most (one row at least).
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000


def printable_bytes() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: printable ones stand for themselves, the others are moved beyond 255."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    moved = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


class _Words(dict):
    """pre-token -> its ids as little-endian int32 bytes. When full it becomes the old generation; what is used again moves back."""

    def __init__(self, encode):
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            ids = self.encode(word.encode())
            made = struct.pack(f"<{len(ids)}i", *ids)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made


class ByteBpe:
    """Encoder and decoder for a tokenizer file of byte-level BPE without normaliser or added prefix space."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = printable_bytes()
        self.byte_id = [0] * 256
        for char, byte in chars.items():
            self.byte_id[byte] = vocab[char]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * top
        for text, number in vocab.items():
            if text not in self.special:
                self.token[number] = bytes(chars[c] for c in text)
        for text, number in self.special.items():
            self.token[number] = text.encode()
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 24 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.rank_bits = len(self.merged).bit_length()
        self.find = regex.compile(PRETOKENS).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.words = _Words(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token. Updates stop where an inner node keeps its value."""
        byte_id, get, merged = self.byte_id, self.rank.get, self.merged
        ids = [byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        shift = 13 if n <= 8192 else 32  # short pre-tokens keep rank and position in a small integer
        none, position = 1 << (self.rank_bits + shift), (1 << shift) - 1
        size = 1 << (n - 2).bit_length()
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(ids[i] << 24 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x < y else y
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != none:
            i = best & position
            gone = after[i]
            new = ids[i] = merged[best >> shift]
            ids[gone] = -1
            right = after[i] = after[gone]
            left = before[i]
            value = none
            if right < n:
                before[right] = i
                r = get(new << 24 | ids[right])
                if r is not None:
                    value = r << shift | i
                k = size + gone
                if tree[k] != none:  # the swallowed symbol starts no pair any more
                    tree[k] = low = none
                    while k > 1:
                        other = tree[k ^ 1]
                        if other < low:
                            low = other
                        k >>= 1
                        if tree[k] == low:
                            break
                        tree[k] = low
            k = size + i
            tree[k] = low = value
            while k > 1:
                other = tree[k ^ 1]
                if other < low:
                    low = other
                k >>= 1
                if tree[k] == low:
                    break
                tree[k] = low
            if left >= 0:
                r = get(ids[left] << 24 | new)
                value = none if r is None else r << shift | left
                k = size + left
                if tree[k] != value:
                    tree[k] = low = value
                    while k > 1:
                        other = tree[k ^ 1]
                        if other < low:
                            low = other
                        k >>= 1
                        if tree[k] == low:
                            break
                        tree[k] = low
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32 bytes; strings of special tokens in the text become those tokens."""
        if self.cut is None:
            return b"".join(map(self.words.__getitem__, self.find(text)))
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<i4").tobytes())
            else:
                out += map(self.words.__getitem__, self.find(part))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _loaded(source: str) -> ByteBpe:
    return ByteBpe(source)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = chars = 0
    for k, text in enumerate(texts):
        if k > at and (k - at >= SLICE_ROWS or chars + len(text) > SLICE_CHARS):
            yield at, k
            at, chars = k, 0
        chars += len(text)
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, source: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """The `keep` columns and ids: array<int> per row of docs, and decoded: string, the ids decoded again, if asked for.

    source: content of the tokenizer file (a fixed size; it goes to the workers as a broadcast variable).
    Null text counts as empty and has no ids; repeated rows are encoded each; other columns are ignored.
    """
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)), "ids array<int>"]) + ", decoded string" * with_decoded
    shipped = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shipped.value)
        shape = arrow_schema(schema)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            for a, b in _slices(texts):
                made = [bpe.encode(t) for t in texts[a:b]]
                offsets = np.append(0, np.cumsum([len(x) // 4 for x in made])).astype(np.int32)
                flat = np.frombuffer(b"".join(made), "<i4")
                columns = [*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
                if with_decoded:
                    columns.append(pa.array([bpe.decode(np.frombuffer(x, "<i4").tolist()) for x in made], pa.string()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)

    src = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.col(text_col).cast("string").alias("t"))
    return map_arrow(src, run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "ids", *["decoded"] * with_decoded)


def decode(rows: DataFrame, source: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded: string) per row; null ids decode to the empty string."""
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, decoded string"
    shipped = rows.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shipped.value)
        for batch in batches:
            made = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.string())], schema=arrow_schema(schema))

    return map_arrow(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, schema).withColumnRenamed("id", id_col)


def tokenizer_source(path: str | None = None) -> str:
    """Content of a tokenizer file; by default the installed public byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"), tokenizer_source(), with_decoded=True)
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
