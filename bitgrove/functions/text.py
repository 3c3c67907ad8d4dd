"""Text to tokens to vectors: normalisation, word pieces, a model-free sentence encoder."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Ids and sizes of the tokenizer's output.
PAD, UNKNOWN, CLS, SEP = 0, 100, 101, 102
MAX_TOKENS = 128


def normalise_ascii(text: Column) -> Column:
    """For ASCII text: controls go, white space becomes a blank, punctuation stands between blanks, lower case, trimmed."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F]", "")
    clean = F.regexp_replace(clean, r"[\x09-\x0D]", " ")
    clean = F.regexp_replace(clean, r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", " $1 ")
    return F.trim(F.lower(clean))


def normalise_text(text: str) -> str:
    """The same with Unicode's classes."""
    out = []
    for c in text:
        kind = unicodedata.category(c)
        if c.isspace() or kind == "Zs":
            out.append(" ")
        elif c in "\0�" or kind in ("Cc", "Cf"):
            continue
        elif kind[0] == "P" or (ord(c) < 128 and kind[0] == "S"):
            out.append(f" {c} ")
        else:
            out.append(c.lower())
    return "".join(out).strip()


def word_pieces(word: str, vocab: dict[str, int]) -> list[int]:
    """The whole word, or greedily the longest pieces from the left; a part without a piece makes the word unknown."""
    if word in vocab:
        return [vocab[word]]
    ids, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = vocab.get(("##" if at else "") + word[at:end])
            if piece is not None:
                ids.append(piece)
                at = end
                break
        else:
            return [UNKNOWN]
    return ids


def tokenize(vocab: dict[str, int], spark: SparkSession) -> Callable[[Column], Column]:
    """A column function text -> struct<input_ids, attention_mask, token_type_ids>, each MAX_TOKENS long. The vocabulary is broadcast."""
    shipped = spark.sparkContext.broadcast(vocab)

    @F.pandas_udf("input_ids array<int>, attention_mask array<int>, token_type_ids array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = shipped.value
        rows = []
        for t in texts:
            ids = [i for w in normalise_text(t or "").split() for i in word_pieces(w, own)][: MAX_TOKENS - 2]
            ids = [CLS, *ids, SEP]
            pad = MAX_TOKENS - len(ids)
            rows.append((ids + [PAD] * pad, [1] * len(ids) + [0] * pad, [0] * MAX_TOKENS))
        return pd.DataFrame(rows, columns=["input_ids", "attention_mask", "token_type_ids"])

    return run


def load_vocab(spark: SparkSession, path: str) -> dict[str, int]:
    """Line number -> id; blank lines have a number but no entry. A vocabulary has a fixed, small size."""
    lines = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).split("\n")
    return {w.strip(): k for k, w in enumerate(lines) if w.strip()}


def hashing_encoder(dims: int = 384) -> Callable[[Column], Column]:
    """A stand-in for a sentence model: the mean of a Gaussian vector per word, normalised. Blank text gives zeros.

    Any column function text -> array<float> can take its place.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def vector(word: str) -> np.ndarray:
            if word not in known:
                if len(known) > 50_000:
                    known.clear()
                known[word] = np.random.default_rng(int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")).standard_normal(dims)
            return known[word]

        out = []
        for t in texts:
            words = normalise_text(t or "").split()
            v = np.mean([vector(w) for w in words], axis=0) if words else np.zeros(dims)
            n = np.sqrt((v * v).sum())
            out.append((v / n if n > 1e-12 else v).astype(np.float32))
        return pd.Series(out, dtype=object)

    return run
