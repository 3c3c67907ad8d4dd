"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions. Each level counts its keys over all rows (partial aggregation, so a hot key is
one row per task), and the keys that occur more than once become a bitmap of fixed size. A row reaches
the next level only if its key may be in the bitmap; rows that stay alone are settled there, and their
full content is never hashed. A bitmap can let a row through in error, which costs a hash and changes
no result, since the last level groups by the full SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import lower_ascii, materialise

#: Bits of a level's bitmap; 16,384 words of 64 bits, 128 KB whatever the input. Bits of one that is sized by its keys, at most: 8 MB.
BITMAP_BITS, MOST_BITS = 1 << 20, 1 << 26
PREFIX_CHARS = 256


def bits_for(keys: int) -> int:
    """Bits of a bitmap that lets through one row in eight in error at most, as long as MOST_BITS suffice."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (8 * keys - 1).bit_length()))


def _slot(key: tuple[Column, ...], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def repeated_keys_bitmap(rows: DataFrame, *key: str) -> Column:
    """A scalar subquery: array<bigint> with a bit set for every key that has two rows or more."""
    return keys_bitmap(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), *key)


def keys_bitmap(keys: DataFrame, *key: str, bits: int = BITMAP_BITS) -> Column:
    """A scalar subquery: array<bigint> of so many bits with the bit of every key set."""
    slots = keys.select(_slot(tuple(map(F.col, key)), bits).alias("_s"))
    words = slots.groupBy(F.shiftright("_s", 6).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_s").bitwiseAND(63).cast("int"))).alias("_b"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("_w"))
    dense = every.join(words, "_w", "left").select(F.struct("_w", F.coalesce("_b", F.lit(0)).alias("_b")).alias("_x"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["_b"])).scalar()


def in_bitmap(bitmap: Column, *key: Column, bits: int = BITMAP_BITS) -> Column:
    slot = _slot(key, bits)
    return F.bit_get(F.element_at(bitmap, (F.shiftright(slot, 6) + 1).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, digest).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest id stays; a null id counts as the smallest. keep_id is that id, group_size the rows of the group.
    Rows that share the largest id of a group are all kept: nothing tells them apart.
    digest: hex SHA-256 of the normalised text, null for rows settled by length or prefix unless hash_all.
    Further columns of docs are ignored, whatever their names. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_t"))
    sized = base.select("*", F.octet_length("_t").alias("_len"))
    same_length = repeated_keys_bitmap(sized.select("_len"), "_len")
    prefix = F.xxhash64(lower_ascii(F.substring("_t", 1, PREFIX_CHARS)))
    by_prefix = sized.where(in_bitmap(same_length, F.col("_len"))).select("_len", prefix.alias("_pre"))
    same_prefix = repeated_keys_bitmap(by_prefix, "_len", "_pre")
    candidate = in_bitmap(same_length, F.col("_len")) & in_bitmap(same_prefix, F.col("_len"), prefix)
    flagged = sized.select("_id", "_t", candidate.alias("_cand"))
    full = F.unhex(F.sha2(lower_ascii(F.col("_t")), 256))
    hashed = materialise(flagged.select("_id", "_cand", (full if hash_all else F.when(F.col("_cand"), full)).alias("_h")), "exact")
    groups = hashed.where("_cand").groupBy("_h").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = materialise(groups.withColumnRenamed("_h", "_gh"), "groups", narrow=True)
    alone = hashed.where(~F.col("_cand")).select("_id", "_h", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    rest = hashed.where("_cand").join(groups, F.col("_h") == F.col("_gh"), "left")
    rest = rest.select("_id", "_h", F.when(F.col("_gh").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"))
    return alone.unionAll(rest).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_h")).alias("digest"),
    )


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in dropped (one column, named _drop); columns stay as they are, null ids stay.

    Only rows whose id may be in dropped, by a bitmap sized by its number of ids, are shuffled with their texts; the others pass as they are read.
    """
    dropped = materialise(dropped, "dropped", narrow=True)
    bits = bits_for(dropped.count())
    suspect = in_bitmap(keys_bitmap(dropped, "_drop", bits=bits), docs[id_col], bits=bits)
    asked = docs.where(suspect)
    return docs.where(~suspect).unionAll(asked.join(dropped, asked[id_col] == dropped["_drop"], "left_anti"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; the columns stay as they are. Ids must be unique or null."""
    found = exact_duplicates(docs, id_col, text_col)
    return drop_ids(docs, found.where(~F.col("kept")).select(F.col(id_col).alias("_drop")).distinct(), id_col)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .base import table

    found = exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)
    return found.withColumnRenamed("digest", "text_sha256")


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
