"""SimHash near-deduplication with bit-sliced comparison.

Fingerprints are made in Arrow batches from the whole text. Documents with one fingerprint form a class
at once (a distributed aggregation), so only distinct fingerprints are compared. Candidates meet in
buckets: with radius r, the bits are cut into blocks and every choice of blocks - r blocks is a key, so
two fingerprints within r differing bits share a key for certain (pigeonhole). For a wide radius, where
that is of no use, keys are sampled bits, as many tables as the wanted recall needs.

Inside a task the rows of many buckets lie side by side as bit planes: plane j holds bit j of 64 rows a
word. A comparison XORs planes and adds them into carry-save counters, one bit of the count a plane, so
64 distances advance with each machine word. Counters start at such a value that the last carry
appears when the radius is exceeded; blocks with nothing but exceeded lanes are dropped between planes.
Only a spanning forest of a task's links leaves it, never all pairs of a group. Where similarity is to be computed in
full, the sets of word runs follow the documents to the cells where a pair within the radius is met, and every such pair is compared there.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, grouped, map_arrow, materialise, spread, table
from .components import LINKS, components, forest, thin
from .exact_dedup import bits_for, drop_ids, in_bitmap, keys_bitmap

SEED = 42
#: Rows of a bucket that one chunk of a hot bucket holds at most, about.
CELL_ROWS = 512
#: Rows that a bucket of sampled bits holds on average, about: comparisons are cheap, so few wide keys save shuffling.
BUCKET_ROWS = 512
#: Rows of whole cells that are compared at a time with their sets of runs, about.
SET_ROWS = 1024
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str | None, size: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words of the text, A-Z lower-cased; fewer words make one run, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only x20 and x09-x0D
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words)] if len(words) <= size else [b" ".join(x) for x in zip(*(words[i:] for i in range(size)))]
    found = np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in runs]), ">u8").astype(np.uint64)
    return np.unique(found) if distinct else found


def widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """Rows of `words` 64-bit hashes: the given one, then mixes of it (SplitMix64 steps)."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        z = hashes + np.uint64(_STEP * k & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """Words of 64 bits; a bit is 1 if set in over half the hashes. No hashes: zero."""
    words = bits // 64
    if not len(hashes):
        return np.zeros(words, np.uint64)
    counts = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 4096):
        wide = widen(hashes[at : at + 4096], words)
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 64, distinct: bool = False) -> DataFrame:
    """(id_col, fp: binary, little-endian words) per row of docs; null text counts as empty."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(shingle_hashes(t.as_py(), size, distinct), bits).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], schema=arrow_schema(schema))

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(src, run, schema).withColumnRenamed("id", id_col)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(rows, words) of uint64 -> (bits, ceil(rows/64)) bit planes."""
    rows, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").T
    out = np.zeros((words * 64, -(-rows // 64) * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


class Counters:
    """Carry-save counters over arrays of lanes; `over` has a bit for each lane beyond the radius."""

    def __init__(self, radius: int, over: np.ndarray):
        width = max(1, radius.bit_length() if radius & (radius + 1) else (radius + 1).bit_length() - 1)
        start = (1 << width) - 1 - radius
        self.digits = [np.full_like(over, FULL if start >> k & 1 else 0) for k in range(width)]
        self.over = over

    def add(self, x: np.ndarray) -> None:
        for k, digit in enumerate(self.digits):
            carry = digit & x
            self.digits[k] = digit ^ x
            x = carry
        self.over |= x

    def take(self, keep: np.ndarray) -> None:
        self.digits = [d[keep] for d in self.digits]
        self.over = self.over[keep]


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, lane within it) of every zero bit."""
    bits = np.unpackbits((~words).view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
    return bits.nonzero()


def near_in_small_groups(planes: np.ndarray, group_end: np.ndarray, rows: int, radius: int) -> tuple[list, list]:
    """Pairs of rows (i, i+s) of one group within the radius, for every shift s; group_end[i]: end of the group of row i."""
    left, right = [], []
    room = group_end - np.arange(rows)
    for shift in range(1, int(room.max(initial=1))):
        valid = np.zeros(planes.shape[1] * 64, np.uint8)
        valid[:rows] = room > shift
        lanes = np.packbits(valid, bitorder="little").view(np.uint64)
        at = lanes.nonzero()[0]
        if not len(at):
            break
        count = Counters(radius, ~lanes[at])
        up, by = at + (shift >> 6), np.uint64(shift & 63)
        top = planes.shape[1] - 1
        for j in range(len(planes)):
            plane = planes[j]
            moved = plane[np.minimum(up, top)] >> by
            if by:
                moved |= plane[np.minimum(up + 1, top)] << (np.uint64(64) - by)
            count.add(plane[at] ^ moved)
            if j % 8 == 7 and j + 1 < len(planes):
                alive = count.over != FULL
                if not alive.all():
                    count.take(alive)
                    at, up = at[alive], up[alive]
                    if not len(at):
                        break
        if len(at):
            word, lane = _lanes(count.over)
            i = at[word] * 64 + lane
            left.append(i)
            right.append(i + shift)
    return left, right


def near_in_large_group(fps: np.ndarray, radius: int, base: int) -> tuple[list, list]:
    """Pairs of rows of one group within the radius: blocks of queries against all planes of the group."""
    rows = len(fps)
    planes = planes_of(fps)
    words = planes.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").astype(bool)
    left, right = [], []
    step = max(1, (1 << 15) // words)
    for q in range(0, rows, step):
        mine = np.arange(q, min(rows, q + step))
        # lanes beyond the query only: each pair once
        valid = np.arange(words * 64)[None, :] > mine[:, None]
        valid &= np.arange(words * 64)[None, :] < rows
        over = ~np.packbits(valid, axis=1, bitorder="little").view(np.uint64)
        flat_q, flat_w = (over != FULL).nonzero()
        count = Counters(radius, over[flat_q, flat_w])
        for j in range(len(planes)):
            flip = np.where(bits[mine, j], FULL, np.uint64(0))
            count.add(planes[j][flat_w] ^ flip[flat_q])
            if j % 8 == 7 and j + 1 < len(planes):
                alive = count.over != FULL
                if not alive.all():
                    count.take(alive)
                    flat_q, flat_w = flat_q[alive], flat_w[alive]
                    if not len(flat_q):
                        break
        if len(flat_q):
            word, lane = _lanes(count.over)
            left.append(base + mine[flat_q[word]])
            right.append(base + flat_w[word] * 64 + lane)
    return left, right


def near_pairs(fps: np.ndarray, starts: np.ndarray, radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j), i < j, of one group and within the radius. starts: first row of each group, ascending."""
    rows = len(fps)
    ends = np.append(starts[1:], rows)
    sizes = ends - starts
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for s, e in zip(starts[sizes > small], ends[sizes > small]):
        a, b = near_in_large_group(fps[s:e], radius, int(s))
        left += a
        right += b
    few = np.repeat((sizes > 1) & (sizes <= small), sizes)
    if few.any():
        where = few.nonzero()[0]
        kept = sizes[(sizes > 1) & (sizes <= small)]
        end = np.repeat(np.cumsum(kept), kept)
        a, b = near_in_small_groups(planes_of(fps[where]), end, len(where), radius)
        left += [where[x] for x in a]
        right += [where[x] for x in b]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def pigeonhole_keys(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """Bit positions of each key: fingerprints within the radius agree on all bits of at least one key."""
    cut = [list(range(bits * b // blocks, bits * (b + 1) // blocks)) for b in range(blocks)]
    return [sum((cut[b] for b in chosen), []) for chosen in itertools.combinations(range(blocks), blocks - radius)]


def tables_for(bits: int, width: int, differ: float, recall: float) -> int:
    """Keys of `width` sampled bits that meet a pair with the given recall, over the spread of its number of differing bits (binomial)."""
    chance = [(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k), math.comb(bits - k, width) / math.comb(bits, width)) for k in range(bits - width + 1)]
    tables = 1
    while sum(p * (1 - (1 - q) ** tables) for p, q in chance) < recall:
        tables += 1
    return tables


def sampled_keys(bits: int, width: int, differ: float, recall: float) -> list[list[int]]:
    """Bit positions of as many keys as find a pair with an expected share `differ` of differing bits with the given recall."""
    rng = np.random.default_rng(SEED)
    return [sorted(rng.choice(bits, width, replace=False).tolist()) for _ in range(tables_for(bits, width, differ, recall))]


def _keyed(fps: DataFrame, keys: list[list[int]], words: int) -> DataFrame:
    """(fp, node, bucket): a row for each fingerprint and key."""
    schema = "bucket long, node long, fp binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1)
            fp = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(-1, words)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
            for number, positions in enumerate(keys):
                packed = np.zeros((len(fp), 8), np.uint8)
                chosen = np.packbits(bits[:, positions], axis=1, bitorder="little")
                packed[:, : chosen.shape[1]] = chosen
                bucket = packed.view(np.uint64)[:, 0] | np.uint64(number << 56)
                yield pa.record_batch([pa.array(bucket.view(np.int64)), batch.column(0), raw], schema=shape)

    return map_arrow(fps.select("node", "fp"), run, schema)


def _links(cells: DataFrame, radius: int, words: int) -> DataFrame:
    """(a, b): links that join what is within the radius in each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(LINKS)
        for part in grouped(batches, "cell", 1 << 14):
            cell = part.column("cell").to_numpy()
            node = part.column("node").to_numpy()
            fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint64).reshape(-1, words)
            starts = np.append(0, (cell[1:] != cell[:-1]).nonzero()[0] + 1)
            i, j = near_pairs(fp, starts, radius)
            a, b = forest(node[i], node[j])
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=shape)

    return map_arrow(cells.select("cell", "node", "fp"), lambda batches: thin(run(batches)), LINKS)


def masks_of(keys: list[list[int]], words: int) -> np.ndarray:
    """A row of `words` 64-bit words for each key, with the bits that it takes."""
    bits = np.zeros((len(keys), words * 64), np.uint8)
    for number, positions in enumerate(keys):
        bits[number, positions] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def first_met(part: pa.Table, radius: int, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs within the radius in the cells of a table, cell by cell. Each pair comes in one cell of all: the one of
    the first key that both share, and of their two chunks. part: rows (cell, bucket, chunk, node, fp) in order of cell."""
    cell, chunk = part.column("cell").to_numpy(), part.column("chunk").to_numpy()
    number = (part.column("bucket").to_numpy().view(np.uint64) >> np.uint64(56)).astype(np.int64)
    fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint64).reshape(len(cell), -1)
    starts = np.append(0, (cell[1:] != cell[:-1]).nonzero()[0] + 1)
    ends = np.append(starts[1:], len(cell))
    mixed = np.repeat(np.minimum.reduceat(chunk, starts) != np.maximum.reduceat(chunk, starts), ends - starts)
    # large cells one by one, small ones together: the pairs of a few hundred thousand rows are never held at once
    cuts = [0, *((ends[:-1] // CELL_ROWS != ends[1:] // CELL_ROWS).nonzero()[0] + 1).tolist(), len(starts)]
    for low, high in zip(cuts, cuts[1:]):
        if low == high:
            continue
        base, end = starts[low], ends[high - 1]
        i, j = near_pairs(fp[base:end], starts[low:high] - base, radius)
        i, j = i + base, j + base
        new = ~mixed[i] | (chunk[i] != chunk[j])
        i, j = i[new], j[new]
        for at in range(0, len(i), 1 << 17):
            x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            for k, mask in enumerate(masks):
                if not len(x):
                    break
                new = (number[x] <= k) | ((fp[x] ^ fp[y]) & mask).any(axis=1)
                x, y = x[new], y[new]
            if len(x):
                yield x, y


def similar(i: np.ndarray, j: np.ndarray, values: np.ndarray, offsets: np.ndarray, jaccard: float) -> np.ndarray:
    """Of pairs (i, j) of sets, which have this Jaccard similarity or more. Set k: distinct values[offsets[k]:offsets[k+1]], small whole numbers."""
    sizes = np.diff(offsets)
    held = np.zeros(len(i), bool)
    able = (np.minimum(sizes[i], sizes[j]) >= jaccard * np.maximum(sizes[i], sizes[j])).nonzero()[0]  # else they can't be
    able = able[np.argsort(i[able], kind="stable")]
    marked = np.zeros(int(values.max(initial=0)) + 1, bool)
    for own in np.split(able, (np.diff(i[able]) != 0).nonzero()[0] + 1):
        if not len(own):
            continue
        mine = values[offsets[i[own[0]]] : offsets[i[own[0]] + 1]]
        marked[mine] = True
        for at in range(0, len(own), 256):
            some = own[at : at + 256]
            other = j[some]
            common = np.array([np.count_nonzero(marked[values[offsets[o] : offsets[o + 1]]]) for o in other.tolist()])
            held[some] = common >= jaccard * (len(mine) + sizes[other] - common)
        marked[mine] = False
    return held


def run_sets(docs: DataFrame, id_col: str, text_col: str, size: int, nodes: DataFrame) -> DataFrame:
    """(id, runs: array<long>): the set of word runs of each document whose id is among nodes (column node, distinct).

    Only such documents are read for their runs: a bitmap sized by their number lets few others through.
    """
    nodes = materialise(nodes, "nodes", narrow=True)
    bits = bits_for(nodes.count())
    near = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(in_bitmap(keys_bitmap(nodes, "node", bits=bits), F.col("id"), bits=bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema("id long, runs array<long>")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                runs = [shingle_hashes(t.as_py(), size, True).view(np.int64) for t in part.column(1)]
                offsets = np.append(0, np.cumsum([len(x) for x in runs])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(runs)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], schema=shape)

    sets = map_arrow(near, run, "id long, runs array<long>")
    return materialise(sets.join(nodes, F.col("id") == F.col("node"), "left_semi"), "runs")


def _similar_links(cells: DataFrame, radius: int, masks: np.ndarray, sets: Callable[[DataFrame], DataFrame], jaccard: float) -> DataFrame:
    """(a, b): links that join what is within the radius in each cell and has this Jaccard similarity of its sets, computed in full for every pair.

    First the rows are found that have such a pair; only they go on with their sets.
    """
    rows = "cell long, bucket long, chunk int, node long, fp binary"

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(rows)
        for part in grouped(batches, "cell", 1 << 12):
            asked = np.zeros(part.num_rows, bool)
            for i, j in first_met(part, radius, masks):
                asked[i] = asked[j] = True
            for batch in part.filter(pa.array(asked)).to_batches():
                yield batch.cast(shape)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(LINKS)
        for part in grouped(batches, "cell", SET_ROWS):
            node, runs = part.column("node").to_numpy(), part.column("runs").combine_chunks()
            runs = runs if isinstance(runs, pa.ListArray) else pa.concat_arrays(runs.chunks)
            offsets = runs.offsets.to_numpy().astype(np.int64)
            _, values = np.unique(runs.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)
            for i, j in first_met(part, radius, masks):
                good = similar(i, j, values, offsets - offsets[0], jaccard)
                a, b = forest(node[i[good]], node[j[good]])
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], schema=shape)

    some = materialise(map_arrow(cells.select("cell", "bucket", "chunk", "node", "fp"), paired, rows), "paired")
    own = sets(some.select("node").distinct())
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = some.join(own, F.col("node") == F.col("id")).drop("id").repartition(tasks, "cell").sortWithinPartitions("cell", "node")
    return map_arrow(both, lambda batches: thin(compare(batches)), LINKS)


def near_classes(fps: DataFrame, id_col: str, radius: int, bits: int = 64, differ: float | None = None, recall: float = 0.95, sets: Callable[[DataFrame], DataFrame] | None = None, jaccard: float = 0.0) -> DataFrame:
    """(id_col, fp, component_id) for rows (id_col, fp): component_id is the smallest id reachable by links of at most `radius` bits.

    Rows with one fingerprint are linked. Without `differ` the search is exact (pigeonhole); with it, a pair
    whose share of differing bits is `differ` is met with probability `recall` or more. Key widths follow the
    number of distinct fingerprints, so that buckets keep their size as the input grows; hot buckets are spread
    over cells. sets, if given, gets nodes and gives their sets (id, runs): links are then the pairs met that also have this Jaccard similarity. Rows with a null id form the class of the other rows with their fingerprint, or a class with a null id.
    """
    spark = fps.sparkSession
    classes = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("node")), "classes", narrow=True)
    alone = classes.where("node is not null")
    count = max(1, alone.count())
    if differ is None:
        blocks = radius + 1 if count < 1 << 22 else radius + 2 if count < 1 << 30 else radius + 3
        keys = pigeonhole_keys(bits, radius, blocks)
    else:
        keys = sampled_keys(bits, min(48, max(6, round(math.log2(count / BUCKET_ROWS)))), differ, recall)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(alone.repartition(tasks), keys, bits // 64)
    cells = spread(materialise(keyed, "keyed"), "bucket", "node", CELL_ROWS if differ is None else 2 * BUCKET_ROWS)
    cells = cells.select("cell", "bucket", "chunk", "node", "fp") if sets else cells.select("cell", "node", "fp")
    cells = cells.repartition(tasks, "cell").sortWithinPartitions("cell", "node")
    links = _similar_links(cells, radius, masks_of(keys, bits // 64), sets, jaccard) if sets else _links(cells, radius, bits // 64)
    # stored first: a stage that reads and one that thins again would keep twice as many Python workers alive
    labels = components(materialise(links, "met"))
    found = classes.join(labels, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    found = materialise(found, "found", narrow=True)
    return fps.join(found, fps["fp"] == found["_fp"], "left").select(id_col, "fp", "component_id")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, fingerprint: 16 hex digits, component_id) per row of docs, by 64-bit SimHash over shingles of `size` words.

    Exact: no link within the radius is missed. Null or empty texts have fingerprint zero and are linked
    like any other; repeated rows are in one class; other columns are ignored. Ids must be of type long.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, size), "fps")
    found = near_classes(fps, id_col, radius)
    return found.select(id_col, _hex64("fp").alias("fingerprint"), "component_id")


def _hex64(col: str):
    """Hex digits of one little-endian 64-bit word, most significant first."""
    digits = F.lower(F.hex(col))
    return F.concat(*[F.substring(digits, at, 2) for at in range(15, 0, -2)])


#: The pipeline's setting: 256 bits over distinct runs of five words. At Jaccard similarity J the share of
#: differing bits is arccos(2J/(1+J))/pi for sets of like size: 0.151 at 0.8. The radius stands 3 deviations above
#: that, and the keys meet 99.5% of such pairs; the similarity of every pair met is then computed, so neither costs precision.
NEAR_BITS, NEAR_SIZE, NEAR_DIFFER, NEAR_RADIUS, NEAR_RECALL, NEAR_JACCARD = 256, 5, 0.151, 56, 0.995, 0.8


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group (the smallest id); columns stay as they are.

    Five-word shingles, Jaccard similarity of 0.8 or more. Rows with a null id stay. Documents without words are duplicates
    of each other. Ids must be of type long and unique or null.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, NEAR_SIZE, NEAR_BITS, distinct=True), "fps")
    found = near_classes(fps, id_col, NEAR_RADIUS, NEAR_BITS, NEAR_DIFFER, NEAR_RECALL, sets=lambda nodes: run_sets(docs, id_col, text_col, NEAR_SIZE, nodes), jaccard=NEAR_JACCARD)
    return drop_ids(docs, found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_drop")).distinct(), id_col)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))
