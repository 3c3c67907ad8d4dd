"""Hamming search: top-k, kNN join, range, approximate candidates, recall.

One semantics everywhere: exact, ascending by (distance, entity_id). A corpus is (entity_id, hv, ...), queries are
(query_id, hv); hv is array<bigint> of one width.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..functions.vectors import stack_words
from ..session import settled

#: Queries that one block of a kNN join holds: 256 codes of 157 words are 321 KB.
QUERY_BLOCK = 256


#: Query codes that are sent to every task at most.
BROADCAST_BYTES = 32 << 20


#: Rows of a corpus that is dealt out evenly before it is searched; a larger one is read where it lies.
DEAL_ROWS = 200_000


def width(df: DataFrame, hv: str = "hv") -> int:
    """Words of the vectors, read from one row; 0 for an empty table."""
    row = df.select(F.size(hv).alias("n")).first()
    return row["n"] if row else 0


def check_k(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be positive")


def with_distance(corpus: DataFrame, query: Column, bits: int) -> DataFrame:
    scored = corpus.select("entity_id", K.hamming("hv", query).alias("distance"))
    return scored.withColumn("similarity", K.similarity("distance", bits))


def search(corpus: DataFrame, query: list[int], k: int = 10, min_similarity: float | None = None) -> DataFrame:
    """(entity_id, distance, similarity) of the k nearest to one query. min_similarity filters the k that were found."""
    check_k(k)
    if min_similarity is not None and not 0 <= min_similarity <= 1:
        raise ValueError("min_similarity must be in [0, 1]")
    literal = F.array(*(F.lit(int(w)).cast("bigint") for w in query))
    top = with_distance(corpus, literal, len(query) * 64).orderBy("distance", "entity_id").limit(k)
    return top if min_similarity is None else top.where(F.col("similarity") >= min_similarity)


def range_search(corpus: DataFrame, query: list[int], max_distance: int) -> DataFrame:
    literal = F.array(*(F.lit(int(w)).cast("bigint") for w in query))
    return with_distance(corpus, literal, len(query) * 64).where(F.col("distance") <= max_distance)


def _rank(pairs: DataFrame, k: int, bits: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "entity_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "entity_id", "distance", K.similarity("distance", bits).alias("similarity"))


_PAIRS = pa.schema([("query_id", pa.int64()), ("entity_id", pa.int64()), ("distance", pa.int64())])


#: Words up to which distances are added word by word; longer codes are added row by row.
FEW_WORDS = 16


def _distances(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Hamming distances, one row a query."""
    words = corpus.shape[1]
    if words <= FEW_WORDS:
        distance, columns = np.zeros((len(queries), len(corpus)), np.uint16), np.ascontiguousarray(corpus.T)
        for at in range(0, len(corpus), 8192):
            for q, query in enumerate(queries):
                out = distance[q, at : at + 8192]
                for w in range(words):
                    out += np.bitwise_count(columns[w, at : at + 8192] ^ query[w])
        return distance
    distance = np.empty((len(queries), len(corpus)), np.int32)
    step = max(128, 20_096 // words)
    for at in range(0, len(corpus), step):  # a part that stays in the cache while all queries pass
        part = corpus[at : at + step]
        mixed, ones = np.empty_like(part), np.empty(part.shape, np.uint8)
        for q in range(len(queries)):
            np.bitwise_xor(part, queries[q], out=mixed)
            np.bitwise_count(mixed, out=ones)
            np.add.reduce(ones, axis=1, dtype=np.int32, out=distance[q, at : at + step])
    return distance


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest and of those as small as the last of them."""
    return np.arange(len(d)) if len(d) <= k else (d <= np.partition(d, k - 1)[k - 1]).nonzero()[0]


class _Exact:
    """The k nearest rows for each query of a block, ties by id, over all parts of a corpus that it meets."""

    def __init__(self, k: int):
        self.k = k

    def start(self, qid: np.ndarray, queries: np.ndarray) -> _Exact:
        self.qid, self.queries = qid, queries
        self.worst = np.full(len(queries), queries.shape[1] * 64, np.int64)
        self.best = tuple(np.empty(0, np.int64) for _ in range(3))  # place of the query, distance, id
        return self

    def candidates(self, corpus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries and rows, and distances: the k nearest of each query, all ties with the last of them, and perhaps others."""
        d = _distances(self.queries, corpus)
        worst, some = self.worst, d[:, : max(1024, 4 * self.k)]
        if some.shape[1] > self.k:  # the k-th of some rows bounds the k-th of all
            worst = np.minimum(worst, np.partition(some, self.k - 1, axis=1)[:, self.k - 1])
        q, row = np.divmod(np.flatnonzero(d <= worst.astype(d.dtype)[:, None]), len(corpus))
        return q, row, d[q, row]

    def meet(self, corpus: np.ndarray, ids: np.ndarray) -> None:
        q, row, d = self.candidates(corpus)
        q, d, e = (np.concatenate([x, y.astype(np.int64)]) for x, y in zip(self.best, (q, d, ids[row])))
        order = np.lexsort((e, d, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(self.queries)))
        kept = np.arange(len(q)) - first[q] < self.k
        self.best = q[kept], d[order][kept], e[order][kept]
        sizes = np.bincount(self.best[0], minlength=len(self.queries))
        full = sizes == self.k
        self.worst[full] = self.best[1][(np.cumsum(sizes) - 1)[full]]

    def rows(self) -> pa.RecordBatch:
        q, d, e = self.best
        return pa.record_batch([pa.array(self.qid[q]), pa.array(e), pa.array(d)], schema=_PAIRS)


class _Sketched(_Exact):
    """The same by sketches: every some-th word of a code. A row whose sketch differs in more bits than the k-th best
    code seen so far makes likely, plus `deviations`, is passed over; the others are compared in full."""

    def __init__(self, k: int, words: int, sketch: int, deviations: float):
        super().__init__(k)
        self.chosen = np.linspace(0, words - 1, min(sketch, words)).astype(int)
        self.deviations = deviations

    def limit(self, distance: float) -> float:
        share, bits = min(0.5, distance / (self.queries.shape[1] * 64)), len(self.chosen) * 64
        return bits * share + self.deviations * max(1.0, (bits * share * (1 - share)) ** 0.5)

    def candidates(self, corpus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rough = _distances(np.ascontiguousarray(self.queries[:, self.chosen]), np.ascontiguousarray(corpus[:, self.chosen]))
        found = []
        for q, query in enumerate(self.queries):
            full = lambda rows: np.bitwise_count(corpus[rows] ^ query).sum(axis=1, dtype=np.int32)  # noqa: E731, B023
            worst = self.worst[q]
            if len(corpus) >= self.k:
                guess = _nearest(rough[q], self.k)
                worst = min(worst, full(guess[np.argsort(rough[q][guess], kind="stable")[: self.k]]).max())
            asked = (rough[q] <= self.limit(worst)).nonzero()[0] if worst < query.size * 64 else np.arange(len(corpus))
            d = full(asked)
            near = _nearest(d, self.k)
            found.append((np.full(len(near), q), asked[near], d[near]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _join(corpus: DataFrame, queries: DataFrame, k: int, words: int, kernel: Callable[[], _Exact]) -> DataFrame:
    """The kernel over every block of queries and every batch or slab of the corpus, then the k best of each query."""
    spark = corpus.sparkSession
    if not words:
        return spark.createDataFrame([], "query_id long, rank int, entity_id long, distance bigint, similarity double")
    schema = "query_id long, entity_id long, distance long"
    if queries.count() * words * 8 <= BROADCAST_BYTES:
        rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "hv").collect()
        if not rows:
            return spark.createDataFrame([], "query_id long, rank int, entity_id long, distance bigint, similarity double")
        shipped = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).view(np.uint64)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shipped.value
            blocks = [kernel().start(qid[at : at + QUERY_BLOCK], q[at : at + QUERY_BLOCK]) for at in range(0, len(q), QUERY_BLOCK)]
            for batch in batches:
                if batch.num_rows:
                    part, ids = stack_words(batch.column(1), batch.num_rows), batch.column(0).to_numpy()
                    for own in blocks:
                        own.meet(part, ids)
            for own in blocks:
                yield own.rows()

        own = corpus.select(F.col("entity_id").cast("long").alias("entity_id"), "hv")
        if corpus.count() <= DEAL_ROWS:
            own = own.repartition(spark.sparkContext.defaultParallelism)  # a small corpus may lie in one file
        return _rank(own.mapInArrow(scan, schema), k, words * 64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid, ids = (np.asarray(batch.column(c)[row].values) for c in (0, 2))
                own = kernel().start(qid, stack_words(batch.column(1)[row].values, len(qid)))
                own.meet(stack_words(batch.column(3)[row].values, len(ids)), ids)
                yield own.rows()

    pairs = _slabs(corpus).join(_blocks(queries))  # rows of hundreds of vectors on either side, each pair once
    return _rank(pairs.select("qid", "qv", "ids", "vs").mapInArrow(meet, schema), k, words * 64)


def knn_join(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, entity_id, distance, similarity): for every query the k nearest of the corpus.

    Queries whose codes take at most BROADCAST_BYTES (counted first) go to every task; the corpus is then read where it
    lies, each task keeps k rows a query and compares QUERY_BLOCK queries with a batch at a time, and only the rows kept are shuffled. More queries are cut into blocks of QUERY_BLOCK and the
    corpus into slabs of SLAB_ROWS; each slab meets each block in the same kernel, so memory holds one of each.
    """
    check_k(k)
    return _join(corpus, queries, k, width(corpus), lambda: _Exact(k))


def ann_join(corpus: DataFrame, queries: DataFrame, k: int = 10, sketch: int = 16, deviations: float = 3.0) -> DataFrame:
    """Approximate kNN, in the shape of knn_join: all rows are compared by `sketch` words of their codes, likely ones in full.

    Bits of a code are independent given a pair, so a sketch of b bits of a pair whose codes differ in a share p of bits
    differs in b*p of them, with deviation sqrt(b*p*(1-p)). A neighbour is missed only if its sketch is off by more than
    `deviations` of these: about one in 700 at 3, whatever the data. Distances of what is found are exact.
    """
    check_k(k)
    words = width(corpus)
    return _join(corpus, queries, k, words, lambda: _Sketched(k, words, sketch, deviations))


def _blocks(queries: DataFrame) -> DataFrame:
    blocks = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.ceil(queries.agg(F.count(F.lit(1))).scalar() / QUERY_BLOCK)))
    return queries.withColumn("_b", blocks).groupBy("_b").agg(F.collect_list(F.struct("query_id", "hv")).alias("q")).select(F.col("q.query_id").alias("qid"), F.col("q.hv").alias("qv"))


#: Corpus rows of a slab: 2,048 codes of 157 words are 2.6 MB.
SLAB_ROWS = 2048


def _slabs(corpus: DataFrame, rows: int | None = None) -> DataFrame:
    slabs = F.pmod(F.xxhash64("entity_id"), F.greatest(F.lit(1), F.ceil(corpus.agg(F.count(F.lit(1))).scalar() / (rows or SLAB_ROWS))))
    return corpus.withColumn("_s", slabs).groupBy("_s").agg(F.collect_list(F.struct("entity_id", "hv")).alias("c")).select(F.col("c.entity_id").alias("ids"), F.col("c.hv").alias("vs"))


def bands_for(share: float, bits: int, recall: float) -> int:
    """Bands of `bits` sampled bits that a pair meets in with this probability, if its codes differ in this share of bits."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** bits))) if 0 < share < 1 else 1


def band_candidates(corpus: DataFrame, queries: DataFrame, bands: int = 24, bits: int = 12, seed: int = 7) -> DataFrame:
    """(query_id, entity_id, q, e) for pairs that agree on all sampled bits of some band: equi-join on (band, value)."""
    words = width(corpus)
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(words * 64, bits, replace=False).tolist() for _ in range(bands)]

    def keys(hv: str) -> Column:
        def value(positions: list[int]) -> Column:
            picked = [F.bit_get(K.get_word(hv, p // 64), F.lit(p % 64)).cast("bigint") * (1 << j) for j, p in enumerate(positions)]
            out = picked[0]
            for x in picked[1:]:
                out = out + x
            return out

        return F.explode(F.array(*(F.struct(F.lit(b).alias("band"), value(p).alias("value")) for b, p in enumerate(chosen))))

    # keys and ids only: vectors are fetched once for each pair that is left
    left = queries.select("query_id", keys("hv").alias("k")).select("query_id", "k.band", "k.value")
    right = corpus.select("entity_id", keys("hv").alias("k")).select("entity_id", "k.band", "k.value")
    pairs = left.join(right, ["band", "value"]).select("query_id", "entity_id").distinct()
    with_query = pairs.join(queries.select("query_id", F.col("hv").alias("q")), "query_id")
    return with_query.join(corpus.select("entity_id", F.col("hv").alias("e")), "entity_id").select("query_id", "entity_id", "q", "e")


class _Bands:
    """Pairs of codes that agree on all sampled bits of some band and differ in max_distance bits at most."""

    def __init__(self, words: int, max_distance: int, recall: float, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        bands = bands_for(max_distance / max(1, words * 64), bits, recall)
        self.chosen = [rng.choice(words * 64, bits, replace=False) for _ in range(bands)]
        self.most = max_distance
        # other pairs differ in more bits than allowed in their first words already
        self.head = min(words, 2 * max_distance // 64 + 8)

    def values(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.chosen), len(codes)), np.int64)
        for band, positions in enumerate(self.chosen):
            for j, p in enumerate(positions):
                out[band] |= (codes[:, p // 64] >> np.uint64(p % 64) & np.uint64(1)).astype(np.int64) << j
        return out

    def pairs(self, left: np.ndarray, right: np.ndarray, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places and distances, a bounded number at a time, each pair once. same: right is left, and pairs are (smaller, larger)."""
        v, w = self.values(left), self.values(right)
        ends = lambda codes: (np.ascontiguousarray(codes[:, : self.head]), np.ascontiguousarray(codes[:, self.head :]))
        (left_head, left_tail), (right_head, right_tail) = ends(left), ends(right)
        differ = lambda a, b: np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)
        for band in range(len(v)):
            order = np.argsort(w[band], kind="stable")
            ranked = w[band][order]
            low = np.searchsorted(ranked, v[band], "left")
            n = np.searchsorted(ranked, v[band], "right") - low
            cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + 1, 1 << 15), "left"))
            for start, stop in zip(cuts, np.append(cuts[1:], len(n))):
                own = n[start:stop]
                x = np.repeat(np.arange(start, stop), own)
                y = order[np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[start:stop], own)]
                if same:
                    x, y = x[x < y], y[x < y]
                d = differ(left_head[x], right_head[y])
                near = d <= self.most
                x, y, d = x[near], y[near], d[near]
                d = d + differ(left_tail[x], right_tail[y])
                new = (d <= self.most) & ~(v[:band, x] == w[:band, y]).any(axis=0)
                if new.any():
                    yield x[new], y[new], d[new]


def band_join(corpus: DataFrame, queries: DataFrame, max_distance: int, recall: float = 0.99, bits: int = 12) -> DataFrame:
    """(query_id, entity_id, distance) of pairs within max_distance, met in bands: for close pairs, where bands are few.

    A pair at max_distance is met with the given probability, closer ones with more; distances are exact. Slabs of queries meet
    slabs of the corpus, and bands are matched inside: codes are written once, whatever the number of bands and pairs.
    """
    words = width(corpus)
    bands = _Bands(words, max_distance, recall, bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, left, other, right in _slab_pairs(batches):
            for x, y, d in bands.pairs(left, right):
                yield pa.record_batch([pa.array(own[x]), pa.array(other[y]), pa.array(d.astype(np.int64))], schema=_PAIRS)

    left = settled(_slabs(queries.withColumnRenamed("query_id", "entity_id"), BAND_ROWS), "queries")
    right = settled(_slabs(corpus, BAND_ROWS), "corpus")
    pairs = left.join(right.select(F.col("ids").alias("ids2"), F.col("vs").alias("vs2")))
    return pairs.mapInArrow(meet, "query_id long, entity_id long, distance long")


#: Codes of a slab of a join in bands: 4,096 of 157 words are 5.1 MB.
BAND_ROWS = 4096


def _slab_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids and codes of either side, from rows of two slabs."""
    for batch in batches:
        for row in range(batch.num_rows):
            own, other = (np.asarray(batch.column(c)[row].values) for c in (0, 2))
            yield own, stack_words(batch.column(1)[row].values, len(own)), other, stack_words(batch.column(3)[row].values, len(other))


def band_classes(corpus: DataFrame, max_distance: int, recall: float = 0.99, bits: int = 12) -> DataFrame:
    """(entity_id, n_links, class_id) per row of the corpus: the pairs of band_join(corpus, corpus), without writing them.

    n_links: other rows linked directly; class_id: the smallest entity_id reachable by links, itself included. Equal codes of a slab
    are compared once, and a pair of slabs gives a count for each row and one link for each row that isn't the first of its class there.
    """
    words = width(corpus)
    if not words:
        return corpus.sparkSession.createDataFrame([], "entity_id long, n_links long, class_id long")
    bands = _Bands(words, max_distance, recall, bits)
    shape = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, left, other, right in _slab_pairs(batches):
            same = own[0] == other[0]
            ids = own if same else np.concatenate([own, other])
            # of equal codes on a side the first stands for all
            kind = lambda v: np.unique(np.ascontiguousarray(v).view(f"V{words * 8}").ravel(), return_index=True, return_inverse=True, return_counts=True)
            _, at, which, copies = kind(left)
            at2, which2, copies2 = (at, which, copies) if same else kind(right)[1:]
            n, n2 = np.zeros(len(at), np.int64), np.zeros(len(at2), np.int64)
            if same:
                n += copies - 1
            links = [(np.arange(len(left)), at[which])] + ([] if same else [(np.arange(len(left), len(ids)), len(left) + at2[which2])])
            for x, y, _ in bands.pairs(left[at], right[at2], same):
                np.add.at(n, x, copies2[y])
                np.add.at(n if same else n2, y, copies[x])
                links.append((at[x], at2[y] + (0 if same else len(left))))
                if sum(len(a) for a, _ in links) > 1 << 20:
                    links = _stars(ids, links)
            (member, low), = _stars(ids, links)
            counts = n[which] if same else np.concatenate([n[which], n2[which2]])
            smallest = ids.copy()
            smallest[member] = ids[low]
            held = (counts > 0) | (smallest != ids)
            yield pa.record_batch([pa.array(ids[held]), pa.array(counts[held]), pa.array(smallest[held])], schema=shape)

    slabs = settled(_slabs(corpus, BAND_ROWS).withColumn("least", F.array_min("ids")), "slabs")
    pairs = slabs.alias("l").join(slabs.alias("r"), F.col("l.least") <= F.col("r.least"))
    found = settled(pairs.select("l.ids", "l.vs", F.col("r.ids").alias("ids2"), F.col("r.vs").alias("vs2")).mapInArrow(meet, "node long, n long, low long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    labels = _classes(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    ids = corpus.select(F.col("entity_id").cast("long").alias("entity_id"))
    joined = ids.join(counts, F.col("entity_id") == F.col("node"), "left").drop("node").join(labels, F.col("entity_id") == F.col("node"), "left")
    return joined.select("entity_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "entity_id").alias("class_id"))


def _stars(ids: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The links (places of ids) as one star a class: each place with the place of the smallest id that it reaches."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    a, b = (rank[np.concatenate(x)] for x in zip(*links))
    label = np.arange(len(ids))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        for places in (label[a], label[b], a, b):
            np.minimum.at(label, places, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return [(order, order[label])]


def _classes(links: DataFrame) -> DataFrame:
    """(node, label) of each node of the links (a, b): the smallest node that it reaches. Labels are passed on and followed until none moves."""
    both = settled(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = settled(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "low").alias("low"))
        up = new.select(F.col("node").alias("_n"), F.col("low").alias("_up"))
        new = settled(new.join(up, F.col("low") == F.col("_n")).select("node", "label", F.least("low", "_up").alias("low")), "labels")
        moved = not new.where("label <> low").isEmpty()
        labels = new.select("node", F.col("low").alias("label"))
        if not moved:
            return labels


def recall_at(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hits, wanted and recall of results (query_id, rank, entity_id) against truth (query_id, entity_id) at rank k."""
    found = results.where(F.col("rank") <= k).select("query_id", "entity_id", F.lit(1).alias("hit"))
    joined = truth.select("query_id", "entity_id").distinct().join(found, ["query_id", "entity_id"], "left")
    return joined.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("wanted")).withColumn("recall", F.col("hits") / F.col("wanted"))
