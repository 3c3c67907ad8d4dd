"""Client surface: immutable query builders, a declarative repository, events, metrics, errors.

Everything ends in a lazy DataFrame; execute_async runs the action in a thread of its own.
"""

from __future__ import annotations

import functools
import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import kernel as K
from .operators import edges as E
from .operators import reason as R
from .operators import search as S
from .sources.store import Store

DEFAULT_K = 10


# ---- errors
class HypervectorError(Exception):
    """Base of the client's errors."""


class ConnectionFailed(HypervectorError):
    pass


class EntityNotFound(HypervectorError):
    def __init__(self, entity_id: int | None, message: str = ""):
        super().__init__(message or f"entity not found: id={entity_id}")
        self.entity_id = entity_id


class CapacityExceeded(HypervectorError):
    pass


class ChainBroke(HypervectorError):
    def __init__(self, failed_hop: int, path: Sequence[int]):
        super().__init__(f"no edge at hop {failed_hop}")
        self.failed_hop, self.path = failed_hop, tuple(path)


def translate(status: str, message: str) -> HypervectorError:
    """An error for a status name and a message."""
    if status in ("UNAVAILABLE", "DEADLINE_EXCEEDED"):
        return ConnectionFailed(message)
    if status == "RESOURCE_EXHAUSTED":
        return CapacityExceeded(message)
    if status == "INVALID_ARGUMENT" and (m := re.search(r"id=(-?\d+)", message)):
        return EntityNotFound(int(m[1]), message)
    return HypervectorError(message)


# ---- ids
Resolver = Callable[[Column], Column]


def for_relations(resolver: Resolver = K.entity_id) -> Resolver:
    return lambda name: resolver(F.concat(F.lit("REL:"), name))


def local_id(name: str, resolver: Resolver = K.entity_id, spark=None) -> int:
    """The id of one name. The default resolver needs no session."""
    if resolver is K.entity_id:
        import hashlib

        return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF
    return spark.range(1).select(resolver(F.lit(name)).alias("id")).first()["id"]


@dataclass(frozen=True)
class Entity:
    """Equal by id alone."""

    id: int
    name: str | None = field(default=None, compare=False)
    embedding: tuple[float, ...] | None = field(default=None, compare=False)
    metadata: tuple[tuple[str, str], ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class Edge:
    subject: Entity
    relation: str
    object: Entity

    def __post_init__(self):
        if not self.relation or not self.relation.strip():
            raise ValueError("an edge needs a relation")


# ---- events and metrics
@dataclass(frozen=True)
class Event:
    kind: str
    operation: str
    seconds: float = 0.0
    count: int | None = None


@dataclass
class Metrics:
    """Timings per operation, batch sizes and failures."""

    seconds: dict[str, list[float]] = field(default_factory=dict)
    batch_sizes: list[int] = field(default_factory=list)
    failures: int = 0

    def record(self, operation: str, seconds: float) -> None:
        self.seconds.setdefault(operation, []).append(seconds)

    def table(self, spark) -> DataFrame:
        """(operation, calls, p50, p95, max) by Spark's percentiles."""
        rows = [(op, float(x)) for op, own in self.seconds.items() for x in own]
        df = spark.createDataFrame(rows, "operation string, seconds double")
        return df.groupBy("operation").agg(F.count(F.lit(1)).alias("calls"), F.percentile_approx("seconds", 0.5).alias("p50"), F.percentile_approx("seconds", 0.95).alias("p95"), F.max("seconds").alias("max"))


# ---- builders
@dataclass(frozen=True)
class _Query:
    client: Client
    k: int = DEFAULT_K

    def top_k(self, k: int):
        S.check_k(k)
        return replace(self, k=k)

    def _run(self, operation: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.client._timed(operation, make)

    def ids(self) -> DataFrame:
        """The ids alone, in order of rank."""
        out = self.execute()
        return out.select("object_id" if "object_id" in out.columns else "entity_id")

    def execute(self) -> DataFrame:
        raise NotImplementedError

    def execute_async(self) -> Future:
        return self.client.pool.submit(lambda: self.execute().collect())


@dataclass(frozen=True)
class Search(_Query):
    vector: tuple[float, ...] | None = None
    hv: tuple[int, ...] | None = None
    threshold: float | None = None

    def min_similarity(self, t: float) -> Search:
        if not 0 <= t <= 1:
            raise ValueError("min_similarity must be in [0, 1]")
        return replace(self, threshold=t)

    def execute(self) -> DataFrame:
        def make() -> DataFrame:
            words = list(self.hv) if self.hv is not None else self.client.encode_one(self.vector)
            return S.search(self.client.store.corpus(), words, self.k, self.threshold)

        return self._run("search", make)


@dataclass(frozen=True)
class Chain(_Query):
    start: int | None = None
    relations: tuple[int, ...] = ()
    approximate: bool = False

    def via(self, relation: str | int) -> Chain:
        return replace(self, relations=(*self.relations, self.client.relation(relation)))

    def approx(self) -> Chain:
        return replace(self, approximate=True)

    def _starts(self) -> DataFrame:
        return self.client.spark.createDataFrame([(0, self.start)], "query_id bigint, entity_id bigint")

    def execute(self) -> DataFrame:
        if not self.relations:
            raise ValueError("a chain needs a relation")
        store = self.client.store
        if self.approximate:
            return self._run("chain", lambda: R.chain_approx(self._starts(), self.relations, store.edges(), store.entities(), store.corpus(), self.k))
        return self._run("chain", lambda: E.chain(self._starts(), self.relations, store.edges()))

    def path(self) -> DataFrame:
        """hop_1 ... hop_n; null from the hop that has no edge on."""
        return E.chain(self._starts(), self.relations, self.client.store.edges(), path=True)

    def require(self) -> list[int]:
        """The path as ids; ChainBroke if a hop has no edge."""
        row = self.path().first()
        hops = [row[f"hop_{n}"] for n in range(1, len(self.relations) + 1)]
        if None in hops:
            raise ChainBroke(hops.index(None) + 1, hops[: hops.index(None)])
        return hops


@dataclass(frozen=True)
class Hop(_Query):
    start: int | None = None
    relation_id: int | None = None

    def execute(self) -> DataFrame:
        store = self.client.store
        asked = self.client.spark.createDataFrame([(0, self.start, self.relation_id)], "query_id bigint, subject bigint, relation bigint")
        return self._run("hop", lambda: R.typed_relation(asked, store.edges(), store.entities(), store.corpus(), self.k))


@dataclass(frozen=True)
class Relation(_Query):
    relation_id: int | None = None
    object_id: int | None = None

    def execute(self) -> DataFrame:
        store = self.client.store
        asked = self.client.spark.createDataFrame([(0, self.relation_id, self.object_id)], "query_id bigint, relation bigint, object bigint")
        return self._run("relation", lambda: R.relation_decode(asked, store.entities(), store.corpus(), self.k))


@dataclass(frozen=True)
class Bundle(_Query):
    members: tuple[int, ...] = ()

    def execute(self) -> DataFrame:
        if len(self.members) < 2:
            raise ValueError("a bundle needs two members")
        store = self.client.store
        rows = self.client.spark.createDataFrame([(0, m) for m in self.members], "query_id bigint, entity_id bigint")
        return self._run("bundle", lambda: R.set_query(rows, store.entities(), store.corpus(), self.k))


@dataclass(frozen=True)
class Analogy(_Query):
    a: int | None = None
    b: int | None = None
    c: int | None = None

    def is_to(self, other: str | int) -> Analogy:
        return replace(self, b=self.client.entity(other))

    def as_(self, other: str | int) -> Analogy:
        return replace(self, c=self.client.entity(other))

    def execute(self) -> DataFrame:
        if self.b is None or self.c is None:
            raise ValueError("an analogy needs is_to and as_")
        store = self.client.store
        asked = self.client.spark.createDataFrame([(0, self.a, self.b, self.c)], "query_id bigint, a bigint, b bigint, c bigint")
        return self._run("analogy", lambda: R.analogy(asked, store.entities(), store.corpus(), self.k))


class Client:
    """Queries and writes on a store; names become ids through the resolver."""

    def __init__(self, store: Store, resolver: Resolver = K.entity_id, watch=None):
        self.store, self.spark, self.resolver, self.watch = store, store.spark, resolver, watch
        self.metrics, self.listeners = Metrics(), []
        self.pool = ThreadPoolExecutor(4)

    # names
    def entity(self, name: str | int) -> int:
        return name if isinstance(name, int) else local_id(name, self.resolver, self.spark)

    def relation(self, name: str | int) -> int:
        return name if isinstance(name, int) else local_id(f"REL:{name}", self.resolver, self.spark)

    def encode_one(self, vector: Sequence[float]) -> list[int]:
        from .functions.vectors import matrix, pack

        if len(vector) != self.store.config.dims:
            raise ValueError(f"vectors must have {self.store.config.dims} dimensions")
        return pack(np.asarray([vector], np.float64), matrix(self.store.config))[0].tolist()

    # queries
    def search(self, vector: Sequence[float]) -> Search:
        return Search(self, vector=tuple(vector))

    def search_binary(self, hv: Sequence[int]) -> Search:
        if len(hv) != self.store.config.words:
            raise ValueError(f"vectors must have {self.store.config.words} words")
        return Search(self, hv=tuple(hv))

    def from_(self, start: str | int) -> Chain:
        return Chain(self, start=self.entity(start))

    def hop(self, start: str | int, relation: str | int) -> Hop:
        return Hop(self, start=self.entity(start), relation_id=self.relation(relation))

    def relation_of(self, relation: str | int, object_: str | int) -> Relation:
        return Relation(self, relation_id=self.relation(relation), object_id=self.entity(object_))

    def bundle(self, *members: str | int) -> Bundle:
        return Bundle(self, members=tuple(map(self.entity, members)))

    def analogy(self, a: str | int) -> Analogy:
        return Analogy(self, a=self.entity(a))

    # writes
    def save(self, rows: DataFrame, vector: str = "embedding") -> None:
        """Stores float vectors, then checks the watchpoints on them."""
        self._timed("save", lambda: self.store.put_float(rows, vector))
        if self.watch is not None:
            self.watch.deliver(self.watch.check(rows.select("entity_id", F.col(vector).alias("embedding"))))
        self._tell(Event("saved", "save"))

    def save_batch(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """Stores what is valid, gives what isn't; only stored rows reach the watchpoints."""
        bad = self._timed("save_batch", lambda: self.store.put_batch(rows, vector))
        total, failed = rows.count(), bad.count()
        self.metrics.batch_sizes.append(total)
        self.metrics.failures += failed
        if self.watch is not None:
            good = rows.join(bad.select(F.col("entity_id").alias("_b")), F.col("entity_id").eqNullSafe(F.col("_b")), "left_anti")
            self.watch.deliver(self.watch.check(good.select("entity_id", F.col(vector).alias("embedding"))))
        self._tell(Event("batch_completed", "save_batch", count=total - failed))
        return bad

    def save_edges(self, rows: DataFrame, strict: bool = False) -> DataFrame:
        bad = self._timed("save_edges", lambda: self.store.put_edges(rows, strict=strict))
        self.metrics.batch_sizes.append(rows.count())
        return bad

    def delete(self, ids: DataFrame) -> None:
        self._timed("delete", lambda: self.store.retract(ids))
        self._tell(Event("deleted", "delete"))

    # state
    def status(self) -> DataFrame:
        return self.store.status()

    def ping(self) -> bool:
        return self.store.ping()

    def health(self, ttl: float = 10.0) -> bool:
        """ping, asked again only after ttl seconds."""
        at, value = getattr(self, "_health", (float("-inf"), False))
        if time.monotonic() - at >= ttl:
            value = self.ping()
            self._health = (time.monotonic(), value)
        return value

    def _timed(self, operation: str, make: Callable[[], Any]) -> Any:
        began = time.perf_counter()
        out = make()
        took = time.perf_counter() - began
        self.metrics.record(operation, took)
        self._tell(Event("executed", operation, took))
        return out

    def _tell(self, event: Event) -> None:
        for listener in self.listeners:
            listener(event)


# ---- declarative repository
def _marked(kind: str, **how) -> Callable:
    def add(fn: Callable) -> Callable:
        fn._query = (kind, how)
        return fn

    return add


def chain(*relations: str) -> Callable:
    return _marked("chain", relations=relations)


def hop(relation: str) -> Callable:
    return _marked("hop", relation=relation)


def analogy() -> Callable:
    return _marked("analogy")


def bundle() -> Callable:
    return _marked("bundle")


def relation(name: str) -> Callable:
    return _marked("relation", relation=name)


def _extra(name: str) -> Callable:
    def of(value: Any) -> Callable:
        def add(fn: Callable) -> Callable:
            fn._extras = {**getattr(fn, "_extras", {}), name: value}
            return fn

        return add

    return of


top_k, min_similarity, projection, circuit_breaker = map(_extra, ("k", "min_similarity", "projection", "fallback"))


def derived(name: str) -> tuple[str, list[str]] | None:
    """A query from a method's name: find_by_relation_<x>_from, find_by_chain_<a>_and_<b>, or the camel-case forms."""
    if m := re.fullmatch(r"findByRelation(\w+)From", name):
        return "hop", [m[1][0].lower() + m[1][1:]]
    if m := re.fullmatch(r"findByChain(\w+)", name):
        parts = [p[0].lower() + p[1:] for p in re.split(r"And(?=[A-Z])", m[1]) if p]
        return ("chain", parts) if len(parts) >= 2 else None
    if m := re.fullmatch(r"find_by_relation_(\w+)_from", name):
        return "hop", [m[1]]
    if m := re.fullmatch(r"find_by_chain_(\w+)", name):
        parts = [p for p in m[1].split("_and_") if p]
        return ("chain", parts) if len(parts) >= 2 else None
    return None


class Repository:
    """Methods marked by the decorators above, or named by the rule of derived(), become queries.

    class Countries(Repository):
        @chain("capital_of", "located_in")
        def continent_of(self, city): ...
    """

    def __init__(self, client: Client):
        self.client = client
        for name in dir(type(self)):
            fn = getattr(type(self), name, None)
            if hasattr(fn, "_query"):
                kind, how = fn._query
                setattr(self, name, functools.partial(self._call, kind, how, getattr(fn, "_extras", {})))

    def __getattr__(self, name: str):
        if (found := derived(name)) is None:
            raise AttributeError(name)
        kind, relations = found
        how = {"relation": relations[0]} if kind == "hop" else {"relations": relations}

        def run(start, k: int = DEFAULT_K) -> DataFrame:
            return self._call(kind, how, {"k": k}, start)

        return run

    def _call(self, kind: str, how: dict, extras: dict, *args) -> DataFrame:
        c = self.client
        try:
            if kind == "chain":
                q: _Query = functools.reduce(lambda q, r: q.via(r), how["relations"], c.from_(args[0]))
            elif kind == "hop":
                q = c.hop(args[0], how["relation"])
            elif kind == "relation":
                q = c.relation_of(how["relation"], args[0])
            elif kind == "bundle":
                q = c.bundle(*args)
            else:
                q = c.analogy(args[0]).is_to(args[1]).as_(args[2])
            out = q.top_k(extras.get("k", DEFAULT_K)).execute()
        except Exception:
            if extras.get("fallback") != "empty":
                raise
            return c.spark.createDataFrame([], "entity_id bigint, distance bigint, similarity double")
        if "min_similarity" in extras and "similarity" in out.columns:
            out = out.where(F.col("similarity") >= extras["min_similarity"])
        return out.select(*extras["projection"]) if "projection" in extras else out
