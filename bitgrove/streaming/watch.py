"""Standing queries: every written embedding is scored against registered centroids.

The check is one stateless expression over (entity, watchpoint) pairs, so the same function serves a batch and a
stream. Watchpoints are few; their number is checked before they are broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel as K

#: Watchpoints that are sent to every task at most.
MAX_WATCHPOINTS = 10_000


@dataclass(frozen=True)
class Watchpoint:
    id: str
    label: str
    centroid: tuple[float, ...]
    info: float = 0.60
    warning: float = 0.75
    critical: float = 0.90

    def __post_init__(self):
        if not self.id or not self.centroid:
            raise ValueError("a watchpoint needs an id and a centroid")
        if not self.info <= self.warning <= self.critical:
            raise ValueError("thresholds must not fall")

    @classmethod
    def at(cls, id: str, label: str, centroid, threshold: float) -> Watchpoint:
        """Thresholds t, t + 0.10 and t + 0.20; what lies above 1 can't be reached."""
        return cls(id, label, tuple(centroid), threshold, threshold + 0.10, threshold + 0.20)


SCHEMA = "watchpoint_id string, label string, centroid array<double>, info double, warning double, critical double"


def check(writes: DataFrame, watchpoints: DataFrame) -> DataFrame:
    """(entity_id, watchpoint_id, label, similarity, approx_distance, severity) for each pair that reaches a threshold.

    writes: (entity_id, embedding), a batch or a stream; watchpoints: rows of SCHEMA.
    """
    pairs = writes.select("entity_id", "embedding").join(F.broadcast(watchpoints))  # at most MAX_WATCHPOINTS rows
    scored = pairs.withColumn("similarity", K.clamped_dot("embedding", "centroid"))
    marked = scored.withColumn("severity", K.severity("similarity", F.col("info"), F.col("warning"), F.col("critical"))).where("severity is not null")
    return marked.select("entity_id", "watchpoint_id", "label", "similarity", K.approx_hamming("similarity").alias("approx_distance"), "severity")


def counters(matches: DataFrame) -> DataFrame:
    return matches.groupBy("watchpoint_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class WatchRegistry:
    spark: SparkSession
    points: dict[str, Watchpoint] = field(default_factory=dict)
    listeners: dict[str, list[Callable[[DataFrame], None]]] = field(default_factory=lambda: defaultdict(list))
    detected: int = 0
    delivered: int = 0
    failed: int = 0

    def register(self, point: Watchpoint) -> None:
        """One watchpoint per id: a later one takes the place of the earlier."""
        if point.id not in self.points and len(self.points) >= MAX_WATCHPOINTS:
            raise ValueError("too many watchpoints to send to every task")
        self.points[point.id] = point

    def unregister(self, id: str) -> bool:
        return self.points.pop(id, None) is not None

    def subscribe(self, listener: Callable[[DataFrame], None], id: str = "*") -> None:
        self.listeners[id].append(listener)

    def table(self) -> DataFrame:
        rows = [(p.id, p.label, [float(x) for x in p.centroid], p.info, p.warning, p.critical) for p in self.points.values()]
        return self.spark.createDataFrame(rows, SCHEMA)

    def check(self, writes: DataFrame) -> DataFrame:
        return check(writes, self.table())

    def deliver(self, matches: DataFrame, _batch: int = 0) -> None:
        """Sends matches to wildcard listeners first, then to those of a watchpoint; a failing listener stops no other."""
        matches = matches.persist()
        try:
            self.detected += matches.count()
            for id, own in [("*", self.listeners["*"]), *((k, v) for k, v in self.listeners.items() if k != "*")]:
                part = matches if id == "*" else matches.where(F.col("watchpoint_id") == id)
                for listener in own:
                    try:
                        listener(part)
                        self.delivered += 1
                    except Exception:  # noqa: BLE001
                        self.failed += 1
        finally:
            matches.unpersist()

    def stream(self, writes: DataFrame, checkpoint: str, **trigger):
        """A running query that checks a stream of writes with the watchpoints of now and delivers each micro-batch.

        Back-pressure is the source's (maxFilesPerTrigger and the like): nothing is dropped.
        """
        return self.check(writes).withColumn("detected_at", F.current_timestamp()).writeStream.foreachBatch(self.deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly(matches: DataFrame, at: str = "detected_at", late: str = "10 minutes") -> DataFrame:
    """Matches per hour, watchpoint and severity; on a stream with a watermark."""
    return matches.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("hour"), "watchpoint_id", "severity").agg(F.count(F.lit(1)).alias("n"))
