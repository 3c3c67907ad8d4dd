import random
import struct

import pytest
from pyspark.sql import functions as F

from bitgrove import api
from bitgrove.functions.vectors import ProjectionConfig
from bitgrove.sources import readers as IO
from bitgrove.sources import store as ST
from bitgrove.sources.store import Store
from bitgrove.streaming import watch as W
from test_kernel import vec


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "entity_id bigint")


@pytest.fixture
def store(spark, tmp_path):
    rng = random.Random(3)
    names = {n: api.local_id(n) for n in ("france", "england", "europe", "REL:capitalOf", "REL:locatedIn")}
    vecs = {n: vec(rng, 157) for n in names}
    for city, land in (("paris", "france"), ("london", "england")):
        names[city] = api.local_id(city)
        vecs[city] = [a ^ b for a, b in zip(vecs[land], vecs["REL:capitalOf"])]
    s = Store(spark, str(tmp_path / "s"), ProjectionConfig(dims=8))
    s.put_binary(spark.createDataFrame([(names[n], vecs[n]) for n in names], "entity_id bigint, hv array<bigint>"))
    edge = lambda a, r, b: (names[a], names[f"REL:{r}"], names[b])
    s.put_edges(spark.createDataFrame([edge("paris", "capitalOf", "france"), edge("london", "capitalOf", "england"), edge("france", "locatedIn", "europe")], "subject_id bigint, relation_id bigint, object_id bigint"))
    return s, names


def test_versions_retract_revive_and_reopen(spark, store):
    s, names = store
    assert s.entities().count() == 7 and s.version == 2 and s.ping()
    s.retract(ids(spark, names["paris"], 12345))
    assert s.entities().count() == 6 and s.entities(version=2).count() == 7 and s.entities(include_retracted=True).count() == 7
    bad = spark.createDataFrame([(names["paris"], names["REL:capitalOf"], names["france"])], "subject_id bigint, relation_id bigint, object_id bigint")
    with pytest.raises(KeyError):
        s.put_edges(bad)
    assert s.put_edges(bad, strict=False).first()["missing"] == "subject"
    again = s.log().where(F.col("entity_id") == names["paris"]).where("hv is not null").select("entity_id", "hv")
    s.put_binary(again)
    assert s.entities().count() == 7
    other = Store(spark, s.root)
    assert other.config == s.config and other.version == s.version
    assert {tuple(r) for r in other.counts().collect()} == {tuple(r) for r in s.counts().collect()} == {("entity", 7), ("typed_edge", 3)}
    with pytest.raises(ST.IncompatibleStore):
        Store(spark, s.root, ProjectionConfig(dims=9))
    with pytest.raises(Exception, match="157 words"):
        s.put_binary(spark.createDataFrame([(1, [1, 2])], "entity_id bigint, hv array<bigint>"))


def test_unfinished_writes_are_not_seen(spark, store):
    s, _ = store
    s._append(s.entities().select("entity_id", "hv", "kind", F.lit(True).alias("deleted"), F.lit(1 << 60).alias("seq")), "entities")
    assert Store(spark, s.root).entities().count() == 7
    v = s.version
    with s:
        pass
    assert s.version == v + 1
    with pytest.raises(RuntimeError), s:
        raise RuntimeError
    assert s.version == v + 1


def test_flat_edges_count_as_nodes(spark, store):
    s, names = store
    s.put_edges(spark.createDataFrame([(names["paris"], names["REL:capitalOf"], names["france"]), (names["london"], names["REL:capitalOf"], names["england"])], "subject_id bigint, relation_id bigint, object_id bigint"), kind="flat")
    assert dict((r["kind"], r["n"]) for r in s.counts().collect()) == {"entity": 7, "typed_edge": 3, "flat_edge": 2}


def test_builders(spark, store):
    s, names = store
    c = api.Client(s)
    heard = []
    c.listeners.append(heard.append)
    assert [r["entity_id"] for r in c.from_("paris").via("capitalOf").via("locatedIn").execute().collect()] == [names["europe"]]
    assert c.from_("paris").via("capitalOf").via("locatedIn").require() == [names["france"], names["europe"]]
    with pytest.raises(api.ChainBroke) as broke:
        c.from_("paris").via("capitalOf").via("capitalOf").require()
    assert broke.value.failed_hop == 2 and broke.value.path == (names["france"],)
    assert c.hop("london", "capitalOf").top_k(5).execute().collect()[0]["object_id"] == names["england"]
    assert c.analogy("london").is_to("england").as_("france").top_k(3).execute().where("rank = 1").first()["entity_id"] == names["paris"]
    assert c.relation_of("capitalOf", "france").top_k(1).execute().first()["entity_id"] == names["paris"]
    assert c.bundle("paris", "paris", "london").top_k(1).ids().first()[0] == names["paris"]
    base = c.from_("paris")
    base.via("capitalOf")
    assert base.relations == ()  # builders don't change
    for bad in (lambda: base.execute(), lambda: c.hop("a", "b").top_k(0), lambda: c.bundle("a").execute(), lambda: c.analogy("a").execute(), lambda: c.search([1.0]).execute(), lambda: c.search([0.0] * 8).min_similarity(2)):
        with pytest.raises(ValueError):
            bad()
    assert len(c.hop("london", "capitalOf").execute_async().result()) == 1
    assert {e.operation for e in heard} >= {"chain", "hop", "analogy"} and c.metrics.table(spark).count() >= 3
    assert c.health() and c.status().first()["dims"] == 8
    assert c.from_("france").via("locatedIn").approx().top_k(2).execute().first()["object_id"] == names["europe"]


def test_repository(spark, store):
    s, names = store

    class Lands(api.Repository):
        @api.chain("capitalOf", "locatedIn")
        @api.top_k(3)
        def continent(self, city): ...

        @api.analogy()
        @api.top_k(2)
        @api.min_similarity(0.99)
        @api.projection(["entity_id"])
        def like(self, a, b, c): ...

        @api.hop("capitalOf")
        @api.circuit_breaker("empty")
        def land(self, city): ...

        @api.bundle()
        @api.circuit_breaker("empty")
        def group(self, *members): ...

        @api.bundle()
        def strict_group(self, *members): ...

    r = Lands(api.Client(s))
    assert r.continent("paris").first()["entity_id"] == names["europe"]
    like = r.like("london", "england", "france")
    assert like.columns == ["entity_id"] and [x[0] for x in like.collect()] == [names["paris"]]
    assert r.land("paris").first()["object_id"] == names["france"]
    assert r.group("one").count() == 0
    with pytest.raises(ValueError):
        r.strict_group("one")
    assert r.findByRelationCapitalOfFrom("paris").first()["object_id"] == names["france"]
    assert r.findByChainCapitalOfAndLocatedIn("paris", 2).first()["entity_id"] == names["europe"]
    assert api.derived("findByRelationCapitalOfFrom") == ("hop", ["capitalOf"])
    assert api.derived("findByChainAAndB") == ("chain", ["a", "b"]) and api.derived("findByChainA") is None
    assert api.derived("find_by_chain_a_and_b") == ("chain", ["a", "b"])
    with pytest.raises(AttributeError):
        r.nothing_of_the_kind


def test_values_and_errors():
    assert api.Entity(1, "a") == api.Entity(1, "b") and api.Entity(1) != api.Entity(2)
    with pytest.raises(ValueError):
        api.Edge(api.Entity(1), " ", api.Entity(2))
    assert isinstance(api.translate("UNAVAILABLE", "x"), api.ConnectionFailed)
    assert api.translate("INVALID_ARGUMENT", "Entity not found: id=42").entity_id == 42
    assert isinstance(api.translate("RESOURCE_EXHAUSTED", ""), api.CapacityExceeded)


def test_float_store_batch_and_watch(spark, tmp_path):
    s = Store(spark, str(tmp_path / "f"), ProjectionConfig(dims=4))
    reg = W.WatchRegistry(spark)
    reg.register(W.Watchpoint("w", "one", (1.0, 0.0, 0.0, 0.0)))
    reg.register(W.Watchpoint("w", "two", (0.0, 1.0, 0.0, 0.0)))
    seen, order = [], []
    reg.subscribe(lambda df: order.append("*"))
    reg.subscribe(lambda df: (order.append("w"), seen.extend(df.collect())), "w")
    reg.subscribe(lambda df: 1 / 0, "w")
    c = api.Client(s, watch=reg)
    rows = spark.createDataFrame([(1, [0.0, 0.95, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [1.0]), (4, None), (None, [0.0] * 4), (5, [float("nan")] * 4)], "entity_id bigint, embedding array<double>")
    bad = {r["entity_id"]: r["error"] for r in c.save_batch(rows).collect()}
    assert bad == {3: "wrong dimensions: 1", 4: "missing embedding", None: "missing id", 5: "non-finite component"}
    assert s.entities().count() == 2 and c.metrics.failures == 4
    assert [(r["entity_id"], r["label"], r["severity"]) for r in seen] == [(1, "two", "CRITICAL")]
    assert order == ["*", "w"] and reg.failed == 1 and reg.detected == 1
    assert c.search([0.0, 2.0, 0.0, 0.0]).top_k(1).execute().first()["entity_id"] == 1
    assert reg.unregister("w") and not reg.unregister("w")
    with pytest.raises(ValueError):
        W.Watchpoint("x", "x", (1.0,), 0.9, 0.5, 0.95)
    assert W.Watchpoint.at("x", "x", (1.0,), 0.7).critical == pytest.approx(0.9)
    with pytest.raises(ValueError):
        ST.raise_if_any(spark.range(1))
    c.delete(ids(spark, 1))
    assert s.entities().count() == 1


def test_audit_and_versions(spark):
    first = ST.audit(ids(spark, 1, 2))
    stored = spark.createDataFrame(first.collect(), first.schema)
    second = {r["entity_id"]: (r["version"], r["created"]) for r in ST.audit(ids(spark, 2, 3), stored).collect()}
    assert second[2][0] == 2 and second[3][0] == 1
    assert second[2][1] == {r["entity_id"]: r["created"] for r in stored.collect()}[2]


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    writes = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("entity_id"), "embedding")
    writes.repartition(4).write.parquet(str(tmp_path / "in"))
    reg = W.WatchRegistry(spark)
    for r in writes.orderBy("entity_id").limit(3).collect():
        reg.register(W.Watchpoint(f"w{r['entity_id']}", "x", tuple(r["embedding"]), 0.1, 0.2, 0.3))
    got = []
    reg.subscribe(lambda df: got.extend((r["entity_id"], r["watchpoint_id"], r["severity"]) for r in df.collect()))
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reg.stream(stream, str(tmp_path / "ck"))
    q.awaitTermination(120)
    want = [(r["entity_id"], r["watchpoint_id"], r["severity"]) for r in reg.check(writes).collect()]
    assert sorted(got) == sorted(want) and len(got) > 3
    hours = W.hourly(reg.check(writes).withColumn("detected_at", F.current_timestamp()))
    assert hours.agg(F.sum("n")).first()[0] == len(want)


def test_readers(spark, tmp_path):
    def put(name, data):
        p = tmp_path / name
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(p)

    csv = put("e.csv", "x,node_id_start,rel_type,node_id_end\n1,10,Officer Of,20\n2,bad,similar,3\n3,5,weird,6\n")
    assert sorted(map(tuple, IO.read_edge_csv(spark, csv).collect())) == [(5, "connected_to", 6), (10, "officer_of", 20)]
    labels = put("l.tsv", "Q7\tSeven\tand more\nnothing\nx\ty\n8\tEight\n")
    assert sorted(map(tuple, IO.read_labels_tsv(spark, labels).collect())) == [(7, "Seven\tand more"), (8, "Eight")]
    tsv = put("e.tsv", "1\tP17\t2\n1\tP17\n3\tP131\t4\t5\n6\tP1\t7\n")
    assert sorted(map(tuple, IO.read_edges_tsv(spark, tsv).collect())) == [(1, "P17", 2), (6, "P1", 7)]
    js = put("r.json", '{"results":{"bindings":[{"item":{"type":"uri","value":"http://x/entity/Q42"},"itemLabel":{"type":"l","value":"A"},"target":{"type":"uri","value":"http://x/Q5"},"pi":{"type":"l","value":"P17"}},{"itemLabel":{"type":"l","value":"B"}}]}}')
    assert list(map(tuple, IO.read_bindings(spark, js).collect())) == [(42, "A", 5, "P17")]
    log = put("edge.dat", b"".join(struct.pack("<qq", k, o) for k, o in ((1, 2), (-3, 4), (1, -9))) + b"tail")
    rows = IO.read_edge_log(spark, log)
    assert sorted((r["seq"], r["edge_key"], r["object_id"]) for r in rows.collect()) == [(0, 1, 2), (1, -3, 4), (2, 1, -9)]
    assert dict(map(tuple, IO.replay(rows).collect())) == {1: -9, -3: 4}
    seeds = spark.createDataFrame([(3, 1, 2), (1, 1, 2)], "start bigint, rel1 bigint, rel2 bigint")
    IO.write_chain_seeds(seeds, str(tmp_path / "seeds"))
    assert list(map(tuple, IO.read_chain_seeds(spark, str(tmp_path / "seeds"), 1).collect())) == [(1, 1, 2)]


def test_names_of_relations(spark):
    rel = api.for_relations()
    got = spark.createDataFrame([("capitalOf",)], "n string").select(rel(F.col("n")).alias("id")).first()["id"]
    assert got == api.local_id("REL:capitalOf")
    own = api.Client.entity(type("C", (), {"resolver": staticmethod(lambda c: F.length(c).cast("bigint")), "spark": spark})(), "four")
    assert own == 4
    assert [tuple(r) for r in IO.relation_rows(spark, {"P17": "country", "P131": "located in"}).collect()] == [("P131", "located in"), ("P17", "country")]
