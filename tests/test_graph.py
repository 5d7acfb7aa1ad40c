"""Traversals, lanes and languages on small fixtures; files, deltas and streams."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwalk.operators import access
from meshwalk.operators import algebra as A
from meshwalk.operators.lanes import MultiLane
from meshwalk.plans import cypher, datalog
from meshwalk.plans import logical as L
from meshwalk.plans.catalog import GraphCatalog
from meshwalk.plans.engine import Engine, detect_language
from meshwalk.plans.traversal import traverse
from meshwalk.sources import deltas, files
from meshwalk.streaming import deltas as stream


@pytest.fixture(scope="module")
def g(spark):
    rng = random.Random(0)
    g = GraphCatalog(spark)
    g.add_domain("user", spark.createDataFrame([(i, f"u{i}@{'ab'[i % 2]}.org", None if i % 5 == 0 else float(i), [float(i % 3), 1.0]) for i in range(30)], "id long, mail string, age double, vec array<double>"), "id")
    g.add_domain("group", spark.createDataFrame([(i, i * 10) for i in range(8)], "id long, size int"), "id")
    g.add_relation("FOLLOWS", spark.createDataFrame([(rng.randrange(30), rng.randrange(30), rng.random()) for _ in range(70)], "a long, b long, w double"), "a", "b", "user", "user")
    g.add_relation("IN_GROUP", spark.createDataFrame([(i, i % 8) for i in range(30)], "a long, b long"), "a", "b", "user", "group", multiplicity=1.0)
    g.add_relation("INCLUDES", spark.createDataFrame([(7, 3), (3, 1), (1, 0), (7, 4), (4, 2)], "a long, b long"), "a", "b", "group", "group")
    return g


def follows(g):
    return {(r["src"], r["dst"]) for r in g.relation("FOLLOWS").edges.collect()}


def ids(df, col="node"):
    return sorted(r[col] for r in df.collect())


def test_hops_and_terminals(g):
    e = follows(g)
    t = traverse(g).from_("user", 1, 2, 99)
    assert t.out("FOLLOWS").collect() == sorted({b for a, b in e if a in (1, 2)})
    assert t.in_("FOLLOWS").collect() == sorted({a for a, b in e if b in (1, 2)})
    assert t.both("FOLLOWS").collect() == sorted({b for a, b in e if a in (1, 2)} | {a for a, b in e if b in (1, 2)})
    assert t.count() == 2 and t.contains(1) and not t.contains(99)
    assert t.out("IN_GROUP").out("INCLUDES").collect() == [0]
    with pytest.raises(ValueError):
        t.out("INCLUDES")
    with pytest.raises(ValueError):
        t.out("NOTHING")


def test_rewrites_change_plans_not_answers(g):
    t = traverse(g).all("user").filter("age > 3").filter("age < 20").out("IN_GROUP")
    assert t.collect() == traverse(g, rewrites=False).all("user").filter("age > 3").filter("age < 20").out("IN_GROUP").collect()
    p = L.rewrite(L.Hop(L.Hop(L.Seed("x"), ("A",)), ("B",)), lambda r: 1.0)
    assert not p.child.distinct and p.distinct
    assert L.rewrite(L.Hop(L.Hop(L.Seed("x"), ("A",)), ("B",)), lambda r: 5.0).child.distinct


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(1000).select("id", (F.col("id") % 7).alias("x"), F.lit("wide").alias("pad")).write.parquet(path)
    c = GraphCatalog(spark).add_domain("n", spark.read.parquet(path), "id")
    plan = traverse(c).all("n").filter("x > 5").nodes()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,5)" in plan and "pad" not in plan


def test_missing_values(g):
    assert traverse(g).all("user").filter("age > 0 || age <= 0").count() == 24
    assert traverse(g).all("user").filter("is_null(age)").collect() == [0, 5, 10, 15, 20, 25]
    assert traverse(g).from_("user", 5).reduce_attr("age", "SUM").first()[0] == 0 and traverse(g).from_("user", 5).reduce_attr("age", "MIN").first()[0] is None
    state = {r["node"]: r["value"] for r in traverse(g).from_("user", 5, 6).mul_node_attr("age").state().collect()}
    assert state == {5: 0.0, 6: 6.0}
    assert {r["node"]: r["value"] for r in traverse(g).from_("user", 5, 6).div_node_attr("age").state().collect()} == {5: 1.0, 6: 1 / 6}


def test_state_and_ties(g):
    assert [r["node"] for r in traverse(g).all("user").rerank([1.0, 0.0], "vec", "dot").top_k(3).collect()] == [2, 5, 8]
    assert traverse(g).all("user").project("age > 20").collect() == [21, 22, 23, 24, 26, 27, 28, 29]
    assert traverse(g).all("user").project("age").reduce_state("ARGMAX").first()[0] == 29


def test_lanes_are_single_runs(g):
    m = MultiLane(g).from_seeds("user", list(range(10))).out("FOLLOWS").out("FOLLOWS")
    got = {}
    for r in m.lanes.collect():
        got.setdefault(r["lane"], set()).add(r["node"])
    for i in range(10):
        assert sorted(got.get(i, ())) == traverse(g).from_("user", i).repeat(2, "FOLLOWS").collect()
    quorum = {n for n in range(30) if sum(n in s for s in got.values()) >= 3}
    assert set(ids(m.nodes_with_quorum(3))) == quorum
    cover = [r["node"] for r in m.greedy_set_cover().collect()]
    assert all(any(n in s for n in cover) for s in got.values())
    half = MultiLane(g, m.lanes, "user").prune_upper_half(5)
    assert {(r["lane"], r["node"]) for r in half.lanes.collect()} == {(k, n) for k in range(5) for n in got.get(k, set()) - got.get(k + 5, set())}
    back = m.project("lane = lane & 3").lanes.collect()
    assert {(r["lane"], r["node"]) for r in back} == {(k, n) for k in (0, 1) for n in got.get(k, ())}


def test_lane_closure_of_concepts(g):
    m = MultiLane(g).from_concept_vectors("user", "vec", [[1.0, 0.0], [0.0, 1.0]], 2, "dot")
    assert m.lanes.count() == 4 and m.repeat_until_stable("FOLLOWS").lanes.count() >= 4


@pytest.mark.parametrize(
    "text,want",
    [
        ("MATCH (g:group)-[:INCLUDES*]->(h) WHERE g.id = 7 RETURN h", [0, 1, 2, 3, 4, 7]), ("MATCH (g:group)-[:INCLUDES]->(h) WHERE h.size < 25 AND g.id IN [7, 4, 1] RETURN g", [1, 4]),
        ("MATCH (g:group) WHERE g.size >= 50 RETURN g LIMIT 2", [5, 6]), ("MATCH (g)-[:INCLUDES*2]->(h) WHERE g.id = 7 RETURN h", [1, 2]), ("MATCH (g)-[:INCLUDES]-(h) WHERE g.id = 3 RETURN h", [1, 7]),
        ("MATCH (u)-[:IN_GROUP]->(g) WHERE u.mail ENDS WITH 'a.org' AND u.age IS NOT NULL RETURN g", [0, 2, 4, 6]), ("MATCH (g:group) WHERE g.id < 4 RETURN g.size", [0, 10, 20, 30]),
    ],
)
def test_cypher(g, text, want):
    assert sorted(r[0] for r in Engine(g).query(text).collect()) == want


def test_cypher_strict_and_ranked(g):
    e = Engine(g)
    assert ids(e.query("MATCH (g)-[:INCLUDES*]->(h) WHERE g.id = 7 RETURN h", strict=True), "result") == [0, 1, 2, 3, 4]
    assert ids(e.query("MATCH (g)-[:INCLUDES*1..2]->(h) WHERE g.id = 7 RETURN h", strict=True), "result") == [1, 2, 3, 4]
    assert [r["result"] for r in e.query("MATCH (u:user) WHERE u.id IN $few RETURN u ORDER BY vector_dot(u.vec, [1.0, 0.0]) LIMIT 2", params={"few": [0, 1, 2, 5]}).collect()] == [2, 5]
    assert e.query("MATCH (u:user)-[:IN_GROUP]->(g) WHERE vector_ann(u.vec, $v, 2) RETURN count(g)".replace("u.vec, $v", "u.vec, [1.0, 0.0]")).first()[0] >= 1


@pytest.mark.parametrize("text", ["MATCH (a)-[]->(b) RETURN b", "MATCH (a)-[:FOLLOWS]->(b) WHERE a.x = 1 OR b.y = 2 RETURN b", "MATCH (a)-[:FOLLOWS*1..99]->(b) RETURN b", "MATCH (a)-[:FOLLOWS]->(b)", "MATCH (a:group)-[:FOLLOWS]->(b) RETURN b", "MATCH (a)-[:FOLLOWS]->(b)-[:FOLLOWS]->(a) RETURN a", "MATCH (a)-[:FOLLOWS]->(b) RETURN c", "MATCH (a)<-[:FOLLOWS]->(b) RETURN b"])
def test_cypher_errors(g, text):
    with pytest.raises(cypher.CypherError):
        cypher.run(text, g)


def test_datalog(g):
    q = lambda t, **k: Engine(g).query(t, "datalog", **k)
    rules = "up(X, Y) :- INCLUDES(X, Y).  % base\nup(X, Y) :- up(X, Z), INCLUDES(Z, Y).\n"
    assert ids(q(rules + "?- up(7, Y)."), "Y") == [0, 1, 2, 3, 4, 7]
    assert ids(q(rules + "?- up(7, Y).", include_seed=False), "Y") == [0, 1, 2, 3, 4]
    assert ids(q(rules + "?- up(X, 0)."), "X") == [0, 1, 3, 7]
    assert ids(q(rules + "can(U) :- IN_GROUP(U, G), up(G, 0).\nno(U) :- user(U), not can(U).\n?- no(U)."), "U") == [i for i in range(30) if i % 8 not in (1, 3, 7)]
    assert ids(q("fact(1, 5). fact(5, 9). r(X) :- fact(X, Y), X < Y, Y != 9. ?- r(X)."), "X") == [1]
    assert ids(q("who(U) :- seed(G), ^IN_GROUP(G, U). ?- who(U).", params={"seed": [2]}), "U") == [2, 10, 18, 26]
    both = "a(X, Y) :- INCLUDES(X, Y). a(X, Y) :- a(X, Z), a(Z, Y). ?- a(7, Y)."
    assert ids(q(both, include_seed=False), "Y") == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("text", ["p(X) :- !q(X), user(X). q(X) :- p(X). ?- p(X).", "p(X, Y) :- user(X).", "p(X) :- nothing(X). ?- p(X).", "p(X) :- user(X)", "p(X) :- user(X, Y). ?- p(X)."])
def test_datalog_errors(g, text):
    with pytest.raises(datalog.DatalogError):
        datalog.run(text, g).count()


def test_scripts_and_programs(g):
    e = Engine(g)
    assert ids(e.query("x = seeds(group, 7)\ny = INCLUDES * x\nreturn INCLUDES * y", "script")) == [1, 2]
    assert e.query("r = pagerank(FOLLOWS, 0.85, 3)\nreturn topk(r, 2)", "script").count() == 2
    assert e.query("return reduce(degree(FOLLOWS), 'SUM')", "script").first()[0] == 70
    assert ids(e.query("l = lane_seeds(user, 1, 2, 3)\nreturn lane_quorum(lane_out(FOLLOWS, l), 1)", "script")) == traverse(g).from_("user", 1, 2, 3).out("FOLLOWS").collect()
    assert ids(e.query('(program (bitset:from 7) (csr-walk-2hop "INCLUDES" "INCLUDES"))')) == [1, 2]
    assert ids(e.query('(let ((a (bitset:from 1 2 3)) (b (bitset:from 2 9))) (set:difference a b))')) == [1, 3]
    assert e.query('(program (bitset:from 7) (fixpoint "INCLUDES" 100 (csr-walk "INCLUDES")) (collect-count))').first()[0] == 6
    assert ids(e.query('(program (bitset:all user) (lane-init-seeds (1 2 3)) (lane-csr-walk "FOLLOWS") (lane-filter-quorum 1))')) == traverse(g).from_("user", 1, 2, 3).out("FOLLOWS").collect()
    loop = '(program (bitset:from 7) (set! n 0) (bitset:from 7) (loop-while (csr-walk "INCLUDES") (csr-walk "INCLUDES")))'
    assert ids(e.query(loop)) == [0]
    assert [detect_language(t) for t in ("MATCH (a) RETURN a", "(program)", "a(X) :- b(X).", "x = A * y")] == ["cypher", "scheme", "datalog", "script"]
    assert ids(e.prepare("MATCH (g:group) WHERE g.id = $x RETURN g").bind("x", 3).execute(), "result") == [3]


def test_access(spark, g):
    users = spark.createDataFrame([(7,), (1,), (2,)], "node long")
    grants = spark.createDataFrame([(0, 100), (4, 104), (2, 102)], "src long, dst long")
    args = (g.relation("IN_GROUP").edges, g.relation("INCLUDES").edges, grants)
    assert {tuple(r) for r in access.permitted(users, *args).collect()} == {(7, 100), (7, 104), (7, 102), (1, 100), (2, 102)}
    denied = spark.createDataFrame([(3, 100)], "src long, dst long")
    assert {tuple(r) for r in access.permitted(users, *args, denied).collect()} == {(7, 104), (7, 102), (1, 100), (2, 102)}
    assert ids(access.check(users, 102, *args)) == [2, 7]
    assert A.adjacent(args[1], 7, 3) and not A.adjacent(args[1], 3, 7)


def test_deltas(spark, g):
    base = g.relation("INCLUDES").edges
    adds, gone = spark.createDataFrame([(0, 5)], "src long, dst long"), spark.createDataFrame([(7, 3)], "src long, dst long")
    new = deltas.compact(g, "INCLUDES", adds, gone)
    assert {tuple(r) for r in deltas.edge_diff(base, new.relation("INCLUDES").edges).collect()} == {("removed", 7, 3), ("added", 0, 5)}
    assert traverse(new).from_("group", 7).repeat_until_stable("INCLUDES").collect() == [2, 4, 7]
    merged = deltas.merge(g, new)
    assert merged.relation("INCLUDES").edges.count() == 6 and merged.domain("user").nodes.count() == 30
    assert deltas.catalog_diff(g, new).count() == 0 and deltas.dangling(g).agg(F.sum("missing")).first()[0] == 0
    assert deltas.catalog_diff(g, merged).collect()[0]["what"] == "rows"
    assert deltas.inspect(g).count() == 5


def test_manifest_and_round_trips(spark, tmp_path, g):
    (tmp_path / "members.tsv").write_text("# who\nann\tdev\n// note\nbob\tdev\nbob\tops\n\n% end\n")
    (tmp_path / "people.csv").write_text("id,age,name\nann,31,Ann\nbob,x,Bob\n")
    spec = {"version": 1, "domains": [{"id": 0, "name": "person", "key_type": "string", "file": "people.csv", "id_column": "id", "attributes": [{"name": "age", "column": "age", "type": "uint32"}]}, {"id": 1, "name": "team", "key_type": "string"}],
            "relations": [{"name": "MEMBER", "src_domain": 0, "tgt_domain": 1, "file": "members.tsv"}]}
    (tmp_path / "graph.json").write_text(json.dumps(spec))
    c = files.from_manifest(spark, str(tmp_path / "graph.json"))
    assert traverse(c).from_("person", "bob").out("MEMBER").collect() == ["dev", "ops"]
    assert {r["node"]: r["age"] for r in c.domain("person").nodes.collect()} == {"ann": 31, "bob": None} and c.domain("team").nodes.count() == 2
    files.save(g, str(tmp_path / "saved"))
    again = files.load(spark, str(tmp_path / "saved"))
    assert deltas.catalog_diff(g, again).count() == 0 and again.relation("IN_GROUP").multiplicity == 1.0
    for fmt in ("csv", "tsv", "jsonl", "parquet"):
        files.export(g.relation("INCLUDES").edges, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    back = files.from_coordinates(spark, *files.to_scipy_parts(g.relation("INCLUDES").edges))
    assert back.count() == 5 and back.columns == ["src", "dst", "weight"]


def test_embedding_files(spark, tmp_path, g):
    v = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.save(tmp_path / "v.npy", v)
    (tmp_path / "v.fvecs").write_bytes(b"".join(struct.pack("<i", 4) + r.tobytes() for r in v))
    (tmp_path / "v.bvecs").write_bytes(b"".join(struct.pack("<i", 4) + r.astype(np.uint8).tobytes() for r in v))
    (tmp_path / "v.ivecs").write_bytes(b"".join(struct.pack("<i", 4) + r.astype("<i4").tobytes() for r in v))
    head = json.dumps({"x": {"dtype": "F32", "shape": [3, 4], "data_offsets": [0, 48]}}).encode()
    (tmp_path / "v.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + v.tobytes())
    for fmt in ("npy", "fvecs", "bvecs", "ivecs", "safetensors"):
        rows = files.read_embeddings(spark, str(tmp_path / f"v.{fmt}")).orderBy("row").collect()
        assert [list(r["embedding"]) for r in rows] == v.tolist(), fmt
    with_v = files.align(files.read_embeddings(spark, str(tmp_path / "v.npy")), "row", g, "group")
    assert with_v.domain("group").nodes.where("embedding IS NOT NULL").count() == 3 and with_v.domain("group").nodes.count() == 8


def test_stream_of_changes(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 2, "add", "2024-01-01 00:00:00"), (1, 3, "add", "2024-01-01 00:01:00")], "src long, dst long, op string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{path}/a")
    source = stream.read_changes(spark, f"{path}/*")
    stream.keep_live(source, str(tmp_path / "live"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, 2, "remove", "2024-01-01 02:00:00"), (4, 4, "add", "2024-01-01 02:00:00")], "src long, dst long, op string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{path}/b")
    stream.keep_live(source, str(tmp_path / "live"), str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in stream.live(spark, str(tmp_path / "live"), 1).collect()} == {(1, 3), (4, 4)}
    counts = stream.degrees_by_window(source).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 3
