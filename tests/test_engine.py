"""Boundaries of the engine's operators on literal tables."""

import pytest
from pyspark.sql import functions as F

from proofloom.catalog import ORACLE_SQL, QUERIES
from proofloom.functions import scalar
from proofloom.model import ppm, stable_id
from proofloom.operators import callables, closure, diff, discover, evidence, glue, mapping, resolve, review, rules
from proofloom.plans import graph, waves
from proofloom.sources import listings, stores
from proofloom.store import components
from proofloom.streaming import lifecycle


def rows(df, *columns):
    return sorted((tuple(x[c] for c in (columns or df.columns)) for x in df.collect()), key=str)


def test_every_query_has_its_sql():
    assert QUERIES and set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("path,kind", [
    ("crates/a/src/lib.rs", "production"), ("third_party/tests/a.rs", "vendor"), ("a/generated/b.rs", "generated"), ("a/b.generated.rs", "generated"),
    ("crates/a/tests/x.rs", "test"), ("src/foo_test.rs", "test"), ("src/tests.rs", "test"), ("examples/a.rs", "example"), ("docs/a.rs", "docs"), ("src/a.py", "other"),
])
def test_path_class(spark, path, kind):
    assert spark.createDataFrame([(path,)], "p string").select(scalar.path_class(F.col("p"))).first()[0] == kind


def test_scalars(spark):
    df = spark.createDataFrame([("parseHTTPResponse_code", "a/../b", "f(a[1{2}])", "artifact:x", 0.25)], "name string, path string, t string, id string, w double")
    x = df.select(scalar.identifier_words(F.col("name")).alias("w"), scalar.safe_path(F.col("path")).alias("s"), scalar.nesting_depth(F.col("t")).alias("d"), scalar.valid_stable_id(F.col("id")).alias("v"), scalar.risk(F.col("w")).alias("r"), ppm(F.lit(2), F.lit(3)).alias("p"), ppm(F.lit(2), F.lit(0)).alias("z"), stable_id("k", F.lit("a"), F.lit(None)).alias("i")).first()
    assert x["w"] == ["code", "http", "parse", "response"] and not x["s"] and x["d"] == 3 and x["v"] and x["r"] == "info" and (x["p"], x["z"]) == (666666, 0) and x["i"].startswith("k:sha256:")


def test_listings(spark):
    tree = spark.createDataFrame([("100644 blob aa\tsrc/a b.rs\x00120000 blob bb\tlink\x00160000 commit cc\tsub\x00",)], "raw string")
    assert rows(listings.parse_tree(tree, "raw"), "path", "regular") == [("link", False), ("src/a b.rs", True), ("sub", False)]
    names = spark.createDataFrame([("M\x00a\x00R100\x00old\x00new\x00D\x00gone\x00",)], "raw string")
    assert rows(listings.parse_changes(names, "raw")) == [("D", "gone", "gone"), ("M", "a", "a"), ("R", "old", "new")]
    patch = spark.createDataFrame([("@@ -1,2 +3 @@\n+x\n@@ -9,2 +8,0 @@\n@@ -20 +30,4 @@ fn\n",)], "p string")
    x = listings.parse_hunks(patch, "p").first()
    assert [(r["start"], r["end"]) for r in x["ranges"]] == [(3, 3), (30, 33)] and x["deletions"] == [8]
    hit = listings.parse_hunks(patch, "p").select(*[scalar.touches(F.col("ranges"), F.col("deletions"), F.lit(a), F.lit(b)).alias(n) for n, a, b in (("in", 2, 3), ("del", 8, 9), ("edge", 4, 8), ("out", 10, 29))]).first()
    assert (hit["in"], hit["del"], hit["edge"], hit["out"]) == (True, True, False, False)


def test_admission_skips_do_not_add_up(spark):
    files = spark.createDataFrame([("s", "a", 5), ("s", "b", 50), ("s", "c", 6), ("s", "d", 5)], "g string, p string, n int")
    assert rows(listings.admitted(files, "g", "p", "n", 10, 10), "path", "outcome") == [("a", "accepted"), ("b", "file_too_large"), ("c", "total_exceeded"), ("d", "accepted")]


def test_chain_breaks(spark):
    ev = spark.createDataFrame([("s", 1, "h1", None), ("s", 2, "h2", "h1"), ("s", 4, "h4", "h2"), ("s", 5, "h5", "bad")], "st string, seq int, h string, p string")
    assert rows(listings.chain_breaks(ev, "seq", "h", "p", "st"), "seq") == [(4,), (5,)]


def test_waves(spark):
    ob = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "id string, weight double")
    dep = spark.createDataFrame([("b", "a")], "id string, on string")
    got = {x["id"]: (x["wave"], x["pos"], x["deferred"]) for x in waves.waves(ob, dep, 2, 2).collect()}
    assert got == {"c": (0, 0, None), "a": (0, 1, None), "b": (1, 0, None)}
    ob = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "id string, weight double")
    got = {x["id"]: (x["wave"], x["deferred"]) for x in waves.waves(ob, spark.createDataFrame([("c", "b")], "id string, on string"), 1, 1).collect()}
    assert got == {"a": (0, None), "b": (None, "budget_exhausted"), "c": (None, "prerequisite_deferred")}
    with pytest.raises(ValueError):
        waves.waves(ob, spark.createDataFrame([("a", "b"), ("b", "a")], "id string, on string"), 1, 1)


def test_waves_and_walks_take_every_order(spark, tmp_path):
    orders = [(k, 30 + k % 20, f"2001-02-{1 + k * 7 % 28:02d} 00:00:00", "OFP"[k % 3], ["1-URGENT", "2-HIGH", "3-MEDIUM"][k % 7 % 3]) for k in range(1, 121)]
    o = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string, o_orderpriority string")
    o.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 9, k % 4) for k in range(1, 121)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want, after, left = {}, {}, {}
    for k, c, d, _, p in sorted(orders, key=lambda x: (x[1], x[2], x[0])):
        after[k] = left.get(c)
        left[c] = k
    risk = {k: "321"[int(p[0]) - 1] for k, _, _, _, p in orders}
    wave = lambda k: 0 if after[k] is None else wave(after[k]) + 1
    for w in {wave(k) for k in after}:
        for pos, k in enumerate(sorted((k for k in after if wave(k) == w), key=lambda k: (-int(risk[k]), f"obligation:{k}"))):
            want[f"obligation:{k}"] = (w, pos, None)
    got = {x["id"]: (x["wave"], x["pos"], x["deferred"]) for x in QUERIES["review_waves"](spark, str(tmp_path)).collect()}
    assert got == want
    walked = {x["node"] for x in QUERIES["context_walk"](spark, str(tmp_path)).collect() if x["depth"] == 0}
    assert walked == {f"o{k}" for k, _, _, s, p in orders if s == "O" and p == "1-URGENT"} and len(walked) > 10


def test_walk_renews_its_budget_on_another_kind(spark):
    edges = spark.createDataFrame([("calls", "a", "b"), ("calls", "b", "c"), ("calls", "c", "d"), ("covers", "c", "t"), ("covers", "t", "u"), ("calls", "t", "v")], "kind string, src string, dst string")
    got = rows(waves.reachable(spark.createDataFrame([("a",)], "node string"), edges, {"calls": 2, "covers": 1}))
    assert got == [("a", 0), ("b", 1), ("c", 2), ("t", 3), ("v", 4)]


def test_scope_division(spark):
    inv = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "invariant int, scope string")
    mem = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("q", "c")], "path string, scope string")
    assert rows(rules.scope_covered(inv, mem)) == [(1, "p"), (2, "q")]


def test_windows(spark):
    seeds = spark.createDataFrame([("f", 40, 45, "a"), ("f", 500, 510, "b"), ("g", 80, 90, "c"), ("g", 100, 110, "d")], "path string, s int, e int, id string")
    assert rows(resolve.windows(seeds, 600), "path", "s", "e", "seeds") == [("f", 1, 93, 1), ("f", 452, 558, 1), ("g", 32, 158, 2)]


def test_score(spark):
    f = spark.createDataFrame([(1, "src/a.rs", 6, 6, "t"), (2, "src/a.rs", 8, 9, "t")], "finding int, path string, s int, e int, tag string")
    r = spark.createDataFrame([(1, "src/a.rs", 5, 7, "t")], "root int, path string, s int, e int, tag string")
    assert rows(resolve.score(f, r)) == [(1, 1, 1)]


def test_glue_rows(spark):
    s = [(1, "satisfied", True, False)] * 2 + [(2, "satisfied", True, False)] + [(3, "unknown", True, False), (3, "satisfied", True, False)] + [(4, "satisfied", True, False), (4, "required", True, False)]
    s += [(5, "satisfied", True, False), (5, "satisfied", False, False)] + [(6, "satisfied", True, True)] * 2 + [(7, "satisfied", True, False)] * 2
    got = glue.glue(spark.createDataFrame(s, "pair int, assignment string, verified boolean, qualified boolean"), spark.createDataFrame([(i,) for i in range(1, 7)], "pair int"))
    want = ["glued", "unknown", "unknown", "failed", "candidate", "glued_with_qualification", "unknown"]
    assert [x[1] for x in rows(got, "pair", "result")] == want


def test_diff(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", 1)], "k int, anchor string, body int")
    b = spark.createDataFrame([(1, "x", 1), (2, "w", 2), (4, "z", 1)], "k int, anchor string, body int")
    assert rows(diff.member_diff(a, b, "k", ["anchor", "body"])) == [(1, "preserved"), (2, "anchor_changed+body_changed"), (3, "removed"), (4, "added")]
    assert (3, 4, "label") in rows(diff.staged_mapping(a, b, "k", "anchor"))


def test_coverage_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "k int, weight double, completed boolean, supported boolean, verified boolean, freshness string")
    assert evidence.coverage(none).count() == 0
    assert rows(evidence.histogram(none, "freshness", ["fresh", "stale"])) == [("fresh", 0), ("stale", 0)]


def test_lifecycle(spark):
    ev = spark.createDataFrame([(1, "a", "generated"), (2, "a", "completed"), (3, "a", "stale"), (4, "a", "planned")], "seq int, stream string, state string")
    assert rows(lifecycle.transition_violations(ev), "seq") == [(2,), (4,)]
    assert rows(lifecycle.latest(ev), "state") == [("planned",)]


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([(i, f"s{i % 3}", ["planned", "completed"][i % 2]) for i in range(20)], "seq int, stream string, state string")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    live = lifecycle.stream_latest(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("latest_states_test").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("latest_states_test"), "stream", "state", "seq") == rows(lifecycle.latest(ev), "stream", "state", "seq")


def test_nine_obligations(spark):
    """One candidate of each of five rules; a missing concurrency model makes four gaps."""
    art = spark.createDataFrame([(1, "crates/a/src/a.rs", True, False, True, False, False, 0), (2, "crates/a/src/b.rs", False, False, False, False, False, 0)], "k long, path string, public boolean, own_change boolean, is_async boolean, awaits boolean, spawns boolean, primitives int")
    contains = spark.createDataFrame([(10, 1)], "container long, member long")
    changes = spark.createDataFrame([(10,)], "k long")
    reentry = spark.createDataFrame([(7, 1, "unbounded_reentry"), (8, 1, "bounded")], "event long, target long, concurrency string")
    calls = spark.createDataFrame([(1, 2, "syntactic_unique")], "caller long, callee long, resolution string")
    external = spark.createDataFrame([(2, 99, None), (2, 98, "key")], "src long, dst long, idempotency string")
    effects = spark.createDataFrame([(99,), (98,)], "k long")
    scoped = spark.createDataFrame([(5, "p")], "invariant long, path string")
    found = rules.rule_candidates(art, contains, changes, reentry, calls, external, effects, scoped)
    table = rules.rule_table(spark)
    states = spark.createDataFrame([("ast", "complete"), ("direct_calls", "complete"), ("test_mapping", "complete"), ("concurrency_model", "missing")], "capability string, state string")
    made = rules.materialise(found, table, states)
    assert rows(made, "rank", "key", "state", "needs") == [
        (0, "node:1", "unknown", ""), (1, "reentry:7:1", "unknown", "node:1"), (2, "contract:2:99", "applicable", ""),
        (3, "path:7:1:2:99", "unknown", "contract:2:99,reentry:7:1"), (4, "invariant:5:p", "unknown", ""),
    ]
    gaps = rules.gap_obligations(found, table, states)
    assert len(rows(gaps)) == 4 and {x["kind"] for x in gaps.collect()} == {"missing_extraction"}
    assert rows(rules.collisions(made.select("rule", "key").union(made.select("rule", "key")), "key"), "n", "rules") == [(2, 1)] * 5


def test_connected_needs_property_mode_target_and_snapshot(spark):
    claims = spark.createDataFrame([(1, 11, "accepted", "p"), (2, 12, "open", "p"), (3, 13, "supported", "p")], "claim long, obligation long, disposition string, property string")
    bound = spark.createDataFrame([(1, 100, "supports", "p"), (2, 100, "supports", "p"), (3, 101, "supports", "p"), (3, 100, "contradicts", "p"), (3, 100, "supports", "q")], "claim long, evidence long, relation string, property string")
    evid = spark.createDataFrame([(100, "test", True, 5), (101, "test", False, 5)], "evidence long, mode string, current boolean, target long")
    targets = spark.createDataFrame([(11, 5), (12, 5), (13, 5)], "obligation long, target long")
    modes = spark.createDataFrame([("p", "test")], "property string, mode string")
    assert rows(closure.supported(claims, bound, evid, targets, modes)) == [(11,)]


def test_historical_closure_wants_equal_sets(spark):
    claims = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "claim long")
    bound = spark.createDataFrame([(1, 5, "reproduces"), (2, 5, "reproduces"), (2, 6, "reproduces"), (3, 5, "reproduces"), (4, 5, "supports")], "claim long, evidence long, relation string")
    verified = spark.createDataFrame([(1, 5, True), (2, 5, True), (3, 5, True), (3, 6, True), (4, 5, True)], "claim long, evidence long, passed boolean")
    decided = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "claim long")
    assert rows(closure.historical(claims, bound, verified, decided)) == [(1, 1)]


def test_callables_match_in_two_phases(spark):
    schema = "k long, path string, qualified string, name string, params int, s int, e int, public boolean, signature string"
    before = spark.createDataFrame([(1, "f", "a::x", "x", 1, 1, 5, True, "s"), (2, "f", "dup", "y", 0, 10, 12, True, "s"), (3, "f", "dup", "y", 0, 20, 22, False, "s"), (4, "f", "gone", "g", 0, 30, 32, True, "s")], schema)
    after = spark.createDataFrame([(11, "f", "a::x", "x", 2, 1, 5, True, "t"), (12, "f", "dup", "y", 0, 10, 12, True, "s"), (13, "f", "dup", "y", 0, 20, 22, True, "s"), (14, "f", "new", "n", 0, 40, 44, False, "s")], schema)
    ranges = spark.createDataFrame([("f", 3, 3)], "path string, s int, e int")
    gone = spark.createDataFrame([("f", 12)], "path string, n int")
    got = callables.changes(before, after, ranges, gone)
    assert rows(got, "source", "target", "status") == [(1, 11, "modified"), (2, 12, "unchanged"), (3, 13, "modified"), (4, None, "removed"), (None, 14, "added")]
    edges = spark.createDataFrame([(50, 11), (11, 11), (51, 14)], "caller long, callee long")
    run = callables.run_obligations(got, edges, spark.createDataFrame([("bad.rs",)], "path string"))
    assert sorted((x["kind"], x["key"]) for x in run.collect()) == [("caller", "50:11"), ("changed", "11"), ("changed", "13"), ("gap", "bad.rs"), ("removed", "4")]


def test_graph_closures(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41)], "src long, dst long")
    seeds = spark.createDataFrame([(20,), (77,)], "node long")
    assert rows(graph.relevant(seeds, edges)) == sorted([(i,) for i in range(1, 21)] + [(77,)], key=str)
    up = graph.ancestors(edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")))
    assert sorted((x["ancestor"], x["depth"]) for x in up.where("node = 1").collect()) == [(i, i - 1) for i in range(2, 21)]
    assert {(x["node"], x["root"]) for x in components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()} == {(i, 1) for i in range(1, 21)} | {(40, 40), (41, 40)}
    stale = graph.staleness(spark.createDataFrame([(2, "r"), (1, "r")], "id long, reason string"), spark.createDataFrame([(1, 2), (3, 1)], "id long, on long"))
    assert rows(stale, "id", "directness", "reasons") == [(1, "direct_and_indirect", "dependency_changed,r"), (2, "direct", "r"), (3, "indirect", "dependency_changed")]


def test_mapping_consumes_vertices(spark):
    a = spark.createDataFrame([(1, "p", "x"), (2, "q", "x"), (3, "old", "z")], "k long, path string, label string")
    b = spark.createDataFrame([(10, "p", "x"), (20, "r", "x"), (30, "new", "z")], "k long, path string, label string")
    got = mapping.staged(a, b, [("path", ["path", "label"]), ("rename", ["path", "label"]), ("label", ["label"])], spark.createDataFrame([("old", "new")], "old string, new string"))
    assert rows(got) == [(1, 10, "path"), (2, 20, "label"), (3, 30, "rename")]


def test_ranks_over_ranges(spark):
    got = waves.rank(spark.range(0, 500, 1, 7).withColumn("v", F.col("id") % 10), [F.desc("v"), F.col("id")]).collect()
    assert sorted((x["rank"], x["id"]) for x in got) == list(enumerate(sorted(range(500), key=lambda i: (-(i % 10), i)), 1))


def test_patches_and_listings_keep_odd_paths(spark):
    raw = "diff --git a/x b/x\n--- a/x\n+++ b/x y\n@@ -1 +2,2 @@\n+a\n+b\ndiff --git a/z b/z\n--- a/z\n+++ /dev/null\n@@ -3,2 +2,0 @@\n-c\n"
    df = spark.createDataFrame([(raw,)], "raw string")
    cut = listings.split_patches(df, "raw")
    assert rows(cut, "path") == [("x y",), ("z",)]
    assert rows(listings.changed_lines(cut, "patch", "path")) == [("x y", 2), ("x y", 3)]
    names = spark.createDataFrame([("A\x00A\x00R100\x00M\x00R\x00T\x00C1\x00",)], "raw string")
    assert rows(listings.parse_changes(names, "raw")) == [("A", "A", "A"), ("R", "M", "R"), ("T", "C1", "C1")]


def test_token_shape(spark):
    got = spark.createDataFrame([('let x = foo("a \\" b", 12);',), ('let  y=bar("",0x1F);',)], "t string").select(scalar.token_shape(F.col("t")).alias("s")).collect()
    assert got[0]["s"] == "let I = I(S, N);" and got[1]["s"] == "let I=I(S,N);"


def test_schema_registry(spark):
    assert rows(stores.registry({"b": "x long", "a": "y string, z array<int>"}, spark)) == [("a", 0, "y", "string"), ("a", 1, "z", "array<int>"), ("b", 0, "x", "bigint")]


def test_touched_has_a_row_for_each_callable_of_one_key(spark):
    made = spark.createDataFrame([(1, "f", 1, 70), (1, "f", 5, 9), (2, "f", 1, 70), (3, "f", 100, 101), (1, "g", 1, 70), (4, "f", 12, 12)], "k long, path string, s int, e int")
    ranges = spark.createDataFrame([("f", 3, 6), ("f", 60, 68)], "path string, s int, e int")
    gone = spark.createDataFrame([("f", 12), ("f", 100)], "path string, n int")
    assert sorted(x["k"] for x in callables.touched(made, ranges, gone).collect()) == [1, 1, 2, 3]


def test_preserved_pairs_of_one_key_keep_their_own_status(spark):
    mapped = spark.createDataFrame([(1, 11, "preserved"), (1, 11, "modified"), (2, 12, "preserved"), (2, 12, "preserved"), (3, None, "preserved")], "source long, target long, status string")
    got = mapping.preserved(mapped, spark.createDataFrame([(1, "s"), (2, "t"), (3, "u")], "k long, signature string"))
    assert sorted(tuple(x) for x in got.collect()) == [(11, "s"), (12, "t"), (12, "t")]


def test_run_keeps_both_callables_of_one_key(spark):
    schema = "k long, path string, qualified string, name string, params int, s int, e int, public boolean, signature string"
    before = spark.createDataFrame([(1, "f", "a", "a", 1, 1, 5, True, "s")], schema)
    after = spark.createDataFrame([(9, "f", "b", "b", 1, 10, 15, True, "s"), (9, "f", "c", "c", 1, 20, 25, True, "s")], schema)
    got = callables.changes(before, after, spark.createDataFrame([], "path string, s int, e int"), spark.createDataFrame([], "path string, n int"))
    run = callables.run_obligations(got, spark.createDataFrame([(50, 9), (50, 9)], "caller long, callee long"), spark.createDataFrame([("bad.rs",), ("bad.rs",)], "path string"))
    assert sorted((x["kind"], x["key"]) for x in run.collect()) == [("caller", "50:9"), *[("changed", "9")] * 4, ("gap", "bad.rs"), ("removed", "1")]


def test_bridge_does_not_pair_the_members_of_a_container(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 9), (4, 2), (9, 2), (5, 6)], "symbol long, change long")
    symbols = spark.createDataFrame([(1,), (1,), (4,), (5,)], "symbol long")
    changes = spark.createDataFrame([(2,), (2,), (3,), (6,)], "change long")
    inside = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1), ("n", 2), ("o", 3)], "container string, member long")
    wide = spark.range(5, 200_000).select(F.lit("w").alias("container"), F.col("id").alias("member"))  # 40 billion pairs
    got = mapping.bridge(edges, symbols, changes, inside.union(wide))
    assert rows(got) == [(1, 2, "bridged"), (1, 3, "candidate"), (1, 9, "change_missing"), (4, 2, "candidate"), (5, 6, "bridged"), (9, 2, "symbol_missing")]


def test_overlapping_spans_equal_all_pairs_and_keep_their_tasks(spark):
    made = [(f"p{i % 2}", i * 7 % 60, i * 7 % 23, i * 7 % 23 + i * 11 % 9 - 2) for i in range(60)]  # some end before they start
    got = review.overlapping_spans(spark.createDataFrame(made, "path string, id long, s int, e int"))
    want = sorted((x[1], y[1]) for x in made for y in made if x[0] == y[0] and x[1] < y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted(tuple(x) for x in got.collect()) == want
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
