"""Call tiers, channels, mapping by neighbours, folds under budgets, contexts, enumerations and the stateful stream against plain Python."""

import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proofloom import store
from proofloom.model import TRANSITIONS, ppm
from proofloom.operators import arms, calls, chain, discover, enumerate as enumeration, schemas, signals, snapshots
from proofloom.plans import contexts, folds
from proofloom.plans.graph import EXCLUSIONS
from proofloom.streaming import stateful


def test_seven_tiers(spark):
    declared = spark.createDataFrame(
        [(1, "m", "", None, "f", True), (2, "m", "a", None, "g", False), (3, "m", "a.b", None, "h", False), (4, "n", "", None, "far", True), (5, "n", "", None, "hid", False), (6, "n", "", "T", "own", True), (7, "m", "", "T", "own", True),
         (8, "p", "", None, "deep", True), (9, "q", "", None, "twice", True), (10, "r", "", None, "twice", True), (11, "n", "", "U", "lone", True), (12, "q", "", None, "pkg", True), (13, "m", "a", None, "f", True)],
        "k long, file string, scope string, owner string, name string, public boolean",
    )
    sites = [
        ("local", "m", "a", None, "plain", "shade"), ("self", "m", "a", "T", "self", "own"), ("self_far", "p", "", "U", "self", "lone"), ("self_name", "p", "", None, "self", "lone"), ("import", "m", "", None, "plain", "got"), ("empty", "m", "", None, "plain", "nothing"),
        ("package", "m", "", None, "plain", "boxed"), ("same", "m", "a.b", None, "plain", "h"), ("nearest", "m", "a.b", None, "plain", "f"), ("outer", "m", "a.b.c", None, "plain", "g"), ("glob", "m", "a", None, "plain", "far"), ("hidden", "m", "a", None, "plain", "hid"), ("many", "m", "a", None, "plain", "twice"), ("none", "m", "a", None, "plain", "zzz"),
    ]
    sites = spark.createDataFrame([(c, "body", *rest) for c, *rest in sites], "call_id string, caller string, file string, scope string, owner string, form string, name string")
    shadows = spark.createDataFrame([("body", "shade"), ("body", "own"), ("other", "f")], "caller string, name string")
    imports = spark.createDataFrame([("m", 2, "got", "n", "far"), ("m", 1, "got", "p", "alias"), ("m", 3, "nothing", "p", "missing"), ("m", 4, "boxed", "left-pad", "pkg")], "file string, place int, local string, module string, imported string")
    globs = spark.createDataFrame([("m", 1, "q"), ("m", 0, "n"), ("m", 2, "r")], "file string, place int, module string")
    aliases = spark.createDataFrame([("p", "alias", "deep")], "file string, exported string, name string")
    reexports = spark.createDataFrame([("p", "*", "p", "*")], "file string, exported string, module string, imported string")
    got = {r[0]: tuple(r[1:]) for r in calls.resolve(sites, declared, shadows, imports, globs, aliases, reexports).collect()}
    assert got == {
        "local": ("local_shadow", 0, None, "unresolved"), "self": ("self_receiver", 1, 7, "exact"), "self_far": ("self_receiver", 1, 11, "name_only"), "self_name": ("name", 1, 11, "name_only"), "import": ("import", 1, 8, "exact"),
        "empty": ("import", 0, None, "unresolved"), "package": ("import", 1, 12, "name_only"), "same": ("same_scope", 1, 3, "exact"), "nearest": ("enclosing_scope", 1, 13, "exact"), "outer": ("enclosing_scope", 1, 2, "exact"),
        "glob": ("glob_import", 1, 4, "exact"), "hidden": ("name", 1, 5, "name_only"), "many": ("glob_import", 1, 9, "exact"), "none": ("none", 0, None, "unresolved"),
    }
    assert set(calls.TIERS) == {x[0] for x in got.values()} - {"none"}


def test_exports_through_cycles_and_at_most_so_far(spark):
    declared = spark.createDataFrame([(1, "z", "f"), (2, "y", "f"), (3, "c9", "g"), (4, "d9", "g")], "k long, file string, name string")
    links = [("a", "*", "b", "*"), ("b", "*", "a", "*"), ("b", "f", "z", "f"), ("a", "f", "y", "f"), ("a", "f", "z", "f")]
    links += [(f"c{i}", "*", f"c{i + 1}", "*") for i in range(1, 9)] + [(f"d{i}", "*", f"d{i + 1}", "*") for i in range(9)]
    reexports = spark.createDataFrame(links, "file string, exported string, module string, imported string")
    none = spark.createDataFrame([], "file string, exported string, name string")
    wanted = spark.createDataFrame([("a", "f"), ("z", "f"), ("c1", "g"), ("d0", "g"), ("a", "x")], "file string, name string")
    got = {(r["file"], r["name"]): (r["n"], r["k"]) for r in calls.exported(wanted, declared, none, reexports).collect()}
    assert got == {("a", "f"): (2, 1), ("z", "f"): (1, 1), ("c1", "g"): (1, 3)}  # d0 is nine re-exports away


def brute_pairs(facts, most, least=600_000):
    df = Counter((c, t) for f in facts for c, terms in zip(signals.CHANNELS, f[2:]) for t in set(terms))
    sets = {f[0]: (f[1], [{t for t in set(terms) if 2 <= df[c, t] <= most} for c, terms in zip(signals.CHANNELS, f[2:])]) for f in facts}
    out = []
    for a, b in combinations(sorted(sets), 2):
        (sa, x), (sb, y) = sets[a], sets[b]
        c, s, o = (len(p & q) for p, q in zip(x, y))
        both = len(x[2]) + len(y[2]) - o
        if sa != sb and c + s >= 1 and o >= 2 and o * 1_000_000 // both >= least:
            out.append((a, b, c, s, o, o * 1_000_000 // both))
    return out


@pytest.mark.parametrize("block", [2, 1024])
def test_signal_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(signals, "BLOCK", block)
    r, facts = random.Random(8), []
    for i in range(90):
        ops = r.sample([f"o{j}" for j in range(30)], r.randint(0, 9)) if i % 3 or not facts else list(facts[r.randrange(len(facts))][4])
        if i % 6 == 0 and ops:
            ops = ops[:-1]
        facts.append((i, f"s{r.randrange(40)}", r.sample(["get", "put", "run"], r.randint(0, 2)), r.sample([f"t{j}" for j in range(6)], 2), ops))
    df = spark.createDataFrame(facts, "id long, shape string, callable array<string>, signature array<string>, operation array<string>")
    got = sorted(tuple(x) for x in signals.signal_pairs(df, discover.cap(90)).collect())
    assert got and got == brute_pairs(facts, discover.cap(90))


def test_signal_boundary(spark):
    """Exactly 600,000 ppm is in; a term of one fact alone is in no union; long sets do not overflow."""
    long = [f"t{i}" for i in range(4500)]
    rows = [(1, "a", ["load"], ["req"], ["x", "y", "z", "p", "q"]), (2, "b", ["store"], ["req"], ["x", "y", "z", "alone"]), (3, "c", [], [], ["p", "q", "w"]), (4, "d", [], [], ["w"]), (5, "e", ["big"], [], long), (6, "f", ["big"], [], long), (7, "g", ["load"], [], ["w", "v"]), (8, "h", None, [], [None, "v"])]
    df = spark.createDataFrame(rows, "id long, shape string, callable array<string>, signature array<string>, operation array<string>")
    got = sorted(tuple(x) for x in signals.signal_pairs(df, 32).collect())
    assert got == [(1, 2, 0, 1, 3, 600_000), (5, 6, 1, 0, 4500, 1_000_000)]
    assert discover.cap(200) == 40 and discover.cap(10) == 32
    assert spark.range(1).select(ppm(F.lit(2_000_000), F.lit(4_000_000)).alias("p")).first()["p"] == 500_000


def test_contract_search(spark):
    rows = [(1, ["load"], [], ["x", "y"]), (2, ["save"], [], ["x", "y"]), (3, [], ["req"], ["x", "y", "z"]), (4, ["load"], [], ["x"])]
    posts = signals.posted(spark.createDataFrame(rows, "id long, callable array<string>, signature array<string>, operation array<string>"))
    contract = {"callable": ["load"], "signature": ["req", "gone"], "operation": ["x", "y", "w"]}
    found = signals.search(posts, contract, 3, least_ppm=300_000)
    assert [tuple(x) for x in found.orderBy("id").collect()] == []  # x is in four facts
    found = signals.search(posts, contract, 4)
    assert [tuple(x) for x in found.orderBy("id").collect()] == [(1, 1, 0, 2, 666_666, 1), (3, 0, 1, 2, 666_666, 2)]
    assert signals.clause_obligations(found, ["a", "b"]).count() == 4
    assert sorted(tuple(x) for x in signals.unmatched(posts, found, contract).collect()) == [(1, "operation", "w"), (1, "signature", "gone"), (1, "signature", "req"), (3, "callable", "load"), (3, "operation", "w"), (3, "signature", "gone")]


def test_mapping_by_neighbours(spark):
    """Relations, contexts and invariants carry no path or label that tells them apart: what they hang on does."""
    v = []
    for side, p in (("before", "b"), ("after", "a")):
        v += [(side, f"{p}f{i}", "file", f"src/{i}" if side == "before" or i != 3 else "lib/3", None, None, f"h{i}") for i in range(5)]
        v += [(side, f"{p}s{i}", "symbol", f"src/{i}", f"n{i}", "same" if i > 2 else f"anchor{i}", "x" if side == "before" or i else "y") for i in range(3)]
        v += [(side, f"{p}r{i}", "relation", None, "calls", None, "w") for i in range(3)] + [(side, f"{p}c{i}", "context", None, "module", None, "w") for i in range(2)] + [(side, f"{p}i", "invariant", None, "once", None, "w")]
    v += [("before", "bgone", "symbol", "src/9", "gone", "gone", "x"), ("before", "brgone", "relation", None, "calls", None, "w"), ("before", "bd1", "symbol", "p", "d", "d", ""), ("before", "bd2", "symbol", "p", "d", "d", ""), ("after", "ad", "symbol", "p", "d", "d", ""), ("before", "brd", "relation", None, "calls", None, "w"), ("before", "bcd", "context", None, "m", None, "")]
    links = []
    for side, p in (("before", "b"), ("after", "a")):
        links += [(side, f"{p}r{i}", 0, f"{p}s{i}") for i in range(3)] + [(side, f"{p}r{i}", 1, f"{p}s{(i + 1) % 3}") for i in range(3)]
        links += [(side, f"{p}c0", 0, f"{p}r0"), (side, f"{p}c0", 0, f"{p}f3"), (side, f"{p}c1", 0, f"{p}f4"), (side, f"{p}i", 0, f"{p}c0"), (side, f"{p}i", 0, f"{p}c1")]
    links += [("before", "brgone", 0, "bgone"), ("before", "brd", 0, "bd1"), ("before", "bcd", 0, "brd")]
    vertices = spark.createDataFrame(v, "side string, k string, kind string, path string, label string, anchor string, body string")
    renames = spark.createDataFrame([("src/3", "lib/3")], "old string, new string")
    got = {r["k"]: (r["stage"], r["status"], r["partner"]) for r in snapshots.map_snapshots(vertices, spark.createDataFrame(links, "side string, k string, place int, member string"), renames).collect()}
    assert got["br1"] == ("relation", "preserved", "ar1") and got["ac0"] == ("context", "preserved", "bc0") and got["bi"] == ("invariant", "preserved", "ai")
    assert got["bf3"] == ("rename", "preserved", "af3") and got["bs0"] == ("symbol_label", "modified", "as0")
    assert got["bgone"] == ("none", "removed", None) and got["brgone"] == ("none", "removed", None)
    assert got["bd1"][1:] == ("merged", None) and got["ad"][1:] == ("merged", None)
    assert got["brd"] == ("none", "unresolved", None) and got["bcd"] == ("none", "unresolved", None)
    assert len(got) == len(v)


def shuffled_rows(spark):
    """Rows that all statements so far have written to shuffles."""
    context = spark.sparkContext
    jvm, jsc = context._jvm, context._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    stages = jsc.statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_statement_of_a_mapping_shuffles_all_links(spark, monkeypatch):
    """What hangs on neighbours is mapped in rounds: none shuffles as many rows as there are links, the result is the same, and working tables are gone."""
    n, sides = 1500, (("before", "b"), ("after", "a"))
    v, links = [], []
    for side, p in sides:
        v += [(side, f"{p}s{i}", "symbol", "src", f"n{i}", None, "x") for i in range(40)]
        v += [(side, f"{p}r{i}", "relation", None, "calls", None, f"w{i % 5 if side == 'before' else 0}") for i in range(n)] + [(side, f"{p}c{i}", "context", None, "module", None, "w") for i in range(n // 3)]
        links += [(side, f"{p}r{i}", place, f"{p}s{m}") for i in range(n) for place, m in ((0, i % 40), (1, i // 40))] + [(side, f"{p}c{i}", 0, f"{p}r{i * 3 + j}") for i in range(n // 3) for j in range(2)]
    v += [("before", "bfree", "relation", None, "calls", None, "w"), ("before", "bnull", "relation", None, None, None, None), ("before", "bgone", "relation", None, "calls", None, "w"), ("before", "bhung", "context", None, "module", None, "w")]
    links += [("before", "bnull", 0, "bs7"), ("before", "bgone", 0, "nowhere"), ("before", "bhung", 0, "bfree")]
    vertices = spark.createDataFrame(v, "side string, k string, kind string, path string, label string, anchor string, body string")
    links = spark.createDataFrame(links, "side string, k string, place int, member string")
    renames = spark.createDataFrame([], "old string, new string")
    written, most, tables = snapshots.written, [0], []

    def counted(df, kind="table"):
        before = shuffled_rows(spark)
        tables.append(written(df, kind))
        most[0] = max(most[0], shuffled_rows(spark) - before)
        return tables[-1]

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(snapshots, "written", counted)
        whole = sorted(map(str, snapshots.map_snapshots(vertices, links, renames).collect()))
        most[0] = 0
        monkeypatch.setattr(snapshots, "MOST_LINKS", 2500, raising=False)
        tables.clear()
        mapped = snapshots.map_snapshots(vertices, links, renames)
        rows = mapped.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < most[0] < links.count()
    assert sorted(map(str, rows)) == whole and len(rows) == len(v)
    got = {r["k"]: (r["stage"], r["status"], r["partner"]) for r in rows}
    for i in range(n):
        assert got[f"br{i}"] == ("relation", "preserved" if i % 5 == 0 else "modified", f"ar{i}") and got[f"ac{i // 3}"] == ("context", "preserved", f"bc{i // 3}")
    assert got["bfree"] == got["bhung"] == ("none", "unresolved", None) and got["bnull"] == got["bgone"] == ("none", "removed", None)
    read = " ".join(mapped.inputFiles())
    left = [t.written_at for t in tables if Path(t.written_at.removeprefix("file:")).is_dir()]
    assert left and all(p in read for p in left)


def plain_fold(sizes, budget):
    left, out = budget, []
    for s in sizes:
        out.append(s <= left)
        left -= s if s <= left else 0
    return out


def test_folds_equal_a_loop(spark):
    r = random.Random(4)
    rows = [(g, i, r.choice([0, 1, r.randint(1, 60), 500])) for g in "abc" for i in range(700 if g == "a" else 60)]
    files = spark.createDataFrame(rows, "g string, path long, size long").repartition(7)
    for most in (None, 40):
        got = {(x["g"], x["path"]): x["outcome"] for x in folds.bounded(files, "g", "path", "size", 400, 3000, most).collect()}
        for g in "abc":
            total = 0
            for n, (_, path, size) in enumerate([x for x in rows if x[0] == g], 1):
                want = "too_many_files" if most and n > most else "file_too_large" if size > 400 else "total_exceeded" if total + size > 3000 else "accepted"
                total += size if want == "accepted" else 0
                assert got[g, path] == want
    at = folds.ordered(files, ["g"], ["path"])
    for budget in (0, 100, 2500):
        hit = {(x["g"], x["path"]) for x in at.join(folds.taken(at, ["g"], "size", budget), ["g", "_at"]).collect()}
        for g in "abc":
            own = [x for x in rows if x[0] == g]
            assert {(g, p) for (_, p, _), ok in zip(own, plain_fold([s for *_, s in own], budget)) if ok} == {x for x in hit if x[0] == g}


def test_context_files_equal_a_loop(spark):
    r = random.Random(12)
    caps = {"path_cap": 40, "test_cap": 2, "included_file_cap": 12, "artifact_bytes_cap": 90, "total_resolved_bytes_cap": 1100, "excerpt_bytes_cap": 30, "total_excerpt_bytes_cap": 200}
    files = [(f"f{i:02d}", r.choice([95, r.randint(10, 60)]), r.choice([35, r.randint(5, 28)]), i % 7 == 1, i % 9 == 2) for i in range(60)]
    reached = [(c, f"n{i}", d := r.randint(0, 4), [f"x{r.randint(0, 9)}" for _ in range(d)] + [f"n{i}"]) for c in (1, 2, 3) for i in r.sample(range(60), 50)]
    holds = [(f"f{i:02d}", f"n{i}") for i in range(60)]
    frame = spark.createDataFrame
    got = contexts.chosen_files(frame(reached, "context long, node string, depth int, path array<string>"), frame(holds, "file string, node string"), frame(files, "file string, bytes long, excerpt long, is_test boolean, giant boolean"), caps)
    found = {(x["context"], x["file"]): x["reason"] for x in got.collect()}
    reasons = set()
    by = {f[0]: f for f in files}
    for c in (1, 2, 3):
        order = sorted((d, p, f"f{int(n[1:]):02d}") for k, n, d, p in reached if k == c)
        tests = included = resolved = shown = 0
        for place, (_, _, f) in enumerate(order, 1):
            _, size, excerpt, is_test, giant = by[f]
            tests += is_test
            if place > caps["path_cap"]:
                why = "path_cap"
            elif is_test and tests > caps["test_cap"]:
                why = "test_cap"
            elif included >= caps["included_file_cap"]:
                why = "included_file_cap"
            elif size > caps["artifact_bytes_cap"]:
                why = "artifact_bytes_cap"
            elif resolved + size > caps["total_resolved_bytes_cap"]:
                why = "total_resolved_bytes_cap"
            else:
                resolved += size
                why = "giant_line" if giant else "excerpt_bytes_cap" if excerpt > caps["excerpt_bytes_cap"] else "total_excerpt_bytes_cap" if shown + excerpt > caps["total_excerpt_bytes_cap"] else None
                if why is None:
                    included, shown = included + 1, shown + excerpt
            assert found[c, f] == why, (c, place, f)
            reasons.add(why)
    counts = contexts.exclusion_counts(got, frame([(1,), (2,), (3,), (4,)], "context long"), 60).collect()
    assert {(x["context"], x["files"]) for x in counts if x["reason"] == "not_reached"} == {(1, 10), (2, 10), (3, 10), (4, 60)}
    assert reasons - {None} <= set(EXCLUSIONS)


def test_canonical_paths(spark):
    edges = spark.createDataFrame([("calls", "a", "p10"), ("calls", "a", "p1"), ("calls", "p10", "t"), ("calls", "p1", "t"), ("calls", "t", "u"), ("calls", "u", "v"), ("covers", "u", "w")], "kind string, src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (2, "u")], "context long, node string")
    got = {(x["context"], x["node"]): x["path"] for x in contexts.canonical_paths(seeds, edges, {"calls": 2, "covers": 1}).collect()}
    assert got[1, "t"] == ["a", "p1", "t"] and (1, "u") not in got and got[2, "w"] == ["u", "w"] and got[2, "v"] == ["u", "v"]


def test_enumeration_closes(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"k{i % 3}", i % 4 == 0) for i in range(40)], "node string, key string, off boolean")
    run = enumeration.enumerated(nodes, ["r1", "r2"], F.when(F.col("off"), "vendor"), 25)
    parts = Counter(x["part"] for x in run.collect())
    assert parts == {"admitted": 25, "deferred": 35, "excluded": 20}
    assert {x["part"]: x["n"] for x in enumeration.accounting(run).collect()} == dict(parts)
    assert enumeration.cover_faults(run, run).count() == 0 and enumeration.cover_faults(run, run.where("part <> 'deferred'")).count() == 35
    assert {x["n"] for x in enumeration.accounting(run.limit(0)).collect()} == {0}


def test_stateful_stream_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(3)
    states = sorted({x for t in TRANSITIONS for x in t})
    events = [(s, n, r.choice(states)) for n in range(30) for s in (1, 2)]
    put = lambda rows, name: spark.createDataFrame(rows, "stream long, seq long, state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")
    live = lambda: spark.readStream.schema("stream long, seq long, state string").parquet(f"{tmp_path}/in/*")
    go = lambda: stateful.run(spark, live(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    put(r.sample(events[:24], 24), "one")
    go()
    put(r.sample(events[24:], 36) + [(1, 3, "stale"), (3, 5, "planned")], "two")
    got = go().collect()
    want = [(3, 5, None, "planned", "first"), (1, 3, None, "stale", "behind")]
    for s in (1, 2):
        own = [x for _, _, x in sorted(e for e in events if e[0] == s)]
        want += [(s, n, own[n - 1] if n else None, x, "first" if not n else "legal" if (own[n - 1], x) in TRANSITIONS else "illegal") for n, x in enumerate(own)]
    assert Counter(tuple(x) for x in got) == Counter(want)


def test_a_break_in_one_hop_takes_its_claim_alone(spark):
    frame, n = spark.createDataFrame, 9
    claims = [(c, c) for c in range(n)]
    parsed = [(c, c) for c in range(n) if c != 1]
    bindings = [(c, f"e{c}", "reproduces") for c in range(n)] + [(c, f"s{c}", "supports") for c in range(n)]
    evidence = [(f"{k}{c}",) for c in range(n) for k in "es" if (k, c) != ("s", 2)]
    checks = [(c, f"e{c}", c != 3) for c in range(n)]
    decisions = [(c, 10 * c, "accept") for c in range(n)]
    findings = [(c, f"f{c}", 10 * c) for c in range(n) if c < 8]
    told = [(c, "verification", f"e{c}" if c != 5 else "e0") for c in range(n)] + [(c, "decision", str(10 * c)) for c in range(n) if c != 6] + [(c, "finding", f"f{c}") for c in range(n) if c not in (7, 8)]
    told = [x for x in told if x[0] != 4]
    got = chain.closed_chain(
        frame(claims, "claim int, execution int"), frame(parsed, "execution int, claim int"), frame(bindings, "claim int, evidence string, relation string"), frame(evidence, "evidence string"), frame(checks, "claim int, evidence string, passed boolean"),
        frame(told, "claim int, kind string, member string"), frame(decisions, "claim int, decision_id int, decision string"), frame(findings, "claim int, finding_id string, decision_id int"),
    )
    assert {r["claim"]: r["broken"] for r in got.collect()} == {0: None, 8: None, **{i + 1: hop for i, hop in enumerate(chain.HOPS)}}


def test_qualifications_through_nested_parts(spark):
    frame = spark.createDataFrame
    parts = frame([("s1", "b"), ("b", "c"), ("c", "s1"), ("s2", "d")], "section string, part string")
    asked = frame([("x", "c"), ("x", "d"), ("x", "dom"), ("y", "d"), ("y", "b"), ("z", "b")], "context string, qualification string")
    got = chain.qualification_faults(asked, frame([("dom",)], "id string"), frame([("x", "s1"), ("y", "s2")], "context string, section string"), parts)
    assert sorted(tuple(r) for r in got.select("context", "qualification").collect()) == [("x", "d"), ("y", "b"), ("z", "b")]


def test_schema_violations_have_pointers(spark):
    schema = {"type": "object", "required": ["a/b", "n"], "additionalProperties": False, "properties": {"a/b": {"type": "array", "uniqueItems": True, "items": {"type": "object", "properties": {"x": {"type": "number", "maximum": 2}}}}, "n": {"type": "null"}, "s": {"type": "string", "pattern": "^a", "maxLength": 3}}}
    bodies = ['{"a/b": [], "n": null}', '{"a/b": [{"x": 1}, {"x": 3}, {"x": 1}, 7], "n": 0}', '{"s": "bcde", "z": 1}', "[1]", "nonsense", None, '{"a/b": [{"x": 1.5}, {"x": "2"}], "n": null, "s": "a\\u00e9"}']
    docs = spark.createDataFrame([*[(i, "one", b) for i, b in enumerate(bodies)], (90, "two", "{}"), (91, None, "{}")], "id int, schema string, body string")
    got = sorted((r["id"], r["pointer"], r["rule"]) for r in schemas.violations(docs, {"one": schema}).collect())
    assert got == sorted([
        (1, "/a~1b", "uniqueItems"), (1, "/a~1b/1/x", "maximum"), (1, "/a~1b/3", "type"), (1, "/n", "type"), (2, "/a~1b", "required"), (2, "/n", "required"), (2, "/s", "maxLength"), (2, "/s", "pattern"), (2, "/z", "additionalProperties"),
        (3, "", "type"), (4, "", "malformed"), (5, "", "malformed"), (6, "/a~1b/1/x", "type"), (90, "", "unknown_schema"), (91, "", "unknown_schema"),
    ])
    with pytest.raises(ValueError):
        schemas.violations(docs, {"one": {"oneOf": []}})


def test_arms(spark):
    frame = spark.createDataFrame
    trials = frame([(t, t // 4, t // 4, "g3" if t % 2 else "b1", "control" if t // 2 % 2 else "positive", f"in{t}") for t in range(12)], "trial int, pair int, unit int, arm string, role string, input_hash string")
    made = frame([(t, t != 5, f"in{t}" if t != 9 else "x", f"out{t}") for t in range(12) if t != 4], "trial int, valid boolean, input_hash string, output_hash string")
    given = frame([(t, f"out{t}" if t != 10 else "x") for t in range(12) if t != 8], "trial int, output_hash string")
    reasoned = arms.trial_reasons(trials, made, given)
    assert {r["trial"]: r["reason"] for r in reasoned.where("reason IS NOT NULL").collect()} == {4: "missing_collection", 5: "protocol_invalid", 9: "collection_binding_invalid", 8: "missing_score", 10: "score_binding_invalid"}
    assert {r["pair"]: r["excluded"] for r in arms.eligible_pairs(reasoned).collect()} == {0: 0, 1: 2, 2: 3}
    spans = "path string, s int, e int, tag string"
    findings = frame([(1, "f1", "p", 5, 30, "t"), (1, "f2", "p", 90, 91, "t"), (1, "f3", "p", 40, 41, "t"), (3, "f4", "p", 40, 40, "t"), (3, "f5", "q", 1, 1, "t"), (0, "f6", "p", 6, 6, "other")], f"trial int, finding string, {spans}")
    roots, anchors = frame([(0, "r1", "p", 1, 6, "t"), (0, "r2", "p", 29, 29, "t")], f"unit int, target string, {spans}"), frame([(0, "a1", "p", 35, 45, "t")], f"unit int, target string, {spans}")
    scores = arms.scored(trials, findings, roots, anchors)
    got = {r["trial"]: tuple(r)[1:] for r in scores.collect()}
    assert got[1] == (3, 2, 2, 1, 0) and got[3] == (2, 1, 0, 2, 1) and got[0] == (1, 0, 0, 1, 0) and got[11] == (0, 0, 0, 0, 0)
    total = {r["arm"]: r for r in arms.run_totals(reasoned, scores).collect()}
    assert (total["g3"]["detected"], total["g3"]["lead"], total["b1"]["lead"], total["g3"]["allegations"], total["g3"]["eligible"]) == (2, 2, -2, 1, 1)
    assert all(r["trials"] - r["counted"] == n for r, n in ((total["b1"], 3), (total["g3"], 2)))


@pytest.mark.parametrize("rounds", [2, 5])
def test_walks_from_shared_seeds_equal_a_loop(spark, rounds):
    r = random.Random(rounds)
    names = ["p1", "p10", "p2", "q\x00", "q\x00\x01", "q\x01", "q", "q!", "p1\x00"]
    edges = sorted({(r.choice(["calls", "callers", "covers"]), r.choice(names), r.choice(names)) for _ in range(22)})
    budgets, seeds = {"calls": 2, "callers": 2, "covers": 1}, [(c, n) for c in range(6) for n in r.sample(names, 2)]
    front = [(c, n, "", 0, (n,)) for c, n in seeds]
    want = {}
    for _ in range(rounds + 1):
        for c, n, _t, _l, p in front:
            want[c, n] = min(want.get((c, n), (99, ())), (len(p) - 1, p))
        steps = [(c, d, k, (left if t == k else budgets[k]) - 1, (*p, d)) for c, n, t, left, p in front for k, s, d in edges if s == n]
        least = {}
        for c, n, t, left, p in steps:
            if left >= 0:
                least[c, n, t, left] = min(least.get((c, n, t, left), p), p)
        front = [(*k, p) for k, p in least.items()]
    frame = spark.createDataFrame
    seeds, edges = frame(seeds, "context long, node string"), frame(edges, "kind string, src string, dst string")
    got = contexts.canonical_paths(seeds, edges, budgets, rounds).collect()
    assert {(x["context"], x["node"]): (x["depth"], tuple(x["path"])) for x in got} == want and len(got) == len(want)
    once = contexts.walked(seeds, edges, budgets, rounds)  # from each seed once, not once a context
    assert once.groupBy("start", "node").count().where("count > 1").isEmpty() and once.select("start").distinct().count() == seeds.select("node").distinct().count()


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_a_written_table_leave_the_disk(spark):
    before = _shuffle_files(spark)
    rows = store.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    left = [f for f in _shuffle_files(spark) - before if f.endswith(".data")]
    assert not left and rows.count() == 7
    assert spark.conf.get(store.SWEEP) == "false"  # as it was


def test_signal_pairs_are_judged_where_they_meet(spark, monkeypatch):
    """Facts that share all operations but no name pass no round, and rounds and blocks of any size lose no pair."""
    monkeypatch.setattr(signals, "BLOCK", 3)
    monkeypatch.setattr(signals, "ROUND", 40)
    monkeypatch.setattr(signals, "CHECKED", 5)
    rows = [(i, f"s{i}", [f"c{i // 2}"], [f"g{i}"], ["v", "w", "x", "y"]) for i in range(20)]
    facts = spark.createDataFrame(rows, "id long, shape string, callable array<string>, signature array<string>, operation array<string>")
    written = []
    keep = signals.written
    monkeypatch.setattr(signals, "written", lambda df, kind="table": written.append((kind, keep(df, kind))) or written[-1][1])
    monkeypatch.setattr(signals, "discard", lambda *t: None)
    got = sorted(tuple(x) for x in signals.signal_pairs(facts, 32).collect())
    assert got == [(2 * i, 2 * i + 1, 1, 0, 4, 1_000_000) for i in range(10)]
    met = [df for kind, df in written if kind == "met"]
    assert len(met) > 1 and sum(df.count() for df in met) < 40  # of 190 pairs that share an operation


def test_arms_in_rounds_equal_one_round(spark, monkeypatch):
    """Findings that meet several targets, given twice or across cells, count once in any number of rounds."""
    r = random.Random(4)
    trials = spark.createDataFrame([(t, t // 4, "control" if t % 2 else "positive") for t in range(8)], "trial int, unit int, role string")
    span = lambda: (r.choice("pq"), (s := r.randrange(30)), s + r.randrange(12), r.choice("tu"))
    found = [(r.randrange(8), f"f{i}", *span()) for i in range(30)]
    roots, anchors = ([(r.randrange(2), f"{k}{i}", *span()) for i in range(12)] for k in "ra")
    spans = "path string, s int, e int, tag string"
    monkeypatch.setattr(arms, "ROUND", 15)
    got = arms.scored(trials, spark.createDataFrame([*found, *found[:5]], f"trial int, finding string, {spans}"), spark.createDataFrame(roots, f"unit int, target string, {spans}"), spark.createDataFrame(anchors, f"unit int, target string, {spans}"))
    meet = lambda f, x: f[0] // 4 == x[0] and f[2] == x[2] and f[5] == x[5] and f[3] <= x[4] and x[3] <= f[4]
    for row in got.collect():
        own = [f for f in found if f[0] == row["trial"]]
        hit = {x[1] for f in own for x in roots if meet(f, x)}
        on = [f for f in own if any(meet(f, x) for x in anchors)]
        matched = [f for f in own if f in on or any(meet(f, x) for x in roots)]
        control = row["trial"] % 2
        assert tuple(row) == (row["trial"], len(own), len(matched), len(hit), len(own) if control else len(own) - len(matched), len(on) if control else 0)


def test_resolved_calls_keep_their_callers(spark):
    """Edges come from the resolved calls alone: the call sites are not joined to them once more."""
    frame = spark.createDataFrame
    sites = frame([(1, 7, "m", "", None, "plain", "f"), (2, 7, "m", "", None, "plain", "f"), (3, 8, "m", "", None, "plain", "far"), (4, 8, "m", "", None, "plain", "gone"), (5, 9, "m", "", None, "plain", "f")], "call_id long, caller long, file string, scope string, owner string, form string, name string")
    declared = frame([(1, "m", "", None, "f", True), (2, "n", "", None, "far", True)], "k long, file string, scope string, owner string, name string, public boolean")
    none = {"imports": "file string, place int, local string, module string, imported string", "globs": "file string, place int, module string", "aliases": "file string, exported string, name string", "reexports": "file string, exported string, module string, imported string"}
    met = calls.resolved(sites, declared, frame([(9, "f")], "caller long, name string"), **{k: frame([], v) for k, v in none.items()})
    assert sorted(tuple(x) for x in calls.edges(met).collect()) == [(7, 1, "exact", 2), (8, 2, "name_only", 1)]


def test_folds_of_files_carry_no_paths(spark, monkeypatch):
    frame, kept, keep = spark.createDataFrame, {}, contexts.written
    monkeypatch.setattr(contexts, "written", lambda df, kind="table": kept.setdefault(kind, df) and keep(df, kind))
    reached = frame([(1, "n", 1, ["s", "n"]), (1, "m", 2, ["s", "n", "m"])], "context long, node string, depth int, path array<string>")
    files = frame([("f", 10, 5, False, False), ("g", 20, 5, False, False)], "file string, bytes long, excerpt long, is_test boolean, giant boolean")
    caps = {"path_cap": 9, "test_cap": 9, "included_file_cap": 9, "artifact_bytes_cap": 99, "total_resolved_bytes_cap": 15, "excerpt_bytes_cap": 99, "total_excerpt_bytes_cap": 99}
    got = contexts.chosen_files(reached, frame([("f", "n"), ("g", "m")], "file string, node string"), files, caps).collect()
    assert sorted((r["file"], r["place"], r["path"], r["reason"]) for r in got) == [("f", 1, ["s", "n"], None), ("g", 2, ["s", "n", "m"], "total_resolved_bytes_cap")]
    assert not any("path" in kept[k].columns for k in ("placed", "resolved", "shown"))


def test_context_files_in_rounds_equal_the_whole(spark, monkeypatch):
    """Walks and contexts go in rounds: no table of a round holds all rows, the result is that of canonical paths ranked whole, and working tables are gone."""
    r = random.Random(21)
    caps = {"path_cap": 12, "test_cap": 2, "included_file_cap": 4, "artifact_bytes_cap": 90, "total_resolved_bytes_cap": 300, "excerpt_bytes_cap": 30, "total_excerpt_bytes_cap": 60}
    budgets, frame = {"calls": 3, "callers": 2}, spark.createDataFrame
    files = frame([(f"f{i:02d}", r.choice([95, r.randint(10, 60)]), r.choice([35, r.randint(5, 28)]), i % 5 == 1, i % 9 == 2) for i in range(30)], "file string, bytes long, excerpt long, is_test boolean, giant boolean")
    holds = frame([(f"f{i % 30:02d}", f"n{i}") for i in range(56)], "file string, node string")
    edges = frame([x for i in range(1, 60) for x in (("calls", f"n{i}", f"n{i // 3}"), ("callers", f"n{i // 3}", f"n{i}"))], "kind string, src string, dst string")
    seeds = frame([(c, f"n{i}") for c in range(9) for i in r.sample(range(56), 3)] + [(9, "n58"), (9, "alone"), (10, "alone")], "context long, node string")
    whole = contexts.chosen_files(contexts.canonical_paths(seeds, edges, budgets, 4), holds, files, caps)
    kept, keep = [], contexts.written
    monkeypatch.setattr(contexts, "written", lambda df, kind="table", *by: kept.append((kind, keep(df, kind, *by))) or kept[-1][1])
    monkeypatch.setattr(contexts, "WALKED", 25)
    monkeypatch.setattr(contexts, "RANKED", 12)
    got = contexts.files_in_rounds(seeds, edges, holds, files, budgets, caps, 4)
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, whole.collect())) and len({x["reason"] for x in got.collect()}) > 5
    parts = [t for kind, t in kept if kind == "chosen"]
    assert len(parts) > 2 and max(t.count() for t in parts) < len(rows) / 2
    read = " ".join(got.inputFiles())
    assert all(t.written_at in read for _, t in kept if Path(t.written_at.removeprefix("file:")).is_dir())
    counts = contexts.files_in_rounds(seeds, edges, holds, files, budgets, caps, 4, counted=True)
    assert sorted(map(str, contexts.excluded(counts, seeds, 30).collect())) == sorted(map(str, contexts.exclusion_counts(whole, seeds, 30).collect()))


def test_edges_equal_links_of_their_ends(spark, monkeypatch):
    """Relations given as edges are mapped as those given as vertices with two links, in rounds, and no statement shuffles a row for each end."""
    r = random.Random(5)
    v, links, edges = [], [], []
    for side, p in (("before", "b"), ("after", "a")):
        v += [(side, f"{p}s{i}", "symbol", "src", f"n{min(i, 37)}" if side == "before" or i % 9 else f"new{i}", None, "x") for i in range(40)]
        for i in range(300):
            ends = (f"{p}s{i % 40}", f"{p}s{i // 40 * 5}" if i % 50 else "nowhere")
            ends = ends if side == "before" or i % 23 else ends[::-1]
            edges.append((side, f"{p}r{i}", "calls" if i % 7 else None, f"w{r.randint(0, 1)}", *ends))
        edges += [(side, f"{p}two{j}", "calls", "w", f"{p}s1", f"{p}s2") for j in range(2 if side == "before" else 1)]
        v += [(side, f"{p}c{i}", "context", None, "module", None, "w") for i in range(100)]
        links += [(side, f"{p}c{i}", 0, f"{p}r{i * 3 + j}") for i in range(100) for j in range(2)]
    frame = spark.createDataFrame
    columns, linked = "side string, k string, kind string, path string, label string, anchor string, body string", "side string, k string, place int, member string"
    renames = frame([], "old string, new string")
    old = snapshots.map_snapshots(frame(v + [(s, k, "relation", None, label, None, body) for s, k, label, body, *_ in edges], columns), frame(links + [(e[0], e[1], place, e[4 + place]) for e in edges for place in (0, 1)], linked), renames)
    want = sorted(map(str, old.collect()))
    monkeypatch.setattr(snapshots, "MOST_EDGES", 200)
    for hashed in (0, 600_000):  # names sorted, and as a hash table
        monkeypatch.setattr(snapshots, "HASHED", hashed)
        got = snapshots.map_snapshots(frame(v, columns), frame(links, linked), renames, frame(edges, "side string, k string, label string, body string, source string, target string"))
        assert sorted(map(str, got.collect())) == want
    assert len({x.split("status=")[1].split(",")[0] for x in want if "relation" in x}) > 4
