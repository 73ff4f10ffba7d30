"""Bounded contexts: walks with canonical paths, and files taken in their order under caps on count and bytes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, written
from .folds import ordered, summed, taken
from .graph import EXCLUSIONS

#: Starts that a round walks from, and seeds whose files are ranked in one: what a round shuffles and holds doesn't grow with the contexts.
WALKED, RANKED = 80_000, 150_000


def _shut(c: str):
    """An id without U+0000, in the same order: rows of walks hold paths as text, joined by it."""
    return F.replace(F.replace(F.col(c), F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))


def _opened(c):
    return F.replace(F.replace(c, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def _walks(seeds: DataFrame, edges: DataFrame, budgets: dict[str, int], most_rounds: int) -> DataFrame:
    """(start, node, depth, between) of walked(), a node once for each way it is met; .parts are its working tables."""
    spark = seeds.sparkSession
    steps = edges.join(F.broadcast(spark.createDataFrame(list(budgets.items()), "kind string, most int")), "kind")  # a row for each kind
    steps = steps.select("kind", "most", _shut("src").alias("src"), _shut("dst").alias("dst")).distinct()
    place = ["start", "node", "token"]
    starts = seeds.select(_shut("node").alias("start")).distinct()
    front = written(starts.select("start", F.col("start").alias("node"), F.lit("").alias("token"), F.lit(0).alias("left"), F.lit("").alias("between")), "walk")
    met = [front]
    every = front.select("start", "node", F.lit(0).alias("depth"), "between")
    for depth in range(1, most_rounds + 1):
        left = F.when(F.col("token") == F.col("kind"), F.col("left") - 1).otherwise(F.col("most") - 1)
        between = F.lit("") if depth == 1 else F.concat("between", "node", F.lit("\x00"))
        step = front.join(steps, front["node"] == steps["src"]).where("dst <> start").select("start", F.col("dst").alias("node"), F.col("kind").alias("token"), left.alias("left"), between.alias("between")).where("left >= 0")
        if depth == most_rounds:
            every = every.unionByName(step.select("start", "node", F.lit(depth).alias("depth"), "between"))
            break
        best = step.repartition(*place).groupBy(*place, "left").agg(F.min("between").alias("between"))
        seen = reduce(DataFrame.unionByName, [m.select(*place, F.col("left").alias("_left")) for m in met])
        best = best.join(seen.groupBy(*place).agg(F.max("_left").alias("_left")), place, "left").where("_left IS NULL OR _left < left")
        front = written(best.select(*place, "left", "between"), "walk")
        if front.isEmpty():
            discard(front)
            break
        met.append(front)
        every = every.unionByName(front.select("start", "node", F.lit(depth).alias("depth"), "between"))
    every.parts = met
    return every


def walked(seeds: DataFrame, edges: DataFrame, budgets: dict[str, int], most_rounds: int = 16) -> DataFrame:
    """(start, node, depth, between): every node that a walk from a start reaches, by its least path: fewest steps, then the ids in order. A start is a node of seeds.

    edges(kind, src, dst) with each direction a kind of its own. Within one kind a walk makes at most budgets[kind] steps, a change of kind starts anew. Ids are
    shut; between has those of the path after the start and before the node, each with a U+0000 after it, so text is in the order of paths and rows are short.
    States (start, node, kind, steps left) are visited once, by the least path to them. A state is left out where an earlier round met its node by the same kind with
    as many steps left, and where its node is the start: whatever comes after it is reached from there in fewer steps. The last round keeps no states. Rows are dealt by start.
    """
    every = _walks(seeds, edges, budgets, most_rounds)
    return every.repartition("start").groupBy("start", "node").agg(F.min(F.struct("depth", "between")).alias("p")).select("start", "node", "p.depth", "p.between")


def canonical_paths(seeds: DataFrame, edges: DataFrame, budgets: dict[str, int], most_rounds: int = 16) -> DataFrame:
    """(context, node, depth, path): every node that a context's walk reaches from its seeds(context, node), by its least path; see walked().

    A walk doesn't depend on its context, so each seed is walked from once, however many contexts have it; a context takes the least path of its seeds.
    """
    of = seeds.select("context", _shut("node").alias("start")).distinct()
    rows = of.join(written(walked(seeds, edges, budgets, most_rounds), "walks"), "start")
    best = rows.groupBy("context", "node").agg(F.min(F.struct("depth", "start", "between")).alias("p"))
    whole = F.when(F.col("p.depth") == 0, F.col("node")).otherwise(F.concat("p.start", F.lit("\x00"), "p.between", "node"))
    return best.select("context", _opened(F.col("node")).alias("node"), "p.depth", F.transform(F.split(whole, "\x00"), _opened).alias("path"))


def chosen_files(reached: DataFrame, holds: DataFrame, files: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(context, file, place, depth, path, bytes, excerpt, reason): each context's files in order of their least path, reason null for those it includes.

    reached(context, node, depth, path), holds(file, node), files(file, bytes, excerpt, is_test, giant). caps: path_cap (files), test_cap (test
    files), included_file_cap, artifact_bytes_cap, total_resolved_bytes_cap, excerpt_bytes_cap, total_excerpt_bytes_cap. Files are
    resolved in order while they fit the total; of those resolved, ones with a giant line or an excerpt that doesn't fit are left out and the next take their
    place, until enough are included. Two running totals, each over what passed so far.
    """
    best = reached.join(holds, "node").groupBy("context", "file").agg(F.min(F.struct("depth", "path")).alias("p"))
    best = written(best.select("context", "file", "p.depth", "p.path"), "best")
    listed = written(best.join(files, "file"), "listed")
    discard(best)
    rows = ordered(listed, ["context"], ["depth", "path", "file"])
    discard(listed)
    told, rows = rows, written(rows.drop("path"), "places")  # the folds need the order alone
    places = summed(summed(rows, ["context"], F.lit(1), "place"), ["context"], F.when(F.col("is_test"), 1).otherwise(0), "tests")
    early = F.when(F.col("place") > caps["path_cap"], "path_cap").when(F.col("is_test") & (F.col("tests") > caps["test_cap"]), "test_cap")
    placed = written(places.withColumn("early", F.coalesce(early, F.when(F.col("bytes") > caps["artifact_bytes_cap"], "artifact_bytes_cap"))), "placed")
    resolved = taken(placed.where("early IS NULL"), ["context"], "bytes", caps["total_resolved_bytes_cap"]).withColumn("resolved", F.lit(True))
    read = written(placed.join(resolved, ["context", "_at"], "left"), "resolved")
    fits = F.col("resolved") & ~F.col("giant") & (F.col("excerpt") <= caps["excerpt_bytes_cap"])
    shown = taken(read.where(fits), ["context"], "excerpt", caps["total_excerpt_bytes_cap"]).withColumn("shown", F.lit(True))
    marked = written(read.join(shown, ["context", "_at"], "left").withColumn("fits", fits), "shown")
    counted = summed(marked, ["context"], F.when(F.col("shown"), 1).otherwise(0), "included")
    full = F.col("included") - F.when(F.col("shown"), 1).otherwise(0) >= caps["included_file_cap"]
    late = F.when(F.col("early") == "artifact_bytes_cap", F.col("early")).when(F.col("resolved").isNull(), "total_resolved_bytes_cap").when(F.col("giant"), "giant_line")
    late = late.when(F.col("excerpt") > caps["excerpt_bytes_cap"], "excerpt_bytes_cap").when(F.col("shown").isNull(), "total_excerpt_bytes_cap")
    reason = F.when(F.col("early").isin("path_cap", "test_cap"), F.col("early")).when(full, "included_file_cap").otherwise(late)
    judged = counted.select("context", "_at", "place", reason.alias("reason"))
    out = told.join(judged, ["context", "_at"]).select("context", "file", "place", "depth", "path", "bytes", "excerpt", "reason")
    out = written(out, "chosen")
    discard(told, rows, placed, read, marked)
    return out


def files_in_rounds(seeds: DataFrame, edges: DataFrame, holds: DataFrame, files: DataFrame, budgets: dict[str, int], caps: dict[str, int], most_rounds: int = 16, counted: bool = False) -> DataFrame:
    """chosen_files() of canonical_paths(); counted: (context, reason, files, bytes) of them instead, for excluded().

    Walks go in rounds of starts: what a start reaches is brought to files at once, each by its least path, and dealt to its contexts, which are ranked in rounds. Only the
    rounds' results stay, paths in two pieces. A context has each file once, so it is one task's sort; its first path_cap files alone are folded, each over those before it, so
    that cap is small. files have distinct ids.
    """
    of = written(seeds.select("context", _shut("node").alias("start")).distinct(), "seeds")
    one = {c: F.col(c) for c in ("bytes", "excerpt", "is_test", "giant")}
    held = written(holds.join(files, "file").select(_shut("node").alias("node"), "file", *one.values()), "held")
    n_seeds, n_starts = of.agg(F.count(F.lit(1)), F.count_distinct("start")).first()
    rounds, turns = max(1, math.ceil(n_seeds / RANKED)), max(1, math.ceil(n_starts / WALKED))
    dealt = []
    for t in range(turns):
        mine = of.where(F.pmod(F.xxhash64("start"), F.lit(turns)) == t)
        walks = _walks(mine.select(_opened(F.col("start")).alias("node")), edges, budgets, most_rounds)
        rest = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.concat("between", "node"))
        best = walks.join(held, "node").repartition("start").groupBy("start", "file").agg(F.min(F.struct("depth", rest.alias("rest"), *one)).alias("p")).select("start", "file", "p.*")
        dealt.append(written(mine.join(best, "start").withColumn("_round", F.pmod(F.xxhash64("context"), F.lit(rounds))), "dealt", "_round"))
        dealt[-1].parts = [dealt[-1].where(F.col("_round") == r) for r in range(rounds)]
        discard(*walks.parts)
    discard(held)
    order = ["depth", "start", "rest", "file"]
    before = Window.partitionBy("context").orderBy(*order)
    out = []
    for r in range(rounds):
        rows = reduce(DataFrame.unionByName, [t.parts[r] for t in dealt]).repartition("context")
        rows = rows.groupBy("context", "file").agg(F.min(F.struct("depth", "start", "rest", *one)).alias("p")).select("context", "file", "p.*")
        rows = rows.withColumns({"place": F.row_number().over(before).cast("long"), "tests": F.sum(F.when(F.col("is_test"), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0))})
        early = F.when(F.col("place") > caps["path_cap"], "path_cap").when(F.col("is_test") & (F.col("tests") > caps["test_cap"]), "test_cap")
        rows = rows.withColumn("early", early)
        fits = ~F.col("giant") & (F.col("excerpt") <= caps["excerpt_bytes_cap"])
        met = F.when(F.col("early").isNull() & (F.col("bytes") <= caps["artifact_bytes_cap"]), F.struct("bytes", "excerpt", fits.alias("fits")))
        rows = rows.withColumn("met", F.collect_list(met).over(before.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("state", F.when(F.col("early").isNull(), _folded(F.col("met"), caps)))  # all others cost no fold
        rows = rows.withColumn("reason", F.when(F.col("early").isNotNull(), F.col("early")).otherwise(_left_out(F.col("state"), one, caps)))
        if counted:
            out.append(written(_by_reason(rows), "excluded"))
        else:
            out.append(written(rows.select("context", "file", "place", "depth", "start", "rest", "bytes", "excerpt", "reason"), "chosen"))
        for t in dealt:  # what is ranked leaves the disk
            t.parts[r].written_at = f"{t.written_at}/_round={r}"
        discard(*[t.parts[r] for t in dealt])
    discard(of, *dealt)
    whole = reduce(DataFrame.unionByName, out)
    if counted:
        return whole
    path = F.when(F.col("depth") == 0, F.col("start")).otherwise(F.concat("start", F.lit("\x00"), "rest"))
    return whole.select("context", "file", "place", "depth", F.transform(F.split(path, "\x00"), _opened).alias("path"), "bytes", "excerpt", "reason")


def _left_out(state: Column, one: dict[str, Column], caps: dict[str, int]) -> Column:
    """Why a file is left out that meets state (resolved, shown, included); null if it isn't."""
    reason = F.when(state["included"] >= caps["included_file_cap"], "included_file_cap").when(one["bytes"] > caps["artifact_bytes_cap"], "artifact_bytes_cap")
    reason = reason.when(state["resolved"] + one["bytes"] > caps["total_resolved_bytes_cap"], "total_resolved_bytes_cap").when(one["giant"], "giant_line")
    return reason.when(one["excerpt"] > caps["excerpt_bytes_cap"], "excerpt_bytes_cap").when(state["shown"] + one["excerpt"] > caps["total_excerpt_bytes_cap"], "total_excerpt_bytes_cap")


def _folded(met: Column, caps: dict[str, int]) -> Column:
    """struct(resolved, shown, included) after the files met(bytes, excerpt, fits), in their order; fits: an excerpt of its own would do."""

    def step(state: Column, x: Column) -> Column:
        read = (state["included"] < caps["included_file_cap"]) & (state["resolved"] + x["bytes"] <= caps["total_resolved_bytes_cap"])
        taken = read & x["fits"] & (state["shown"] + x["excerpt"] <= caps["total_excerpt_bytes_cap"])
        more = {"resolved": F.when(read, x["bytes"]), "shown": F.when(taken, x["excerpt"]), "included": F.when(taken, F.lit(1).cast("long"))}
        return F.struct(*[(state[c] + n.otherwise(F.lit(0).cast("long"))).alias(c) for c, n in more.items()])

    return F.aggregate(met, F.struct(*[F.lit(0).cast("long").alias(c) for c in ("resolved", "shown", "included")]), step)


def _by_reason(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("context", F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def exclusion_counts(chosen: DataFrame, contexts: DataFrame, n_files: int) -> DataFrame:
    """(context, reason, files, bytes): files of each context by reason, `included` for those that stay; not_reached is what the table has beside them."""
    return excluded(_by_reason(chosen), contexts, n_files)


def excluded(met: DataFrame, contexts: DataFrame, n_files: int) -> DataFrame:
    """met(context, reason, files, bytes) with not_reached for each context: the files that none of its rows counts."""
    reached = contexts.select("context").distinct().join(met.groupBy("context").agg(F.sum("files").alias("n")), "context", "left")
    others = reached.select("context", F.lit("not_reached").alias("reason"), (F.lit(n_files) - F.coalesce("n", F.lit(0))).cast("long").alias("files"), F.lit(None).cast("long").alias("bytes"))
    return met.unionByName(others.where("files > 0"))
