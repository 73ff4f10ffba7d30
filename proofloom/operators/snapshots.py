"""Mapping of two snapshots by kind, where later stages know a vertex by what its neighbours were mapped to."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, written

#: Links, or vertices, of a round where more don't need more rounds than the most: each round reads what it is drawn from anew, so their number stays fixed.
MOST_LINKS, MOST_ROUNDS = 4_000_000, 16
#: Edges of a round, likewise; names that a task holds as a hash table, beyond which they are sorted.
MOST_EDGES, HASHED = 12_000_000, 600_000

#: Status of a component by its numbers of vertices before and after.
STATUSES = ("added", "removed", "preserved", "modified", "split", "merged", "unresolved")


def status(before: Column, after: Column, same: Column) -> Column:
    one = F.when(same, "preserved").otherwise("modified")
    met = F.when((before == 1) & (after == 1), one).when(before == 1, "split").when(after == 1, "merged").otherwise("unresolved")
    return F.when(before == 0, "added").when(after == 0, "removed").otherwise(met)


def _rounds(n: int) -> int:
    return max(1, min(MOST_ROUNDS, math.ceil(n / MOST_LINKS)))


def _drawn(r: int, rounds: int, *by: str) -> Column:
    """Whether a row is of round r: by hash, so the views are filtered before they shuffle anything."""
    return F.pmod(F.xxhash64(*by), F.lit(rounds)) == r


def _paired(rows: DataFrame, stage: str) -> DataFrame:
    """rows(side, k, key, body, ..) with stage, status, partner, which are null where the key is not on both sides; all vertices of a key are one component."""
    of = lambda side: F.col("side") == side
    keyed = rows.where("key IS NOT NULL")
    groups = keyed.groupBy("key").agg(
        F.count_if(of("before")).alias("before"),
        F.count_if(of("after")).alias("after"),
        F.min(F.when(of("before"), F.struct("k", "body"))).alias("b"),
        F.min(F.when(of("after"), F.struct("k", "body"))).alias("a"),
    )
    one = (F.col("before") == 1) & (F.col("after") == 1)
    own = status(F.col("before"), F.col("after"), F.col("b.body").eqNullSafe(F.col("a.body")))
    met = groups.where("before > 0 AND after > 0").select("key", own.alias("status"), F.when(one, F.col("b.k")).alias("bk"), F.when(one, F.col("a.k")).alias("ak"))
    told = lambda df, stage, status, partner: df.select(*rows.columns, stage.alias("stage"), status.alias("status"), partner.alias("partner"))
    null = F.lit(None).cast("string")
    judged = told(keyed.join(met, "key", "left"), F.when(F.col("status").isNotNull(), stage), F.col("status"), F.when(of("before"), F.col("ak")).otherwise(F.col("bk")))
    return judged.unionByName(told(rows.where("key IS NULL"), null, null, null))


def _names(found: list[DataFrame]) -> DataFrame:
    """(side, member, name, known): one name for both ends of a pair, the id before; null where a component isn't a pair or hangs on one that isn't. New and gone vertices have no row."""
    every = reduce(DataFrame.unionByName, found).where(~F.col("status").isin("added", "removed"))
    name = F.when(F.col("partner").isNotNull(), F.when(F.col("side") == "before", F.col("k")).otherwise(F.col("partner")))
    return every.select("side", F.col("k").alias("member"), name.alias("name"), F.lit(True).alias("known"))


def _named(links: DataFrame, names: DataFrame) -> DataFrame:
    """links(side, member, name, known, ..) that have no name yet with that of their member, if names has one."""
    new = names.withColumnsRenamed({"name": "_name", "known": "_known"})
    filled = {c: F.coalesce(c, f"_{c}").alias(c) for c in ("name", "known")}
    return links.join(new, ["side", "member"], "left").select(*[filled.get(c, F.col(c)) for c in links.columns])


def neighbourhood_keys(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(side, k, key, body, ..) whose key also holds what the members of their links(side, k, place, name, known) were mapped to; blocked: a member's component isn't a pair.

    Members of one place are a set, whose order does not matter. Their names are added up to fingerprints, so an owner of
    any number of members is summed before it is shuffled: a count, an exclusive or and a sum of two 64-bit hashes. An owner with a member
    that is new, gone or unresolved has a null key; it is blocked in the last case, and where it has no member. Bodies stay where there is a key.
    """
    open_ = F.col("name").isNull()
    told = links.groupBy("side", "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(open_).alias("open"),
        F.count_if(open_ & F.col("known").isNotNull()).alias("unresolved"),
        F.bit_xor(F.xxhash64("place", "name")).alias("x"),
        F.sum(F.xxhash64(F.lit("sum"), "place", "name").cast("decimal(20,0)")).alias("s"),
    )
    closed = F.col("open") == 0
    changed = {"key": F.when(closed, F.struct("key", "n", "x", "s")), "body": F.when(closed, F.col("body"))}
    joined = rows.join(told, ["side", "k"], "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns], (F.coalesce("unresolved", F.lit(1)) > 0).alias("blocked"))


def keyed_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges(side, k, label, body, source, target) with the names of both ends instead of them, null where an end has none, and blocked: an end's component isn't a pair."""
    few = names.count() <= HASHED * int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for end in ("source", "target"):
        new = names.withColumnsRenamed({"member": end, "name": f"_{end}", "known": f"_known_{end}"})
        edges = edges.join(new.hint("shuffle_hash") if few else new, ["side", end], "left")
    blocked = [F.col(f"_{end}").isNull() & F.col(f"_known_{end}").isNotNull() for end in ("source", "target")]
    return edges.select("side", "k", F.coalesce("label", F.lit("")).alias("label"), "body", F.col("_source").alias("source"), F.col("_target").alias("target"), (blocked[0] | blocked[1]).alias("blocked"))


def paired_edges(rows: DataFrame, stage: str) -> DataFrame:
    """keyed_edges() rows with stage, status, partner, as _paired() has them. Those of one label and pair of names meet in one shuffle, sorted by a hash: they are parallel edges, a task's for one key."""
    closed = F.col("source").isNotNull() & F.col("target").isNotNull()
    key = ["label", "source", "target"]
    of = {side: lambda c, side=side: F.when(F.col("side") == side, F.col(c)) for side in ("before", "after")}
    all_ = Window.partitionBy("_hash", *key)
    met = rows.where(closed).withColumn("_hash", F.xxhash64(*key)).repartition("_hash")
    met = met.withColumns({f"_{side}": F.count(of[side]("side")).over(all_) for side in of} | {f"_{side}_{c}": F.min(of[side](c)).over(all_) for side in of for c in ("k", "body")})
    both, one = (F.col("_before") > 0) & (F.col("_after") > 0), (F.col("_before") == 1) & (F.col("_after") == 1)
    own = status(F.col("_before"), F.col("_after"), F.col("_before_body").eqNullSafe(F.col("_after_body")))
    partner = F.when(one, F.when(F.col("side") == "before", F.col("_after_k")).otherwise(F.col("_before_k")))
    null = F.lit(None).cast("string")
    told = lambda df, *new: df.select("side", "k", "blocked", *[c.alias(n) for c, n in zip(new, ("stage", "status", "partner"))])
    return told(met, F.when(both, stage), F.when(both, own), partner).unionByName(told(rows.where(~closed), null, null, null))


def map_snapshots(vertices: DataFrame, links: DataFrame, renames: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(side, k, kind, stage, status, partner): every vertex of both snapshots once; partner is set where a component is one of each side.

    vertices(side `before` or `after`, k, kind, path, label, anchor, body), k distinct on a side; links(side, k, place, member);
    renames(old, new) of files whose content is equal. In this order, each stage consuming what it pairs: files of one path, files of a
    rename with equal bodies, symbols of one path and label, symbols of one anchor, other artifacts of one path and label, then relations, contexts,
    invariants and limitations by label and what their members were mapped to. All vertices of a key are one component, never parted by a
    choice. Pairs are preserved if their bodies are equal. A vertex that hangs on an unresolved one is unresolved itself.

    edges(side, k, label, body, source, target): relations with a link of place 0 and one of place 1 each, if vertices and links don't hold them. An edge takes the names of
    its ends in its own row, so it is shuffled once for each end and once for its key, and links of edges are no rows.

    What hangs on neighbours is keyed in rounds by the hash of its id, and paired in rounds by the hash of its key: the shuffles of one round are
    on the disk at a time. A kind's rows are written once, as they are returned.
    """
    joined = lambda *c: F.when(reduce(Column.__and__, [F.col(x).isNotNull() for x in c]), F.concat_ws("\x1f", *c))
    kind = lambda *names: vertices.where(F.col("kind").isin(*names))
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    known = ("file", "symbol", "relation", "context", "invariant", "limitation")
    found: list[DataFrame] = []

    def told(rows: DataFrame, waits: Column) -> DataFrame:
        own = F.coalesce("status", F.when(waits, "unresolved"), F.when(F.col("side") == "before", "removed").otherwise("added"))
        return rows.select("side", "k", "kind", F.coalesce("stage", F.lit("none")).alias("stage"), own.alias("status"), "partner")

    def run(rows: DataFrame, stages: dict[str, Column]) -> None:
        rows = rows.select("side", "k", "kind", "body", *[key.alias(name) for name, key in stages.items()])
        for i, name in enumerate(stages):
            later, new = ["body", *list(stages)[i + 1 :]], F.col("status").isNull()
            met = _paired(rows.withColumnRenamed(name, "key"), name)
            if len(later) == 1:
                found.append(written(told(met, F.lit(False)), f"stage-{name}"))
            else:  # what isn't met keeps what the next stages read
                met = written(met.select("side", "k", "kind", *[F.when(new, F.col(c)).alias(c) for c in later], "stage", "status", "partner"), f"stage-{name}")
                found.append(told(met.where(~new), F.lit(False)))
                rows = met.where(new).select("side", "k", "kind", *later)

    moved = F.when(F.col("side") == "before", F.col("new")).otherwise(F.col("path"))
    files = kind("file").join(renames.groupBy(F.col("old").alias("path")).agg(F.min("new").alias("new")), "path", "left")
    run(files, {"path": F.col("path"), "rename": F.when(moved.isNotNull(), F.concat_ws("\x1f", moved, "body"))})
    run(kind("symbol"), {"symbol_label": joined("path", "label"), "symbol_anchor": F.col("anchor")})
    run(vertices.where(~F.col("kind").isin(*known)), {"exact_key": joined("kind", "path", "label")})

    def keyed(rows: DataFrame, held: DataFrame, name: str) -> DataFrame:
        rows = rows.where(F.col("kind") == name).select("side", "k", "kind", F.coalesce("label", F.lit("")).alias("key"), "body")
        return written(neighbourhood_keys(rows, held.where(F.col("kind") == name)), f"keys-{name}")

    first, *others = known[2:]
    keys, later = [], []
    unnamed = {"name": F.lit(None).cast("string"), "known": F.lit(None).cast("boolean")}
    if edges is not None:
        names = written(_names(found), "names")
        rounds = max(1, min(MOST_ROUNDS, math.ceil(64 * edges.where(_drawn(0, 64, "side", "k")).count() / MOST_EDGES)))
        turn = F.pmod(F.xxhash64("label", "source", "target"), F.lit(rounds)).alias("_round")
        parts = [written(keyed_edges(edges.where(_drawn(r, rounds, "side", "k")), names).select("*", turn), "keys-edges", "_round") for r in range(rounds)]
        done = []
        for r in range(rounds):
            mine = [t.where(F.col("_round") == r) for t in parts]
            rows = paired_edges(union(mine), first).withColumn("kind", F.lit(first))
            done.append(written(told(rows, F.col("blocked")), f"stage-{first}"))
            for t, m in zip(parts, mine):  # what is paired leaves the disk
                m.written_at = f"{t.written_at}/_round={r}"
            discard(*mine)
        discard(names, *parts)
        owners = kind(*others).select("side", "k", "kind")
        later = [written(links.join(owners, ["side", "k"]).withColumns(unnamed), "links-later")]
        # edges are named only if a link has a member that may be one
        met = union([f.select("side", "k") for f in found] + [owners.select("side", "k")]).withColumnRenamed("k", "member")
        fresh = [*found] if later[0].join(met, ["side", "member"], "left_anti").isEmpty() else [*found, *done]
        found.extend(done)
    else:
        rounds = _rounds(64 * links.where(_drawn(0, 64, "side", "k")).count())  # a 64th of the owners tells how many links there are
        for r in range(rounds):  # links are read once for all kinds; those of the first kind are keyed at once
            mine = _drawn(r, rounds, "side", "k")
            owners = written(kind(first, *others).where(mine).select("side", "k", "kind", "label", "body"), "owners")
            held = written(links.where(mine).join(owners.select("side", "k", "kind"), ["side", "k"]), "links")
            keys.append(keyed(owners, held.where(F.col("kind") == first).join(_names(found), ["side", "member"], "left"), first))
            later.append(written(held.where(F.col("kind") != first).withColumns(unnamed), "links-later"))
            discard(owners, held)

    for name in (first, *others) if edges is None else others:
        if name != first:
            # the links that are left learn what was mapped since they were named last, in rounds of names, which may be many more than they
            held, rounds = union(later).where(F.col("kind").isin(*others[others.index(name) :])), _rounds(union(fresh).count() // 4)
            drawn = [_drawn(r, rounds, "side", "member") for r in range(rounds)]
            named = [written(_named(held.where(mine), _names(fresh).where(mine)), "links-later") for mine in drawn]
            discard(*later)
            later, held = named, union(named)
            rounds = _rounds(held.where(F.col("kind") == name).count())
            keys = [keyed(kind(name).where(mine), held.where(mine), name) for mine in (_drawn(r, rounds, "side", "k") for r in range(rounds))]
        rows = union(keys)
        rounds = _rounds(rows.count())
        done = [written(told(_paired(rows.where(_drawn(r, rounds, "key")), name), F.col("blocked")), f"stage-{name}") for r in range(rounds)]
        discard(*keys)
        # those of the first kind are named with the files, symbols and others before it
        fresh = [*found, *done] if name == first else done
        found.extend(done)
    discard(*later)
    return union(found)
