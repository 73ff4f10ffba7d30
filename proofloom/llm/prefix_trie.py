"""Prefix tries of conversations: partial tries of partitions, merged by hash, rolled up from the ends of their paths.

A turn is known by a digest of role and text, a node by a chain of the digests from the root. Chains are cut
into blocks of BLOCK turns, chained apart and joined, so a conversation of any length is the work of many tasks. Texts are
shuffled once, to order the turns; all else moves digests.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, running, written

#: Turns of a block of a chain.
BLOCK = 1024
#: Ids of a piece of an end list.
PIECE = 4096
#: Nodes that a partition combines before it hands them on; partial tries that one task of a merge puts together.
MOST_NODES, FAN_IN = 1 << 17, 64
_ROOT = b"\0" * 16


def _chain(before: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(before + digest, digest_size=16).digest()


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, digest, chars) as a table: places from 0 by turn (null first), then role and text; null roles and texts are empty.

    A range sort over all turns, counted up over its ranges: a conversation of any length is spread over tasks.
    """
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv IS NOT NULL")
    by = ["conv", "turn", "role", "text"]  # ascending: nulls first
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", digest.alias("digest"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"))
    placed = written(placed.withColumn("part", F.shiftright("at", 33)), "turns")
    # a row for each conversation and range
    parts = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv", "part", "first", before.alias("before"))
    turns = written(placed.join(parts, ["conv", "part"]).select("conv", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "digest", "chars"), "turns")
    discard(placed)
    return turns


def rebuilt(turns: DataFrame, host: Column, taken: Column, most: int) -> DataFrame:
    """(conv, depth, digest, chars, is_end): conversations that begin with turns of their host, with depth 0 for each.

    host and taken are of conv: the conversation whose first `taken` turns (at most `most`) stand in for the first `taken` of conv's own.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    heads = turns.where(F.col("pos") < most).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))  # `most` turns at most
    convs = sizes.select("conv", "n", host.alias("host"), taken.cast("long").alias("h")).join(heads.select(F.col("conv").alias("host"), "head"), "host", "left")
    lead = F.least("h", F.coalesce(F.size("head").cast("long"), F.lit(0)))
    convs = convs.withColumn("lead", F.when(F.col("head").isNull(), 0).otherwise(lead))
    convs = written(convs.withColumn("length", F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "convs")
    shared = convs.where("lead > 0").select("conv", "length", F.explode(F.slice("head", F.lit(1), F.col("lead").cast("int"))).alias("t"))
    shared = shared.select("conv", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.chars", "length")
    own = turns.join(convs.select("conv", "h", "lead", "length"), "conv").where("pos >= h")
    own = own.select("conv", (F.col("lead") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "chars", "length")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars"), "length")
    paths = written(shared.union(own).union(roots).select("conv", "depth", "digest", "chars", (F.col("depth") == F.col("length")).alias("is_end")), "rebuilt")
    discard(convs)
    return paths


def _block() -> Column:
    return F.floor(F.col("depth") / BLOCK).cast("long")


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, chars, is_end) as a table: the node of each place of a conversation (conv, depth from 0 without gaps, digest, chars, is_end)."""

    def chained(parts):
        import pyarrow as pa

        conv = block = None
        before = _ROOT
        for batch in parts:
            nodes, parents = [], []
            for c, d, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if c != conv or d // BLOCK != block:
                    conv, block, before = c, d // BLOCK, _ROOT
                parents.append(before)
                if d:
                    before = _chain(before, digest)
                nodes.append(before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column(3), batch.column(4)], ["conv", "depth", "node", "parent", "chars", "is_end"])

    dealt = turns.select("conv", "depth", "digest", "chars", "is_end").repartitionByRange("conv", _block()).sortWithinPartitions("conv", "depth")
    inner = written(dealt.mapInArrow(chained, "conv long, depth long, node binary, parent binary, chars long, is_end boolean"), "paths")
    lasts = inner.where((F.col("depth") + 1) % BLOCK == 0).select("conv", (_block() + 1).alias("block"), F.col("node").alias("digest"))  # the last node of a full block
    if lasts.isEmpty():
        return inner

    def joined(parts):
        import pyarrow as pa

        conv, before = None, _ROOT
        for batch in parts:
            out = []
            for c, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                before = _chain(_ROOT if c != conv else before, digest)
                conv = c
                out.append(before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["conv", "block", "outer"])

    # a row for every BLOCK turns of a conversation
    outer = written(lasts.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(joined, "conv long, block long, outer binary"), "blocks")
    whole = lambda before, node: F.substring(F.unhex(F.sha2(F.concat(before, node), 256)), 1, 16)
    rows = inner.withColumn("block", _block()).join(outer, ["conv", "block"], "left")
    earlier = outer.select("conv", (F.col("block") + 1).alias("block"), F.col("outer").alias("outer_before"))
    rows = rows.join(earlier, ["conv", "block"], "left").join(lasts.select("conv", "block", F.col("digest").alias("last_before")), ["conv", "block"], "left")
    node = F.when(F.col("outer").isNull(), F.col("node")).otherwise(whole(F.col("outer"), F.col("node")))
    # the first of a block hangs under the last of the block before
    last = F.when(F.col("outer_before").isNull(), F.col("last_before")).otherwise(whole(F.col("outer_before"), F.col("last_before")))
    parent = F.when(F.col("outer").isNull(), F.col("parent")).when(F.col("depth") % BLOCK == 0, last).otherwise(whole(F.col("outer"), F.col("parent")))
    found = written(rows.select("conv", "depth", node.alias("node"), parent.alias("parent"), "chars", "is_end"), "paths")
    discard(inner, outer)
    return found


def nodes(steps: DataFrame) -> DataFrame:
    """(node, parent, depth, chars, n, least) as a table: tries of partitions, merged by node until one is left; n members, the smallest of them."""

    def combined(parts):
        import pyarrow as pa

        def given(kept):
            columns = list(zip(*((k, *v) for k, v in kept.items())))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["node", "parent", "depth", "chars", "n", "least"])

        kept = {}
        for batch in parts:
            for node, parent, depth, chars, conv in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held = kept.get(node)
                if held is None:
                    kept[node] = [parent, depth, chars, 1, conv]
                else:
                    held[3] += 1
                    held[4] = min(held[4], conv)
            if len(kept) > MOST_NODES:
                yield given(kept)
                kept = {}
        if kept:
            yield given(kept)

    schema = "node binary, parent binary, depth long, chars long, n long, least long"
    tries = written(steps.select("node", "parent", "depth", "chars", "conv").mapInArrow(combined, schema).withColumn("part", F.spark_partition_id()), "tries")
    width = (tries.agg(F.max("part")).first()[0] or 0) + 1
    merged = lambda df, *keys: df.groupBy("node", *keys).agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n").alias("n"), F.min("least").alias("least"))
    while width > FAN_IN:
        fewer = written(merged(tries.withColumn("part", F.floor(F.col("part") / FAN_IN)), "part"), "tries")
        discard(tries)
        tries, width = fewer, -(-width // FAN_IN)
    found = written(merged(tries), "nodes")
    discard(tries)
    return found


def end_digests(steps: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: SHA-256 of their ids, ascending, joined by commas.

    Lists are sorted by range, so those of one node may lie in many tasks, which join pieces of PIECE ids; the digest then reads the pieces in turn
    and holds one batch of them.
    """

    def pieces(parts):
        import pyarrow as pa

        node, ids = None, []
        out = []

        def flushed():
            if ids:
                out.append((node, ids[0], ",".join(map(str, ids)).encode()))

        for batch in parts:
            for n, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node or len(ids) >= PIECE:
                    flushed()
                    node, ids = n, []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "first", "ids"])
                out = []
        flushed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "first", "ids"])

    def digested(parts):
        import pyarrow as pa

        node, held = None, None
        for batch in parts:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != node:
                    if held is not None:
                        out.append((node, held.hexdigest()))
                    node, held = n, hashlib.sha256(ids)
                else:
                    held.update(b"," + ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([held.hexdigest()])], ["node", "ends_sha256"])

    ends = steps.where("is_end").select("node", "conv")
    listed = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node binary, first long, ids binary")
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digested, "node binary, ends_sha256 string")


def rolled_up(steps: DataFrame, found: DataFrame, children: DataFrame) -> DataFrame:
    """(node, n_leaves, saved) summed over subtrees.

    A node belongs to its smallest member. The nodes of one conversation are the lower end of its path: their values are summed from the
    end up, and the sum of all goes to each node above them on the path. So a trie of any depth takes the same few steps.
    """
    own = found.join(children, "node", "left").select(F.col("least").alias("conv"), "depth", "node", ((F.col("n") - 1) * F.col("chars")).alias("value"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"))
    own = written(own.withColumn("block", -_block()).withColumn("up", -F.col("depth")), "own")
    both = running(running(own, ["conv"], "block", [F.col("up")], F.col("value"), "value_below"), ["conv"], "block", [F.col("up")], F.col("leaf"), "leaf_below")
    lower = both.select("node", (F.col("leaf") + F.col("leaf_below")).alias("n_leaves"), (F.col("value") + F.col("value_below")).alias("saved"))
    totals = own.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("leaf").alias("n_leaves"), F.sum("value").alias("saved"))
    upper = steps.select("conv", "depth", "node").join(totals, "conv").where("depth < top").select("node", "n_leaves", "saved")
    sums = lower.union(upper).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    summed = written(sums, "rolled")
    discard(own)
    return summed


def trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix of the conversations.

    turns (conv, depth from 0 without gaps, digest, chars, is_end). No conversations, no rows. Equal conversations are members of the same
    nodes; a conversation without turns is one of the root. Prefixes are equal if their chains of 128-bit digests are.
    """
    steps = paths(turns)
    found = nodes(steps)
    children = written(found.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    summed = rolled_up(steps, found, children)
    whole = found.join(summed, "node").join(children, "node", "left").join(end_digests(steps), "node", "left")
    whole = written(whole, "trie")
    parents = whole.where("n_children > 0").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    below = whole.where("depth > 0").join(parents, "parent")  # many children of one node: split as a skewed join
    above = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = [
        F.col("least").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    ]
    out = written(below.select(*columns).union(above.select(*columns)), "nodes")
    discard(steps, found, children, summed, whole)
    return out


def conversation_trie(rows: DataFrame, host: Column | None = None, taken: Column | None = None, most: int = 5) -> DataFrame:
    """trie() of rows (conv_id, turn, role, text); with host and taken, of conversations rebuilt by rebuilt().

    Other columns are not read. Turns are ordered by turn (null first), then role and text; null roles and texts are empty; rows
    without conv_id are in no conversation; repeated rows are turns of their own.
    """
    turns = ordered_turns(rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text"))
    full = rebuilt(turns, F.col("conv") if host is None else host, F.lit(0) if taken is None else taken, most)
    out = trie(full)
    discard(turns, full)
    return out
