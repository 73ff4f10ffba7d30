"""N-gram Jaccard join: equal sets fall together, small sets meet by fixed-size subsets, large ones by inverted lists.

Two sets of sizes a and b link only if they share o(a, b) shingles. A small (light) set therefore puts
forth all its subsets of the sizes o(a, b) of its possible partners; linked light sets share one. A
large (heavy) set is dealt by the hashes of its shingles into as many cells as the shingles in which linked
sets can differ, and some spare ones; linked sets then have more equal cells than spare ones. The contents of
cells are the elements of the inverted lists. Linked sets that differ in d shingles share
one of their first d + 1 elements in one fixed order, in which poor and frequent elements are last; under these they are listed. Single
shingles are no elements, for lists of frequent ones grow with the corpus.
The size where the one way costs more than the other is the boundary; light sets that can link to heavy ones
are listed too. Every candidate pair is checked on the whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, free_name, release, written
from .words import bytes_of, slices, word_hashes

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 1 << 20
#: A class of sizes spans this many of the steps by which linked sizes can differ.
_CLASS_STEPS = 3
#: Sets of each list that are checked against its others, round by round, before all that are left apart.
_PIVOTS = (1, 8)
#: Sets of a block, and the longest list whose pairs are joined as rows: longer ones are compared block by block.
_BLOCK, _SHORT = 256, 16
#: Least cells of a parity signature.
_SIGNED = 512

@dataclass(frozen=True)
class Terms:
    """words per shingle; sets link when den * intersection >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100

    def shared(self, a: int, b: int) -> int:
        """Fewest shingles that linked sets of sizes a and b share."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def subsets(self, n: int) -> list[int]:
        """Sizes of the subsets that a light set of n shingles puts forth."""
        return sorted({self.shared(n, m) for m in self.partners(n) if m >= 1})

    def classes(self, n: int) -> list[int]:
        """Size classes whose lists hold a set of n: its own and, if a partner can lie in the next, that too."""
        return sorted({self._class_of(n), self._class_of(self.partners(n)[-1])})

    def _class_of(self, n: int) -> int:
        return int(log(n) / (_CLASS_STEPS * log(self.den / self.num)) + 1e-9)

    def _top(self, c: int) -> int:
        """A bound on the sizes in class c."""
        return int((self.den / self.num) ** (_CLASS_STEPS * (c + 1))) + 1

    def _differ(self, both: int) -> int:
        """Most shingles in which linked sets of together `both` shingles differ."""
        return (self.den - self.num) * both // (self.den + self.num)

    def listed(self, n: int, c: int) -> int:
        """Elements under which a set of n is listed in class c: one more than it can differ in from a partner there."""
        return self._differ(n + min(self.partners(n)[-1], self._top(c))) + 1

    def cells(self, c: int) -> int:
        """Cells of a set in class c: more than its linked sets can differ in, and some spare ones."""
        most = self._differ(2 * self._top(c)) + 1
        return most + (most + 3) // 8

    def light_cost(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subsets(n))

    def boundary(self, list_length: float) -> int:
        """Largest size whose subsets cost no more than its inverted lists."""
        n = 0
        while n < 64 and self.light_cost(n + 1) <= self.listed(n + 1, self.classes(n + 1)[0]) * (1 + list_length):
            n += 1
        return n


def shingle_sets(column, terms: Terms):
    """For slices of an Arrow string column: the sorted distinct shingle hashes of each whole text.

    A-Z are lower-cased; a text of fewer words than a shingle is one shingle of all its words; null and empty texts have none.
    """
    for begin, end in slices(column):
        ids, first = word_hashes(column[begin:end], lower=True)
        counts = np.diff(first)
        h = np.full(len(ids), np.uint64(terms.words))
        for i in range(min(terms.words, len(h))):
            part = h[: len(h) - i]
            part ^= ids[i:]
            part *= _PRIME
            part ^= part >> np.uint64(32)
        for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), counts.tolist()):
            if n >= terms.words:
                s = h[a : b - terms.words + 1]
                s.sort()
                yield s if len(s) < 2 or (s[1:] != s[:-1]).all() else np.unique(s)
            elif n:
                x = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in ids[a:b]:
                        x = (x ^ w) * _PRIME
                        x ^= x >> np.uint64(32)
                yield np.array([x], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def shingle_set(text: str | None, terms: Terms) -> np.ndarray:
    """The set of one text."""
    import pyarrow as pa

    return next(shingle_sets(pa.array([text], pa.string()), terms))


def elements(s: np.ndarray, c: int, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a set in class c (a hash of class, cell and the cell's shingles each), and shingles in each cell."""
    k = terms.cells(c)
    with np.errstate(over="ignore"):
        mixed = (s ^ (s >> np.uint64(31))) * _PRIME
        cell = ((mixed >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, cell, mixed ^ (mixed >> np.uint64(29)))
        h = (sums ^ np.arange(1, k + 1, dtype=np.uint64) * _PRIME ^ np.uint64(c)) * _PRIME
    return (h ^ (h >> np.uint64(32))) * _PRIME, np.bincount(cell, minlength=k)


def _name(s: np.ndarray) -> int | None:
    """The node of a set: a 64-bit hash of it."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _described(docs: DataFrame, terms: Terms) -> DataFrame:
    """(kind, doc_id, mark, n, node, sign): one row of kind 0 per document, whose mark is a hash of id and text; of kind 1 per slot of elements that is frequent in some task
    (node: slot, n: how often); of kind 2 and 3 per task the elements and the slots that have any. One pass over the texts.
    """

    def describe(parts):
        import pyarrow as pa

        release()
        n, named = np.zeros(_CELLS, np.int64), set()
        types = {"kind": pa.int32(), "doc_id": pa.int64(), "mark": pa.int64(), "n": pa.int64(), "node": pa.int64(), "sign": pa.binary()}
        table = lambda *c: pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(c, types.values())], list(types))
        for batch in parts:
            sizes, nodes, signs = [], [], []
            for s in shingle_sets(batch.column(1), terms):
                node = _name(s)
                sizes.append(len(s))
                nodes.append(node)
                signs.append(signature(s) if len(s) else None)
                if len(s) and node not in named:
                    named.add(node)
                    np.add.at(n, (elements(s, terms.classes(len(s))[0], terms)[0] >> np.uint64(44)).astype(np.int64), 1)
            yield table([0] * len(sizes), batch.column(0), batch.column(2), sizes, nodes, signs)
        some = np.flatnonzero(n > max(12, 4 * n.mean()))
        k = len(some)
        yield table([1] * k + [2, 3], [None] * (k + 2), [None] * (k + 2), [*n[some].tolist(), int(n.sum()), int((n > 0).sum())], [*some.tolist(), None, None], [None] * (k + 2))

    marked = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark"))
    return marked.mapInArrow(describe, "kind int, doc_id long, mark long, n long, node long, sign binary")


def _frequent(described: DataFrame, most: int = 1 << 15) -> tuple[np.ndarray, float]:
    """Slots of elements that are frequent in some task, and the mean length of the lists.

    Only the order of elements and the boundary follow from these, never which pairs link; so the
    bound on the slots loses nothing.
    """
    sums = described.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "node").limit(most).collect()
    totals = {r[0]: r[1] for r in described.where("kind > 1").groupBy("kind").agg(F.sum("n")).collect()}
    return np.array(sorted(r[0] for r in top), np.int64), totals.get(2, 0) / max(1, totals.get(3, 1))


def _listed(nodes: list[int], keys: list[np.ndarray]):
    """A batch of (key, node)."""
    import pyarrow as pa

    counts = [len(k) for k in keys]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(nodes, np.int64), counts))], ["key", "node"])


def _keys(s: np.ndarray, terms: Terms, is_late: np.ndarray, boundary: int) -> list[int]:
    """Lookup keys of one set: subsets if it is light, elements if it is heavy or can link to a heavy one."""
    n, out = len(s), []
    if not n:
        return out
    if n <= boundary:
        for c in terms.subsets(n):
            for chosen in combinations(s.tolist(), c):
                h = c
                for x in chosen:
                    h = ((h ^ x) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
                    h ^= h >> 32
                out.append(h)
    if terms.partners(n)[-1] > boundary:
        for c in terms.classes(n):
            found, held = elements(s, c, terms)
            poor = np.minimum(held, 4) - 4 * is_late[(found >> np.uint64(44)).astype(np.int64)]
            out += found[np.lexsort((found, -poor))[: terms.listed(n, c)]].tolist()
    return out


def linked_components(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, mark, n_shingles, node, component_id) per row of docs (doc_id long, text); mark: xxhash64 of both.

    component_id: smallest doc_id reachable by links, the row's own for texts without words. Rows with
    equal sets are one node (named by a 64-bit hash of the set; two sets in 10**19 share a name).
    A null doc_id links like any other but is never the smallest; alone, its component_id is null.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    described = written(_described(docs, terms), "sets")
    sets = described.where("kind = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), "node", "sign")
    frequent, list_length = _frequent(described)
    boundary = terms.boundary(list_length)
    is_late = np.zeros(_CELLS, bool)
    is_late[frequent] = True

    def listing(parts):
        """Each set once a task: copies of one text put forth no more keys than there are tasks."""
        import pyarrow as pa

        release()
        named = set()
        for batch in parts:
            nodes, keys, held = [], [], 0
            for s in shingle_sets(batch.column(0), terms):
                node = _name(s)
                if node is None or node in named:
                    continue
                named.add(node)
                nodes.append(node)
                keys.append(np.array(_keys(s, terms, is_late, boundary), np.uint64).view(np.int64))
                held += len(keys[-1])
                if held > 1 << 17:
                    yield _listed(nodes, keys)
                    nodes, keys, held = [], [], 0
            if nodes:
                yield _listed(nodes, keys)

    some = sets.where("node IS NOT NULL")
    classes = written(some.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.min("mark").alias("mark"), F.first("sign").alias("sign")), "classes")
    # dealt by key once: the lists of two sets or more are found and kept within the same partitions
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = docs.select("text").mapInArrow(listing, "key long, node long").where("key IS NOT NULL").repartition(parts, "key")
    many = listed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    listed = written(listed.join(many.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key", "node"]), "lists")
    # a central set has many partners: it meets those of its lists that differ a little, each in its own way
    length = listed.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    central = listed.join(length, "key").groupBy("node").agg(F.sum("length").alias("met"))
    lists, listed = listed, written(listed.join(central.join(classes.select("node", "n"), "node"), "node"), "central")
    discard(lists)
    edges, roots = None, None
    for pivots in _PIVOTS:
        rows = _split(listed, roots)
        heads = rows.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("_part")).agg(F.max(F.struct("met", "node", "root", "n")).alias("pivot"))
        heads = heads.select("key", F.col("pivot.node").alias("p"), F.col("pivot.root").alias("p_root"), F.col("pivot.n").alias("p_n"))
        stars = rows.join(heads, "key").where(F.col("root") != F.col("p_root")).where(_fits("n", "p_n", terms))
        stars = stars.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        stars = written(stars, "stars")
        found = _linked(stars, docs, classes, terms)
        discard(stars, roots)
        edges = found if edges is None else edges.union(found)
        roots = components(edges)
    # what the stars leave apart: all pairs of a list that lie in different components
    open_ = _split(listed, roots)
    length = open_.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    open_ = written(open_.join(length, "key").select("key", "node", "root", "n", "length"), "open")
    one = open_.where(F.col("length") <= _SHORT).select("key", F.col("root").alias("r1"), F.col("node").alias("x"), F.col("n").alias("nx"))
    two = one.select("key", F.col("r1").alias("r2"), F.col("x").alias("y"), F.col("nx").alias("ny"))
    pairs = one.join(two, "key").where("r1 < r2").where(_fits("nx", "ny", terms)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.union(_by_blocks(open_.where(F.col("length") > _SHORT), classes, terms)).distinct()
    pairs = written(pairs, "pairs")
    more = _linked(pairs, docs, classes, terms)
    discard(pairs, open_, listed)
    if not more.isEmpty():
        roots = components(edges.union(more))
    named = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    node_component = named.join(least, "root").select("node", "component_id")
    joined = sets.select("doc_id", "mark", "n_shingles", "node").join(node_component, "node", "left")
    return joined.select("doc_id", "mark", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _by_blocks(open_: DataFrame, classes: DataFrame, terms: Terms) -> DataFrame:
    """(a, b): pairs of a long list that lie in different components and that signatures do not rule out.

    A list is dealt into blocks of about _BLOCK sets; each task compares two blocks, and what it rules out is never a row.
    """
    rows = open_.join(classes.select("node", "sign"), "node")
    blocks = F.ceil(F.col("length") / _BLOCK).cast("long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n", "sign")

    def compare(group):
        import pyarrow as pa

        nodes, roots, n, block = (group.column(c).to_numpy() for c in ("node", "root", "n", "block"))
        signs = [np.frombuffer(x, np.uint8)[8:] for x in group.column("sign").to_pylist()]
        least = min(map(len, signs))
        signs = np.stack([_folded(x, least) for x in signs])
        first, second = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        right = np.flatnonzero(block == second)
        a, b = [], []
        for x in np.flatnonzero(block == first):
            apart, both = np.bitwise_count(signs[x] ^ signs[right]).sum(axis=1, dtype=np.int64), n[x] + n[right]
            keep = (roots[x] != roots[right]) & (terms.den * (both - apart) >= terms.num * (both + apart))
            met = nodes[right[keep]]
            a.append(np.minimum(nodes[x], met))
            b.append(np.maximum(nodes[x], met))
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _split(listed: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of the lists whose sets lie in several components, with their root (without roots, each set's own)."""
    if roots is None:
        return listed.withColumn("root", F.col("node"))
    rooted = written(listed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rooted.join(split, "key", "left_semi")


def _fits(a: str, b: str, terms: Terms) -> F.Column:
    """Sizes a and b are near enough to link."""
    return (F.col(a) * terms.den >= F.col(b) * terms.num) & (F.col(b) * terms.den >= F.col(a) * terms.num)


def signature(s: np.ndarray) -> bytes:
    """Size (8 bytes) and parities of the shingles in cells, a power of two that grows with the size.

    Two sets differ in as many shingles as their parities in cells, or more. Halves of a signature
    XORed are the signature of half as many cells, so sets of unequal sizes compare.
    """
    cells = max(_SIGNED, 1 << (len(s) // 2).bit_length())
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _apart(p: bytes, q: bytes) -> int:
    """Fewest shingles in which the sets of two signatures differ."""
    x, y = np.frombuffer(p, np.uint8)[8:], np.frombuffer(q, np.uint8)[8:]
    least = min(len(x), len(y))
    x, y = _folded(x, least), _folded(y, least)
    return int(np.bitwise_count(x ^ y).sum())


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, terms: Terms) -> DataFrame:
    """Those pairs (a, b) of nodes that link: first by signatures, which rule out without error, then by whole sets.

    Whole sets are computed anew, from one text of each node that is left, so those of other texts are never stored.
    They are compared by all 64 bits of each shingle's hash.
    """

    def possible(parts):
        import pyarrow as pa

        for batch in parts:
            keep = []
            for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist()):
                apart, both = _apart(p, q), int.from_bytes(p[:8], "little") + int.from_bytes(q[:8], "little")
                keep.append(terms.den * (both - apart) >= terms.num * (both + apart))  # intersection <= (both - apart) / 2
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    signs = classes.select("node", "sign")
    signed = pairs.join(signs.select(F.col("node").alias("a"), F.col("sign").alias("p")), "a").join(signs.select(F.col("node").alias("b"), F.col("sign").alias("q")), "b")
    left = written(signed.select("a", "b", "p", "q").mapInArrow(possible, "a long, b long"), "possible")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    one = written(classes.join(nodes, "node", "left_semi").select("mark"), "needed")

    def compute(parts):
        import pyarrow as pa

        release()
        for batch in parts:
            found = [s.tobytes() for s in shingle_sets(batch.column(0), terms) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(np.frombuffer(s, np.uint64)) for s in found], pa.int64()), pa.array(found, pa.binary())], ["node", "set"])

    texts = docs.withColumn("mark", F.xxhash64("doc_id", "text")).join(one, "mark", "left_semi").select("text")
    whole = written(texts.mapInArrow(compute, "node long, set binary"), "whole-sets")
    distinct = whole.dropDuplicates(["node"])

    def check(parts):
        import pyarrow as pa

        for batch in parts:
            keep = []
            x, x_at = bytes_of(batch.column(2))
            y, y_at = bytes_of(batch.column(3))
            for i in range(batch.num_rows):
                p, q = x[x_at[i] : x_at[i + 1]].view(np.uint64), y[y_at[i] : y_at[i + 1]].view(np.uint64)
                keep.append(enough(p, q, terms))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = left.join(distinct.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(distinct.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    found = written(full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    discard(left, one, whole)
    return found


def enough(p: np.ndarray, q: np.ndarray, terms: Terms) -> bool:
    """Whether two sorted sets of hashes link."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")  # two runs: merged
    shared = int((both[1:] == both[:-1]).sum())
    return terms.den * shared >= terms.num * (len(both) - shared)


def one_of_each(docs: DataFrame, terms: Terms) -> DataFrame:
    """docs with one row of each component: one with the smallest doc_id; rows equal in doc_id and text are one row.

    Rows without words are no copies of each other and all stay. Rows of one doc_id but different texts are
    apart: each stays or goes with its own text's component.
    """
    found = linked_components(docs.select("doc_id", "text"), terms)
    heads = found.where("node IS NOT NULL AND doc_id <=> component_id")
    heads = heads.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("node")).alias("alone")).agg(F.min(F.struct("node", "mark")).alias("head"))
    mark = free_name(docs.columns, "mark")
    keep = heads.select(F.col("head.mark").alias(mark)).union(found.where("node IS NULL").select(F.col("mark"))).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return marked.join(keep, mark, "left_semi").dropDuplicates([mark]).drop(mark)
