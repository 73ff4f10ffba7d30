"""Words that collide under linear hashes, language ID, prefix tries and whitening against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from proofloom.llm import fingerprint, langid, ngram_join, prefix_trie, queries, sharding, suffix_dedup, tokens, whitening, words
from proofloom.llm.common import ship


def thue_morse(n, a, b):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


X, Y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_colliding_words_have_hashes_ids_and_sets_of_their_own(spark):
    import pyarrow as pa

    found, _ = words.word_hashes(pa.array([f"{X} {Y} {X[:512]} {Y[:512]} {X[:16]} {Y[:16]}"]))
    assert len(set(found.tolist())) == 6
    enc = tokens.Encoder(queries.tokenizer_path())
    texts = [X, Y, f"{X} {Y}", f"one {Y[:64]} two {X[:64]}"]
    ids, ends = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i - 1] if i else 0 : ends[i]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    terms = ngram_join.Terms(3, 90, 100)
    some = " ".join(f"w{i}" for i in range(60))
    assert not np.array_equal(ngram_join.shingle_set(f"{some} {X}", terms), ngram_join.shingle_set(f"{some} {Y}", terms))
    ship(spark)
    few = " ".join(f"w{i}" for i in range(9))
    docs = spark.createDataFrame([(1, f"{few} {X} {few}"), (2, f"{few} {Y} {few}"), (3, f"{few} {X} {few}")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.linked_components(docs, terms).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    half = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{half} {X} {half}"), (2, f"{half} {Y} {half}")], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(docs).where("doc_id = 2").count() == 0


def test_chunks_of_equal_hashes_are_told_apart(monkeypatch):
    """With only 64 hashes for all chunks, ids are still the tokenizer's."""
    import pyarrow as pa

    real = words.hashes
    monkeypatch.setattr(tokens, "hashes", lambda *a, **k: real(*a, **k) & np.uint64(63))
    enc, r = tokens.Encoder(queries.tokenizer_path()), random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefgh,.É") for _ in range(r.randint(1, 20))) for _ in range(80)) for _ in range(12)]
    ids, ends = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i - 1] if i else 0 : ends[i]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_merged_sketches_are_those_of_the_shingles_together(spark):
    from pyspark.sql import functions as F

    r = random.Random(7)
    texts = ["", "one", "two words", *(" ".join(r.choice("abcdefg") * r.randint(1, 3) for _ in range(r.choice([5, 6, 9, 80]))) for _ in range(9))]
    df = spark.createDataFrame([(i, j, x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)], "i int, j int, x string, y string")
    both = F.array_union(fingerprint.shingles(F.col("x")), fingerprint.shingles(F.col("y")))
    got = df.select(fingerprint.merged(fingerprint.sketch(F.col("x")), fingerprint.sketch(F.col("y"))).alias("m"), both.alias("b")).collect()
    for row in got:
        low = sorted(h for h in row["b"] if h < (1 << 32) // fingerprint.SCALE)
        assert row["m"] == (low or sorted(row["b"])[:1])


def test_shards_equal_brute_force(spark):
    """The shard of the largest score, one hash a shard; a weight of three takes three times the rows; a new shard only takes."""
    import xxhash

    weights, keys = [1.0, 3.0, 1.0, 0.5], [*range(-50, 3000), None]
    rows = sharding.shard_rows(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", weights).collect()

    def score(key, shard, weight):
        text = "\x00null" if key is None else str(key)
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), xxhash.xxh64_intdigest(text.encode(), 42))
        return -weight / math.log(((h >> 11) + 0.5) / (1 << 53))

    for r in rows:
        scores = [score(r["doc_id"], i, w) for i, w in enumerate([*weights, 1.0])]
        assert r["shard"] == max(range(4), key=lambda i: scores[i])
        assert r["grown_shard"] == max(range(5), key=lambda i: scores[i]) and r["grown_shard"] in (r["shard"], 4)
    shares = Counter(r["shard"] for r in rows)
    assert 2.4 < shares[1] / shares[0] < 3.6 and all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n)) for k, n in shares.items())


# language ID

ROWS = [("en", "the cat sat on the mat and the dog sat on the log"), ("en", "a dog and a cat"), ("de", "der hund und die katze sitzen auf der matte"), ("de", "die katze über dem haus")]


def brute_bits(texts: list[str], target: str, order: int = langid.ORDER) -> float:
    """Method C with exclusion, straight from the texts."""
    seen = defaultdict(Counter)
    for t in texts:
        raw = b"\n" * order + t.encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen[raw[i - k : i]][raw[i]] += 1
    raw, bits = b"\n" * order + target.encode(), 0.0
    for i in range(order, len(raw)):
        out = set()
        for k in range(order, -1, -1):
            here = {s: c for s, c in seen.get(raw[i - k : i], {}).items() if s not in out}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if raw[i] in here:
                bits -= math.log2(here[raw[i]] / total)
                break
            bits -= math.log2(len(here) / total)
            out |= set(here)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_code_lengths_equal_brute_force(spark):
    import pyarrow as pa

    ship(spark)
    model = langid.fit(spark.createDataFrame(ROWS, "lang string, text string"))
    assert model.languages == ["de", "en"]
    targets = ["the cat", "die katze und", "zzz", "", "q\x00é漢", "a" * 300]
    got = langid.Costs(model).lengths(pa.array(targets))
    for i, t in enumerate(targets):
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute_bits([x for l, x in ROWS if l == lang], t), abs=1e-6)


def test_bounded_trees_are_still_codes(spark):
    """With few entries the probabilities of all bytes after any context add up to 1."""
    ship(spark)
    r = random.Random(1)
    rows = ROWS + [(lang, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(200))) for lang in ("de", "en")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), most=1024)
    whole = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert sum(map(len, model.trees[1].grams)) <= 512
    assert sum(map(len, model.trees[1].grams)) < sum(map(len, whole.trees[1].grams))
    for m in (model, whole):
        for context in (b"the ", b"dog ", b"qqqq", b"\n\n\n\n"):
            codes = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], np.int64)
            assert np.exp2(-m.trees[1].bits(codes)).sum() == pytest.approx(1, abs=1e-9)


def test_windows_of_parts_equal_those_of_whole_texts():
    import pyarrow as pa

    data, offsets = words.bytes_of(pa.array(["abcdefghij", "", None, "xy", "z" * 20]))
    parts = [np.concatenate(x) for x in zip(*langid.windows(data, offsets, 4, 7))]
    whole = [np.concatenate(x) for x in zip(*langid.windows(data, offsets, 4, 1000))]
    assert all(np.array_equal(a, b) for a, b in zip(parts, whole))
    assert whole[1][0] == int.from_bytes(b"\n\n\n\na", "big") and whole[1][10] == int.from_bytes(b"\n\n\n\nx", "big")


def test_language_of_odd_texts(spark):
    ship(spark)
    model = langid.fit(spark.createDataFrame([*ROWS, (None, "x"), ("de", None)], "lang string, text string"))
    docs = spark.createDataFrame([(1, "the dog", 5), (1, "the dog", 5), (2, None, 1), (3, "", 1), (4, "12 34 !", 1), (None, "die katze " * 9000, 1)], "doc_id long, text string, has_letter int")
    got = [tuple(r) for r in langid.predict(docs, model).select("doc_id", "has_letter", "lang_pred", "score").collect()]
    assert [(a, b, c) for a, b, c, _ in got] == [(1, 5, "en"), (1, 5, "en"), (2, 1, "und"), (3, 1, "und"), (4, 1, "und"), (None, 1, "de")]
    assert all((s == 0) == (c == "und") and 0 <= s <= 1 for _, _, c, s in got)
    nothing = langid.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


# prefix tries


def brute_trie(rows, rebuild):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        host = int(c - math.fmod(c, 100))
        full[c] = (own.get(host, [])[:h] if rebuild else []) + v[h:]
    members, ends = defaultdict(set), defaultdict(set)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
        ends[tuple(v)].add(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [q for q in members if q[: len(k)] == k]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(not children[q] for q in below), saved, sha))
    return Counter(out)


def talks(seed, n):
    r = random.Random(seed)
    lines, rows = ["hi", "hello there", "", "é漢", "ok then"], []
    for c in [*range(-3, n), 100, 107, 200, 205, 301]:
        for t in range(r.choice([0, 1, 2, 3, 9])):
            rows.append((c, r.choice([None, t, t, t]), r.choice(["user", "assistant", None]), r.choice([*lines, None])))
    return rows + [(None, 0, "user", "x"), *rows[:3]]


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block, piece", [(1024, 4096), (2, 2)])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, block, piece):
    """Also with blocks of two turns and end lists in pieces of two ids, as long conversations and hot nodes have them."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    ship(spark)
    rows = talks(1, 40)
    spark.createDataFrame(rows, TALK).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r[c] for c in names) for r in got) == brute_trie(rows, True)
    plain = prefix_trie.conversation_trie(spark.createDataFrame([(*r, "z") for r in rows], f"{TALK}, node string")).collect()
    assert Counter(tuple(r[c] for c in names) for r in plain) == brute_trie(rows, False)


def test_tries_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN_IN", 2)
    monkeypatch.setattr(prefix_trie, "MOST_NODES", 3)
    ship(spark)
    rows = talks(5, 30)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TALK).repartition(6)).collect()
    assert Counter(tuple(r) for r in got) == brute_trie(rows, False)


def test_trie_of_nothing(spark):
    ship(spark)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TALK)).count() == 0


# whitening


def vectors(n=300, d=12, seed=0):
    r = np.random.default_rng(seed)
    v = (r.normal(size=(n, d)) @ r.normal(size=(d, d)) / 4 + r.normal(size=d)).astype(np.float32)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [float("nan")] * d), (904, [float("inf")] + [0.0] * (d - 1)), (905, [None] + [0.0] * (d - 1)), (None, rows[5][1]), rows[7]]
    return rows, odd


def test_whitening_equals_brute_force(spark):
    ship(spark)
    rows, odd = vectors()
    table = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "vec_id long, embedding array<float>, whitened double").repartition(4)
    got = whitening.whitened(table, "vec_id", "embedding", 8).collect()
    kept = rows + odd[-2:]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = centred @ u / np.sqrt(e)
    assert len(got) == n * 8
    by = defaultdict(list)
    for r in got:
        by[r["key"], r["component"]].append(r)
    signs = [math.copysign(1, by[0, j + 1][0]["whitened"] * want[0, j]) for j in range(8)]
    for i, (key, _) in enumerate(kept):
        for j in range(8):
            r = by[key, j + 1][0]
            assert r["n"] == n and int(r["deviation"]) == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
            assert r["whitened"] == pytest.approx(signs[j] * want[i, j], abs=1e-8)
            assert r["explained"] == pytest.approx(e[j] / (centred**2).sum() * n, rel=1e-9) and r["identity_error"] < 1e-9
    assert len(by[7, 1]) == 2 and len(by[None, 1]) == 1


def test_whitening_without_variance(spark):
    ship(spark)
    made = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whitened(made([]), "vec_id", "embedding").count() == 0
    assert whitening.whitened(made([(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").count() == 0
    one = whitening.whitened(made([(i, [float(i), 5.0, float(i)]) for i in range(10)]), "vec_id", "embedding").collect()
    assert len(one) == 10 and {r["component"] for r in one} == {1} and one[0]["explained"] == pytest.approx(1)


def test_whitening_of_huge_entries_is_exact(spark):
    ship(spark)
    rows = [(i, [float(i) * 1e9, 3e300 if i == 4 else 1.0]) for i in range(6)]
    got = {r["key"]: int(r["deviation"]) for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").where("component = 1").collect()}
    x = [[min(max(math.floor(1024 * c), -(1 << 52)), 1 << 52) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((6 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(6)}
