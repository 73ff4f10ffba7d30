"""Every operator against a brute-force version on small tables with nulls, ties, repeated rows and odd texts."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from proofloom.llm import fingerprint, mixing, ngram_join, packing, quality, queries, sharding, suffix_dedup, token_files, toxicity, warc
from proofloom.llm.common import components, ship
from proofloom.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abdeilnorstuéß") for _ in range(r.randint(2, 8))) for _ in range(n)]


def corpus(seed=0, n=60):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empties, repeated rows."""
    r, words = random.Random(seed), vocabulary()
    shared = " ".join(r.choice(words) for _ in range(70))
    texts = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.choice([0, 1, 2, 4, 9, 30, 120, 400]))]
        if i % 7 == 0 and texts:
            t = texts[r.randrange(len(texts))].split()
            for _ in range(max(1, len(t) // 60) if i % 2 else 0):
                if t:
                    t[r.randrange(len(t))] = r.choice(words)
        if i % 9 == 0:
            t = t[:5] + shared.split() + t[5:]
        texts.append(" ".join(t) + ("\n" if i % 5 == 0 else ""))
    texts += ["same line\nsame line\nother # line\n", "a b c d e a b c d e f", "\t \n", "ALL Caps Text " * 8, "x" * 5000, "don't <|endoftext|> go\x1fon"]
    rows = [(3 * i, t, "en", ["s1", "s2", "hot", "hot", None][i % 5], len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), rows[7], (1002, rows[7][1], "fr", "hot", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables that the registered queries read."""
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    page = "<p>" + "word " * 300 + "</p>"
    pages = [(1, "http://a", page), (2, "http://b", page), (3, None, None), (4, "http://c", "short"), (5, "http://d", "short"), (6, "http://e", page + "é"), (7, "http://f", page), (7, "http://f", page)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(3 * i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    ship(spark)
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    r, words = random.Random(3), vocabulary()
    docs, labels = [], []
    for i in range(400):
        t = [r.choice(words) for _ in range(60)]
        if i % 4 == 0:
            t[r.randrange(60)] = r.choice(["gronkle", "vexorab"])
        docs.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(900, None), (901, "")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l)
    rows = toxicity.score(d.withColumn("held", toxicity.held_out(d["doc_id"])), model).collect()
    assert all(0 <= x["score"] <= 1 for x in rows)
    assert all(x["held"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in rows)
    held = [x for x in rows if x["held"] and x["doc_id"] < 400]
    right = sum((x["score"] >= 0.5) == (x["doc_id"] % 4 == 0) for x in held)
    assert held and right / len(held) > 0.95


def test_toxicity_ratios_and_features_equal_brute_force(spark):
    """The features of a fit are exactly the cells whose smoothed log ratio stands out, counted over all training texts."""
    r, words = random.Random(11), vocabulary(n=30)
    docs, labels = [], []
    for i in range(240):
        t = [r.choice(words) for _ in range(12)] + (["gronkle"] if i % 3 == 0 and i % 2 else [])
        docs.append((i, " ".join(t)))
        labels.append((i, int(i % 3 == 0)))
    docs.append((500, None))
    labels += [(500, 1), (777, 1), (3, None)]  # a label without text, one without a document, one without a value
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    seen, n = [Counter(), Counter()], [0, 0]
    for (i, t), (_, y) in zip(docs, labels):
        if t is not None and zlib.crc32(str(i).encode()) % 5:
            seen[y].update(set(toxicity.cells([t])[1].tolist()))
            n[y] += 1
    ratio = {c: np.log(((seen[1][c] + 1) / (n[1] + 2)) / ((seen[0][c] + 1) / (n[0] + 2))) for c in seen[0] | seen[1]}
    value = {c: x * min(1.0, abs(x) * np.sqrt(seen[0][c] + seen[1][c]) / toxicity.EVIDENCE) ** toxicity.POWER for c, x in ratio.items()}
    want = {c for c, x in value.items() if abs(x) >= toxicity.LEAST}
    got = set(np.flatnonzero(model.weights).tolist())
    assert got and got <= want and len(got) > 0.9 * len(want)
    assert all(model.weights[c] > 0 for c in got if seen[0][c] == 0)


def test_toxicity_fit_has_converged():
    """At the fit the gradient of the loss is nought in every weight, as a plain solver's is."""
    r = np.random.default_rng(4)
    texts = [np.unique(r.integers(0, 50, 12)).astype(np.int32) for _ in range(300)]
    toxic = np.array([7 in t or 9 in t for t in texts]) ^ (r.random(300) < 0.05)
    scale = np.concatenate([r.normal(0, 2, 50), np.zeros(14)])
    texts = [t[scale[t] != 0] for t in texts]
    w, b = toxicity.regress(texts, scale, toxic, gap=1e-10)
    p = np.array([1 / (1 + np.exp(-(w[t].sum() + b))) for t in texts])
    gradient = np.zeros(len(scale))
    for t, d in zip(texts, p - toxic):
        gradient[t] += d * scale[t]
    some = scale != 0
    assert np.abs(gradient[some] + w[some] / scale[some]).max() < 1e-3 and abs((p - toxic).sum() + b / 9) < 1e-3
    assert not w[~some].any()


def test_toxicity_learns_from_few_labels(spark):
    r, words = random.Random(2), vocabulary()
    docs = [(i, " ".join([r.choice(words) for _ in range(25)] + (["gronkle"] if i % 2 else []))) for i in range(26)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int"))
    scores = model.scores([t for _, t in docs])
    assert min(scores[1::2]) > max(scores[::2])


def test_toxicity_bound_on_cells_keeps_the_odds(spark, monkeypatch):
    r, words = random.Random(6), vocabulary()
    docs = [(i, " ".join([r.choice(words) for _ in range(20)] + (["gronkle"] if i % 5 == 0 else []))) for i in range(600)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in docs], "doc_id long, toxic int")
    whole = toxicity.fit(d, l)
    monkeypatch.setattr(toxicity, "MOST_CELLS", 60_000)
    some = toxicity.fit(d, l)
    assert (some.weights != 0).sum() < (whole.weights != 0).sum()
    for model in (whole, some):
        scores = model.scores([t for _, t in docs])
        assert sum((s >= 0.5) == (i % 5 == 0) for (i, _), s in zip(docs, scores)) > 580


def test_toxicity_without_labels_scores_low(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(x["score"] < 0.5 for x in toxicity.score(d, toxicity.fit(d, none)).collect())


def test_toxicity_bound_keeps_the_odds(spark):
    r, words = random.Random(5), vocabulary()
    docs, labels = [], []
    for i in range(2000):
        t = [r.choice(words) for _ in range(20)]
        if i % 10 == 0 and i % 20:
            t[r.randrange(20)] = "gronkle"
        docs.append((i, " ".join(t)))
        labels.append((i, int(i % 10 == 0)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    clean = [t for i, t in docs if i % 10]
    whole, bound = (toxicity.fit(d, l, most_per_class=n).scores(clean) for n in (3000, 100))
    odds = [float(np.median(np.log(s / (1 - s)))) for s in (whole, bound)]
    assert abs(odds[0] - odds[1]) < 1 and odds[1] < -1


def test_water_fill_reshares():
    got = mixing.water_fill([100, 1000, 10], [3, 1, 2])
    assert got[0] == 200 and got[2] == 20 and abs(sum(got) - 1.5 * 1110) < 1e-6 and got[1] <= 2000


def test_mixing(spark, sf):
    rows = queries.QUERIES["op2_mixing"](spark, sf).collect()
    assert Counter(x["doc_id"] for x in rows) == Counter(r[0] for r in corpus())
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    source = {r[0]: r[3] for r in corpus()}
    taken, whole = defaultdict(int), defaultdict(int)
    for x in rows:
        assert x["size"] == size[x["doc_id"]] and 0 <= x["taken"] <= 2 * x["size"]
        taken[source[x["doc_id"]]] += x["taken"]
        whole[source[x["doc_id"]]] += x["size"]
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill([whole[s] for s in names], [[3, 1, 2][i % 3] for i in range(len(names))])
    assert [taken[s] for s in names] == [round(t) for t in want]
    assert sorted(map(str, queries.QUERIES["op2_mixing"](spark, sf).collect())) == sorted(map(str, rows))


def test_schedule_is_even(spark):
    plan = mixing.plan([("a", 90_000), ("b", 60_000), (None, 20_000)], block=64)
    got = mixing.schedule(spark, plan).orderBy("slot").collect()
    assert [x["slot"] for x in got] == list(range(len(got)))
    for i, s in enumerate(plan):
        assert sorted(x["rank"] for x in got if x["source"] == i) == list(range(s.slots))
        half = sum(x["source"] == i for x in got[: len(got) // 2])
        assert abs(half - s.slots / 2) < 12


def test_codes_give_every_token():
    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**32 - 1, 7] * 300, np.uint32)
    ends = np.array([0, 3, 3, len(ids)])
    f = token_files.TokenFile(token_files.pack(ids, ends))
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()
    assert f.range(515, 1100).tolist() == ids[515:1100].tolist()
    assert [f.document(k).tolist() for k in range(4)] == [[], ids[:3].tolist(), [], ids[3:].tolist()]
    assert token_files.TokenFile(token_files.pack(ids[:0], ends[:0])).n_tokens == 0


def plain_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most_kept", [50, 1 << 20])
def test_encoder_equals_tokenizer(most_kept):
    import pyarrow as pa

    ids, own, r = plain_ids(), Encoder(queries.tokenizer_path(), most_kept=most_kept), random.Random(2)
    letters = "aBcé ßİı'.,!#$%\n\t\x1c\x85 Σσς中文١²½_-«»\u0301😀"
    texts = [x[1] for x in corpus()] + ["a b c İstanbul Σας é ﬁ 1234 it's we'll ... ́x", "日本語 text 🙂🙂", None, "", "word, " * 9000]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    got, ends = own.encode(pa.array(texts, pa.string()), 2)
    assert [x.tolist() for x in np.split(got, ends)[:-1]] == [ids(t) + [2] for t in texts] and len(got) == ends[-1]
    bare, ends = own.encode(pa.array(texts, pa.string())[3:40])
    assert [x.tolist() for x in np.split(bare, ends)[:-1]] == [ids(t) for t in texts[3:40]]


def test_word_hashes_follow_words():
    import pyarrow as pa

    from proofloom.llm import words

    texts = [x[1] for x in corpus()] + ["B b\x0bB", "x" * 400_000 + " tail", " lead", "é É"]
    column, seen = pa.array(texts, pa.string()), {}
    got, first = words.word_hashes(column)
    every = [WORD.findall(t or "") for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in every]
    for h, w in zip(got.tolist(), (w for ws in every for w in ws)):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    lower, _ = words.word_hashes(pa.array(["Ab É", "aB É", "ab é"], pa.string()), lower=True)
    assert lower[0] == lower[2] == lower[4] and lower[1] == lower[3] != lower[5]
    parts = list(words.slices(column, 3000))
    assert parts[0][0] == 0 and parts[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert np.array_equal(np.concatenate([words.word_hashes(column[a:b])[0] for a, b in parts]), got)


def test_token_files(spark, sf):
    rows = sorted(queries.QUERIES["op3_token_files"](spark, sf).collect(), key=lambda x: x["start"])
    ids, at = plain_ids(), 0
    want = {(r[0], tuple(ids(r[1]) + [2])) for r in corpus()}
    assert [x["doc_id"] for x in rows] == sorted(r[0] for r in corpus())
    crc = {(d, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for d, i in want}
    for x in rows:
        assert x["start"] == at and (x["doc_id"], x["n_tokens"], x["ids_crc32"]) in crc
        at += x["n_tokens"]


def test_quality(spark, sf):
    rows = queries.QUERIES["op4_quality_rules"](spark, sf).collect()
    want = {r[0]: r[1] or "" for r in corpus()}
    assert len(rows) == len(corpus())
    for x in rows:
        t = want[x["doc_id"]]
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [s for s in t.split("\n") if WORD.search(s)]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert x["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (x["base_failed"] and x["kept"])


def test_cascade_order_does_not_change_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = [quality.BASE, *quality.RULES]
    verdict = lambda order: sorted((x["doc_id"], x["rejected_by"] is None) for x in quality.cascade(docs, order).collect())
    assert verdict(rules) == verdict(rules[::-1]) == verdict([r for r, _ in quality.ordered_rules(docs, sample_rows=30)])


def test_cascade_skips_later_rules(spark):
    """A rule that would fail the job is never evaluated for texts that an earlier rule rejects."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "bad"), (2, "bad"), (3, None)], "doc_id long, text string")
    first = quality.Rule("first", lambda t: (t == "bad") | (t == ""))
    second = quality.Rule("second", lambda t: F.raise_error(F.concat(F.lit("evaluated "), t)).isNotNull())
    assert {x["rejected_by"] for x in quality.cascade(docs, [first, second]).collect()} == {"first"}


def test_rules_are_ordered_by_rejection_per_cost(spark):
    """Of two rules that reject the same, the cheaper is first; one that rejects nothing is last."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "word " * 400) for i in range(300)], "doc_id long, text string")
    never = quality.Rule("never", lambda t: F.length(t) < 0)
    dear = quality.Rule("dear", lambda t: quality.repeat_words(quality.word_list(t)) >= 0)
    cheap = quality.Rule("cheap", lambda t: F.length(t) > 3)
    assert [r.name for r, _ in quality.ordered_rules(docs, rules=(never, dear, cheap))] == ["cheap", "dear", "never"]


def test_rule_sample_is_drawn_by_rows(spark):
    """A text that most rows have is no larger a share of the sample than of the table."""
    docs = spark.range(40_000).selectExpr("id AS doc_id", "IF(id % 10 < 7, 'the same text', concat('text ', id)) AS text")
    seen = []
    always = quality.Rule("seen", lambda t: t.isNotNull())
    written = quality.written
    try:
        quality.written = lambda df, kind: seen.append(df.count()) or written(df, kind)
        quality.ordered_rules(docs, rules=(always,), sample_rows=1000)
    finally:
        quality.written = written
    assert 800 < seen[0] < 1200


@pytest.mark.parametrize("clash", ["score", "shard", "n_words", "next_text", "m", "order", "cell", "mark", "cuts"])
def test_clashing_columns(spark, clash):
    """A user's column that is called like one that an operator adds is replaced where it is a result and kept where it is inner."""
    docs = spark.createDataFrame([(1, "one two three four five six", "a", "x"), (2, "seven eight", "b", "y"), (3, None, None, "z")], f"doc_id long, text string, source string, {clash} string")
    model = toxicity.Model(np.zeros(1 << toxicity.BITS), 0.0)
    scored = toxicity.score(docs, model)
    assert scored.count() == 3 and scored.columns.count("score") == 1
    measured = quality.measures(docs)
    assert len(set(measured.columns)) == len(measured.columns) and measured.count() == 3
    ahead = fingerprint.with_next(docs, "doc_id", ["text"])
    assert len(set(ahead.columns)) == len(ahead.columns) and ahead.count() == 3
    assert sharding.shard_rows(docs.drop("text"), "doc_id", [1.0, 1.0]).count() == 3
    for same in (ngram_join.one_of_each(docs, ngram_join.Terms(5, 80, 100)), suffix_dedup.without_repeats(docs)):
        assert same.columns == docs.columns and {x[clash] for x in same.collect()} == {"x", "y", "z"}
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns and mixed.count() >= 1


def test_sharding(spark, sf):
    rows = queries.QUERIES["op5_sharding"](spark, sf).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in rows) == want
    slots = defaultdict(list)
    for x in rows:
        slots[x["shard"]].append(x["slot"])
        assert x["grown_shard"] in (x["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_shape_shards(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    n = Counter(x["shard"] for x in sharding.shard_rows(rows, "k", [1.0, 3.0]).collect())
    assert 0.7 < n[1] / 4000 < 0.8


def brute_components(rows, words, num, den):
    sets = []
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("terms", [ngram_join.Terms(3, 90, 100), ngram_join.Terms(5, 80, 100), ngram_join.Terms(1, 60, 100)])
def test_jaccard_components(spark, terms):
    r, words = random.Random(5), vocabulary(n=40)
    rows = [(x[0], x[1]) for x in corpus(2, 50)]
    base = [r.choice(words) for _ in range(26)]
    for i in range(40):  # chains of small sets around the boundary
        base = list(base)
        base[r.randrange(len(base))] = r.choice(words) + str(i)
        rows.append((2000 + i, " ".join(base[: r.randint(10, 26)])))
    got = ngram_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), terms).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute_components(rows, terms.words, terms.num, terms.den)


def test_jaccard_long_lists_in_blocks(spark, monkeypatch):
    """Variants of one text, many of which link with no other, met without pivots in small blocks."""
    monkeypatch.setattr(ngram_join, "_SHORT", 1)
    monkeypatch.setattr(ngram_join, "_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "_PIVOTS", (1,))
    r, words, terms = random.Random(8), vocabulary(n=60), ngram_join.Terms(3, 90, 100)
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(r.randint(0, 5)):
            text[r.randrange(len(text))] = r.choice(words) + str(r.randint(0, 9))
        rows.append((i, " ".join(text[r.randint(0, 6) :])))
    got = ngram_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), terms).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute_components(rows, 3, 90, 100)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(x["node"], x["root"]) for x in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_verification_uses_all_bits(monkeypatch):
    """Two shingles of a set that share their upper 32 bits count twice."""
    terms, r = ngram_join.Terms(3, 90, 100), random.Random(3)
    shared = sorted({r.getrandbits(64) for _ in range(88)})
    twin = (shared[5] & ~0xFFFFFFFF) | ((shared[5] + 1) & 0xFFFFFFFF)
    p = np.array(sorted({*shared, twin, (shared[9] & ~0xFFFFFFFF) | 7, *range(4)}), np.uint64)
    q = np.array(sorted({*shared, twin, (shared[9] & ~0xFFFFFFFF) | 7, *range(10, 14)}), np.uint64)
    assert ngram_join.enough(p, q, terms)
    assert not ngram_join.enough(p, np.append(q, [np.uint64(2**64 - 1), np.uint64(2**64 - 2), np.uint64(2**64 - 3)]), terms)


def test_one_of_each_keeps_texts_apart(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (9, b, "x"), (9, b, "x"), (7, "", "x"), (8, None, "x"), (None, "lone words stay here now yes", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    kept = ngram_join.one_of_each(docs, ngram_join.Terms(5, 80, 100))
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[5], rows[6], rows[7]])


def test_fill_plan_is_full_and_whole():
    r = random.Random(1)
    counts = Counter(r.choice([r.randint(1, 64), 64, 40, 24]) for _ in range(3000))
    plan = packing.fill_plan(counts, 64)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert used == counts
    assert sum(t for _, t in plan) <= -(-sum(n * k for n, k in counts.items()) // 64) * 1.02 + 1


def test_packing(spark, sf):
    rows = queries.QUERIES["op7_packing"](spark, sf).collect()
    ids = plain_ids()
    want = Counter()
    for d, t, *_ in corpus():
        x = ids(t) + [1]
        for p, b in enumerate(range(0, len(x), 4096)):
            part = x[b : b + 4096]
            want[d, p, b, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows) == want
    bins = defaultdict(list)
    for x in rows:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096


def test_long_texts_are_cut_and_filed(spark):
    """Texts over two sequences, over a token file's size, and rows that repeat."""
    docs = [(1, "alpha, Beta " * 9000), (2, "gamma"), (2, "gamma"), (None, "x" * 300), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    ids = plain_ids()
    cut = packing.pack_pieces(packing.pieces(d, "doc_id", "text", queries.tokenizer_path(), 1, 4096), 4096).collect()
    want = Counter()
    for k, t in docs:
        x = ids(t) + [1]
        for p, b in enumerate(range(0, len(x), 4096)):
            want[k, p, b, len(x[b : b + 4096]), zlib.crc32(struct.pack(f"<{len(x[b : b + 4096])}I", *x[b : b + 4096]))] += 1
    assert Counter((x["key"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in cut) == want and max(p for _, p, *_ in want) >= 4
    from proofloom.llm.common import fresh_path

    files = token_files.write_files(d, "doc_id", "text", queries.tokenizer_path(), 2, fresh_path(spark, "tokens"), file_bytes=64)
    assert files.count() >= 2
    read = token_files.read_files(files).orderBy("start").collect()
    assert [x["key"] for x in read] == [None, 1, 2, 2, 4]
    assert [x["n_tokens"] for x in read] == [len(ids(dict(docs).get(x["key"]))) + 1 for x in read]


def test_record_names_the_page():
    fields, payload = warc.parse_record(warc.record("response", "urn:page:1", b"<p>", "00", None, 3, "http://a/\r\nX: y"))
    assert fields["warc-target-uri"] == "http://a/%0D%0AX:%20y" and fields["warc-record-id"] == "<urn:page:1>" and payload == b"<p>"
    assert warc.parse_record(warc.record("response", "urn:page:1", b"", "00", None, 0))[0]["warc-target-uri"] == "urn:page:1"


def test_warc(spark, sf):
    rows = queries.QUERIES["op8_warc"](spark, sf).collect()
    page = "<p>" + "word " * 300 + "</p>"
    html = {1: page, 2: page, 3: "", 4: "short", 5: "short", 6: page + "é", 7: page}
    assert sorted(x["page_id"] for x in rows) == [1, 2, 3, 4, 5, 6, 7, 7]
    for x in rows:
        data = html[x["page_id"]].encode()
        revisit = x["page_id"] in (1, 2)
        assert (x["payload_bytes"], x["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (x["record_type"], x["refers_to"]) == (("revisit", 7) if revisit else ("response", None))


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    data = warc.zip_stored([("a.txt", b"alpha"), ("b/é.bin", bytes(range(256)))], zip64=wide)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("a.txt") == b"alpha" and z.testzip() is None
    own = warc.ZipArchive(io.BytesIO(data))
    assert own.whole("b/é.bin") == bytes(range(256)) and own.range("b/é.bin", 10, 4) == bytes(range(10, 14))
    with pytest.raises(ValueError):
        own.range("a.txt", 3, 9)


def test_fingerprints(spark, sf):
    rows = queries.QUERIES["op9_fingerprints"](spark, sf).collect()
    texts = sorted({(r[0], r[1] or "") for r in corpus()})
    many = Counter(r[0] for r in corpus())
    assert len(rows) == len(corpus())
    prints = {}
    for x in rows:
        i = [d for d, _ in texts].index(x["doc_id"])
        t = texts[i][1]
        options = {texts[(i + 1) % len(texts)][1]} | ({t} if many[x["doc_id"]] > 1 else set())
        half = len(t) // 2
        assert x["n_chars"] == len(t)
        assert x["edited_sha256"] in {hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest() for n in options}
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        assert prints.setdefault(t, x["fingerprint"]) == x["fingerprint"]


def test_likeness_equals_brute_force(spark, sf):
    """Sketches hold exactly the shingle hashes below the bound, and likeness is theirs, over every document."""
    import xxhash

    def hashed(parts):
        """Spark's xxhash64 of strings in turn: each seeds the next."""
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), h)
        return h >> 32

    def kept(text):
        w = WORD.findall(text.lower())
        k = 5
        found = {hashed(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({hashed([" ".join(w)])} if w else set())
        low = {h for h in found if h < (1 << 32) // 4}
        return low or set(sorted(found)[:1])

    share = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    docs = [(r[0], r[1] or "") for r in corpus() if r[0] not in (1002,) and (r[1] or "").isascii()]
    docs = sorted({d: t for d, t in docs}.items())
    folder = f"{sf}-ascii"
    spark.createDataFrame(docs, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    rows = {x["doc_id"]: x for x in queries.QUERIES["op9_fingerprints"](spark, folder).collect()}
    for i, (d, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert rows[d]["fingerprint"] == "".join(f"{h:08x}" for h in sorted(kept(t)))
        assert rows[d]["edited_fingerprint"] == "".join(f"{h:08x}" for h in sorted(kept(edited)))
        assert rows[d]["near_edited"] == pytest.approx(share(kept(t), kept(edited))) and rows[d]["near_next"] == pytest.approx(share(kept(t), kept(n)))


@pytest.mark.parametrize("ids", [list(range(900)), [*range(899), 10**15], [7] * 600 + list(range(300)), [None] * 500 + list(range(0, 4000, 10)), [5]])
def test_next_row_over_ranges(spark, monkeypatch, ids):
    """Far-off, repeated and null keys: next is the row after in (key, hash) order, and no range holds most rows."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 16)
    monkeypatch.setattr(fingerprint, "CUTS", 8)
    docs = spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id long, text string")
    from pyspark.sql import functions as F

    rows = fingerprint.with_next(docs.withColumn("h", F.xxhash64("text")), "doc_id", ["text"]).collect()
    order = sorted(rows, key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, x["h"]))
    assert Counter((x["doc_id"], x["text"]) for x in rows) == Counter((d, f"t{i}") for i, d in enumerate(ids))
    assert [x["next_text"] for x in order] == [x["text"] for x in order[1:] + order[:1]]
    sizes = [r["count"] for r in docs.select(fingerprint._ranges(docs, "doc_id", F.xxhash64("text")).alias("c")).groupBy("c").count().collect()]
    assert len(ids) == 1 or max(sizes) <= len(ids) // 4


def test_sketches_estimate_containment(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = spark.createDataFrame([(" ".join(words[:1000]), " ".join(words))], "a string, b string")
    a, b = fingerprint.sketch(rows["a"]), fingerprint.sketch(rows["b"])
    got = rows.select(fingerprint.containment(a, b).alias("c"), fingerprint.jaccard(a, b).alias("j")).first()
    assert got["c"] > 0.99 and abs(got["j"] - 0.25) < 0.05


def test_short_texts_have_a_sketch(spark, tmp_path):
    texts = [f"alpha{i} beta gamma" for i in range(40)] + ["alpha0 beta gamma " * 40, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.QUERIES["op9_fingerprints"](spark, str(tmp_path)).collect(), key=lambda x: x["doc_id"])
    assert [x["fingerprint"] != "" for x in rows] == [True] * 41 + [False] * 2
    assert len({x["fingerprint"] for x in rows[:40]}) == 40
    assert all(x["near_next"] == x["in_next"] == 0 for x in rows[:39])
    assert [(x["near_next"], x["in_next"]) for x in rows[40:]] == [(0, 0), (1, 1), (0, 1)]


def test_containment_of_few_shingles_looks_into_the_text(spark):
    words = [f"w{i}" for i in range(600)]
    pairs = [(" ".join(words[i : i + 5]), " ".join(words)) for i in range(500)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = fingerprint.sketch(df["a"]), fingerprint.sketch(df["b"])
    got = df.select(fingerprint.containment(a, b, df["b"]).alias("c")).collect()
    assert {x["c"] for x in got} == {1.0}


def test_suffix_dedup(spark):
    rows = [(x[0], x[1]) for x in corpus(4, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.repeated_spans(docs).collect()
    windows = Counter(tuple(w[i : i + 50]) for w in (WORD.findall(t or "") for _, t in rows) for i in range(len(w) - 49))
    want = defaultdict(set)
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            if windows[tuple(w[i : i + 50])] > 1:
                want[d] |= set(range(i, i + 50))
    covered = defaultdict(set)
    for x in got:
        covered[x["doc_id"]] |= set(range(x["first"], x["last"]))
    assert covered == want and want
    seen, first = set(), defaultdict(set)
    for d, t in sorted(set(rows), key=lambda x: (x[0], x[1] or "")):
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            if windows[tuple(w[i : i + 50])] > 1 and tuple(w[i : i + 50]) not in seen:
                first[d] |= set(range(i, i + 50))
            seen.add(tuple(w[i : i + 50]))
    kept = defaultdict(set)
    for x in got:
        if x["kept"]:
            kept[x["doc_id"]] |= set(range(x["first"], x["last"]))
    assert kept == first and first
    left = suffix_dedup.without_repeats(docs).collect()
    expected = Counter()
    for d, t in rows:
        w = [x for i, x in enumerate(WORD.findall(t or "")) if i not in want[d] or i in first[d]]
        if w or not want[d]:
            expected[d, " ".join(w)] += 1
    assert Counter((x["doc_id"], " ".join(WORD.findall(x["text"] or ""))) for x in left) == expected
    assert {x["doc_id"] for x in left if x["text"] is None} == {1000}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "mixing", "packing"]
    one = corpus_pipeline.one_of_near_copies(spark, docs, sf)
    assert one.columns == docs.columns
    left = [(x["doc_id"], x["text"]) for x in one.collect()]
    groups = brute_components([(r[0], r[1]) for r in corpus()], 5, 80, 100)
    assert sorted(d for d, _ in left) == sorted({d for d, _, c in groups if d == c})
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns
    size = sum(len(WORD.findall(r[1] or "")) for r in corpus())
    assert abs(sum(len(WORD.findall(x["text"] or "")) for x in mixed.collect()) - 1.5 * size) <= 5
    # toxicity: those stay that the same model scores below 0.5, with all their columns
    told = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores, blank = told.scores([x[1] for x in corpus()]), told.scores([None])[0]
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.count() == int(((scores < 0.5) | (scores <= blank)).sum()) and clean.where("text IS NULL OR text = ''").count() == sum(not x[1] for x in corpus())
    # most labels toxic, no n-gram that tells: nothing goes
    spark.createDataFrame([(3 * i, 1) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{sf}-all/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, f"{sf}-all").count() == len(corpus())
    r, words = random.Random(9), vocabulary()
    planted = [(i, " ".join([r.choice(words) for _ in range(30)] + (["gronkle"] if i % 4 == 0 else [])), "en", "s1", 1) for i in range(200)] + [(500, None, "en", "s1", 0)]
    folder = f"{sf}-toxic"
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    some = spark.createDataFrame(planted, SCHEMA).withColumnRenamed("n_chars", "score")
    model = toxicity.fit(some, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, some, folder)
    left = {x["doc_id"] for x in clean.collect()}
    assert clean.columns == some.columns and left == {x[0] for x, p in zip(planted, model.scores([x[1] for x in planted])) if p < 0.5}
    assert left == {i for i in range(200) if i % 4} | {500}
    # packing: every row's ids whole and in place, sequences gapless and full but for the last few
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    ids, want = plain_ids(), Counter()
    for d, t, *_ in corpus():
        x = ids(t) + [1]
        for p, b in enumerate(range(0, len(x), 4096)):
            want[d, p, zlib.crc32(struct.pack(f"<{len(x[b : b + 4096])}I", *x[b : b + 4096]))] += 1
    assert Counter((x["doc_id"], x["piece"], x["ids_crc32"]) for x in packed) == want
    spans = defaultdict(list)
    for x in packed:
        spans[x["sequence_id"]].append((x["offset"], x["length"]))
    assert all(sorted(v)[i][0] == sum(n for _, n in sorted(v)[:i]) for v in spans.values() for i in range(len(v)))
    assert len(spans) <= -(-sum(n for v in spans.values() for _, n in v) // 4096) + 1
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_of_nothing(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
