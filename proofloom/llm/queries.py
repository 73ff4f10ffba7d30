"""The registered queries opN_<name>: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, mixing, ngram_join, packing, prefix_trie, quality, sharding, suffix_dedup, token_files, toxicity, warc, whitening
from .common import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(query):
    """query, with the package given to the workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = quality.cascade(docs, [rule for rule, _ in quality.ordered_rules(docs)])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base_failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return quality.measures(judged).select("doc_id", *counts, base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_rows(rows, "doc_id", [1.0] * 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("kept", fingerprint.sketch(F.col("text")))
    rows = fingerprint.with_next(docs, "doc_id", ["text", "kept"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_kept", fingerprint.sketch(F.col("edited")))
    a, b, c = F.col("kept"), F.col("edited_kept"), F.col("next_kept")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(a).alias("fingerprint"),
        fingerprint.as_text(b).alias("edited_fingerprint"),
        fingerprint.jaccard(a, b).alias("near_edited"),
        fingerprint.jaccard(a, c).alias("near_next"),
        fingerprint.containment(a, b, F.col("edited")).alias("in_edited"),
        fingerprint.containment(a, c, F.col("next_text")).alias("in_next"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.encode_table(spark, documents(spark, sf_dir), "doc_id", "text", tokenizer_path(), 2)
    return rows.withColumnRenamed("key", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir), "doc_id", "text", tokenizer_path(), 1, 4096)
    return packing.pack_pieces(cut, 4096).withColumnRenamed("key", "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    placed, used, sources = mixing.mix(docs, ["doc_id"], "source", "size")
    return mixing.taken(placed, used, sources, "size").select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.linked_components(documents(spark, sf_dir), ngram_join.Terms(3, 90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeated_spans(documents(spark, sf_dir))
    return spans.select("doc_id", F.col("first").alias("first_word"), F.col("last").alias("last_word"), F.col("kept").alias("is_first"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    # null where it doesn't fit a long; the whole number follows
    return found.select(F.col("key").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_whole"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_fingerprints": op9_fingerprints,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_language_id": op11_language_id,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_whitening": op13_whitening,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}

ORACLE_SQL = {
    "op4_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM t, unnest(range(1, len(w) - 3)) AS u(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(0, 5) AS r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
       OR 10 * n_symbols > n_words OR n_dup_lines >= 3 OR n_words > 100000) AS kept
FROM m""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON g.h = p.h""",
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS a FROM t GROUP BY c),
k AS (SELECT c, a, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
  lambda v, y: list_reduce(list_concat([xor(v, y)], range(8)), lambda z, i: xor(z >> 1, (z & 1) * 3988292384))), 4294967295) % 6 AS h FROM l),
b AS (SELECT k.c, list_concat(coalesce(o.a, [])[1:k.h], k.a[k.h + 1:]) AS a FROM k LEFT JOIN l o ON o.c = k.c - k.c % 100),
m AS (SELECT c, d, a[1:d] AS s, len(a) = d AS e FROM b, unnest(range(0, len(a) + 1)) AS u(d)),
n AS (SELECT s, d, min(c) AS c, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (e) AS ends FROM m GROUP BY s, d),
q AS (SELECT s[1:d - 1] AS s, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(n.s[d].x) END AS saved FROM n LEFT JOIN q USING (s)),
r AS (SELECT a.s, count(*) FILTER (b.kids = 0) AS n_leaves, sum(b.saved) AS saved FROM v a JOIN v b ON b.d >= a.d AND b.s[1:a.d] = a.s GROUP BY 1)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, u.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, n_leaves, r.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN r USING (s) LEFT JOIN n u ON v.d > 0 AND u.s = v.s[1:v.d - 1]""",
}
