"""The registered queries of the training-data operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfacet.llm import bpe, conversation_trie, embedding_dedup, exact_dedup, license_scan, mixing, ngram_join, pii, quality, substring_dedup, toxicity, url_filter, whitening
from sparkfacet.llm._spark import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file in the installed package of public tokenizers, which every executor has too."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.with_spans(docs, pii.fit_detector(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "mix.topic", "mix.n_tokens", F.round("mix.weight", 6).alias("weight"), F.round("mix.prob", 6).alias("prob"), "mix.selected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_severity(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_severity(docs.select("doc_id", "text"), model).select("doc_id", "severity.*")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base, spans = F.transform("base", lambda b: b.label), F.transform("spans", lambda s: s.label)
    names = [F.array_join(F.array_sort(F.array_distinct(c)), ",") for c in (base, F.concat(base, spans))]
    places = F.transform("base", lambda b: b.word)
    score = F.greatest(F.when(F.size("base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s.cover)), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), names[0].alias("base_labels"), names[1].alias("labels"), score.alias("score"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.with_verdicts(pages, url_filter.fit_bayes(pages))
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), F.round("p_block", 6).alias("p_block"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")), into="score")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.with_shared_starts(turns))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    done = whitening.with_whitened(vectors, whitening.fit_whitening(vectors)).filter("whitening is not null").select("vec_id", "whitening.*")
    each = done.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"), "n", "deviation", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pii, op2_mixing, op3_toxicity, op4_suffix_dedup, op5_exact_dedup, op6_itq_dedup, op7_ngram_jaccard_join, op8_license_scan, op9_url_filter, op10_bpe, op11_mil_quality, op12_conversation_trie, op13_whitening)
    return {f.__name__: f for f in every}


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)
"""


NGRAM_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


TRIE_SQL = r"""
WITH RECURSIVE crc(i, v, k) AS (SELECT range::BIGINT, range::BIGINT, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 6 AS h FROM own, tab),
rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS l FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
place AS (SELECT conv_id, depth, l[1:depth] AS prefix, len(l) = depth AS ends FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS depth FROM rebuilt)),
node AS MATERIALIZED (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends) AS e FROM place GROUP BY prefix, depth),
path AS MATERIALIZED (SELECT a.conv_id AS member, a.depth, n.conv_id FROM place a JOIN node n ON n.depth = a.depth AND n.prefix = a.prefix),
up AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.prefix[n.depth].t) END AS saved FROM node n LEFT JOIN path p ON p.member = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL),
every AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (conv_id, depth)),
below AS (SELECT p.conv_id, p.depth, sum((u.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens FROM every u JOIN path p ON p.member = u.conv_id AND p.depth <= u.depth GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(e, '')) AS ends_sha256 FROM every JOIN below USING (conv_id, depth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.oracle(), "op5_exact_dedup": EXACT_SQL, "op7_ngram_jaccard_join": NGRAM_SQL, "op12_conversation_trie": TRIE_SQL}
