"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import alignment, encoding, hard_negatives, jaccard, katz, mixing, packing, pii, quality_model, quality_rules, simhash, substrings, token_counts, topk
from tidegate.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), encoding.vocabulary(), capacity=2048)


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), sample_rows=6000, folds=3, fold=1)
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", quality_model.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def op3_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=3, part=90, whole=100)


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), window=35)


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", scale=64)
    return topk.top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), quality_model.held_out("doc_id", 5, 1))


def op9_line_labelling_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality_rules.train_field(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs.select("doc_id", "text"), field).drop("text")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents"), encoding.vocabulary()))


def op11_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", scale=256)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=10, least=30, most=90)


def op12_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op13_arrow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), encoding.vocabulary(), encoding.vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_signature_tree_join": JOIN_SQL, "op5_source_mixing": MIXING_SQL, "op6_superkmer_dedup": WINDOWS_SQL, "op7_threshold_topk": TOPK_SQL, "op11_bond_hard_negatives": NEGATIVES_SQL}


#: All pairs that share a shingle, by their numbers of shared ones; components by following links.
JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS shingle FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.reached) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY 1, 2
"""


#: Every window written out and counted.
WINDOWS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS run FROM p),
t AS (SELECT doc_id, i FROM k WHERE run IN (SELECT run FROM k GROUP BY run HAVING count(*) > 1)),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM t, range(35) o(j) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id)
SELECT doc_id, n_words, n_words - len(kept)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM f
"""


#: Sources' targets: those that stop at three times their size are a prefix in the order of size per weight.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  substr(md5(concat_ws(chr(10), doc_id::VARCHAR, text)), 1, 12) AS digits FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
             (3.0 * source_size)::DOUBLE AS cap, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level
      FROM w WINDOW r AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, cap / weight) AS share FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE share * weight END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY digits RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, digits) AS bucket
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * least(3, whole + CASE WHEN upto <= rest OR bucket < 2 * (rest - (upto - bucket)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


#: Anchors against all rows; the windows of the five positives against the scores of other labels.
NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS anchor_id, c.row AS other, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.row <> c.row),
p AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.row, p.place, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON p.row = s.row AND p.place <= 5 AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
