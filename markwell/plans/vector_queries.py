"""Vectors and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from markwell.functions.registry import embedder
from markwell.functions.vectors import cosine, l2_normalize
from markwell.operators import duplicates as D
from markwell.operators import set_join as J
from markwell.operators import similarity as S
from markwell.operators.generate import numbered
from markwell.plans.catalog import query
from markwell.plans.scoring_queries import EVAL, evaluation
from markwell.operators import grading as G
from markwell.plans.views import table, v_answers, v_marked, v_vectors

PAIRS = ("v_vectors", "v_pairs")
VECTORS = ("v_vectors",)


@query("embed_text", "E1", """
SELECT doc_id, task_number, i AS dim, vec[i + 1] AS value FROM (SELECT doc_id, task_number, vec, unnest(range(64)) AS i FROM v_hashed) WHERE vec[i + 1] > 0""", ("v_answers", "v_hashed"))
def embed_text(spark, sf):
    vec = embedder("hashed_words")(F.col("content"))
    return numbered(v_answers(spark, sf), ["doc_id", "task_number"], vec, "dim", "value").filter("value > 0")


@query("l2_normalize", "E2", """
SELECT vec_id, i AS dim, round(CASE WHEN n = 0 THEN v[i + 1] ELSE v[i + 1] / n END, 6) AS value FROM (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, unnest(range(64)) AS i FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 10 = 0 THEN 0.0::DOUBLE ELSE x::DOUBLE END) AS v FROM embeddings))""")
def l2(spark, sf):
    zeroed = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x.cast("double")))
    unit = table(spark, sf, "embeddings").select("vec_id", l2_normalize(zeroed).alias("u"))
    return numbered(unit, ["vec_id"], "u", "dim", "value").withColumn("value", F.round("value", 6))


@query("cosine", "E3", """
SELECT a.vec_id, round(CASE WHEN a.vec_id % 10 = 0 THEN 0 ELSE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) END, 6) AS cosine
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    some = F.when(F.col("vec_id") % 10 != 0, F.col("v"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(some, "w"), 6).alias("cosine"))


@query("reference_similarity", "E4", """
SELECT v.doc_id, round(max(s) FILTER (v.slot = 1), 6) AS task_1, round(max(s) FILTER (v.slot = 2), 6) AS task_2, round(max(s) FILTER (v.slot = 3), 6) AS task_3,
  round(max(s) FILTER (v.slot = 4), 6) AS task_4, round(avg(s), 6) AS average
FROM v_vectors v JOIN (SELECT slot, vec FROM v_vectors WHERE doc_id = 0 AND slot > 0) r ON r.slot = v.slot,
LATERAL (SELECT list_dot_product(v.vec, r.vec) / sqrt(list_dot_product(v.vec, v.vec) * list_dot_product(r.vec, r.vec)) AS s) GROUP BY 1""", VECTORS)
def reference_similarity(spark, sf):
    """Document 0 plays the reference answers; every document is compared with it."""
    vectors = v_vectors(spark, sf)
    out = S.reference_summary(S.reference_similarity(vectors, vectors.filter("doc_id = 0")))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("task_1", "task_2", "task_3", "task_4", "average")])


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


SCORES = ("overall_similarity", "average_task_similarity", "content_similarity")
SCORES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)


@query("pairwise_similarity", "E5", f"""
SELECT doc_id, other_id, {SCORES_SQL} FROM v_pairs WHERE doc_id < other_id AND overall_similarity >= 0.1""", PAIRS)
def pairwise_similarity(spark, sf):
    pairs = S.pairwise_similarity(v_vectors(spark, sf), 0.1, copies=True)
    return rounded(pairs, *SCORES).select("doc_id", "other_id", *SCORES)


TOP_SQL = f"""
SELECT doc_id, CAST(place AS INT) AS place, other_id, {SCORES_SQL}, (SELECT count(DISTINCT doc_id) - 1 FROM v_vectors) AS total_comparisons
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overall_similarity DESC, other_id) AS place FROM v_pairs) WHERE place <= 3"""


@query("top_similar", "E6", TOP_SQL, PAIRS)
def top_similar(spark, sf):
    top = S.top_similar(v_vectors(spark, sf))
    return rounded(top, *SCORES).select("doc_id", "place", "other_id", *SCORES, "total_comparisons")


@query("incremental_similarity", "E7", TOP_SQL, PAIRS)
def incremental_similarity(spark, sf):
    """A quarter of the documents arrives after the rest was compared; the result equals a full run."""
    vectors = v_vectors(spark, sf)
    base, new = vectors.filter("doc_id % 4 <> 0"), vectors.filter("doc_id % 4 = 0")
    out = S.incremental_similarity(S.top_similar(base), base, new)
    return rounded(out, *SCORES).select("doc_id", "place", "other_id", *SCORES, "total_comparisons")


@query("similar_work_lookup", "E8", """
SELECT b.doc_id, b.other_id, round(b.overall_similarity, 6) AS overall_similarity, a.task_number, a.content
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overall_similarity DESC, other_id) AS place FROM v_pairs) b
LEFT JOIN v_answers a ON a.doc_id = b.other_id WHERE place = 1 AND overall_similarity > 0.15""", ("v_vectors", "v_pairs", "v_answers"))
def similar_work_lookup(spark, sf):
    top = S.top_similar(v_vectors(spark, sf), k=1)
    return rounded(S.similar_work(top, v_answers(spark, sf), 0.15), "overall_similarity")


@query("mean_pool", "E9", """
SELECT label, i - 1 AS dim, round(avg(e), 6) AS value FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL""")
def mean_pool(spark, sf):
    tokens = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    pooled = S.mean_pool(tokens, ["label"])
    return numbered(pooled, ["label"], "vec", "dim", "value").withColumn("value", F.round("value", 6))


@query("choose_reference", "E10", "SELECT doc_id, task_number, chosen, chosen_sim FROM v_eval", EVAL)
def choose_reference(spark, sf):
    return evaluation(spark, sf).select("doc_id", "task_number", "chosen", "chosen_sim")


@query("similarity_from_evaluation", "E11", """
SELECT doc_id, task_number, CASE WHEN doc_id % 3 = 0 THEN coalesce(ai_sim, hr_sim) ELSE chosen_sim END AS similarity FROM v_eval""", EVAL)
def similarity_from_evaluation(spark, sf):
    chosen = F.when(F.col("doc_id") % 3 != 0, F.col("chosen"))
    value = G.similarity_from_evaluation(chosen, F.col("hr_sim"), F.col("ai_sim"))
    return evaluation(spark, sf).select("doc_id", "task_number", value.alias("similarity"))


@query("knn_lsh", "E12")
def knn_lsh(spark, sf):
    return rounded(S.knn_lsh(v_vectors(spark, sf)), *SCORES).select("doc_id", "place", "other_id", *SCORES)


@query("knn_lsh_found", "E12", """
SELECT count(DISTINCT doc_id) AS documents, CAST(sum(least(3, n)) AS BIGINT) AS partners, true AS found_enough
FROM (SELECT doc_id, (SELECT count(DISTINCT doc_id) - 1 FROM v_vectors) AS n FROM (SELECT DISTINCT doc_id FROM v_vectors))""", VECTORS)
def knn_lsh_found(spark, sf):
    """The share of the exact partners of all documents that the approximate search finds is at least 0.9."""
    exact = S.top_similar(v_vectors(spark, sf)).select("doc_id", "other_id", F.lit(1).alias("exact"))
    found = S.knn_lsh(v_vectors(spark, sf)).select("doc_id", "other_id", F.lit(1).alias("found"))
    both = exact.join(found, ["doc_id", "other_id"], "left")
    return both.agg(
        F.countDistinct("doc_id").alias("documents"), F.count("exact").alias("partners"),
        (F.count("found") >= F.lit(0.9) * F.count("exact")).alias("found_enough"),
    )


@query("exact_duplicates", "E13", """
SELECT doc_id, sha256(text) AS file_hash, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies
FROM documents QUALIFY copies > 1""")
def exact_duplicates(spark, sf):
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return D.exact_duplicates(hashed)


@query("near_duplicates", "E14", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, coalesce(CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END, []) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT count(*) FROM links WHERE a = s.doc_id) AS n_links, c.class_id
FROM s JOIN (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY 1) c ON c.doc_id = s.doc_id""")
def near_duplicates(spark, sf):
    """Texts of all documents, five-word runs, at least 80 % alike."""
    return J.near_duplicates(table(spark, sf, "documents").withColumnRenamed("text", "content"))


@query("alike_submissions", "E14", """
WITH m AS (SELECT doc_id, list_transform(range(64), lambda i: list_sum(list_transform(list(vec), lambda v: v[i + 1]))) AS vec FROM v_hashed GROUP BY 1),
vecs AS (SELECT doc_id, task_number AS slot, vec FROM v_hashed),
p AS (SELECT a.doc_id, b.doc_id AS other_id, avg(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec))) AS average
      FROM vecs a JOIN vecs b ON a.slot = b.slot AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT p.doc_id, p.other_id, round((average + list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec))) / 2, 6) AS overall_similarity
FROM p JOIN m a ON a.doc_id = p.doc_id JOIN m b ON b.doc_id = p.other_id
WHERE (average + list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec))) / 2 >= 0.70""", ("v_answers", "v_hashed"))
def alike_submissions(spark, sf):
    """Submissions whose embedded answers and whole text are at least 0.70 alike."""
    embed = embedder("hashed_words")
    answers = v_answers(spark, sf).select("doc_id", F.col("task_number").alias("slot"), embed(F.col("content")).alias("vec"))
    whole = v_answers(spark, sf).groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_list("content")), "\n").alias("content")  # at most four answers
    ).select("doc_id", F.lit(0).alias("slot"), embed(F.col("content")).alias("vec"))
    pairs = S.pairwise_similarity(answers.unionByName(whole), 0.70, copies=True)
    return rounded(pairs, "overall_similarity").select("doc_id", "other_id", "overall_similarity")
