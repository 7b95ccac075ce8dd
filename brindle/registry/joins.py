"""Queries over joins, set operations and audits (J*, U*, V*, A74, A75, A83)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, joins, matching, sampling
from ..sources.tables import scores, table, vectors
from .base import registrar, sql, tidy

ENTRIES: dict = {}
register = registrar(ENTRIES)


@register("j01_positional_join", "SELECT d.doc_id, d.lang, e.label::BIGINT AS label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def _(spark, d):
    v = vectors(spark, d).select("row_id", "label")
    return joins.by_row(table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "lang"), v).select(F.col("row_id").alias("doc_id"), "lang", "label")


@register("j05_gather_rows", sql("SELECT row_id, component, score FROM s WHERE row_id IN (SELECT vec_id FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 16)", "row_id component", "score"))
def _(spark, d):
    """A semi-join by sampled rows."""
    s = scores(spark, d)
    keys = sampling.sample_rows(vectors(spark, d).select("row_id"), 16, "row_id", 0)
    return tidy(joins.gather(s, keys, ["row_id"]).drop("label"))


@register("j06_vocabulary_lookup", "WITH v AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS token_id FROM (SELECT DISTINCT role FROM conversations)) SELECT conv_id, turn, token_id FROM conversations JOIN v USING (role)")
def _(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    vocab = c.select("role").distinct().withColumn("token_id", F.row_number().over(Window.orderBy("role")).cast("long") - 1)
    return c.join(F.broadcast(vocab), "role").select("conv_id", "turn", "token_id")  # one row per role


@register("j07_source_documents", sql("SELECT s.row_id, s.component, s.score, d.lang, d.n_chars FROM s JOIN documents d ON d.doc_id = s.row_id WHERE s.score > 0.3", "row_id component lang n_chars", "score"))
def _(spark, d):
    s = scores(spark, d).where("score > 0.3").select(F.col("row_id").alias("doc_id"), "component", "score")
    return tidy(s.join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumnRenamed("doc_id", "row_id"))


@register("j08_replay_validation", "SELECT count(*)::BIGINT AS unmatched FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return joins.unmatched(lines, table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"]).agg(F.count("*").alias("unmatched"))


@register("j09_held_out_documents", "SELECT min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') GROUP BY text")
def _(spark, d):
    """Anti-join on text digests."""
    docs = table(spark, d, "documents")
    return joins.held_out_documents(docs, docs.where("source = 'src0'")).select("doc_id")


_NEAR = "n AS (SELECT a.vec_id AS row_id, b.vec_id AS match, round(abs(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"


@register("j10_nearest_direction", f"WITH {_NEAR} SELECT row_id, match, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cosine DESC, match) AS rn FROM n) WHERE rn = 1")
def _(spark, d):
    """Blocked products; every row whose id 50 divides, against all others."""
    v = vectors(spark, d)
    return tidy(matching.nearest(v.where("row_id % 50 = 0"), v, exclude_self=True))


_UNIT = "u AS (SELECT row_id, component, score / sqrt(sum(score * score) OVER (PARTITION BY row_id)) AS score FROM s), n AS (SELECT a.row_id, b.row_id AS match, round(sum(a.score * b.score), 9) AS p FROM u a JOIN u b USING (component) WHERE a.row_id % 50 = 0 GROUP BY ALL)"


@register("j11_extreme_products", sql("SELECT row_id, match, side, rank, p AS product FROM (SELECT *, 'top' AS side, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, match) AS rank FROM n UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY row_id ORDER BY p, match) FROM n) WHERE rank <= 3", "row_id match side rank", "product", _UNIT))
def _(spark, d):
    """Both ends of a readout."""
    from ..functions import vectors as V

    v = vectors(spark, d).withColumn("vec", V.l2_normalize(F.col("vec")))
    return tidy(matching.extreme_products(v.where("row_id % 50 = 0"), v, 3))


@register("j12_most_isolated", "WITH p AS (SELECT a.vec_id AS row_id, max(round(abs(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9)) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1) SELECT row_id, round(cosine, 6) AS cosine FROM p ORDER BY p.cosine, row_id LIMIT 1")
def _(spark, d):
    return tidy(matching.most_isolated(vectors(spark, d)).select("row_id", "cosine"))


@register("j14_optimal_matching")
def _(spark, d):
    """One-to-one matching of each label's directions with the next one's; tested against all
    permutations."""
    v = vectors(spark, d)
    runs = v.groupBy(F.col("label").alias("run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "vec"))), lambda x: x["vec"]).alias("vecs"))
    a, b = runs.select(F.col("run").alias("run_a"), F.col("vecs").alias("vecs_a")), runs.select(F.col("run").alias("run_b"), F.col("vecs").alias("vecs_b"))
    return tidy(matching.match_groups(a.join(b, F.col("run_a") + 1 == F.col("run_b"))))


@register("j15_pairs", "SELECT a.n_regionkey::BIGINT AS region, a.n_nationkey::BIGINT AS base, b.n_nationkey::BIGINT AS source FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("key"))
    return joins.pairs_on(n, "region", "key")


@register("j16_key_set_equality", "SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _(spark, d):
    from ..operators.agreement import same_keys

    return same_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@register("j18_configuration_audit", "SELECT o_orderkey AS k, (o_orderstatus = CASE WHEN lo = hi AND lo IN ('F', 'O') THEN lo ELSE 'P' END) AS agree FROM orders JOIN (SELECT l_orderkey, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"))
    want = lines.select("k", F.when((F.col("lo") == F.col("hi")) & F.col("lo").isin("F", "O"), F.col("lo")).otherwise("P").alias("status"))
    have = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return audit.same_setting([have.join(want.select("k"), "k", "left_semi"), want], ["k"], ["status"])


@register("j19_profile_compare", sql("SELECT 'label' AS field, count(*)::BIGINT AS rows, 0::BIGINT AS mismatches, 0.0 AS max_error FROM s UNION ALL SELECT 'score', count(*)::BIGINT, count_if(NOT abs(0.001 * (row_id % 3 = 0)::INT) <= 1e-6 + 1e-5 * abs(score + 0.001 * (row_id % 3 = 0)::INT))::BIGINT, max(0.001 * (row_id % 3 = 0)::INT) FROM s", "field rows mismatches", "max_error"))
def _(spark, d):
    """Stored against reproduced, exact and near fields; here every third row is off."""
    s = scores(spark, d)
    off = s.withColumn("score", F.col("score") + F.when(F.col("row_id") % 3 == 0, 0.001).otherwise(0.0))
    return tidy(joins.compare(s, off, ["row_id", "component"], ["label"], ["score"], atol=1e-6))


@register("j22_keys_in_all", "SELECT source FROM documents GROUP BY source HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)")
def _(spark, d):
    return joins.keys_in_all(table(spark, d, "documents"), ["source"], "lang")


@register("j24_duplicate_keys", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    """Keys that must be unique and are not."""
    return joins.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@register("j25_fill_blank_labels", "SELECT d.doc_id, CASE WHEN lang <> 'en' AND quality = 1 THEN 'good' WHEN lang <> 'en' THEN '' ELSE lang END AS label FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("lang")).otherwise("").alias("label"))
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return joins.fill_blank(docs, marks, ["doc_id"], "label", "quality", 1, "good").select("doc_id", "label")


@register("u02_set_operations", "SELECT 'intersect' AS op, count(*)::BIGINT AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'union', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def _(spark, d):
    """U2-U4."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.intersect(b), "intersect").unionByName(count(a.subtract(b), "except")).unionByName(count(a.unionByName(b).distinct(), "union"))


@register("v02_row_equality", "SELECT doc_id, side FROM (SELECT doc_id, 'left' AS side FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 'right' FROM documents WHERE lang = 'de')")
def _(spark, d):
    """V2, V7, V8: rows on one side only."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return joins.same_rows(docs.where("lang != 'de'").select("doc_id"), docs.where("lang != 'fr'").select("doc_id"))


@register("v10_field_bounds", "SELECT count(*)::BIGINT AS n, count_if(l_quantity < 1 OR l_quantity > 40)::BIGINT AS outside, round(avg(l_quantity), 6) AS mean FROM lineitem")
def _(spark, d):
    return tidy(audit.field_bounds(table(spark, d, "lineitem").select(F.col("l_quantity").alias("v"), F.lit(40.0).alias("c")), "v", "c"))


@register("v11_stored_means", "SELECT o_orderpriority AS p, round(avg(o_totalprice), 2) AS mean, TRUE AS ok FROM orders GROUP BY 1")
def _(spark, d):
    """Stored aggregates against recomputed ones."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("mean"))
    kept = o.groupBy("p").agg(F.avg("mean").alias("mean"))
    return tidy(audit.stored_mean_check(o, kept, ["p"], "mean").select("p", "mean", "ok"), 2)


@register("a68_finite_audit", "SELECT count(*) FILTER (WHERE event_id % 7 = 0 OR event_id % 11 = 0)::BIGINT AS value, 0::BIGINT AS event_id FROM events")
def _(spark, d):
    """A68 over events some of whose values are made NaN or infinite."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    e = table(spark, d, "events").select(value.alias("value"), F.col("event_id").cast("double").alias("event_id"))
    return joins.finite_audit(e, ["value", "event_id"])


@register("a75_merge_methods", "SELECT lang AS method, count(*)::BIGINT AS n, 1000::BIGINT AS tokens FROM documents GROUP BY 1")
def _(spark, d):
    m = table(spark, d, "documents").groupBy(F.col("lang").alias("method")).agg(F.count("*").alias("n")).withColumn("tokens", F.lit(1000).cast("long"))
    return audit.merge_methods([m.where("method < 'es'"), m.where("method >= 'es'")], "method", "tokens")


@register("a83_nested_audit", "SELECT unnest([10, 50, 200])::BIGINT AS size, unnest([10, 50, 200])::BIGINT AS n, TRUE AS ok")
def _(spark, d):
    n = sampling.nested_samples(vectors(spark, d).select("row_id"), [10, 50, 200], "row_id", 2)
    return audit.nested_audit(n, [10, 50, 200]).select("size", "n", "ok")
