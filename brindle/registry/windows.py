"""Queries over ranks, windows, top-k and sampling (W*, L*, R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling, tokens, windows
from ..operators.statistics import component_statistics
from ..plans import profile
from ..sources.tables import scores, table, vectors
from .base import registrar, sql, tidy

ENTRIES: dict = {}
register = registrar(ENTRIES)

_TOK = "tok AS (SELECT doc_id, unnest(range(0, len(w)))::BIGINT AS pos, unnest(w) AS token FROM (SELECT doc_id, regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1) AS w FROM documents WHERE len(regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1)) > 0))"


@register("w01_competition_rank", sql("SELECT row_id, component, rank() OVER (PARTITION BY row_id ORDER BY abs(score) DESC) AS rank FROM s", "row_id component rank"))
def _(spark, d):
    return scores(spark, d).select("row_id", "component", windows.competition_rank(F.abs("score"), "row_id").alias("rank"))


@register("w02_retained_ranks", sql("SELECT row_id, component, score, rank FROM (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY abs(score) DESC) AS rank FROM s) WHERE score > 0.3", "row_id component rank", "score"))
def _(spark, d):
    s = scores(spark, d)
    keep = s.where("score > 0.3").select("row_id", "component")
    return tidy(windows.ranks_of_retained(s, keep).select("row_id", "component", "rank", "score"))


@register("w04_deviation_rank", sql("SELECT component, dev, row_number() OVER (ORDER BY dev DESC, component) AS rank FROM (SELECT component, round(abs(avg(abs(score) + ln(1 + exp(-2 * abs(score))) - ln(2)) - 0.37456720748834715), 9) AS dev FROM s GROUP BY 1)", "component rank", "dev"))
def _(spark, d):
    from pyspark.sql import Window

    from ..functions.scalars import GAUSSIAN, logcosh

    m = scores(spark, d).groupBy("component").agg(F.round(F.abs(F.avg(logcosh(F.col("score"))) - GAUSSIAN["logcosh"]), 9).alias("dev"))
    return tidy(m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("dev"), "component"))))


@register("w05_context_window", f"WITH {_TOK} SELECT doc_id, pos, token, array_to_string(list(token) OVER w, '') AS context, coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS target_start FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def _(spark, d):
    """Over whole documents."""
    return windows.context_window(tokens.tokenize(table(spark, d, "documents")), 4, 4).drop("target_end")


@register("w06_asymmetric_window", f"WITH {_TOK} SELECT * FROM (SELECT doc_id, pos, md5(array_to_string(list(token) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 8 FOLLOWING), '')) AS context FROM tok) WHERE pos >= 1")
def _(spark, d):
    """The first token is no target, yet stands in the contexts of others."""
    t = tokens.tokenize(table(spark, d, "documents"))
    return windows.context_window(t, 24, 8).where("pos >= 1").select("doc_id", "pos", F.md5("context").alias("context"))


@register("w07_prefix_budget", f"WITH {_TOK}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) SELECT doc_id, n::BIGINT AS n, least(n, 20000 - before)::BIGINT AS take FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) WHERE before < 20000")
def _(spark, d):
    """The budget runs over a distributed prefix sum."""
    docs = table(spark, d, "documents").where(tokens.not_blank(F.col("text")))
    n = docs.select("doc_id", F.size(tokens.token_texts(F.col("text"))).cast("long").alias("n"))
    return windows.prefix_budget(n, "doc_id", "n", 20000).select("doc_id", "n", "take")


@register("w08_chat_budget", "WITH n AS (SELECT conv_id, sum(len(regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1))) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, n::BIGINT AS n, least(n, 3000 - before)::BIGINT AS take FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) WHERE before < 3000")
def _(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    n = c.groupBy("conv_id").agg(F.sum(F.size(tokens.token_texts(F.col("text")))).alias("n"))
    return windows.prefix_budget(n, "conv_id", "n", 3000).select("conv_id", "n", "take")


@register("w09_flat_index", f"WITH {_TOK} SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS flat FROM tok")
def _(spark, d):
    t = tokens.tokenize(table(spark, d, "documents")).select("doc_id", "pos")
    return windows.flat_positions(t)


@register("w10_random_fragments", "WITH w AS (SELECT doc_id, regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1) AS ids FROM documents), f AS (SELECT *, (('0x' || left(md5('3:' || doc_id), 12))::BIGINT % (len(ids) - 64 + 1))::BIGINT AS start FROM w WHERE len(ids) >= 64) SELECT doc_id, start, array_to_string(ids[start + 1 : start + 64], ' ') AS fragment FROM f")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tokens.token_texts(F.col("text")).alias("ids"))
    return sampling.random_fragments(docs, "ids", 64, "doc_id", 3).select("doc_id", "start", F.concat_ws(" ", "fragment").alias("fragment"))


@register("w11_influence_radius", sql("SELECT row_id, min(CASE WHEN cum >= 0.5 - 1e-12 THEN component + 1 END)::BIGINT AS radius50, min(CASE WHEN cum >= 0.9 - 1e-12 THEN component + 1 END)::BIGINT AS radius90 FROM (SELECT row_id, component, sum(p) OVER (PARTITION BY row_id ORDER BY component) AS cum FROM (SELECT row_id, component, score * score / sum(score * score) OVER (PARTITION BY row_id) AS p FROM s)) GROUP BY row_id", "row_id radius50 radius90"))
def _(spark, d):
    from ..functions import vectors as V
    from ..sources.tables import long_scores

    e = long_scores(vectors(spark, d).select("row_id", V.energy(F.col("vec")).alias("vec"))).select("row_id", (F.col("component") + 1).alias("distance"), F.col("score").alias("p"))
    return tidy(windows.cumulative_radius(e, ["row_id"], "distance", "p", (0.5, 0.9)))


@register("w12_suffix", "SELECT doc_id, k::BIGINT AS k, array_to_string(ids[greatest(len(ids) - k, 0) + 1 :], ' ') AS suffix FROM (SELECT doc_id, regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1) AS ids FROM documents), (SELECT unnest([1, 2, 4, 16]) AS k)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tokens.token_texts(F.col("text")).alias("ids"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 16)])).alias("k"))
    return docs.select("doc_id", F.col("k").cast("long").alias("k"), F.concat_ws(" ", tokens.suffix(F.col("ids"), F.col("k"))).alias("suffix"))


@register("w13_first_recovery", sql("SELECT row_id, min(component) AS upper, arg_min(below, component) AS lower FROM (SELECT row_id, component, score, coalesce(lag(component) OVER (PARTITION BY row_id ORDER BY component), 0) AS below FROM s) WHERE score > 0.15 GROUP BY row_id UNION ALL SELECT row_id, -1, 0 FROM s GROUP BY row_id HAVING max(score) <= 0.15", "row_id upper lower"))
def _(spark, d):
    return windows.first_recovery(scores(spark, d), ["row_id"], "component", F.col("score") > 0.15).withColumn("upper", F.coalesce("upper", F.lit(-1).cast("long")))


@register("w14_running_sign", sql("SELECT component, row_id, CASE WHEN sum((score < 0)::INT) OVER (PARTITION BY component ORDER BY row_id) % 2 = 1 THEN -1 ELSE 1 END::BIGINT AS sign FROM s", "component row_id sign"))
def _(spark, d):
    return windows.running_sign(scores(spark, d), "component", "row_id", "score").select("component", "row_id", "sign")


@register("w15_adjacent_overlap", sql("SELECT label, step, CASE WHEN prev IS NOT NULL THEN len(list_intersect(items, prev)) / 10 END AS to_previous, len(list_intersect(items, last)) / 10 AS to_final FROM (SELECT *, lag(items) OVER (PARTITION BY label ORDER BY step) AS prev, last(items) OVER (PARTITION BY label ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM (SELECT label, step, list(component ORDER BY rn) AS items FROM (SELECT label, step, component, row_number() OVER (PARTITION BY label, step ORDER BY m DESC, component) AS rn FROM (SELECT label, row_id % 5 AS step, component, round(avg(abs(score)), 9) AS m FROM s GROUP BY ALL)) WHERE rn <= 10 GROUP BY ALL))", "label step", "to_previous to_final"))
def _(spark, d):
    """W15, J17, U5."""
    m = scores(spark, d).groupBy("label", (F.col("row_id") % 5).alias("step"), "component").agg(F.round(F.avg(F.abs("score")), 9).alias("m"))
    top = windows.top_per_key(m, 10, ["label", "step"], [F.desc("m"), F.col("component")])
    items = top.groupBy("label", "step").agg(F.collect_set("component").alias("items"))
    return tidy(windows.adjacent_overlap(items, "label", "step", "items").select("label", "step", "to_previous", "to_final"))


@register("w16_last_position", f"WITH {_TOK} SELECT doc_id, max(pos) AS pos, arg_max(token, pos) AS token FROM tok GROUP BY doc_id")
def _(spark, d):
    return windows.last_position(tokens.tokenize(table(spark, d, "documents")), "doc_id", "pos")


@register("w17_role_counters", "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations")
def _(spark, d):
    return windows.role_counters(table(spark, d, "conversations")).select("conv_id", "turn", "role", "nth")


@register("w19_unique_document_top", sql("SELECT label, row_id, score FROM (SELECT label, row_id, round(score, 9) AS score, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, row_id) AS rn FROM s WHERE component = 2) WHERE rn = 1 ORDER BY score DESC, label LIMIT 5", "label row_id", "score"))
def _(spark, d):
    s = scores(spark, d).where("component = 2").withColumn("score", F.round("score", 9))
    return tidy(windows.unique_document_top(s, "label", "score", 5).select("label", "row_id", "score"))


_TAILS = "(SELECT component, CASE WHEN avg(pow(score - m, 3)) >= 0 THEN 1 ELSE -1 END AS tail FROM (SELECT *, avg(score) OVER (PARTITION BY component) AS m FROM s) GROUP BY 1)"
_OCC = f"SELECT component, row_id, tail::BIGINT AS tail, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(score) DESC, row_id DESC) AS rn FROM s JOIN {_TAILS} USING (component) WHERE sign(score) = tail) WHERE rn <= 8"


@register("l02_topk_occurrences", sql(_OCC, "component row_id tail rn", "score"))
def _(spark, d):
    """L2, L3: the strongest rows on each component's tail."""
    s = scores(spark, d)
    return tidy(profile.occurrences(s, component_statistics(s), 8).select("component", "row_id", "tail", "rn", "score"))


@register("l03_profile_with_ranks", sql(f"SELECT component, row_id, score, r AS absolute_score_rank FROM ({_OCC}) JOIN (SELECT row_id, component, rank() OVER (PARTITION BY row_id ORDER BY abs(score) DESC) AS r FROM s) USING (row_id, component)", "component row_id absolute_score_rank", "score"))
def _(spark, d):
    """The second pass of a profile: occurrences with the rank of the component in each row."""
    return tidy(profile.profile(scores(spark, d), 8)["occurrences"].select("component", "row_id", "score", "absolute_score_rank"))


@register("l04_topk_per_row", sql("SELECT row_id, component, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(score) DESC, component) AS rn FROM s) WHERE rn <= 4", "row_id component rn", "score"))
def _(spark, d):
    return tidy(windows.top_per_key(scores(spark, d), 4, ["row_id"], [F.desc(F.abs("score")), F.col("component")]).drop("label"))


@register("l07_ordered_union", sql("SELECT component, min(row_id * 64 + rn) AS first_pos FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(score) DESC, component) AS rn FROM s) WHERE rn <= 3 GROUP BY component", "component first_pos"))
def _(spark, d):
    """First-seen distinct items over rows in order."""
    top = windows.top_per_key(scores(spark, d), 3, ["row_id"], [F.desc(F.abs("score")), F.col("component")])
    return windows.first_seen(top.withColumn("pos", F.col("row_id") * 64 + F.col("rn")), "component", "pos")


@register("l09_record_split", sql("SELECT component, kind, nth, row_id FROM (SELECT *, row_number() OVER (PARTITION BY component, kind ORDER BY rank) AS nth FROM (SELECT component, row_id, rank, CASE WHEN (rank - 1) % 4 = 0 THEN 'explanation' WHEN (rank - 1) % 4 = 2 THEN 'held_out' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, row_id) AS rank FROM s) WHERE rank <= 20 UNION ALL SELECT component, row_id, rank, 'random' FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY md5('5:' || row_id), row_id) AS rank FROM s) WHERE rank <= 20 AND (rank - 1) % 3 = 1) WHERE kind IS NOT NULL) WHERE nth <= 5", "component kind nth row_id"))
def _(spark, d):
    s = scores(spark, d)
    top = windows.top_per_key(s, 20, ["component"], [F.desc("score"), F.col("row_id")]).withColumnRenamed("rn", "rank")
    rnd = sampling.sample_per_key(s, 20, ["component"], "row_id", 5).withColumnRenamed("rn", "rank")
    return sampling.record_split(top, rnd, ["component"], "rank").select("component", "kind", "nth", "row_id")


@register("r01_uniform_sample", "SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 100")
def _(spark, d):
    return sampling.sample_rows(table(spark, d, "documents").select("doc_id"), 100, "doc_id", 11)


@register("r03_nested_samples", "SELECT row_id, rank, (rank <= 10)::BIGINT + (rank <= 50)::BIGINT + 1 AS n_samples FROM (SELECT vec_id AS row_id, row_number() OVER (ORDER BY md5('2:' || vec_id), vec_id) AS rank FROM embeddings) WHERE rank <= 200")
def _(spark, d):
    n = sampling.nested_samples(vectors(spark, d).select("row_id"), [10, 50, 200], "row_id", 2)
    return n.select("row_id", "rank", F.size("samples").cast("long").alias("n_samples"))


@register("r05_sample_per_group", "SELECT label, row_id FROM (SELECT label::BIGINT AS label, vec_id AS row_id, row_number() OVER (PARTITION BY label ORDER BY md5('4:' || vec_id), vec_id) AS rn FROM embeddings) WHERE rn <= 3")
def _(spark, d):
    return sampling.sample_per_key(vectors(spark, d).select("label", "row_id"), 3, ["label"], "row_id", 4).select("label", "row_id")


@register("r08_accept_until", "SELECT doc_id FROM documents WHERE n_chars > 2000 ORDER BY md5('9:' || doc_id), doc_id LIMIT 30")
def _(spark, d):
    return sampling.accept_until(table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars") > 2000, 30, "doc_id", 9).select("doc_id")


@register("a37_band_samples", "WITH b AS (SELECT event_id, value, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 200 THEN 2 END::BIGINT AS band FROM events WHERE value >= 0 AND value < 200) SELECT band, event_id, round(value, 6) AS value, n_band FROM (SELECT *, count(*) OVER (PARTITION BY band) AS n_band, row_number() OVER (PARTITION BY band ORDER BY md5('1:' || event_id), event_id) AS rn FROM b) WHERE rn <= 10")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return tidy(sampling.band_samples(e, "value", [(0, 10), (10, 50), (50, 200)], 10, "event_id", 1).select("band", "event_id", "value", "n_band"))


