"""Queries over documents, conversations and events (S1-S4, J2-J4, P31, P32, X1-X3, section 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokens
from ..plugins import ToySource, capture
from ..sources.tables import table
from .base import registrar

ENTRIES: dict = {}
register = registrar(ENTRIES)

_W = "regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1)"


@register("s01_tokenize", f"SELECT doc_id, unnest(range(0, len(w)))::BIGINT AS pos, unnest(w) AS token FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) > 0")
def _(spark, d):
    """All tokens of all documents; ``context`` would cut them as a model does."""
    return tokens.tokenize(table(spark, d, "documents"))


@register("s03_chat_documents", "SELECT conv_id, count(*)::BIGINT AS n_messages, bool_and(role IN ('system', 'user', 'assistant') AND regexp_matches(text, '[^ \\t\\n\\r]')) AND bool_or(role = 'assistant') AS valid FROM conversations GROUP BY conv_id")
def _(spark, d):
    """S3, P31."""
    c = tokens.conversations_of(table(spark, d, "conversations"))
    return c.select("conv_id", F.size("messages").cast("long").alias("n_messages"), tokens.valid_chat(F.col("messages"), fitting=True).alias("valid"))


@register("s04_text_identity", "SELECT lang, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS identity FROM documents GROUP BY lang")
def _(spark, d):
    """An identity of each language's texts from their digests."""
    docs = table(spark, d, "documents").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))).alias("hs"))
    return docs.select("lang", F.sha2(F.concat_ws(",", F.transform("hs", lambda x: x["h"])), 256).alias("identity"))


@register("s15_conversation_text", "SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || trim(text, ' '), chr(10) ORDER BY turn) AS text FROM conversations WHERE regexp_matches(text, '[^ \\t\\n\\r]') GROUP BY conv_id")
def _(spark, d):
    c = tokens.conversations_of(table(spark, d, "conversations"))
    return c.select("conv_id", tokens.conversation_text(F.col("messages")).alias("text")).where("text is not null")


@register("p32_not_blank", f"SELECT doc_id, len({_W})::BIGINT AS n_tokens FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')")
def _(spark, d):
    docs = table(spark, d, "documents").where(tokens.not_blank(F.col("text")))
    return docs.select("doc_id", F.size(tokens.token_texts(F.col("text"))).cast("long").alias("n_tokens"))


@register("j03_rendered_spans", "SELECT conv_id, turn, start, start + length(text) AS \"end\" FROM (SELECT *, (coalesce(sum(2 * length(role) + 5 + length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 2)::BIGINT AS start FROM conversations)")
def _(spark, d):
    return tokens.rendered_spans(table(spark, d, "conversations")).select("conv_id", "turn", "start", "end")


@register("j02_span_overlap", "WITH p AS (SELECT *, (coalesce(sum(2 * length(role) + 5 + length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 2)::BIGINT AS start FROM conversations), c AS (SELECT conv_id, max(start + length(text) + length(role) + 3) AS n FROM p GROUP BY 1), t AS (SELECT conv_id, unnest(range(0, n, 7))::BIGINT AS start FROM c) SELECT DISTINCT t.conv_id, t.start FROM t JOIN p ON t.conv_id = p.conv_id AND p.role = 'assistant' AND t.start + 7 > p.start AND t.start < p.start + length(text)")
def _(spark, d):
    """Seven-character tokens of the rendered chat that touch an assistant's content."""
    turns = table(spark, d, "conversations")
    p = tokens.rendered_spans(turns)
    ends = p.groupBy("conv_id").agg(F.max(F.col("end") + F.length("role") + 3).alias("n"))
    t = ends.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(7).cast("long"))).alias("start")).withColumn("end", F.col("start") + 7)
    return tokens.overlapping(t, p.where("role = 'assistant'"), "conv_id").select("conv_id", "start")


@register("j04_last_title", "SELECT conv_id, turn, last(CASE WHEN role = 'user' THEN 'user ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("opens", F.when(F.col("role") == "user", F.concat(F.lit("user "), F.col("turn").cast("string"))))
    return tokens.last_title(c, "conv_id", "turn", "opens").select("conv_id", "turn", "title")


@register("x07_document_framing", "SELECT doc_id, CASE lang WHEN 'en' THEN 'bos' WHEN 'fr' THEN 'eos' ELSE 'none' END AS framing FROM documents")
def _(spark, d):
    reg = spark.createDataFrame([("en", "bos"), ("fr", "eos")], "lang string, framing string")
    return tokens.framed(table(spark, d, "documents").select("doc_id", "lang"), reg, "lang").select("doc_id", "framing")


@register("x01_toy_capture", "SELECT conv_id, count(*)::BIGINT * 2 AS n_rows, 16::BIGINT AS width FROM (SELECT conv_id, unnest(regexp_extract_all(text, '([^ \\t\\n\\r]+)', 1)) FROM conversations) GROUP BY conv_id")
def _(spark, d):
    """Vectors of two layers from the shipped source, for whole chats."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    parts = max(8, 2 * turns.rdd.getNumPartitions())
    turns = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "text")
    t = turns.select("conv_id", "turn", F.posexplode(tokens.token_texts(F.col("text"))).alias("p", "token")).withColumn("pos", F.col("turn") * 2**31 + F.col("p"))
    got = capture(t, ToySource(), [0, 1], doc="conv_id", context=None, ordered=True)
    return got.groupBy("conv_id").agg(F.count("*").alias("n_rows"), F.max(F.size("vec")).cast("long").alias("width"))


@register("st_running_moments", "SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(kurtosis_pop(value), 4) AS kurtosis FROM events GROUP BY 1")
def _(spark, d):
    """A3 as its batch twin; the streaming form is in ``streaming.live`` and tested against this."""
    from ..streaming.live import running_moments

    m = running_moments(table(spark, d, "events"), "event_type", "value")
    return m.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("kurtosis", 4).alias("kurtosis"))


@register("st_stream_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    """Tumbling windows, run as a stream over the files that are there now."""
    import uuid

    from ..storage import shared_dir
    from ..streaming.live import windowed

    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"w{uuid.uuid4().hex[:12]}"
    w = windowed(stream, "ts", "event_type", "value", late="365 days")
    q = w.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@register("st_sessions", "SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k")
def _(spark, d):
    from ..streaming.live import sessions

    return sessions(table(spark, d, "events"), "ts", "user_id").select("user_id", "start", "n")


