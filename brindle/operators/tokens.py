"""Documents, conversations and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of the built-in tokenizer.
TOKEN = "([^ \\t\\n\\r]+)"


def token_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def not_blank(text: Column) -> Column:
    """P32."""
    return text.isNotNull() & (F.regexp_count(text, F.lit("[^ \\t\\n\\r]")) > 0)


def tokenize(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", context: int | None = None) -> DataFrame:
    """A row per token of each document that is not blank: doc, pos (from 0), token. ``context``
    cuts documents to their first tokens."""
    tokens = token_texts(F.col(text))
    if context is not None:
        tokens = F.slice(tokens, 1, context)
    return docs.where(not_blank(F.col(text))).select(doc, F.posexplode(tokens).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def conversations_of(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """S3: one row per conversation, its messages in order. A conversation is gathered whole."""
    return turns.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def valid_chat(messages: Column, *, fitting: bool = False, roles: Sequence[str] = ("system", "user", "assistant")) -> Column:
    """Known roles and contents that are not blank; for fitting, an assistant message too."""
    ok = (F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isin(*roles) & not_blank(m["content"]))
    return ok & F.exists(messages, lambda m: m["role"] == "assistant") if fitting else ok


def conversation_text(messages: Column) -> Column:
    """Lines "Role: content" of the valid messages; null if there are none."""
    good = F.filter(messages, lambda m: m["role"].isNotNull() & not_blank(m["content"]))
    return F.when(F.size(good) > 0, F.concat_ws("\n", F.transform(good, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.trim(m["content"])))))


def rendered_spans(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn as <role>content</role>, and where its content stands in the rendered chat. Spans
    are running sums of lengths; nothing is searched."""
    piece = F.length(role) * 2 + 5 + F.length(text)
    before = F.coalesce(F.sum(piece).over(Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = turns.withColumn("start", (before + F.length(role) + 2).cast("long"))
    return out.withColumn("end", (F.col("start") + F.length(text)).cast("long"))


def overlapping(tokens: DataFrame, spans: DataFrame, on: str) -> DataFrame:
    """Tokens [start, end) that overlap a span of the same conversation; empty tokens never do. The
    equi-join on the conversation keeps the range condition local to it."""
    t, s = tokens.alias("t"), spans.alias("s")
    hit = (F.col(f"t.{on}") == F.col(f"s.{on}")) & (F.col("t.end") > F.col("s.start")) & (F.col("t.start") < F.col("s.end")) & (F.col("t.end") > F.col("t.start"))
    return t.join(s, hit, "left_semi")


def last_title(df: DataFrame, group: str, pos: str, title: str) -> DataFrame:
    """As-of: the last title at or before each position."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("title", F.last(F.col(title), ignorenulls=True).over(w))


def suffix(ids: Column, length: Column | int) -> Column:
    """The last ``length`` items."""
    n = F.least(F.size(ids), length if isinstance(length, Column) else F.lit(length))
    return F.slice(ids, (F.size(ids) - n + 1).cast("int"), n.cast("int"))


def framed(docs: DataFrame, framing: DataFrame, model: str) -> DataFrame:
    """Adds the document framing of each row's model; the registry is a small dimension table."""
    return docs.join(framing, model, "left").withColumn("framing", F.coalesce("framing", F.lit("none")))


def decodable_span(pieces: Sequence[bytes], at: int, most: int = 8) -> tuple[int, int] | None:
    """The shortest run of pieces around ``at`` (at most ``most`` long) that decodes as UTF-8."""
    for n in range(1, most + 1):
        for lo in range(max(0, at - n + 1), min(at, len(pieces) - n) + 1):
            try:
                b"".join(pieces[lo : lo + n]).decode()
            except UnicodeDecodeError:
                continue
            return lo, lo + n
    return None
