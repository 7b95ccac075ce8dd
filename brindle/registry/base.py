"""What the query modules share: registration, rounding, and the long form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
#: The long form of ``embeddings``: row_id, label, component, score.
LONG = "s AS (SELECT vec_id AS row_id, label::BIGINT AS label, (i - 1)::BIGINT AS component, embedding[i]::DOUBLE AS score FROM embeddings, range(1, 65) t(i))"


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (and no negative zero), whole numbers as longs."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)


def sql(body: str, plain: str, rounded: str = "", ctes: str = "", digits: int = DIGITS) -> str:
    """SELECT over ``body`` with the same rounding; ``ctes`` come behind the long form."""
    cols = [c for c in plain.split()] + [f"round({c}, {digits}) + 0.0 AS {c}" for c in rounded.split()]
    more = f", {ctes}" if ctes else ""
    return f"WITH {LONG}{more} SELECT {', '.join(cols)} FROM ({body})"


def registrar(entries: dict):
    def register(name: str, oracle: str | None = None):
        def keep(f):
            entries[name] = (f, oracle)
            return f

        return keep

    return register
