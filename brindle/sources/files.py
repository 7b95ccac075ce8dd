"""Readers and writers of documents, activations, lenses and results.

Stores are folders of Parquet beside a small JSON manifest; both go through Spark's file systems, so
they can lie wherever Spark can read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import not_blank

#: Keys of an activation manifest that must agree before layers are added to a store.
IDENTITY = ("model", "revision", "site", "width", "dtype", "context", "framing", "dataset", "seed")


def read_text_rows(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """JSON, JSON lines or Parquet by the name's ending; rows whose text is blank are left out."""
    kinds = {"json": "json", "jsonl": "json", "parquet": "parquet"}
    kind = kinds.get(path.rsplit(".", 1)[-1])
    if kind is None:
        raise ValueError(f"unknown format of {path}")
    df = spark.read.format(kind).load(path)
    return df.where(not_blank(F.col(field).cast("string")))


def dataset_identity(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_parallel_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of two tab-parted fields, trimmed, both not blank."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == 2)
    return rows.select(F.trim(F.col("f")[0]).alias("source"), F.trim(F.col("f")[1]).alias("target")).where("source <> '' and target <> ''")


def read_checkpoint_lines(spark: SparkSession, path: str, schema: str, index: str) -> DataFrame:
    """JSON lines of which the last may be cut off; an index that has gaps is an error."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(index).isNotNull())
    n, top = rows.agg(F.count_distinct(index), F.max(index)).first()
    if n and top != n - 1:
        raise ValueError("the index has gaps")
    return rows


def _file(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON file, written beside its place and renamed into it."""
    text = json.dumps(value, indent=1, sort_keys=True, allow_nan=False)
    fs, final, jvm = _file(spark, path)
    partial = jvm.org.apache.hadoop.fs.Path(path + ".partial")
    out = fs.create(partial, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(partial, final):
        raise OSError(f"could not rename to {path}")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _file(spark, path)
    return bool(fs.exists(p))


def safe_name(name: str) -> str:
    """Names inside a store are relative and do not climb."""
    if name.startswith("/") or ".." in name.split("/") or not re.fullmatch(r"[A-Za-z0-9._/=-]+", name):
        raise ValueError(f"unsafe name {name!r}")
    return name


def differences(a: Mapping, b: Mapping, prefix: str = "") -> list[str]:
    """Paths at which two nested configurations differ."""
    out = []
    for k in sorted({*a, *b}):
        at = f"{prefix}{k}"
        if isinstance(a.get(k), Mapping) and isinstance(b.get(k), Mapping):
            out += differences(a[k], b[k], at + ".")
        elif (k in a) != (k in b) or a.get(k) != b.get(k):
            out.append(at)
    return out


class ActivationStore:
    """Vectors of several layers, a Parquet folder for each, beside a manifest that names the
    complete ones. A layer is complete once its rows are written and counted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def manifest_path(self) -> str:
        return f"{self.path}/manifest.json"

    def manifest(self) -> dict:
        return read_json(self.spark, self.manifest_path)

    def create(self, identity: Mapping, layers: Sequence[int]) -> list[int]:
        """Opens or resumes; returns the layers still to be written. Another identity is refused."""
        if exists(self.spark, self.manifest_path):
            have = self.manifest()
            wrong = [k for k in IDENTITY if have["identity"].get(k) != identity.get(k)]
            if wrong or have["layers"] != sorted(layers):
                raise ValueError(f"the store differs in {', '.join(wrong) or 'layers'}")
            return [k for k in have["layers"] if str(k) not in have["rows"]]
        write_json(self.spark, self.manifest_path, {"identity": dict(identity), "layers": sorted(layers), "rows": {}})
        return sorted(layers)

    def write(self, layer: int, rows: DataFrame) -> None:
        """Rows: row_id, document_index, position, token_id, vec."""
        at = f"{self.path}/layer={int(layer)}"
        rows.select("row_id", "document_index", "position", "token_id", "vec").write.mode("overwrite").parquet(at)
        width = self.manifest()["identity"]["width"]
        n, bad = self.spark.read.parquet(at).agg(F.count("*"), F.count_if(F.size("vec") != width)).first()
        if bad:
            raise ValueError(f"{bad} vectors have another width than {width}")
        m = self.manifest()
        m["rows"][str(layer)] = n
        write_json(self.spark, self.manifest_path, m)

    def read(self, layers: Sequence[int] | None = None) -> DataFrame:
        """Complete layers only; the filter on ``layer`` prunes folders."""
        m = self.manifest()
        want = sorted(int(k) for k in m["rows"]) if layers is None else sorted(layers)
        missing = [k for k in want if str(k) not in m["rows"]]
        if missing:
            raise ValueError(f"layers are not complete: {missing}")
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/layer={k}" for k in want])


def layer_list(text: str, n_layers: int) -> list[int]:
    """P33: "all" or distinct numbers in range, sorted."""
    if text == "all":
        return list(range(n_layers))
    got = [int(x) for x in text.split(",")]
    if len(set(got)) != len(got) or any(not 0 <= x < n_layers for x in got):
        raise ValueError(f"layers must be distinct and lie below {n_layers}")
    return sorted(got)


def save_profiles(profiles: DataFrame, path: str) -> None:
    """Compressed JSON, one line a component."""
    profiles.write.mode("overwrite").option("compression", "gzip").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def html_report(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A self-contained page around the first ``limit`` rows as JSON; a report shows that many."""
    body = ",".join(r[0] for r in rows.limit(limit).select(F.to_json(F.struct(*rows.columns))).collect())
    data = f"[{body}]".replace("<", "\\u003c")
    head = title.replace("&", "&amp;").replace("<", "&lt;")
    return f"<!doctype html><meta charset=utf-8><title>{head}</title><h1>{head}</h1><table id=t></table><script>const rows={data};const t=document.getElementById('t');rows.forEach(r=>{{const tr=t.insertRow();Object.values(r).forEach(v=>tr.insertCell().textContent=typeof v=='object'?JSON.stringify(v):v)}})</script>"


def common_provenance(layers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns on which all layers agree, with their value; only they head a model card."""
    one = lambda c: F.when(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) == 1, F.max(F.col(c).cast("string")))
    wide = layers.agg(*[one(c).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("f")).select("f.*").where("value is not null")


def chat_rows(turns: DataFrame, ok: Column) -> DataFrame:
    """S3: conversations that pass, and the number of those that do not."""
    skipped = turns.agg(F.count_if(~ok).alias("skipped"))
    return turns.where(ok).crossJoin(F.broadcast(skipped))


def space_preflight(spark: SparkSession, path: str, need: int, margin: float = 1.1) -> None:
    """Refuses a write for which the file system reports too little space."""
    fs, p, _ = _file(spark, path)
    free = fs.getStatus(p).getRemaining()
    if need * margin > free:
        raise OSError(f"{need} bytes and a margin are needed, {free} are free")


def check_held_out(fitted: Mapping, held_out: Mapping) -> None:
    """Held-out rows must come from the same model, site, width, context and framing."""
    wrong = [k for k in ("model", "revision", "site", "width", "context", "framing") if fitted.get(k) != held_out.get(k)]
    if wrong:
        raise ValueError(f"held-out rows differ in {', '.join(wrong)}")
