"""A lens: fitted components of a set of layers, with scoring, editing, profiles and storage
(S10, S11, M10-M12, X3, X4, X6, P2, P3, P11-P15)."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.linear import apply_linear
from ..operators.matching import extreme_products
from ..sources.files import differences, read_json, write_json
from .fastica import fit_fastica

VERSION = 1


def intervention(values: Mapping[int, float] | tuple[int, float]) -> dict[int, float]:
    """{component: value}; ids are not negative, values finite."""
    pairs = dict([values]) if isinstance(values, tuple) else dict(values)
    for c, v in pairs.items():
        if not isinstance(c, int) or c < 0 or not math.isfinite(v):
            raise ValueError(f"bad intervention {c}: {v}")
    return pairs


@dataclass
class Layer:
    center: np.ndarray
    reading: np.ndarray
    writing: np.ndarray
    pre_center: np.ndarray | None = None
    l2: bool = True
    fitting: dict = field(default_factory=dict)


class Lens:
    def __init__(self, layers: dict[int, Layer], provenance: dict | None = None):
        self.layers, self.provenance = layers, provenance or {}

    @classmethod
    def fit(cls, rows: DataFrame, n_components: int, *, layer: int = 0, provenance: dict | None = None, lens: Lens | None = None, **options) -> Lens:
        """Fits one layer; a lens given is extended, unless its provenance differs; a layer that
        it has already is left as it is."""
        if lens is not None:
            wrong = differences(lens.provenance, provenance or {})
            if wrong:
                raise ValueError(f"the lens differs in {', '.join(wrong)}")
            if layer in lens.layers:
                return lens
        f = fit_fastica(rows, n_components, **options)
        got = Layer(f.center, f.reading, f.writing, f.pre_center, f.l2, {"n_rows": f.n_rows, "objectives": f.objectives.tolist(), "strengths": f.strengths.tolist(), "history": f.history, "held_out": f.held_out})
        lens = lens or cls({}, provenance)
        lens.layers[layer] = got
        return lens

    def transform(self, rows: DataFrame, layer: int, *, vec: str = "vec", out: str = "scores") -> DataFrame:
        """P2."""
        x = self.layers[layer]
        return apply_linear(rows, x.reading, vec=vec, out=out, offset=x.center, pre_center=x.pre_center, l2=x.l2)

    def inverse_transform(self, rows: DataFrame, layer: int, *, scores: str = "scores", out: str = "restored") -> DataFrame:
        """In the prepared space (after pre-centering and scaling)."""
        x = self.layers[layer]
        return apply_linear(rows, x.writing, vec=scores, out=out, shift=x.center)

    def analyze(self, tokens: DataFrame, layer: int, *, vec: str = "vec") -> DataFrame:
        """Scores and their energies of captured token rows."""
        return self.transform(tokens, layer, vec=vec).withColumn("energy", V.energy(F.col("scores")))

    def clamp(self, rows: DataFrame, layer: int, values, *, vec: str = "vec", out: str = "edited") -> DataFrame:
        """Sets chosen scores, restores the vector and its length. What the components do not span stays."""
        x = self.layers[layer]
        scored = self.transform(rows, layer, vec=vec, out="__s").withColumn("__d", V.subtract(V.clamp(F.col("__s"), intervention(values)), F.col("__s")))
        moved = apply_linear(scored, x.writing, vec="__d", out="__m")
        return moved.withColumn(out, V.restore_norm(V.add(V.l2_normalize(F.col(vec)) if x.l2 else F.col(vec), F.col("__m")), F.col(vec))).drop("__s", "__d", "__m")

    def steer(self, rows: DataFrame, layer: int, offsets, *, vec: str = "vec", out: str = "edited", cap: Mapping[int, float] | None = None, initial=None, step: str | None = None, last_only: tuple[str, str] | None = None) -> DataFrame:
        """Adds offsets along writing directions; ``cap`` bounds each score; ``initial`` replaces
        the offsets where the step column is 0; ``last_only`` (document, position) edits last positions only."""
        from pyspark.sql import Window

        x = self.layers[layer]
        scored = self.transform(rows, layer, vec=vec, out="__s")
        k = x.reading.shape[0]

        def amounts(values: dict[int, float]):
            out = []
            for c in range(k):
                s, o = F.col("__s")[c], values.get(c, 0.0)
                out.append(V.capped_offset(s, o, cap[c]) if cap and c in cap else F.lit(float(o)))
            return F.array(*out)

        move = amounts(intervention(offsets))
        if initial is not None and step is not None:
            move = F.when(F.col(step) == 0, amounts(intervention(initial))).otherwise(move)
        if last_only:
            doc, pos = last_only
            move = F.when(F.col(pos) == F.max(pos).over(Window.partitionBy(doc)), move).otherwise(F.array_repeat(F.lit(0.0), k))
        moved = apply_linear(scored.withColumn("__d", move), x.writing, vec="__d", out="__m")
        return moved.withColumn(out, V.add(F.col(vec), F.col("__m"))).drop("__s", "__d", "__m")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per layer as Parquet, then the manifest; a lens without manifest is not complete."""
        rows = [(int(k), x.center.tolist(), x.reading.tolist(), x.writing.tolist(), None if x.pre_center is None else x.pre_center.tolist(), bool(x.l2)) for k, x in sorted(self.layers.items())]
        spark.createDataFrame(rows, "layer int, center array<double>, reading array<array<double>>, writing array<array<double>>, pre_center array<double>, l2 boolean").write.mode("overwrite").partitionBy("layer").parquet(f"{path}/layers")
        write_json(spark, f"{path}/manifest.json", {"version": VERSION, "provenance": self.provenance, "layers": sorted(self.layers), "fitting": {str(k): x.fitting for k, x in self.layers.items()}})

    @classmethod
    def load(cls, spark: SparkSession, path: str, layers: list[int] | None = None) -> Lens:
        """The manifest, then the layers asked for; others are not read."""
        m = read_json(spark, f"{path}/manifest.json")
        if m.get("version") != VERSION:
            raise ValueError(f"unknown version {m.get('version')}")
        want = m["layers"] if layers is None else layers
        rows = spark.read.parquet(f"{path}/layers").where(F.col("layer").isin([int(x) for x in want])).collect()
        return cls({r["layer"]: Layer(np.array(r["center"]), np.array(r["reading"]), np.array(r["writing"]), None if r["pre_center"] is None else np.array(r["pre_center"]), r["l2"], m["fitting"].get(str(r["layer"]), {})) for r in rows}, m["provenance"])


def logit_effects(rows: DataFrame, unembedding: DataFrame, k: int, *, vec: str = "vec") -> DataFrame:
    """For each row the k tokens with the largest and the k with the least logit, from a table
    (token_id, token, vec). Every block of the vocabulary is ranked on its own before blocks meet."""
    best = extreme_products(rows.select(F.col("row_id"), F.col(vec).alias("vec")), unembedding.select(F.col("token_id").alias("row_id"), "vec"), k)
    return best.withColumnRenamed("match", "token_id").withColumnRenamed("product", "logit").join(unembedding.select("token_id", "token"), "token_id")
