"""Literal rows for windows, joins, sampling, matching, statistics and streams."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import audit, dictionaries, erf, joins, matching, sampling, statistics, tokens, windows
from brindle.plans import profile
from brindle.plugins import ToySource, capture, check_site
from brindle.sources import files
from brindle.streaming import live


def long(spark, matrix):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(matrix) for c, v in enumerate(row)], "row_id bigint, component bigint, score double")


def test_competition_rank(spark):
    s = long(spark, [[3, -3, 2, -1], [0, -4, 2, -3]]).withColumn("k", windows.competition_rank(F.abs("score"), "row_id"))
    got = [[r["k"] for r in s.where(F.col("row_id") == i).orderBy("component").collect()] for i in (0, 1)]
    assert got == [[1, 1, 3, 4], [4, 1, 3, 2]]


def test_profile_prefers_later_rows_and_tail(spark):
    s = long(spark, [[1], [1], [1], [1], [-1.8]])
    p = profile.profile(s, 2)
    st = p["statistics"].first()
    assert st["positive_energy"] > 0.5 and st["skewness"] < 0 and st["tail"] == -1
    assert [r["row_id"] for r in p["occurrences"].collect()] == [4]
    ties = profile.profile(long(spark, [[1], [1], [0], [0], [0]]), 1)["occurrences"].collect()
    assert [r["row_id"] for r in ties] == [1]


def test_running_total_and_budget(spark):
    docs = spark.createDataFrame([(i, n) for i, n in enumerate([3, 4, 5, 6])], "doc_id bigint, n bigint")
    got = windows.prefix_budget(docs, "doc_id", "n", 9).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["take"], r["short"]) for r in got] == [(0, 3, False), (1, 4, False), (2, 2, False)]
    assert windows.prefix_budget(docs, "doc_id", "n", 99).first()["short"]
    assert windows.prefix_budget(docs.limit(0), "doc_id", "n", 9).count() == 0


def test_contexts_and_suffixes(spark):
    t = spark.createDataFrame([(1, k, c) for k, c in enumerate("abcdefghijkl")], "doc_id bigint, pos bigint, token string")
    r = windows.context_window(t, 4, 4).where("pos = 2").first()
    assert (r["context"], r["target_start"], r["target_end"]) == ("abcdefg", 2, 3)


def test_chat_spans(spark):
    turns = spark.createDataFrame([(1, 0, "user", "question"), (1, 1, "assistant", "answer")], "conv_id bigint, turn bigint, role string, text string")
    p = tokens.rendered_spans(turns)
    chat = "<user>question</user><assistant>answer</assistant>"
    r = p.where("role = 'assistant'").first()
    assert chat[r["start"] : r["end"]] == "answer"
    chars = spark.range(len(chat)).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    hit = tokens.overlapping(chars, p.where("role = 'assistant'"), "conv_id")
    assert sorted(r["start"] for r in hit.collect()) == list(range(r["start"], r["end"]))
    msgs = tokens.conversations_of(turns)
    assert msgs.select(tokens.valid_chat(F.col("messages"), fitting=True), tokens.conversation_text(F.col("messages"))).first()[:] == (True, "User: question\nAssistant: answer")
    assert not tokens.conversations_of(turns.where("role = 'user'")).select(tokens.valid_chat(F.col("messages"), fitting=True)).first()[0]


def test_sampling(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    a, b = ({r[0] for r in sampling.sample_rows(df.repartition(k), 10, "row_id", 3).collect()} for k in (1, 6))
    assert a == b and len(a) == 10
    n = sampling.nested_samples(df, [5, 10], "row_id", 3)
    assert all(r["ok"] for r in audit.nested_audit(n, [5, 10]).collect()) and n.count() == 10
    s = long(spark, [[float(k)] for k in range(1, 41)])
    top = windows.top_per_key(s, 20, ["component"], [F.desc("score")]).withColumnRenamed("rn", "rank")
    rnd = sampling.sample_per_key(s, 20, ["component"], "row_id").withColumnRenamed("rn", "rank")
    got = sampling.record_split(top, rnd, ["component"], "rank")
    assert sorted(r["n"] for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()) == [5, 5, 5]


def test_assignment_beats_all_permutations():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        w = rng.random((n, m))
        best = max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        got = matching.assignment(w)
        assert len(set(got.tolist())) == n and sum(w[i, j] for i, j in enumerate(got)) == pytest.approx(best)


def test_nearest_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, vec array<double>")
    monkeypatch.setattr(matching, "BLOCK", 7)
    got = {r["row_id"]: r["match"] for r in matching.nearest(df, df, exclude_self=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.abs(u @ u.T) - 2 * np.eye(30)
    assert got == {i: int(c[i].argmax()) for i in range(30)}
    assert matching.nearest(df, df.limit(0)).count() == 0


def test_erf(spark):
    s = long(spark, [[5, 4, 3], [5, -6, 3], [5, 0.5, 3]]).withColumn("target", F.lit(1).cast("long"))
    got = erf.suffix_recovery(s, ["row_id"], "component", "target", 2, 1).orderBy("row_id").collect()
    assert [(r["rank"], r["sign_ok"], r["recovered"]) for r in got] == [(2, True, True), (1, False, False), (3, True, False)]
    g = spark.createDataFrame([(0, 3, 0.1), (0, 2, 0.2), (0, 1, 0.7)], "row_id bigint, d bigint, p double")
    r = erf.gradient_statistics(g, ["row_id"], "d", "p").first()
    assert r["geometric"] == pytest.approx(math.exp(0.1 * math.log(3) + 0.2 * math.log(2))) and r["arithmetic"] == pytest.approx(1.4)
    assert (r["radius50"], r["radius90"]) == (1, 2)


def test_saturation(spark):
    pts = [(1.0, 0.7)] + [(k, 0.92) for k in (31.99999, 31.999995, 32.0)]
    got = dictionaries.collapse_saturated(pts)
    assert len(got) == 2 and got[1][0] == pytest.approx(31.999995, rel=1e-6)


def test_kurtosis_matches_closed_form(spark):
    x = np.random.default_rng(0).standard_normal(5000) ** 3
    df = spark.createDataFrame([(0, float(v)) for v in x], "component bigint, score double").repartition(9)
    d = x - x.mean()
    want = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert statistics.component_statistics(df).first()["kurtosis"] == pytest.approx(want, rel=1e-9)


def test_constants_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(statistics.safe_corr(F.col("a"), F.col("b"))).first()[0] is None


def test_compare_and_audits(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k bigint, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "z", 2.1)], "k bigint, s string, v double")
    got = {r["field"]: (r["rows"], r["mismatches"]) for r in joins.compare(a, b, ["k"], ["s"], ["v"]).collect()}
    assert got == {"s": (2, 1), "v": (2, 1)}
    assert joins.finite_audit(spark.createDataFrame([(float("nan"),)], "v double"), ["v"]).first()[0] == 1
    checks = audit.run_checks({"good": lambda: True, "bad": lambda: 1 / 0})
    assert [c["status"] for c in checks] == ["passed", "failed"]
    with pytest.raises(Exception, match="overlap"):
        m = spark.createDataFrame([("m", 5)], "method string, tokens bigint")
        audit.merge_methods([m, m], "method", "tokens").collect()


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 0, 10, [1.0, 2.0]), (1, 0, 2, 12, [3.0, 4.0]), (2, 1, 1, 21, [5.0, 6.0])], "row_id bigint, document_index bigint, position bigint, token_id bigint, vec array<float>")
    store = files.ActivationStore(spark, str(tmp_path / "a"))
    ident = {"model": "toy", "width": 2}
    assert store.create(ident, [0, 1]) == [0, 1]
    store.write(0, rows)
    assert files.ActivationStore(spark, str(tmp_path / "a")).create(ident, [0, 1]) == [1]
    assert [r["token_id"] for r in store.read([0]).orderBy("row_id").collect()] == [10, 12, 21]
    with pytest.raises(ValueError, match="not complete"):
        store.read([1])
    with pytest.raises(ValueError, match="model"):
        store.create({"model": "other", "width": 2}, [0, 1])
    files.space_preflight(spark, "file:///tmp", 1)
    with pytest.raises(OSError, match="free"):
        files.space_preflight(spark, "file:///tmp", 10**18)
    files.check_held_out(ident, ident)
    with pytest.raises(ValueError, match="width"):
        files.check_held_out(ident, {"model": "toy", "width": 3})
    with pytest.raises(ValueError, match="unsafe"):
        files.safe_name("../x")
    assert "&lt;b>" in files.html_report(rows.select("row_id"), "<b>")
    with pytest.raises(ValueError, match="unknown format"):
        files.read_text_rows(spark, "x.csv")
    (tmp_path / "d.jsonl").write_text('{"text": "a b"}\n{"text": " "}\n{"text": "c"}\n')
    assert files.read_text_rows(spark, str(tmp_path / "d.jsonl")).count() == 2


def test_toy_source_is_causal(spark):
    src = ToySource(8)
    a, b = src.run(["x", "y"], [0])[0], src.run(["x", "y", "z"], [0])[0]
    assert np.allclose(a, b[:2])
    docs = spark.createDataFrame([(1, "x y z"), (2, " "), (3, None)], "doc_id bigint, text string")
    got = capture(tokens.tokenize(docs), src, [0, 1])
    assert got.count() == 6
    with pytest.raises(ValueError):
        check_site(src, "mlp_out")


class Whole:
    """A source that takes whole documents only."""

    width, sites = 4, ("residual",)

    def run(self, tokens, layers):
        return {layer: np.full((len(tokens), 4), float(len(tokens) + layer)) for layer in layers}


class Pieces(ToySource):
    """A source that must be given pieces."""

    def run(self, tokens, layers):
        raise AssertionError("a whole document was gathered")


def test_capture_streams_documents(spark):
    """Documents over many batches, one without id, and pieces smaller than a batch: the vectors are those of whole runs."""
    docs = spark.createDataFrame([(1, " ".join(f"a{k % 31}" for k in range(500))), (2, "x"), (None, "y z"), (3, " ".join(f"b{k}" for k in range(90)))], "doc_id bigint, text string")
    rows = tokens.tokenize(docs)
    spark.sparkContext.addPyFile(__file__)  # for the sources
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64")
    try:
        wide = 2**16  # so that a piece is at most 8 tokens
        assert [r["n"] for r in capture(rows, Pieces(wide), [0, 3]).where("doc_id = 3").groupBy("layer").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("w")).collect()] == [90, 90]
        got = capture(rows, Pieces(8), [0, 3]).collect()
        whole = capture(rows, Whole(), [0, 3], context=None).collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(whole) == 2 * (500 + 1 + 2 + 90)
    for d, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        want = ToySource(8).run(text.split(), [0, 3])
        for layer in (0, 3):
            mine = sorted((r["pos"], r["token"], r["vec"]) for r in got if r["doc_id"] == d and r["layer"] == layer)
            assert [t for _, t, _ in mine] == text.split() and np.array_equal([v for *_, v in mine], want[layer])
            assert {tuple(r["vec"]) for r in whole if r["doc_id"] == d and r["layer"] == layer} == {(float(len(text.split()) + layer),) * 4}
    assert capture(rows, Whole(), [0], context=3).count() == 3 + 1 + 2 + 3


def test_token_vectors_are_numpys_draws():
    """One generator set anew for each token gives what a generator of its own gives, remembered or not."""
    words = ["", "a", "é漢"] + [f"w{k}" for k in range(300)]
    for width in (3, 16):
        want = []
        for w in words:
            v = np.random.default_rng(int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")).standard_normal(width)
            want.append(v / np.linalg.norm(v))
        src = ToySource(width)
        assert np.array_equal(src.token_vectors(words), want) and np.array_equal(src.token_vector("a"), want[1])
        for take in (slice(0, 100), slice(50, None), slice(0, None)):
            assert np.array_equal(src._vectors(words[take] * 2), want[take] * 2)
    one, two = {0: [], 2: []}, None
    for k in range(0, len(words), 7):
        got, two = src.resume(words[k : k + 7], [0, 2], two)
        for layer in one:
            one[layer].extend(got[layer])
    whole = src.run(words, [0, 2])
    assert all(np.array_equal(one[layer], whole[layer]) for layer in one)


def test_toy_capture_takes_late_turns_and_long_ones(spark, tmp_path):
    """Turns from 10000 on were cut, though whole chats are asked for."""
    from brindle.registry import all_entries

    rows = [(1, 0, "system", "a b"), (1, 20_000, "user", "c d e"), (1, 2**31, "user", "f"), (2, 1, "user", None), (None, 3, "user", "g"), (3, 0, "user", " ")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = all_entries()["x01_toy_capture"][0](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 12, 16), (None, 2, 16)]


def test_streaming_topk_and_moments(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2, k, float(k) * (-1) ** k) for k in range(20)], "component bigint, row_id bigint, score double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = live.drain(live.streaming_topk(stream, "component", "row_id", "score", 3), "topk", "update")
    last = {(r["component"], r["rank"]): r["row_id"] for r in got.collect()}
    assert last[(0, 1)] == 18 and last[(1, 1)] == 19
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    m = live.drain(live.running_moments(stream, "component", "score"), "moments", "complete")
    want = {r["component"]: r["mean"] for r in live.running_moments(rows, "component", "score").collect()}
    assert {r["component"]: r["mean"] for r in m.collect()} == pytest.approx(want)


def test_decodable_span():
    pieces = ["é".encode()[:1], "é".encode()[1:], b"a"]
    assert tokens.decodable_span(pieces, 0) == (0, 2) and tokens.decodable_span(pieces, 2) == (2, 3)
    assert tokens.decodable_span([b"\xff"], 0) is None


def test_bootstrap(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("v"))
    r = statistics.bootstrap_mean(df, "v", 300).first()
    assert r["low"] < 99.5 < r["high"] and r["high"] - r["low"] < 40
