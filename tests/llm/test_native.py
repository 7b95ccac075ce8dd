"""Mixing, rules and sharding: against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import make, prose

from brindle.llm import mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights, share=1.5, cap=2.0):
    """Shares the excess again until no source is above its cap."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] > cap * sizes[k]}
        if not over:
            for k in open_:
                out[k] = level * weights[k]
            break
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        open_ -= over
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 300)), "en", rng.choice(["a", "a", "a", "b", "ä", None])) for i in range(300)]
    return rows, make(spark, rows).repartition(4).cache()


def test_mix(corpus, empty, odd):
    rows, docs = corpus
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    size = {i: len(WORD.findall(t)) for i, t, _, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(size[i] for i, _, _, s in rows if s == n) for n in names]
    want = dict(zip(names, water_fill(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])))
    for i, _, _, s in rows:
        assert got[i]["size"] == size[i] and got[i]["target"] == pytest.approx(want[s], abs=1e-5)
        assert 0 <= got[i]["taken"] <= 2 * size[i]
    for n in names:
        assert sum(got[i]["taken"] for i, _, _, s in rows if s == n) == round(want[n])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(odd).count() == odd.count()


def test_mixed_documents(corpus, empty, odd):
    rows, docs = corpus
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = Counter()
    text = {i: t for i, t, _, _ in rows}
    for r in out.collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert text[r["doc_id"]].startswith(r["text"])
    assert taken == Counter({i: n for i, n in plan.items() if n})
    assert mixing.mixed_documents(empty).count() == 0
    mixing.mixed_documents(odd).count()


def test_higher_quality_is_drawn_earlier(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 50) if i % 2 else "### $$$ " * 25, "en", s) for i in range(400) for s in ["a"]]
    got = mixing.mix_sources(make(spark, rows), share=0.5, weights=(1,)).collect()
    good = sum(r["taken"] > 0 for r in got if r["doc_id"] % 2)
    assert good > 1.5 * sum(r["taken"] > 0 for r in got if not r["doc_id"] % 2)


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_rules(spark, odd, empty):
    rng = random.Random(3)
    texts = ["a b c a b c a", "a a a a", "l\nl\n \n\nl x\nl", "# $ | <>&", "x", prose(rng, 400), (prose(rng, 30) + "\n") * 8, None, "a b\x85c d"]
    docs = make(spark, [(i, t, "en" if i % 2 else None, "a") for i, t in enumerate(texts)]).unionByName(odd)
    got = quality_rules.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None or r["doc_id"] >= len(texts) or odd.where(f"doc_id = {r['doc_id']}").count():
            continue
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(texts[r["doc_id"]])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty).count() == 0


def test_divergence_rejects_markup(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 200), "en", "a") for i in range(60)] + [(99, " ".join(f"{w.upper()}!!" for w in prose(rng, 200).split()), "en", "a")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(make(spark, rows)).collect()}
    assert not got.pop(99) and all(got.values())


def test_shards(corpus, odd, empty):
    rows, docs = corpus
    for table in (docs, odd):
        got = sharding.shard_documents(table).collect()
        assert len(got) == table.count()
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
            assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    got = {r["doc_id"]: r for r in sharding.shard_documents(docs).collect()}
    loads = Counter()
    for i, t, _, _ in rows:
        assert got[i]["size"] == len(t.encode()) + 16 and got[i]["text_crc32"] == zlib.crc32(t.encode())
        loads[got[i]["shard"]] += got[i]["size"]
    slots = Counter()
    for r in got.values():
        slots[r["virtual_slot"]] += r["size"]
    assert max(loads.values()) <= sum(slots.values()) / 40 + max(slots.values())
    assert sharding.shard_documents(empty).count() == 0


def test_growing_moves_slots_to_the_new_shard_only(spark, corpus, tmp_path):
    """A map is stored, loaded, edited and used; rows in slots that were empty have a shard, too."""
    path = f"file://{tmp_path}/map"
    part = corpus[1].where("doc_id % 9 = 0")
    slots = sharding.slot_bytes(sharding.slotted(part, 64))
    sharding.save_map(sharding.build_map(slots, 4, 64), path)
    old = sharding.load_map(spark, path)
    assert old.count() == 64 and {r["shard"] for r in old.collect()} == {0, 1, 2, 3}
    sharding.save_map(sharding.add_shard(sharding.slot_bytes(sharding.slotted(corpus[1], 64)), old, 4), path)
    new = sharding.load_map(spark, path)
    assert {r["version"] for r in new.collect()} == {2} and sharding.load_map(spark, path, 1).count() == 64
    a, b = ({r["doc_id"]: r for r in sharding.shard_documents(corpus[1], n_slots=64, slot_map=m).collect()} for m in (old, new))
    assert len(a) == len(b) == corpus[1].count()
    moved = [i for i in a if a[i]["shard"] != b[i]["shard"]]
    assert moved and all(b[i]["shard"] == 4 for i in moved) and {r["map_version"] for r in b.values()} == {2}


def test_groups_of_equal_texts_are_split(spark):
    got = sharding.shard_documents(make(spark, [(i, "the same text", "en", "a") for i in range(400)])).collect()
    loads = Counter(r["shard"] for r in got)
    assert len(loads) == 40 and max(loads.values()) <= 20


def test_mix_delivers_what_it_plans(spark):
    """Rows that repeat id and size share their takings without loss or gain."""
    rows = [(1, "a b c d e f g", "en", "x")] * 3 + [(2, "h i j", "en", "x")] * 2 + [(k, "word " * k, "en", "y") for k in range(3, 9)] + [(3, "other words here", "en", "y")]
    docs = make(spark, rows)
    for share in (0.3, 0.5, 0.9, 1.5):
        planned = mixing.mix_sources(docs, share=share).groupBy("doc_id").sum("taken").collect()
        mixed = Counter()
        for r in mixing.mixed_documents(docs, share=share).collect():
            mixed[r["doc_id"]] += len(r["text"].split())
        assert {i: n for i, n in planned if n} == dict(mixed)
