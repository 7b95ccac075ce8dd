import hashlib
import random
import re

from conftest_llm import make

from brindle.llm import pii

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if k == 1:
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif k == 2:
                total = sum(sum(divmod(int(c) * 2, 10)) if j % 2 else int(c) for j, c in enumerate(digits[::-1]))
                ok = 16 <= len(digits) <= 19 and total % 10 == 0
            elif k == 3:
                ok = 8 <= len(digits) <= 15
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_against_the_rules():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@-+ 5()%\n2é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute(t), t


def test_linear_on_long_runs():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_spans(t)


def test_documents(spark, odd, empty):
    assert pii.find_personal_data(empty).count() == 0
    got = pii.find_personal_data(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" and r["n_email"] == 0 for r in got)
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_bootstrapped_context_finds_more(spark):
    seeds = [d for k in range(400) if pii.luhn(d := str(4000123412340000 + 7 * k))][:10]
    rows = [(k, f"please use card number {s} for the order", "en", "a") for k, s in enumerate(seeds)]
    rows += [(50, "please use card number 4111-1111-1111-1112 for the order", "en", "a"), (51, "version 20.15.33 of the order", "en", "a")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(make(spark, rows)).collect()}
    assert got[50]["n_card"] == 0 and got[50]["n_added"] == 1 and got[50]["spans"] == "card:23:42"
    assert got[51]["n_added"] == 0
    for k in range(len(seeds)):
        assert got[k]["n_card"] == 1 and got[k]["spans"] == "card:23:39" and got[k]["n_added"] == 0


def test_repeated_rows_repeat(spark):
    rows = [(1, "mail a@b.cd now", "en", "a")] * 3
    got = pii.find_personal_data(make(spark, rows)).collect()
    assert [r["spans"] for r in got] == ["email:5:11"] * 3
