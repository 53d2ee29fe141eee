"""Term counts and divergences against a plain count in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from dyadflow.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["a", "The", "word", "eightlet", "ninelette", "sixteenlettersxx", "seventeenletterss", "É" * 4, "漢字漢字漢字", "é" * 30, "z" * 300, "aa", "a\x7fb", "Ünder"]


def found(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute(rows, least=10, top=10):
    """``rows`` of (text, lang, source)."""
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    out = []
    for lang in {r[1] for r in rows}:
        held, counts = Counter(), defaultdict(Counter)
        for text, own, source in rows:
            if own == lang:
                terms = found(text)
                held.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, n in held.items() if n >= least]
        total = Counter()
        for c in counts.values():
            total.update(c)

        def p(c, v=len(kept), kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        own, whole = {s: p(c) for s, c in counts.items()}, p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(own[s][t], whole[t]), t) for t in kept if counts[s][t] and own[s][t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def made(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = [draw.choice(WORDS) for _ in range(draw.randrange(30))]
        rows.append((draw.choice([" ", ", ", "9"]).join(words) if i % 17 else None, draw.choice(["en", "de", None]), f"s{draw.randrange(9)}" if i % 5 else "s0"))
    rows += [("", "xx", "a"), (None, "xx", None), ("the the", "yy", None)] + [("Repeated row", "zz", "a")] * 12
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").selectExpr(
        "*", "1 AS doc_id", "'x' AS term", "2L AS n", "'y' AS part"
    )


def results(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_runs_of_a_batch():
    draw = random.Random(2)
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(200))) for _ in range(50)] + ["", "é", "x" * 50_000]
    groups = [draw.randrange(4) for _ in texts]
    n, documents = Counter(), Counter()
    for text, group in zip(texts, groups, strict=True):
        terms = found(text)
        n.update((t, group) for t in terms)
        documents.update((t, group) for t in set(terms))
    got = list(divergence.term_runs([t.encode() for t in texts], groups))
    assert len({g[:2] for g in got}) == len(got)
    assert {(t.decode(), g): (c, d) for t, g, c, d in got} == {k: (n[k], documents[k]) for k in n}
    assert list(divergence.term_runs([b"", b" 1"], [0, 0])) == []


@pytest.mark.parametrize("batch_bytes,block_rows", [(1 << 22, 1 << 16), (100, 3)])
def test_report_equals_a_plain_count(spark, monkeypatch, batch_bytes, block_rows):
    monkeypatch.setattr(divergence, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block_rows)
    rows = made(400)
    got = results(divergence.report(table(spark, rows)))
    assert got == brute(rows)
    assert {r[:4] for r in got if r[0] == "xx"} == {("xx", "a", "pair", ""), ("xx", "", "pair", "a")}


def test_other_limits(spark):
    rows = made(150, seed=3)
    assert results(divergence.report(table(spark, rows), least_documents=2, top_terms=3)) == brute(rows, 2, 3)


def test_nothing(spark):
    assert divergence.report(table(spark, made(1)).limit(0)).count() == 0


def test_long_division_is_exact(spark):
    cases = [(0, 3), (10**15, 8 * 10**15), (7, 9), (123_456_789_012, 999_999_999_999), (10**12 - 2, 10**12)]
    frame = spark.createDataFrame(cases, "n long, m long").select("n", "m", divergence._probability("n", "m").alias("p"))
    for row in frame.collect():
        assert row["p"] == 1 + 10**9 * (row["n"] + 2) // row["m"]
