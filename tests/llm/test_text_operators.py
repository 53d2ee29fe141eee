"""Personal data, secrets, mixing and language ID against brute force on odd and ordinary rows."""

import hashlib
import random
import re
import string
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dyadflow.llm import language, mixing, pii, secrets

SF = "/root/testdata/sf0.001"
ODD = [
    (-1, None), (-2, ""), (-3, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4 +1 (23) 456-7890"),
    (-4, "é DE89 3704 0044 0532 0130 00 iban ssn: 123-45-6789 call (555) 123-4567 AKIA12345"),
    (-5, "9" * 3000 + " " + "a" * 3000 + " " + "1 " * 2000),
    (-6, "4111-1111-1111-1111-12 --4111111111111111 +49 30 1234567890 a.b@c-d.e.f..g@h.i@j.k 1.1.1.1.1"),
    (-7, "Token == 'abcdefghijkl' PASSWORD: \"x\" api_key=ABCDEFGHIJKLMNOP AKIAABCDEFGHIJKLMN0 deadbeefdeadbeef1"),
    (-8, "token=éabc secret:= aaaaaaaaaaaaaaaaaaaa ghp_a8Kd92LsQz71mXc0pRt5 some_long_identifier_name_v2_final"),
    (-8, "token=éabc secret:= aaaaaaaaaaaaaaaaaaaa ghp_a8Kd92LsQz71mXc0pRt5 some_long_identifier_name_v2_final"),
]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd)


def luhn(hit):
    digits = [int(c) for c in hit if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def matches(text, rules):
    out = []
    for rank, (kind, pattern, test) in enumerate(rules):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if test(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def count(m):
    return sum(c.isdigit() for c in m.group())


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) < 256 for p in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= count(m) <= 19 and luhn(m.group())),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= count(m) <= 15),
]
ASSIGN = r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = [
    ("assign", ASSIGN, lambda m: len(m.group(2)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
]


def held_against(rows, texts, rules):
    for row in rows:
        base = matches(texts[row["doc_id"]], rules)
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), row
        assert set(filter(None, base.split(","))) <= set(row["spans"].split(","))
        for kind, _, _ in rules:
            assert row[f"n_{kind}"] == base.count(f"{kind}:")


def test_personal_data(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.report(docs).collect()
    assert len(rows) == docs.count()
    held_against(rows, texts, PII)
    added = next(r.spans for r in rows if r.doc_id == -4)
    assert added == "iban:2:29,ssn:40:51,local_phone:57:71"


def test_redaction_keeps_everything_else(docs):
    rows = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert rows[-1] is None and rows[-2] == ""
    assert rows[-4] == "é <IBAN> iban ssn: <SSN> call <LOCAL_PHONE> AKIA12345"
    assert rows[-6] == "4111-1111-1111-1111-12 --<CARD> <PHONE> <EMAIL><EMAIL>@j.k <IP>.1"
    assert pii.redact(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,found",
    [
        ("IBAN DE89370400440532013000 Bitte zahlen", ["DE89370400440532013000"]),
        ("to GB82 WEST 1234 5698 7654 32 BIC ABCD", ["GB82 WEST 1234 5698 7654 32"]),
        ("DE89 3704 0044 0532 0130 00 2024-01-02", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000EUR", ["DE89370400440532013000"]),
        ("DE89370400440532013000 GB82WEST12345698765432", ["DE89370400440532013000", "GB82WEST12345698765432"]),
        ("REF AB12 34567890123 DE89370400440532013000", ["DE89370400440532013000"]),
        ("MT84MALT011000012345MTLCAST001S IBAN", ["MT84MALT011000012345MTLCAST001S"]),
        ("DE89370400440532013001 Bitte zahlen", []),
    ],
)
def test_account_numbers_before_capitals_and_digits(spark, text, found):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [s for s in pii.find_pii(df).head().pii if s.kind == "iban"]
    assert [text[s.start : s.end] for s in spans] == found
    if found:
        assert pii.redact(df).head().text.count("<IBAN>") == len(found)


def test_very_many_spans_in_one_text(spark):
    """200,000 addresses in one text, found and redacted in time that grows with the text, not its square."""
    parts = [f"u{i}@x.de 10.0.{i % 256}.7 " for i in range(100_000)]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    row = pii.report(df).head()
    assert (row.n_email, row.n_ip) == (100_000, 100_000)
    held_against([row], {1: text}, PII)
    assert time.monotonic() - start < 120
    short = spark.createDataFrame([(1, "".join(parts[:10_000]))], "doc_id long, text string")
    assert pii.redact(short).head().text == "<EMAIL> <IP> " * 10_000


def test_very_many_secrets_in_one_text(spark, docs):
    model = secrets.train(secrets.labelled_tokens(docs))
    draw = random.Random(4)
    letters = string.ascii_letters + string.digits
    tokens = ["".join(draw.choice(letters) for _ in range(24)) for _ in range(40_000)]
    text = " ".join(f"token={t}" if i % 2 else f"{t} {'0123456789abcdef' * 2}" for i, t in enumerate(tokens))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    row = secrets.report(df, model).head()
    assert time.monotonic() - start < 120
    held_against([row], {1: text}, SECRETS)
    assert (row.n_assign, row.n_hex) == (20_000, 20_000)
    assert row.spans.count("random") > 19_000
    base = [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if not s.startswith("random")]
    ends = {b for _, b in base}
    starts = {a for a, _ in base}
    for span in row.spans.split(","):
        kind, a, b = span.split(":")
        if kind == "random":  # none lies in a base span
            assert not {int(a), int(b)} & (starts | ends)


def test_checksums(spark):
    one = spark.range(1)
    assert one.select(pii.mod97(F.lit("GB82 WEST 1234 5698 7654 32"))).first()[0]
    assert not one.select(pii.mod97(F.lit("GB82 WEST 1234 5698 7654 33"))).first()[0]


def test_secrets(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = secrets.train(secrets.labelled_tokens(docs))
    rows = secrets.report(docs, model).collect()
    held_against(rows, texts, SECRETS)
    spans = next(r.spans for r in rows if r.doc_id == -8)
    assert "random:41:65" in spans and spans.count("random") == 1
    empty = secrets.train(secrets.labelled_tokens(docs.limit(0)))
    assert set(empty) == {0.0}


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 40)), f"s{i % 4}" if i % 9 else None) for i in range(600)]
    rows += [(1000 + i, " ".join(["w"] * 30), "hot") for i in range(400)] + [(None, None, "hot"), (5, "", "empty")]
    rows += [(7, "a b", "s0")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, order = defaultdict(int), {}
    for _, text, source in rows:
        size[source] += len((text or "").split())
    for n, source in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        order[source] = (3, 1, 2)[n % 3]
    target, free, left = {}, dict(order), 1.5 * sum(size.values())
    while True:
        above = [s for s in free if left * free[s] / sum(free.values()) > 2 * size[s]]
        if not above:
            break
        for s in above:
            target[s] = 2.0 * size[s]
        free = {s: w for s, w in free.items() if s not in above}
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    got = mixing.mix(df).collect()
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    for source in size:
        assert abs(taken[source] - target[source]) <= 80
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["copies"])
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(again, key=key)]
    emitted = mixing.mixed(df.withColumn("copies", F.lit("x")).withColumn("size", F.lit(None)))
    assert emitted.columns == ["doc_id", "text", "source", "copies", "size"]
    assert emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_language_learns_from_windows_of_whole_texts(spark):
    """Windows lie anywhere in a text, copies come once, and a prediction is the smallest sum of blocks."""
    texts = [("x" * 5_000 + f" {i} " + "".join(chr(97 + (i * 7 + j) % 26) for j in range(5_000)), "aa") for i in range(30)]
    texts += [("der die das und nicht " * 40, "de")] * 60 + [("the of and to in that " * 40, "en")] * 20
    rows = spark.createDataFrame(texts, "text string, lang string")
    model = language.dictionaries(rows)
    assert [name for name, _ in model] == ["de", "aa", "en"]
    sizes = {name: len(content) for name, content in model}
    assert all(language.WINDOW - 30 < sizes[name] <= language.WINDOW for name in ("de", "en"))  # one window of a text that is there 60 times
    own = dict(model)["aa"]
    assert any(part.strip(b"x ") for part in own.split(b" ")) and len(own) <= 30 * (language.WINDOW + 1)
    assert max(len(set(w)) for w in own.split(b" ")) > 20  # beyond the first characters
    names, compressors = [n for n, _ in model], language._compressors(model)
    for text in ("das und die der nicht", "that and the of to in", "xxxx xxxxxx xxxxxxxxx"):
        plain = language.folded(text)
        totals = [sum(len(c.compress(plain[a : a + language.BLOCK])) for a in range(0, len(plain), language.BLOCK)) for c in compressors]
        assert language.judge(text, names, compressors)[0] == names[totals.index(min(totals))]


def test_language(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.report(whole).join(whole.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame(
        [(None, None, "en"), (1, "", "de"), (2, "12 !!", None), (3, "the of and", None)],
        "doc_id long, text string, lang string",
    )
    out = {r.doc_id: r for r in language.report(whole.select("doc_id", "text", "lang").union(odd)).collect()}
    assert [out[k].lang_pred for k in (None, 1, 2)] == ["und"] * 3
    kept = language.recognised(odd.withColumn("score", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 0
    assert language.report(odd.limit(0)).count() == 0
