"""The trie against nodes counted prefix by prefix."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dyadflow.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, sha), (role, text)))
    plain = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    whole = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        origin = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(plain.get(origin, [])[:h] + turns[h:])
        for depth in range(len(whole[c]) + 1):
            members[whole[c][:depth]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves = sum(sums[c][0] for c in children[path]) or 1
        saved = (len(members[path]) - 1) * words + sum(sums[c][1] for c in children[path])
        sums[path] = leaves, saved
        ending = ",".join(str(c) for c in sorted(members[path]) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((
            min(members[path]), len(path), parent, len(members[path]), len(children[path]), leaves, saved,
            hashlib.sha256(ending.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, frame.select(*names).collect()), key=str)


def made(seed, conversations, alphabet, longest, start=0):
    draw = random.Random(seed)
    rows = []
    for c in range(start, start + conversations):
        if draw.random() < 0.15:
            continue
        shared = draw.random() < 0.4
        for turn in range(draw.randrange(1, longest)):
            text = f"w {turn}" if shared else " ".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 3)))
            rows.append((c, turn, draw.choice(["user", "user", None]) if not shared else "user", text))
    draw.shuffle(rows)
    return rows


ODD = [
    (None, 1, "user", "nobody"), (-3, None, None, None), (-3, 2, "user", ""), (-3, None, "user", "x\ty"), (-20, 0, "user", "base"),
    (-25, 0, "us", "era"), (-25, 1, "use", "ra"), (-25, 1, "use", "ra"), (61, 5, "user", "word " * 20_000), (63, 0, "user", "é漢"),
]


@pytest.mark.parametrize("span,limit", [(1_024, 1 << 16), (2, 3), (1, 2), (3, 40), (100, 5)])
def test_nodes_are_those_of_a_plain_count(spark, span, limit):
    rows = made(1, 120, "ab", 9) + ODD + [(c, t, "user", f"long {t}") for c in (200, 201, 202, 203) for t in range(12 + c % 3)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS id", "2 AS head", "3 AS words")
    assert found(trie.nodes(table, span, limit)) == brute(rows)


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 7)
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(150) for t in range(4)] + made(2, 40, "abc", 5, 5_000)
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(trie.nodes(table, 3, 4)) == brute(rows)


def test_long_shared_stem_is_one_round(spark):
    """Conversations that part after 60 equal turns burst below one path."""
    rows = [(20 * c, t, "user", f"turn {t}" if t < 60 else f"{c} {t}") for c in range(12) for t in range(64)]
    rows += [(20 * 12, t, "user", f"turn {t}") for t in range(60)]
    assert found(trie.nodes(spark.createDataFrame(rows, SCHEMA), 1_024, 100)) == brute(rows)


def test_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert trie.report(nothing).count() == 0
    assert trie.report(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_report_columns(spark):
    got = trie.report(spark.createDataFrame([(7, 0, "user", "a b")], SCHEMA))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    assert got.agg(F.max("n_convs")).first()[0] == 1
