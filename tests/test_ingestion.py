import datetime as dt

import pytest
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.operators import validation, writes
from dyadflow.operators.dyads import completed_matches
from dyadflow.operators.keys import resolve_natural_keys
from dyadflow.operators.loading import canonical_rows
from dyadflow.sources import results_csv, tables

HEADER = ",".join(vocab.RESULT_COLUMNS)


def _csv(tmp_path, *lines, name="fixture.csv", header=HEADER):
    path = tmp_path / name
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(path)


def _load(spark, path):
    rows = results_csv.with_row_numbers(results_csv.read_results(spark, path))
    return validation.validate_results(rows)


def test_a_good_row_is_typed(spark, tmp_path):
    path = _csv(tmp_path, 'ev-25,"Event, 25",Core,2026-08-01,right,105 kg, Adam ,Nür,3,2,completed,video-1,')
    row = _load(spark, path).first()
    assert row["problems"] == [] and row["row_number"] == 2
    assert row["event_name"] == "Event, 25" and row["athlete_a"] == "Adam" and row["athlete_b"] == "Nür"
    assert row["scheduled_at"] == dt.datetime(2026, 8, 1) and row["score_a"] == 3
    assert row["batch_key"] == f"manual-results:file:{path}"


def test_all_problems_of_all_rows_are_reported(spark, tmp_path):
    path = _csv(
        tmp_path,
        "ev-25,East,Core,2026-08-01,wrong,105 kg,A,B,three,2,completed,,",
        "ev-26,East,Core,2026-08-02,right,,C,D,,,cancelled,,",
        "ev-27,East,Core,2026-13-02,right,1,C,D,-1,2,completed,,0",
    )
    got = {r["row_number"]: " ".join(r["problems"]) for r in _load(spark, path).collect()}
    assert "unrecognized arm wrong" in got[2] and "non-numeric score in score_a" in got[2]
    assert "missing weight_class" in got[3] and "unrecognized status cancelled" in got[3]
    assert "invalid event_date" in got[4] and "bout must be" in got[4] and "score_a" in got[4]


def test_scores_only_for_completed_matches(spark, tmp_path):
    path = _csv(tmp_path, "e,E,C,2026-08-01,right,1,A,B,3,,dq,,", "e,E,C,2026-08-01,right,1,A,C,3,3,completed,,")
    got = [r["problems"] for r in _load(spark, path).orderBy("row_number").collect()]
    assert got == [
        ["scores are allowed only for completed matches"],
        ["completed match requires unequal numeric scores"],
    ]


@pytest.mark.parametrize("bouts,ok", [(("", ""), False), (("1", "1"), False), (("1", ""), False), (("1", "2"), True)])
def test_same_day_rematches_need_distinct_bouts(spark, tmp_path, bouts, ok):
    path = _csv(
        tmp_path,
        f"e,E,C,2026-08-01,right,1,A,B,3,2,completed,,{bouts[0]}",
        f"e,E,C,2026-08-01,right,1,b,a,3,1,completed,,{bouts[1]}",
        "e,E,C,2026-08-01,left,1,A,B,3,1,completed,,7",
    )
    rows = _load(spark, path).orderBy("row_number").collect()
    assert [bool(r["problems"]) for r in rows] == [not ok, not ok, False]
    if ok:
        assert [r["scheduled_at"].minute for r in rows] == [1, 2, 0]


def test_equal_names_in_two_folders_are_two_files(spark, tmp_path):
    line = "e,E,C,2026-08-01,right,1,A,B,3,2,completed,,"
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        _csv(tmp_path / folder, line, line.replace("A,B", f"C,{folder}"))
    rows = _load(spark, f"{tmp_path}/*/*.csv").collect()
    assert sorted((r["batch_key"][-13:], r["row_number"]) for r in rows) == [
        ("x/fixture.csv", 2), ("x/fixture.csv", 3), ("y/fixture.csv", 2), ("y/fixture.csv", 3)
    ]
    # the same match in two files is no rematch within either
    assert all(r["problems"] == [] for r in rows)


def test_rows_of_one_file_in_several_parts(spark, tmp_path):
    lines = [f"e{i},E,C,2026-08-01,right,1,A,B,3,2,completed,," for i in range(4_000)]
    path = _csv(tmp_path, *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        read = results_csv.read_results(spark, path)
        assert read.select("file_block").distinct().count() > 5
        rows = results_csv.with_row_numbers(read).select("event_slug", "row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["event_slug"]: r["row_number"] for r in rows} == {f"e{i}": i + 2 for i in range(4_000)}


def test_whole_file_mode_rejects_the_file(spark, tmp_path):
    good = "e,E,C,2026-08-01,right,1,A,B,3,2,completed,,"
    _csv(tmp_path, good, name="a.csv")
    _csv(tmp_path, good.replace("A,B", "C,D"), good.replace("right", "up"), name="b.csv")
    checked = _load(spark, str(tmp_path))
    assert validation.accepted(checked).count() == 2
    kept = validation.accepted_files(checked, "batch_key").collect()
    assert [r["batch_key"] for r in kept] == [f"manual-results:file:{tmp_path}/a.csv"]
    counts = validation.outcome_counts(checked).first()
    assert (counts["selected"], counts["completed"], counts["failed"]) == (3, 2, 1)


def test_a_foreign_header_is_refused(spark, tmp_path):
    path = _csv(tmp_path, "1,2", name="x.csv", header="event_slug,event_name")
    with pytest.raises(ValueError, match="header"):
        results_csv.check_header(spark, path)
    results_csv.check_header(spark, _csv(tmp_path, name="y.csv"))


def _subs(spark, rows):
    return spark.createDataFrame(
        [(b, dt.datetime(2026, 1, 1, m), s) for b, m, s in rows], "base_key string, scheduled_at timestamp, seq long"
    )


def test_rematches_get_numbers_and_replays_keep_keys(spark):
    none = spark.createDataFrame([], "natural_key string, base_key string, scheduled_at timestamp")
    subs = _subs(spark, [("e:a:b:left", 3, 1), ("e:a:b:left", 2, 2), ("e:a:b:left", 3, 3), ("e:a:c:left", 1, 4)])
    for limit in (None, 1):
        got = resolve_natural_keys(subs, none, limit)
        keys = {r["seq"]: r["natural_key"] for r in got.collect()}
        assert keys == {1: "e:a:b:left", 3: "e:a:b:left", 2: "e:a:b:left:2", 4: "e:a:c:left"}
    stored = got.select("natural_key", "base_key", "scheduled_at").distinct()
    again = resolve_natural_keys(subs, stored)
    assert {r["seq"]: r["natural_key"] for r in again.collect()} == keys
    more = resolve_natural_keys(_subs(spark, [("e:a:b:left", 9, 7)]), stored)
    assert more.first()["natural_key"] == "e:a:b:left:3"


def test_replaying_a_file_leaves_every_table_as_it_was(spark, tmp_path):
    path = _csv(
        tmp_path,
        "e,E,C,2026-08-01,right,1,Bo,Al,3,2,completed,v1,1",
        "e,E,C,2026-08-01,right,1,Al,Bo,3,1,completed,,2",
        "e,E,C,2026-08-01,left,1,Al,Cy,,,no_contest,,",
    )
    names = {"events": ["slug"], "athletes": ["canonical_name"], "matches": ["natural_key"],
             "competitors": ["match_id", "athlete_id"], "videos": ["match_id", "video_id"]}
    stored = {n: writes.KeyedTable(spark, str(tmp_path / n), keys, buckets=4) for n, keys in names.items()}
    empty = spark.createDataFrame([], "natural_key string, base_key string, scheduled_at timestamp")

    def load(existing):
        rows = validation.accepted(_load(spark, path)).withColumn("seq", F.col("row_number"))
        new = canonical_rows(rows, existing)
        for name in names:
            frame = getattr(new, name)
            if "seq" in frame.columns:
                stored[name].upsert(frame, "seq")
            else:
                stored[name].insert_ignore(frame)
        return {n: sorted(map(str, t.read().collect())) for n, t in stored.items()}

    first = load(empty)
    again = load(stored["matches"].read().select("natural_key", "base_key", "scheduled_at"))
    assert first == again
    assert [len(first[n]) for n in names] == [1, 3, 3, 6, 1]
    keys = {r["natural_key"] for r in stored["matches"].read().collect()}
    assert keys == {"e:al:bo:right", "e:al:bo:right:2", "e:al:cy:left"}
    view = completed_matches(stored["matches"].read(), stored["competitors"].read())
    assert view.count() == 2 and view.where("athlete_a_id >= athlete_b_id").isEmpty()


def test_upsert_is_last_write_wins_and_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "id long, v string, seq long")
    once = writes.upsert(base, updates, ["id"], "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(writes.upsert(once, updates, ["id"], "seq").collect()) == sorted(once.collect())


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    kept = writes.KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets=8)
    with pytest.raises(FileNotFoundError):
        kept.read()
    kept.upsert(spark.range(100).selectExpr("id", "'a' AS v", "1L AS seq"), "seq")
    before = set(kept.read().inputFiles())
    kept.upsert(spark.createDataFrame([(7, "x", 2), (7, "y", 3)], "id long, v string, seq long"), "seq")
    folder = lambda files: {f.rsplit("/", 2)[1] for f in files}
    after = set(kept.read().inputFiles())
    assert len(folder(before ^ after)) == 1 and folder(before) == folder(after)
    assert kept.read().count() == 100 and kept.read().where("id = 7").first()["v"] == "y"
    kept.insert_ignore(spark.createDataFrame([(7, "z"), (200, "n"), (200, "m")], "id long, v string"))
    assert kept.read().count() == 101 and kept.read().where("id = 7").first()["v"] == "y"


def test_ties_are_settled_by_content(spark):
    rows = [(1, v, 1) for v in "abcdef"]
    one = writes.latest(spark.createDataFrame(rows, "id long, v string, seq long"), ["id"], "seq").first()
    two = writes.latest(spark.createDataFrame(rows[::-1], "id long, v string, seq long").repartition(3), ["id"], "seq").first()
    assert one == two


def test_failed_extractions_are_kept_completed_ones_replaced(spark):
    base = spark.createDataFrame([(1, "completed", "old"), (1, "failed", "f0")], "k long, status string, p string")
    updates = spark.createDataFrame([(1, "completed", "new", 1), (1, "failed", "f1", 2)], "k long, status string, p string, seq long")
    got = writes.upsert_extractions(base, updates, ["k"], "seq")
    assert sorted(map(tuple, got.collect())) == [(1, "completed", "new"), (1, "failed", "f0"), (1, "failed", "f1")]


def test_a_claim_without_time_has_one_key(spark):
    rows = spark.createDataFrame([(1, None, "t", 1), (1, None, "t", 2)], "source_id long, timestamp_seconds int, claim_text string, seq long")
    assert writes.latest(writes.claim_keys(rows), tables.KEYS["claims"], "seq").count() == 1


def test_a_match_without_exactly_two_sides_is_left_out(spark):
    when = dt.datetime(2026, 1, 1)
    m = spark.createDataFrame(
        [(i, 1, when.date(), when, "left", "w", s) for i, s in ((1, "completed"), (2, "completed"), (3, "completed"), (4, "dq"))],
        "match_id long, event_id long, held_on date, scheduled_at timestamp, arm string, weight_class string, status string",
    )
    c = spark.createDataFrame(
        [(1, 9, "loss"), (1, 4, "win"), (2, 4, "win"), (3, 1, "win"), (3, 2, "loss"), (3, 5, "loss"), (4, 1, None), (4, 2, None)],
        "match_id long, athlete_id long, result string",
    )
    got = completed_matches(m, c).collect()
    assert [(r["match_id"], r["athlete_a_id"], r["athlete_b_id"], r["result_a"]) for r in got] == [(1, 4, 9, "win")]


def test_evidence_claims_must_fit_their_extraction(spark):
    when = dt.datetime(2026, 1, 1)
    subs = spark.createDataFrame([("b", vocab.EVIDENCE_SCHEMA_VERSION, "m")], "batch_key string, schema_version string, match_natural_key string")
    src = spark.createDataFrame([("b", "s1", "t", "1", "u"), ("b", "s2", "t", "2", "u")], "batch_key string, key string, source_type string, external_id string, url string")
    ext = spark.createDataFrame(
        [("b", "x1", "s1", "p", "m", "v", when, "completed", None), ("b", "x2", "s1", "p", "m", "v", when, "failed", "e")],
        "batch_key string, key string, source_key string, provider string, model string, prompt_version string, extracted_at timestamp, status string, error_message string",
    )
    claim = lambda s, x: ("b", s, "text", when, ["A"], x)
    schema = "batch_key string, source_key string, text string, extracted_at timestamp, subject_names array<string>, extraction_key string"
    check = lambda *c: [r["problem"] for r in validation.evidence_problems(subs, src, ext, spark.createDataFrame(list(c), schema)).collect()]
    assert check(claim("s1", "x1"), claim("s2", "")) == []
    wrong = "claim extraction must be completed and reference the same source"
    assert check(claim("s2", "x1")) == [wrong]
    assert check(claim("s1", "x2")) == [wrong]
    assert check(claim("s1", "x9")) == ["claim references unknown extraction: x9"]


def test_contract_rules_come_from_the_schema(spark):
    contract = tables.schema("claim_annotations")
    rows = spark.createDataFrame(
        [(1, "m", "v", "form", ["hook"], None, "left", "unclear", "observed"),
         (2, "m", None, "rumour", ["magic"], None, "up", "unclear", "observed")],
        "claim_id long, model string, prompt_version string, claim_type string, concepts array<string>, subject_athlete_id long, arm string, temporality string, certainty string",
    )
    got = {r["claim_id"]: r["problems"] for r in validation.contract_problems(rows, contract).collect()}
    assert got[1] == []
    assert got[2] == ["missing prompt_version", "unrecognized arm", "unrecognized claim_type", "unrecognized concepts"]


def test_empty_extractions_need_a_limitation(spark):
    rows = spark.createDataFrame(
        [(vocab.EXTRACTION_SCHEMA_VERSION, [], ["no sound"]), (vocab.EXTRACTION_SCHEMA_VERSION, [], []), ("v9", ["c"], [])],
        "schema_version string, claims array<string>, limitations array<string>",
    )
    got = [r["problems"] for r in validation.empty_extraction_problems(rows).collect()]
    assert got == [[], ["zero claims require a limitation"], ["unsupported extraction schema version"]]
