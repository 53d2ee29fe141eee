import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from dyadflow.functions import recency, text
from dyadflow.operators import claims as cl
from dyadflow.operators import discovery as ds
from dyadflow.operators import evidence as ev
from dyadflow.operators import mechanisms as mech
from dyadflow.sources import artifacts
from tests.helpers import match, matches, random_matches

START = dt.datetime(2026, 1, 1)


def _claims(spark, rows):
    """rows: claim_id, day of publication or None, claim type, subjects"""
    claims = spark.createDataFrame(
        [(i, None if d is None else START + dt.timedelta(days=d), t) for i, d, t, _ in rows],
        "claim_id long, published_at timestamp, claim_type string",
    )
    subjects = spark.createDataFrame(
        [(i, a) for i, _, _, who in rows for a in who], "claim_id long, athlete_id long"
    )
    return claims, subjects


def _encode(spark, match_rows, claim_rows, **kw):
    claims, subjects = _claims(spark, claim_rows)
    return {r["match_id"]: r for r in ev.encode(matches(spark, match_rows), claims, subjects, **kw).collect()}


def test_publication_must_be_strictly_earlier_and_known(spark):
    got = _encode(
        spark, [match(1, 100, 1, 2)],
        [(1, 99, "form", [1]), (2, 100, "form", [1]), (3, None, "form", [2]), (4, 50, "form", [7]), (5, 98, "form", [1, 2])],
    )[1]
    assert (got["evidence_count"], got["too_late_count"], got["unknown_time_count"]) == (2, 1, 1)


@pytest.mark.parametrize("days,flag", [(10, True), (30, True), (30.9, True), (31, False), (45, False)])
def test_recent_injury_counts_whole_days(spark, days, flag):
    got = _encode(spark, [match(1, 100, 1, 2)], [(1, 100 - days, "injury", [2])])[1]
    assert got["recent_injury_flag"] is flag and got["technique_advantage_flag"] is False


def test_technique_flag(spark):
    got = _encode(spark, [match(1, 100, 1, 2)], [(1, 10, "opponent_comparison", [2])])[1]
    assert got["technique_advantage_flag"] is True


@pytest.mark.parametrize("limit", [None, 30])
def test_encoding_matches_the_listed_claims(spark, limit):
    rng = random.Random(6)
    ms = random_matches(rng, 60, hot=0.5)
    rows = []
    for i in range(150):
        who = sorted(rng.sample(range(12), 2)) if rng.random() < 0.4 else [rng.choice([0, 0, rng.randrange(12)])]
        rows.append((i, rng.choice([None, rng.randrange(25), rng.randrange(25)]), rng.choice(["injury", "tactic", "form"]), who))
    claims, subjects = _claims(spark, rows)
    df = matches(spark, ms)
    listed = ev.describe_claims(df, claims, subjects).groupBy("match_id").agg(
        F.count_if("eligible").alias("n"),
        F.count_if(F.col("excluded_reason") == ev.UNKNOWN_TIME).alias("u"),
        F.count_if(F.col("excluded_reason") == ev.TOO_LATE).alias("l"),
        F.bool_or(F.col("eligible") & (F.col("claim_type") == "tactic")).alias("t"),
    )
    want = {r["match_id"]: (r["n"], r["u"], r["l"], r["t"]) for r in listed.collect()}
    got = ev.encode(df, claims, subjects, max_rows_per_task=limit).collect()
    assert len(got) == len(ms)
    for r in got:
        assert (r["evidence_count"], r["unknown_time_count"], r["too_late_count"], r["technique_advantage_flag"]) == want.get(r["match_id"], (0, 0, 0, False))


def test_unresolved_subjects_are_null_not_errors(spark):
    a = spark.createDataFrame([(1, 5, "Al", "left"), (2, 5, "", "unclear")], "claim_id long, match_id long, subject_athlete_name string, arm string")
    c = spark.createDataFrame([(5, "Al", 77)], "match_id long, name string, athlete_id long")
    got = {r["claim_id"]: (r["subject_athlete_id"], r["arm"]) for r in cl.resolve_subjects(a, c).collect()}
    assert got == {1: (77, "left"), 2: (None, None)}


def test_a_custom_annotator_runs_on_batches(spark):
    def shout(batch):
        return batch.assign(
            claim_type="form", concepts=[["hook"]] * len(batch), subject_athlete_name="", arm="left",
            temporality="unclear", certainty="observed",
        )[["claim_id", "claim_type", "concepts", "subject_athlete_name", "arm", "temporality", "certainty"]]

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "claim_id long, claim_text string")
    assert {r["concepts"][0] for r in cl.annotate(rows, shout).collect()} == {"hook"}


@pytest.mark.parametrize("limit", [None, 3])
def test_first_claim_wins_and_numbers_are_dense(spark, limit):
    a = spark.createDataFrame([(0, "v", None, "x"), (1, "v", "00:01", "x"), (2, "v", None, "x")], "pos long, video_id string, timestamp string, claim string")
    b = spark.createDataFrame([(0, "v", "00:01", "x", "r"), (1, "w", "00:01", "x", "r")], "pos long, video_id string, timestamp string, claim string, relevance string")
    got = cl.dedupe_claims(cl.union_datasets([a, b]), max_rows_per_task=limit).orderBy("evidence_index").collect()
    assert [(r["evidence_index"], r["file_ord"], r["pos"]) for r in got] == [(0, 0, 0), (1, 0, 1), (2, 1, 1)]


def test_time_texts(spark):
    cases = {"01:05": 65, "1:00:01": 3601, "100:00": 6000, "5": None, "a:b": None, "1:2:3:4": None, "": None, "-1:00": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.timestamp_seconds("t").alias("s"), text.deep_link(F.lit("u"), "t").alias("l"))
    for r in df.collect():
        assert r["s"] == cases[r["t"]]
        assert r["l"] == ("u" if r["s"] is None else f"u&t={r['s']}s")
    shown = spark.createDataFrame([(65,), (3601,), (0,)], "s long").select(text.format_seconds("s").alias("t"))
    assert [r["t"] for r in shown.collect()] == ["01:05", "01:00:01", "00:00"]


def test_durations(spark):
    cases = {"PT1H30M": 5400, "PT1H": 3600, "PT2M3S": 123, "PT45S": 45, "P1D": 0, "live": 0, None: 0, "PT": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.iso_duration_seconds("t").alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == cases


def test_recency_edges(spark):
    cases = {"2026-04-26T00:00:00Z": (0, "current_window"), "2027-01-01T00:00:00Z": (0, "current_window"),
             "2025-10-28T00:00:00Z": (180, "current_window"), "2025-10-27T23:59:59Z": (180, "current_window"),
             "2025-10-27T00:00:00Z": (181, "recent_context"), "2024-04-26T00:00:00+00:00": (730, "recent_context"),
             "2020-01-01T00:00:00Z": (2307, "historical_context"), "never": (None, "unknown"), "": (None, "unknown"), None: (None, "unknown")}
    age = recency.age_days(recency.published_at("t"), F.lit("2026-04-26"))
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", age.alias("a"), recency.bucket(age).alias("b"))
    assert {r["t"]: (r["a"], r["b"]) for r in df.collect()} == cases


def test_weights_and_lifts_in_text(spark):
    cases = {
        "around 105 kg and 80-85kg": ["105", "80-85"], "1234kg": [], "lifts 60 KG, ~ 70 - 75 kg": ["60", "70-75"],
        "5 kg": [], "100kgs": [], "nearly100kg": ["100"], "really100kg": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.kg_values("t").alias("v"))
    assert {r["t"]: r["v"] for r in df.collect()} == cases
    one = spark.createDataFrame([("body weight 100 kg, back pressure 60 kg",)], "_text string")
    r = cl.with_text_values(one).select("*", cl.promoted_kind(F.lit("unclear")).alias("k")).first()
    assert r["text_measurements"] == ["body_weight=100", "body_weight=60"]
    assert r["text_lifts"] == ["back_pressure=100", "back_pressure=60"] and r["k"] == "measurement"


def test_dimensions_are_filled_and_kept_within_recency(spark):
    claims = spark.createDataFrame(
        [(0, "body weight 100 kg", "", False, ["durable_style"]), (1, "x", None, True, ["current_form"])],
        "evidence_index long, claim string, relevance string, current_form_allowed boolean, allowed_evidence_roles array<string>",
    )
    items = spark.createDataFrame(
        [(0, None, "current", None, None, None, None, ["reach=70"], None, True, None, None, None, None),
         (1, "Self_Report", " Style", None, ["hook"], None, None, None, ["curl=60"], True, None, None, None, None),
         (9, None, None, None, None, None, None, None, None, None, None, None, None, None)],
        "evidence_index long, evidence_kind string, temporal_scope string, arm_side string, mechanics array<string>, table_positions array<string>, "
        "physical_attributes array<string>, measurements array<string>, lifts array<string>, current_form_usable boolean, durable_style_usable boolean, "
        "historical_context_usable boolean, noise_risk string, dimension_confidence string",
    )
    got = {r["evidence_index"]: r for r in cl.normalize_dimensions(items, claims).collect()}
    assert set(got) == {0, 1}
    assert got[0]["temporal_scope"] == "historical_event" and got[0]["current_form_usable"] is False
    assert got[0]["measurements"] == ["reach=70", "body_weight=100"] and got[0]["evidence_kind"] == "measurement"
    assert got[0]["durable_style_usable"] is True and got[0]["noise_risk"] == "medium"
    assert got[1]["evidence_kind"] == "athlete_self_report" and got[1]["temporal_scope"] == "durable_style"
    assert got[1]["current_form_usable"] is True and got[1]["lifts"] == ["curl=60"]
    bare = {r["evidence_index"]: r for r in cl.normalize_dimensions(items, claims, keep_supplied=False).collect()}
    assert bare[0]["measurements"] == ["body_weight=100"]


def test_nested_dimensions_convert_default_and_add_text_values(spark):
    claims = spark.createDataFrame(
        [(0, "Body weight 100 kg, 90 kg and 100 kg", None, False), (1, "pronation", "with 60 kg", True), (2, None, None, True)],
        "evidence_index long, claim string, relevance string, current_form_allowed boolean",
    )
    items = spark.createDataFrame(
        [(0, None, ['{"name": "body_weight", "value": 100}', "long arms", None, "[1]"], None, ['{"tested_property": "grip"}']),
         (1, "measurement", ["{broken"], ['{"lift_name": "pronation", "value": "60", "setup_details_visible": true}', "7"], None),
         (2, None, [], None, None), (9, None, ["lost"], None, None)],
        "evidence_index long, evidence_kind string, measurements array<string>, lifts array<string>, transferable_lessons array<string>",
    )
    got = {r["evidence_index"]: r for r in cl.nested_dimensions(items, claims).collect()}
    assert set(got) == {0, 1, 2}
    m = [(x["metric"], x["value"], x["unit"], x["confidence"]) for x in got[0]["measurements"]]
    assert m == [("body_weight", "100", "", "medium"), ("long arms", "", "", "low"), ("[1]", "", "", "low"), ("body_weight", "90", "kg", "medium")]
    assert got[0]["evidence_kind"] == "measurement" and got[0]["lifts"] == []
    assert got[0]["transferable_lessons"][0]["tested_property"] == "grip" and got[0]["transferable_lessons"][0]["referenced_opponent_or_match"] == ""
    assert [(x["lift_name"], x["value"], x["setup_details_visible"]) for x in got[1]["lifts"]] == [("pronation", "60", True), ("7", "", False)]
    assert got[1]["measurements"][0]["metric"] == "{broken"
    assert got[2]["measurements"] == [] and got[2]["evidence_kind"] == "unclear"


def test_atoms_get_ids_from_claim_and_position(spark):
    claims = spark.createDataFrame([(0, True, ["durable_style"]), (31, False, [])], "evidence_index long, current_form_allowed boolean, allowed_evidence_roles array<string>")
    atom = "struct<evidence_index:long,actor:string,action:string,lane:string,position_state:string,enables:array<string>,denies:array<string>,source_basis:string,confidence:string,current_form_usable:boolean,durable_style_usable:boolean,historical_context_usable:boolean>"
    mk = lambda i, **k: (i, k.get("actor"), "cup", None, None, None, None, k.get("basis"), None, True, None, None)
    responses = spark.createDataFrame([(1, [mk(0, basis="Narrator"), mk(31), mk(0)]), (2, [mk(31, actor="X")])], f"batch long, atoms array<{atom}>")
    got = {r["atom_id"]: r for r in cl.normalize_atoms(responses, claims).collect()}
    assert set(got) == {"a0_1", "a0_3", "a31_1"}
    assert got["a0_1"]["source_basis"] == "analyst_interpretation" and got["a0_1"]["current_form_usable"] is True
    assert got["a31_1"]["current_form_usable"] is False and got["a31_1"]["actor"] == "X" and got["a0_3"]["actor"] == "unknown"


@pytest.mark.parametrize("limit", [None, 10])
def test_coverage_matches_brute_force(spark, limit):
    rng = random.Random(1)
    cs = [(rng.choice([1, 1, 2, 3]), i, rng.choice([None, rng.randrange(500)])) for i in range(80)]
    ws = [(rng.choice([1, 1, 2]), s := rng.randrange(450), s + rng.randrange(40)) for _ in range(25)]
    claims = spark.createDataFrame(cs, "source_id long, claim_id long, seconds long")
    windows = spark.createDataFrame(ws, "source_id long, start_seconds long, end_seconds long")
    got = {r["claim_id"]: r["covered"] for r in ds.covered_claims(claims, windows, limit).collect()}
    want = {i: t is not None and any(w == s and b <= t <= e for w, b, e in ws) for s, i, t in cs}
    assert got == want


def test_round_robin_interleave(spark):
    lists = [["a", "b", "c"], ["b", "d"], ["a", "", "e", "f"]]
    rows = [(v, i, k) for i, l in enumerate(lists) for k, v in enumerate(l)]
    df = spark.createDataFrame(rows, "id string, list_ord long, rank long")
    assert [r["id"] for r in ds.interleave(df, 4).collect()] == ["a", "b", "d", "c"]
    assert [r["id"] for r in ds.interleave(df, 9).collect()] == ["a", "b", "d", "c", "e", "f"]
    assert ds.interleave(df, 0).count() == 0


def test_polymorphic_analysis(spark, tmp_path):
    docs = {
        "v1__m.json": {"analysis": {"claims": [{"claim": "a", "timestamp": "00:01"}, {"claim": "b"}], "summary": "s"}, "usage_metadata": {"candidatesTokenCount": 10, "promptTokensDetails": [{"modality": "AUDIO", "tokenCount": 1000000}]}},
        "v2__m.json": {"analysis": [{"claim": "c"}]},
        "v3__m.json": {"analysis": "text"},
        "v4.json": {"other": 1},
        "v1__m__x_eval.json": {"analysis": {"pass_fail": "Pass"}},
        "a__bcdefgh_.json": {},
        "a__bcdefgh___gemini-2.json": {},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    rows = artifacts.read_documents(spark, str(tmp_path))
    assert {(r["video_id"], r["model"], r["is_evaluation"]) for r in rows.collect()} == {
        ("v1", "m", False), ("v2", "m", False), ("v3", "m", False), ("v4", None, False), ("v1", "m", True),
        ("a__bcdefgh_", None, False), ("a__bcdefgh_", "gemini-2", False)}
    got = artifacts.analysis_claims(rows.where("NOT is_evaluation"))
    assert sorted((r["video_id"], r["pos"], r["claim"], r["timestamp"]) for r in got.collect()) == [
        ("v1", 0, "a", "00:01"), ("v1", 1, "b", None), ("v2", 0, "c", None)]
    cost = rows.where("video_id = 'v1' AND NOT is_evaluation").withColumn("u", artifacts.usage()).select(
        ds.media_cost("u.promptTokensDetails", "u.candidatesTokenCount").alias("c")).first()["c"]
    assert cost == pytest.approx(1.0 + 10 * 2.5e-6)


def test_landed_answers(spark):
    doc = lambda d: spark.createDataFrame([("q", 0, json.dumps(d))], "query string, list_ord long, document string")
    found = artifacts.search_candidates(doc({"items": [{"id": {"videoId": "x"}, "snippet": {"title": "T"}}, {"id": {}}, {"id": {"videoId": "y"}}]}))
    assert [(r["id"], r["rank"], r["title"]) for r in found.collect()] == [("x", 0, "T"), ("y", 2, None)]
    video = artifacts.video_metadata(doc({"items": [{"id": "x", "contentDetails": {"duration": "PT1M"}, "statistics": {"viewCount": "12"}}]})).first()
    assert (video["view_count"], video["like_count"], video["duration"]) == (12, None, "PT1M")
    seg = artifacts.transcript_segments(doc({"segments": [{"start": 0.5, "end": 2, "text": " hi "}]})).first()
    assert (seg["start_seconds"], seg["end_seconds"], seg["text"]) == (0.5, 2.0, "hi")
    raw = spark.createDataFrame([("{\"text\": \"a\"}",), ("no json",)], "document string")
    got = artifacts.with_fallback(raw, "document", "struct<text:string>").collect()
    assert got[0]["decoded"]["text"] == "a" and got[0]["raw_text"] is None
    assert got[1]["decoded"] is None and got[1]["raw_text"] == "no json"


def test_seeds_file(tmp_path):
    path = tmp_path / "seeds.json"
    path.write_text(json.dumps({"trusted_channels": [{"name": "A", "priority": 5}], "positive_title_terms": ["x"], "negative_title_terms": []}))
    seeds = artifacts.read_seeds(str(path), ("a", "b"))
    assert seeds.trusted_channels == {"A": 5} and seeds.positive_terms == ["x"]


def test_bundle_sections_and_theme_claims(spark, tmp_path):
    claims = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "evidence_index long, claim string")
    themes = spark.createDataFrame([("t", [2, 9, 0, 1])], "theme_id string, evidence_refs array<long>")
    got = mech.theme_claims(themes, claims, 2).orderBy("position").collect()
    assert [r["evidence_index"] for r in got] == [2, 0]
    dims = spark.createDataFrame([(1, "k")], "evidence_index long, kind string")
    atoms = spark.createDataFrame([(1, "a1_1"), (1, "a1_2")], "evidence_index long, atom_id string")
    flat = mech.attach(claims, dims, atoms)
    assert flat.count() == 4
    mech.write_bundle(str(tmp_path / "bundle"), {"claims": flat, "themes": themes})
    assert spark.read.json(str(tmp_path / "bundle" / "claims")).count() == 4


def test_front_shares_round_half_up(spark):
    rows = spark.createDataFrame([("d", "a", 1), ("d", "b", 7), ("d", "even", 0), ("e", "even", 0)], "dossier_id string, leans string, claim_count long")
    got = {r["dossier_id"]: (r["share_a"], r["share_b"], r["share_even"]) for r in mech.front_verdict(rows).collect()}
    assert got == {"d": (13, 88, -1), "e": (0, 0, 100)}
