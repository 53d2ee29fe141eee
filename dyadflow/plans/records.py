"""Registered queries of stored runs, dossiers and the smaller rules of both tracks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadflow.functions import text, vocab
from dyadflow.operators import claims as cl
from dyadflow.operators import features, folds, ledger, models, protocols, ratings, validation
from dyadflow.operators import mechanisms as mech
from dyadflow.plans import fixtures as fx
from dyadflow.plans.evidence import ATOMS, CLAIMS, DOC_CLAIMS, _recent, atoms, doc_claims, raw_claims
from dyadflow.plans.fixtures import DYADS, SIDES, table, with_ctes
from dyadflow.plans.prediction import ASOF, FOLDS, MIN_TRAINING_EVENTS, _completed, _plan, _r
from dyadflow.staging import stage, stage_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- runs and protocols


_SIZES = """
n AS (SELECT count(*) AS tests FROM matches JOIN tested USING (event_id)),
trained AS (SELECT count(*) AS trains FROM matches JOIN eligible e USING (event_id) JOIN tested t ON e.position < t.position)
""".strip()


@query(
    "ledger_runs",
    with_ctes(
        """SELECT 1::BIGINT AS run_id, 'completed' AS status, true AS promotable, trains + tests AS feature_rows,
  2 * tests AS predictions, tests AS scored, true AS immutable FROM n, trained
UNION ALL SELECT 2, 'failed', false, trains + tests, 0, 0, false FROM n, trained""",
        DYADS, SIDES, FOLDS, _SIZES,
    ),
)
def ledger_runs(spark, sf):
    """A run that completes and one whose probabilities are refused, from the ledger they wrote."""
    matches, _, plan = _plan(spark, sf)
    payloads = ledger.rating_payloads(folds.fold_members(plan, ledger.with_inputs(matches), *ledger.INPUTS))
    book = ledger.Ledger(spark, stage_path(spark, "ledger"))

    def beyond(given, folded):
        run = models.elo_family().run(given, folded)
        return models.FoldRun(run.predictions.withColumn("p_a", F.col("p_a") + 1.0), run.params)

    families = {1: models.elo_family(), 2: models.ModelFamily("rating", beyond)}
    for run_id, family in families.items():
        try:
            ledger.run_experiment(
                book, run_id, "elo", family, matches, plan, payloads, protocol_id=1,
                feature_schema="outcomes_elo_v1", git_sha="0" * 40, git_dirty=run_id == 2,
            )
        except ValueError:
            if run_id != 2:
                raise
    closed = []
    for run_id in families:
        try:
            book._require_open(run_id)
        except PermissionError:
            closed.append(run_id)
    stored = book.read("predictions").groupBy("run_id").agg(F.count(F.lit(1)).alias("predictions"))
    sizes = book.every_attempt("manifests").select(F.col("run_id").cast("long").alias("run_id"), "feature_rows")
    return (
        book.runs().join(sizes, "run_id").join(stored, "run_id", "left")
        .select(
            F.col("run_id").cast("long").alias("run_id"), "status", (~F.col("git_dirty")).alias("promotable"),
            "feature_rows", F.coalesce("predictions", F.lit(0)).alias("predictions"),
            F.coalesce(F.get_json_object("metrics", "$.n").cast("long"), F.lit(0)).alias("scored"),
            F.col("run_id").isin(closed).alias("immutable"),
        )
    )


@query(
    "ledger_retries",
    with_ctes(
        """SELECT 1::BIGINT AS run_id, 'completed' AS status, 2::BIGINT AS attempts, trains + tests AS visible_inputs,
  2 * (trains + tests) AS stored_inputs, 1::BIGINT AS manifests, 2 * tests AS visible_predictions,
  tests AS visible_models, tests AS scored, 4::BIGINT AS refused_writes, true AS id_refused FROM n, trained
UNION ALL SELECT 2, 'failed', 1, 0, trains + tests, 0, 0, 0, 0, 4, false FROM n, trained
UNION ALL SELECT 3, 'completed', 1, trains + tests, trains + tests, 1, 2 * tests, tests, tests, 4, true FROM n, trained""",
        DYADS, SIDES, FOLDS, _SIZES,
    ),
)
def ledger_retries(spark, sf):
    """A run that fails after its predictions and is run again, one that stays failed, one with an id handed
    out; then every table is written to and every id started once more."""
    matches, _, plan = _plan(spark, sf)
    athletes = ("athlete_a_id", "athlete_b_id")
    members = folds.fold_members(plan, ledger.with_inputs(matches), *athletes, *ledger.INPUTS)
    payloads = ledger.rating_payloads(members)
    book = ledger.Ledger(spark, stage_path(spark, "ledger"))
    even = members.where("role = 'test'").select("fold_index", "match_id", *athletes, F.lit(0.5).alias("p_a"))
    params = even.select("fold_index", "match_id", F.lit("p").alias("name"), F.col("p_a").alias("value"))

    def started(run_id):
        return book.start(
            run_id, git_sha="0" * 40, git_dirty=False, protocol_id=1, feature_schema="outcomes_elo_v1", kind="rating",
            model_family="even", hyperparams={},
        )

    def attempt(run_id, *, fails):
        run_id = started(run_id)
        book.append_inputs(run_id, payloads)
        book.append_predictions(run_id, even)
        book.append_params(run_id, params)
        if fails:
            book.fail(run_id, "lost on the way")
            return
        book.complete(run_id, {"n": book.own_rows("predictions", run_id).count() // 2})

    attempt(1, fails=True)
    attempt(2, fails=True)
    attempt(1, fails=False)
    attempt(None, fails=False)
    after = []
    for run_id in (1, 2, 3):
        refused, reused = 0, False
        for name in book.TABLES:
            try:
                book._put(name, run_id, params.limit(1))
            except PermissionError:
                refused += 1
        if run_id != 2:  # a failed run may be started again
            try:
                started(run_id)
            except PermissionError:
                reused = True
        after.append((run_id, refused, reused))
    told = spark.createDataFrame(after, "run_id long, refused_writes long, id_refused boolean")
    counted = lambda rows, name: rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    out = book.runs().select(
        "run_id", "status", "attempts", F.get_json_object("metrics", "$.n").cast("long").alias("scored")
    )
    for name, rows in (
        ("visible_inputs", book.read("feature_rows")), ("stored_inputs", book.every_attempt("feature_rows")),
        ("manifests", book.read("manifests")), ("visible_predictions", book.read("predictions")),
        ("visible_models", book.read("models")),
    ):
        out = out.join(counted(rows, name), "run_id", "left")
    return out.fillna(0).join(told, "run_id")


_BOXED = """
boxed AS (SELECT max(event_id) AS event_id FROM dyads),
start AS (SELECT min(held_on) AS held_on FROM dyads WHERE event_id = (SELECT event_id FROM boxed)),
placed AS (SELECT event_id, held_on, row_number() OVER (ORDER BY held_on, event_id) - 1 AS position
  FROM (SELECT DISTINCT event_id, held_on FROM dyads WHERE event_id <> (SELECT event_id FROM boxed)))
""".strip()


@query(
    "stored_protocols",
    with_ctes(
        """SELECT 'box' AS name, 'lockbox_retrospective' AS kind, 1::BIGINT AS folds,
  (SELECT count(*) FROM matches WHERE held_on < (SELECT held_on FROM start)
    OR event_id = (SELECT event_id FROM boxed)) AS placements
UNION ALL SELECT 'rolling', 'rolling_origin',
  (SELECT count(*) FROM placed WHERE position >= 8 AND event_id IN (SELECT event_id FROM matches)),
  (SELECT count(*) FROM matches JOIN placed USING (event_id))""",
        DYADS, _BOXED,
    ),
)
def stored_protocols(spark, sf):
    """A lockbox, and after it a rolling-origin protocol asked for twice, as they are stored."""
    everything = stage(fx.dyads(spark, sf), "dyads")
    matches = everything.where("status = 'completed'").drop("score_a", "score_b", "status")
    events = everything.select("event_id", "held_on").distinct()
    store = protocols.ProtocolStore(spark, stage_path(spark, "protocols"))
    try:
        store.rolling_origin("early", MIN_TRAINING_EVENTS, events, matches)
        raise RuntimeError("a rolling-origin protocol was created before any lockbox")
    except ValueError:
        pass
    last = events.orderBy(F.desc("event_id")).limit(1)
    store.seed_lockbox("box", "lockbox_retrospective", events, matches, last)
    for _ in range(2):
        store.rolling_origin("rolling", MIN_TRAINING_EVENTS, events, matches)
    count = lambda what, condition: store._read(what).groupBy("protocol_id").agg(F.count_if(condition).alias(what))
    return (
        store._read("protocols").join(count("plans", F.col("fold_index").isNotNull()), "protocol_id")
        .join(count("placements", F.lit(True)), "protocol_id")
        .select("name", "kind", F.col("plans").alias("folds"), "placements")
    )


_MET = """
met AS (
  SELECT m.match_id, count(o.match_id) AS prior_meetings FROM matches m
  LEFT JOIN matches o ON o.athlete_a_id = m.athlete_a_id AND o.athlete_b_id = m.athlete_b_id
    AND (o.held_on, o.event_id) < (m.held_on, m.event_id) GROUP BY 1)
""".strip()


@query(
    "cutoff_defaults",
    with_ctes(
        """SELECT m.match_id, array_to_string(list_sort(list_concat(
    CASE WHEN prior_meetings = 0 THEN ['head_to_head_diff'] ELSE [] END,
    CASE WHEN a.prior_matches = 0 THEN ['days_since_last_match_a', 'prior_rating_a', 'recent_form_a', 'win_rate_a'] ELSE [] END,
    CASE WHEN b.prior_matches = 0 THEN ['days_since_last_match_b', 'prior_rating_b', 'recent_form_b', 'win_rate_b'] ELSE [] END)), ',') AS defaulted
FROM matches m JOIN met USING (match_id)
JOIN at_event_form a ON a.match_id = m.match_id AND a.side = 'a'
JOIN at_event_form b ON b.match_id = m.match_id AND b.side = 'b'""",
        DYADS, SIDES, ASOF, _MET,
    ),
)
def cutoff_defaults(spark, sf):
    """Features of a test row that rest on nothing, by the state before its event."""
    rows = features.cutoff_features(_completed(spark, sf))
    return ledger.defaulted_features(rows).select(
        "match_id", F.array_join("defaulted_features", ",").alias("defaulted")
    )


@query(
    "default_ratings",
    with_ctes(
        """SELECT m.match_id, round(CASE WHEN a.n = 0 AND m.athlete_a_id % 2 = 0 THEN 1400.0 + m.athlete_a_id % 7 ELSE 1500.0 END::DOUBLE, 6) AS prior_rating_a,
  round(CASE WHEN b.n = 0 AND m.athlete_b_id % 2 = 0 THEN 1400.0 + m.athlete_b_id % 7 ELSE 1500.0 END::DOUBLE, 6) AS prior_rating_b
FROM matches m JOIN numbered a ON a.match_id = m.match_id AND a.side = 'a'
JOIN numbered b ON b.match_id = m.match_id AND b.side = 'b'""",
        DYADS, SIDES,
        """numbered AS (SELECT match_id, side, row_number() OVER (PARTITION BY athlete_id ORDER BY scheduled_at, match_id) - 1 AS n FROM sides)""",
    ),
)
def default_ratings(spark, sf):
    """Debuts take the rating supplied for them; where none is, and later, the flat one stays."""
    matches = _completed(spark, sf)
    flat = matches.select(
        "match_id", F.lit(1500.0).alias("prior_rating_a"), F.lit(1500.0).alias("prior_rating_b")
    )
    supplied = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").alias("athlete_id"), (F.lit(1400.0) + F.col("s_suppkey") % 7).alias("rating")
    )
    return features.history_features(matches, flat, supplied).select(
        "match_id", _r("prior_rating_a"), _r("prior_rating_b")
    )


@query(
    "rating_parameters",
    with_ctes(
        """SELECT CAST(t.fold_index AS BIGINT) AS fold_index, count(DISTINCT s.athlete_id) AS athletes
FROM tested t JOIN eligible e ON e.position < t.position JOIN sides s ON s.event_id = e.event_id GROUP BY 1""",
        DYADS, SIDES, FOLDS,
    ),
)
def rating_parameters(spark, sf):
    """How many athletes a fold's stored ratings name: those of its training events, no later one."""
    matches, _, plan = _plan(spark, sf)
    kept = matches.join(plan.select("event_id"), "event_id", "left_semi")
    params = ratings.fold_ratings(kept, ratings.elo_states(kept), plan)
    return params.groupBy(F.col("fold_index").cast("long").alias("fold_index")).agg(
        F.count(F.lit(1)).alias("athletes")
    )


# ---------------------------------------------------------------- dossiers


@query(
    "nested_atoms",
    with_ctes(
        """SELECT o_orderkey AS evidence_index, o_orderstatus AS kind, count(atom_id) AS atoms,
  coalesce(string_agg(atom_id || '/' || action, ',' ORDER BY atom_id), '') AS listed
FROM orders LEFT JOIN (SELECT * FROM atoms WHERE current_form_usable) ON evidence_index = o_orderkey GROUP BY 1, 2""",
        ATOMS,
    ),
)
def nested_atoms(spark, sf):
    orders = table(spark, sf, "orders")
    claims = orders.select(F.col("o_orderkey").alias("evidence_index"))
    dimensions = orders.select(F.col("o_orderkey").alias("evidence_index"), F.col("o_orderstatus").alias("kind"))
    usable = atoms(spark, sf).where("current_form_usable").select("evidence_index", "action", "atom_id")
    nested = mech.attach_nested(claims, dimensions, usable)
    listed = F.array_join(F.transform("atoms", lambda a: F.concat_ws("/", a["atom_id"], a["action"])), ",")
    return nested.select(
        "evidence_index", "kind", F.size("atoms").cast("long").alias("atoms"), listed.alias("listed")
    )


@query(
    "dossier_summary",
    with_ctes(
        """SELECT dossier, claim_count, source_count, current_form_claim_count, distribution,
  coalesce(atom_count, 0) AS atom_count, coalesce(theme_count, 0) AS theme_count
FROM (SELECT dossier, count(*) AS claim_count, count(DISTINCT video_id) AS source_count,
    count(*) FILTER (WHERE source_recency = 'current_window') AS current_form_claim_count,
    (SELECT string_agg(source_recency || '=' || n, ',' ORDER BY source_recency) FROM (
      SELECT source_recency, count(*) AS n FROM recent i WHERE i.dossier = o.dossier GROUP BY 1)) AS distribution
  FROM recent o GROUP BY dossier)
LEFT JOIN (SELECT CASE page_id % 3 WHEN 0 THEN 'en' ELSE 'fr' END AS dossier, count(*) AS atom_count FROM pages GROUP BY 1) USING (dossier)
LEFT JOIN (SELECT CASE role WHEN 'user' THEN 'en' ELSE 'de' END AS dossier, count(*) AS theme_count FROM conversations GROUP BY 1) USING (dossier)""",
        DOC_CLAIMS,
    ),
)
def dossier_summary(spark, sf):
    claims = _recent(doc_claims(spark, sf))
    themes = table(spark, sf, "conversations").select(
        F.when(F.col("role") == "user", "en").otherwise("de").alias("dossier")
    )
    atoms = table(spark, sf, "pages").select(F.when(F.col("page_id") % 3 == 0, "en").otherwise("fr").alias("dossier"))
    rows = mech.dossier_summary(claims, atoms, themes, ["dossier"])
    entries = F.array_sort(F.transform(F.map_entries("recency_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select(
        "dossier", "claim_count", "source_count", "current_form_claim_count",
        F.array_join(entries, ",").alias("distribution"), "atom_count", "theme_count",
    )


@query(
    "dossier_documents",
    """SELECT conv_id, coalesce(turns, 0) AS turns, coalesce(n, 0) AS claims, coalesce(text_sha, sha256('')) AS text_sha,
  coalesce(ids, '') AS ids
FROM (SELECT conv_id, count(*) AS turns, sha256(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS text_sha FROM conversations GROUP BY 1)
FULL JOIN (SELECT doc_id // 3 AS conv_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1) USING (conv_id)""",
)
def dossier_documents(spark, sf):
    themes = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    claims = table(spark, sf, "documents").select(F.expr("doc_id div 3").alias("conv_id"), "doc_id")
    whole = mech.dossier_documents({"themes": themes, "claims": claims}, ["conv_id"], {"themes": "turn", "claims": "doc_id"})
    texts = F.array_join(F.transform("themes", lambda t: F.coalesce(t["text"], F.lit(""))), "|")
    return whole.select(
        "conv_id", F.size("themes").cast("long").alias("turns"), F.size("claims").cast("long").alias("claims"),
        F.sha2(texts, 256).alias("text_sha"),
        F.array_join(F.transform("claims", lambda c: c["doc_id"].cast("string")), ",").alias("ids"),
    )


# ---------------------------------------------------------------- claims


@query(
    "stacked_datasets",
    """SELECT coalesce(source, 'none') AS source, file_ord::INTEGER AS file_ord, count(*) AS n, count(lang) AS with_lang FROM (
  SELECT source, 0 AS file_ord, lang FROM documents UNION ALL SELECT url, 1, page_id::VARCHAR FROM pages
  UNION ALL SELECT role, 2, NULL FROM conversations) GROUP BY 1, 2""",
)
def stacked_datasets(spark, sf):
    sets = [
        table(spark, sf, "documents").select("source", "lang"),
        table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("lang"), F.col("url").alias("source")),
        table(spark, sf, "conversations").select(F.col("role").alias("source")),
    ]
    return cl.union_datasets(sets).groupBy(F.coalesce("source", F.lit("none")).alias("source"), "file_ord").agg(
        F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang")
    )


@query(
    "missing_slugs",
    """SELECT DISTINCT 'item-' || l_partkey AS slug FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def missing_slugs(spark, sf):
    slug = lambda c: F.concat(F.lit("item-"), F.col(c).cast("string")).alias("slug")
    return folds.missing_slugs(
        table(spark, sf, "supplier").select(slug("s_suppkey")), table(spark, sf, "lineitem").select(slug("l_partkey"))
    )


@query(
    "resolved_subjects",
    """SELECT l_orderkey AS match_id, l_linenumber::BIGINT AS line,
  CASE l_linenumber % 3 WHEN 0 THEN 'nobody' ELSE 'Customer ' || o_custkey END AS subject_athlete_name,
  CASE l_linenumber % 3 WHEN 0 THEN NULL ELSE o_custkey END AS subject_athlete_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE NULL END AS arm
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def resolved_subjects(spark, sf):
    owner = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("athlete_id"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"),
    )
    line = F.col("l_linenumber")
    arms = F.array(*map(F.lit, ("left", "right", "unclear", "both")))
    told = table(spark, sf, "lineitem").join(owner, F.col("l_orderkey") == F.col("match_id")).select(
        "match_id", line.cast("long").alias("line"),
        F.when(line % 3 == 0, "nobody").otherwise(F.col("name")).alias("subject_athlete_name"),
        F.get(arms, (line % 4).cast("int")).alias("arm"),
    )
    return cl.resolve_subjects(told, owner).select(
        "match_id", "line", "subject_athlete_name", "subject_athlete_id", "arm"
    )


@query(
    "nullable_arms",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE NULL END AS arm FROM orders""",
)
def nullable_arms(spark, sf):
    arms = F.array(*map(F.lit, ("left", "right", "unclear", "Left", "")))
    return table(spark, sf, "orders").select(
        "o_orderkey", text.nullable_arm(F.get(arms, (F.col("o_orderkey") % 5).cast("int"))).alias("arm")
    )


@query(
    "atom_ids",
    """SELECT evidence_index, 'a' || evidence_index || '_' || row_number() OVER (PARTITION BY batch ORDER BY pos) AS atom_id
FROM (SELECT l_orderkey AS evidence_index, l_orderkey // 30 AS batch, l_orderkey * 8 + l_linenumber AS pos FROM lineitem)""",
)
def atom_ids(spark, sf):
    lines = table(spark, sf, "lineitem")
    none = F.lit(None)
    kinds = {"enables": "array<string>", "denies": "array<string>", "current_form_usable": "boolean",
             "durable_style_usable": "boolean", "historical_context_usable": "boolean"}
    names = ["actor", "action", "lane", "position_state", "enables", "denies", "source_basis", "confidence",
             "current_form_usable", "durable_style_usable", "historical_context_usable"]
    atom = F.struct(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("evidence_index"),
        *[none.cast(kinds.get(n, "string")).alias(n) for n in names],
    )
    batch = cl.batch_index("l_orderkey", vocab.ATOM_BATCH)
    responses = lines.groupBy(batch.alias("batch")).agg(F.sort_array(F.collect_list(atom)).alias("atoms"))
    claims = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("evidence_index"), F.lit(True).alias("current_form_allowed"),
        F.array().cast("array<string>").alias("allowed_evidence_roles"),
    )
    return cl.normalize_atoms(responses, claims).select("evidence_index", "atom_id")


@query(
    "custom_annotations",
    with_ctes(
        """SELECT claim_id, CASE WHEN strlen(claim_text) % 2 = 0 THEN 'form' ELSE 'rumour' END AS claim_type,
  CASE WHEN strlen(claim_text) % 2 = 0 THEN '' ELSE 'unrecognized claim_type' END AS problems FROM claims""",
        CLAIMS,
    ),
)
def custom_annotations(spark, sf):
    """A function of one's own over batches of claims, then the rules on what it says."""

    def annotator(batch):
        import pandas as pd

        even = batch["claim_text"].map(lambda t: len(t.encode()) % 2 == 0)
        return pd.DataFrame({
            "claim_id": batch["claim_id"],
            "claim_type": even.map({True: "form", False: "rumour"}),
            "concepts": [["hook"]] * len(batch),
            "subject_athlete_name": "", "arm": "unclear", "temporality": "unclear", "certainty": "unclear",
        })

    checked = validation.annotation_problems(cl.annotate(raw_claims(spark, sf), annotator))
    return checked.select("claim_id", "claim_type", F.array_join("problems", ",").alias("problems"))


@query(
    "contract_rules",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN lang IS NULL THEN 'missing lang' END,
  CASE WHEN lang NOT IN ('en', 'de') THEN 'unrecognized lang' END, CASE WHEN text IS NULL THEN 'missing text' END,
  CASE WHEN doc_id % 3 = 0 THEN 'unrecognized tags' END], lambda p: p IS NOT NULL), ',') AS problems FROM documents""",
)
def contract_rules(spark, sf):
    contract = T.StructType([
        T.StructField("lang", T.StringType(), False, {"enum": ["en", "de"]}),
        T.StructField("text", T.StringType(), False),
        T.StructField("tags", T.ArrayType(T.StringType()), True, {"enum": ["a", "b"]}),
    ])
    tags = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("z"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b")))
    rows = table(spark, sf, "documents").withColumn("tags", tags)
    return validation.contract_problems(rows, contract).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query(
    "empty_extractions",
    f"""SELECT doc_id, array_to_string(list_sort(list_filter([
  CASE WHEN doc_id % 4 = 0 THEN 'unsupported extraction schema version' END,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'zero claims require a limitation' END], lambda p: p IS NOT NULL)), ',') AS problems
FROM documents""",
)
def empty_extractions(spark, sf):
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 8 == 0, "other").when(d % 4 != 0, vocab.EXTRACTION_SCHEMA_VERSION).alias("schema_version"),
        F.when(d % 3 != 0, F.array("lang")).when(d % 2 == 0, none).alias("claims"),
        F.when(d % 5 == 0, F.array(F.lit("no audio"))).otherwise(none).alias("limitations"),
    )
    checked = validation.empty_extraction_problems(rows)
    return checked.select("doc_id", F.array_join(F.array_sort("problems"), ",").alias("problems"))


@query(
    "ingested_batches",
    with_ctes(
        "SELECT claim_type, count(DISTINCT source_id) AS sources, count(*) AS claims FROM claims GROUP BY 1",
        CLAIMS,
    ),
)
def ingested_batches(spark, sf):
    return cl.ingestion_summary(raw_claims(spark, sf), ["claim_type"])


@query(
    "outcomes_with_skips",
    """SELECT coalesce(source, '') AS source, count(*) AS selected, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS completed,
  count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0) AS failed, count(*) FILTER (WHERE doc_id % 5 = 0) AS skipped
FROM documents GROUP BY 1""",
)
def outcomes_with_skips(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        F.coalesce("source", F.lit("")).alias("source"), "doc_id",
        F.when(d % 3 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("problems"),
    )
    return validation.outcome_counts(rows, ["source"], d % 5 == 0)
