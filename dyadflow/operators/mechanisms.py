"""Tactics: mechanism nodes, moves, fronts, conflicts, and the evidence bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.functions import recency, text, vocab


def _or(value: Column | str, default: str) -> Column:
    found = text.col(value)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(default)).otherwise(found)


def normalize_actor(actor: Column | str, tokens: Mapping[str, Sequence[str]]) -> Column:
    """Name of the side whose token occurs in the actor text, else the text itself."""
    lower = F.lower(F.coalesce(text.col(actor), F.lit("")))
    result = _or(actor, "Unassigned")
    for name, needles in reversed(list(tokens.items())):
        result = F.when(text.contains_any(lower, [n.lower() for n in needles]), F.lit(name)).otherwise(result)
    return result


def leans(value: Column | str, token_a: str, token_b: str) -> Column:
    lower = F.lower(text.col(value))
    return (
        F.when(F.contains(lower, F.lit(token_a.lower())), "a")
        .when(F.contains(lower, F.lit(token_b.lower())), "b")
        .otherwise("even")
    )


def mechanism_nodes(atoms: DataFrame, tokens: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per (actor, action, lane): distinct claims, currently usable atoms, first confidence.

    Input order is (evidence_index, atom_id)."""
    keyed = atoms.select(
        normalize_actor("actor", tokens).alias("actor"),
        _or("action", "unknown action").alias("action"),
        _or("lane", "unknown lane").alias("lane"),
        "evidence_index", "atom_id", "current_form_usable",
        _or("confidence", "unknown").alias("confidence"),
    )
    key = ["actor", "action", "lane"]
    counted = _count_claims(keyed, key, {"current_usable_count": "current_form_usable"})
    return _with_first(counted, keyed, key, ["confidence"])


def _count_claims(rows: DataFrame, key: Sequence[str], flags: Mapping[str, str]) -> DataFrame:
    """Rows, flagged rows, distinct claims and first claim per key, in hash aggregations only."""
    per_claim = rows.groupBy(*key, "evidence_index").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
    return per_claim.groupBy(*key).agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.sum("_rows").alias("atom_count"),
        *[F.sum(n).alias(n) for n in flags],
        F.min("evidence_index").alias("_first"),
    )


def _with_first(
    counted: DataFrame, rows: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Add column values of the first atom of each key; only atoms of first claims are compared."""
    first = rows.join(
        counted.select(*key, F.col("_first").alias("evidence_index")), [*key, "evidence_index"], "left_semi"
    )
    order = F.struct("evidence_index", "atom_id")
    values = first.groupBy(*key).agg(
        *[F.min_by(c, order).alias(c) for c in columns], F.min(order).alias("first_seen")
    )
    return counted.drop("_first").join(values, list(key))


def node_claims(atoms: DataFrame, tokens: Mapping[str, Sequence[str]]) -> DataFrame:
    """The claims behind each node, as rows."""
    return atoms.select(
        normalize_actor("actor", tokens).alias("actor"),
        _or("action", "unknown action").alias("action"),
        _or("lane", "unknown lane").alias("lane"),
        "evidence_index",
    ).distinct()


def move_counts(atoms: DataFrame, token_a: str, token_b: str) -> DataFrame:
    """Moves per side bucket (a, b or shared) keyed by the raw actor and action."""
    side = leans(F.coalesce("actor", F.lit("")), token_a, token_b)
    bucketed = atoms.select(
        F.when(side == "even", "shared").otherwise(side).alias("bucket"),
        F.coalesce("actor", F.lit("")).alias("actor"),
        F.coalesce("action", F.lit("")).alias("_action"), _or("lane", "unknown").alias("lane"),
        "evidence_index", "atom_id",
    )
    key = ["bucket", "actor", "_action"]
    counted = _count_claims(bucketed, key, {})
    return _with_first(counted, bucketed, key, ["lane"]).select(
        "bucket", "actor", _or("_action", "unspecified").alias("move"), "lane",
        F.col("atom_count").alias("moves"), "claim_count", "first_seen",
    )


def top_nodes(nodes: DataFrame, limits: Mapping[str, int], others: int) -> DataFrame:
    """Best nodes of each named side and of everyone else together, by claims."""
    side = F.lit("shared")
    limit = F.lit(others)
    for name, k in limits.items():
        side = F.when(F.col("actor") == name, F.lit(name)).otherwise(side)
        limit = F.when(F.col("actor") == name, F.lit(k)).otherwise(limit)
    best = Window.partitionBy("side").orderBy(F.desc("claim_count"), "first_seen", "action", "lane")
    widest = max([others, *limits.values()])
    return (
        nodes.withColumn("side", side)
        .withColumn("_limit", limit)
        .withColumn("position", F.row_number().over(best))
        # the fixed bound lets Spark drop rows before the shuffle
        .where(F.col("position") <= widest)
        .where("position <= _limit")
        .drop("_limit")
    )


def theme_fronts(themes: DataFrame, token_a: str, token_b: str) -> DataFrame:
    """Card fields of each theme (dossier_id, pos from 0, theme_id, label, match_relevance,
    challenged_assumption, why_this_theme_emerged, claim_count)."""
    sentence = lambda n: F.substring_index(n, ".", 1)
    number = (F.col("pos") + 1).cast("string")
    return themes.select(
        "dossier_id", "theme_id",
        F.when(F.col("pos") < 9, F.concat(F.lit("0"), number)).otherwise(number).alias("ordinal"),
        F.substring(F.upper("label"), 1, 32).alias("label"),
        F.concat(sentence("match_relevance"), F.lit("?")).alias("question"),
        F.coalesce("challenged_assumption", sentence("why_this_theme_emerged")).alias("popular_take"),
        leans("label", token_a, token_b).alias("leans"),
        "claim_count",
    )


def front_verdict(fronts: DataFrame, by: Sequence[str] = ("dossier_id",)) -> DataFrame:
    """Fronts per side and claim-weighted shares; what rounding leaves goes to even."""
    weight = lambda s: F.coalesce(F.sum(F.when(F.col("leans") == s, F.col("claim_count"))), F.lit(0))
    counted = fronts.groupBy(*by).agg(
        *[F.count_if(F.col("leans") == s).alias(f"fronts_{s}") for s in ("a", "b", "even")],
        weight("a").alias("_a"), weight("b").alias("_b"),
        F.greatest(F.lit(1), F.coalesce(F.sum("claim_count"), F.lit(0))).alias("_total"),
    )
    share = lambda c: F.floor(F.col(c) / F.col("_total") * 100 + 0.5).cast("long")
    return counted.select(
        *by, "fronts_a", "fronts_b", "fronts_even", share("_a").alias("share_a"),
        share("_b").alias("share_b"), (100 - share("_a") - share("_b")).alias("share_even"),
    )


def most_common(rows: DataFrame, column: str, seq: str, limit: int = 20) -> DataFrame:
    """Most frequent values; ties in order of first appearance."""
    return (
        rows.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_first"))
        .orderBy(F.desc("n"), "_first")
        .limit(limit)
        .drop("_first")
    )


def atom_text() -> Column:
    return F.lower(
        F.concat_ws(
            " ", "action", "lane", "position_state", F.concat_ws(" ", "enables"), F.concat_ws(" ", "denies")
        )
    )


def conflicts(
    atoms: DataFrame,
    rules: Mapping[str, tuple[tuple[str, Sequence[str]], tuple[str, Sequence[str]]]],
    per_side: int = vocab.CONFLICT_IDS_PER_SIDE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pairs of opposed mechanisms. A rule names, for each side, an actor and the words to look for;
    it holds when both sides have at least one atom. Ids are the first ones in input order."""
    marks = []
    for name, sides in rules.items():
        for side, (actor, needles) in zip("ab", sides):
            hit = (F.lower("actor") == actor.lower()) & text.contains_any("_text", needles)
            marks.append(F.when(hit, F.struct(F.lit(name).alias("rule"), F.lit(side).alias("side"))))
    marked = (
        atoms.withColumn("_text", atom_text())
        .select(*by, "evidence_index", "atom_id", F.explode(F.array_compact(F.array(*marks))).alias("m"))
        .select(*by, "evidence_index", "atom_id", "m.*")
    )
    first = Window.partitionBy(*by, "rule", "side").orderBy("evidence_index", "atom_id")
    listed = (
        marked.withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= per_side)
        .groupBy(*by, "rule")
        .agg(*[
            F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("_r", "atom_id")))).getField("atom_id").alias(f"side_{s}_atom_ids")
            for s in "ab"
        ])
    )
    return listed.where((F.size("side_a_atom_ids") > 0) & (F.size("side_b_atom_ids") > 0))


# ------------------------------------------------------------------ bundle


def evidence_summary(claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts over claims, with the recency histogram as a map."""
    counted = claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("claim_count"),
        F.count_distinct("video_id").alias("source_count"),
        F.count_if("current_form_allowed").alias("current_form_claim_count"),
        *[F.count_if(F.col("source_recency") == b).alias(f"_{b}") for b in recency.BUCKETS],
    )
    histogram = F.create_map(*[x for b in recency.BUCKETS for x in (F.lit(b), F.col(f"_{b}"))])
    return counted.select(
        *by, "claim_count", "source_count", "current_form_claim_count",
        F.map_filter(histogram, lambda _, n: n > 0).alias("recency_distribution"),
    )


def dimension_counts(dimensions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    filled = lambda n: F.count_if(F.coalesce(F.size(n), F.lit(0)) > 0)
    return dimensions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("dimension_count"),
        filled("mechanics").alias("mechanics_dimension_count"),
        filled("measurements").alias("measurement_dimension_count"),
        filled("lifts").alias("lift_dimension_count"),
    )


def source_counts(claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Claims per source with the title, channel and recency it was first seen with."""
    first = lambda n: F.min_by(n, "evidence_index").alias(n)
    return claims.groupBy(*by, "video_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        first("video_title"), first("channel"), first("source_recency"),
        F.min("evidence_index").alias("first_index"),
    )


def hero_claim(claims: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First claim of the current window, else the first claim."""
    order = F.struct((F.col("source_recency") != "current_window").alias("late"), "evidence_index")
    return claims.groupBy(*by).agg(
        F.min_by("evidence_index", order).alias("evidence_index"),
        F.min_by("claim", order).alias("claim"),
    )


def attach(claims: DataFrame, dimensions: DataFrame, atoms: DataFrame) -> DataFrame:
    """Claims with their dimension and one row per atom; claims without atoms stay, once."""
    return claims.join(dimensions, "evidence_index", "left").join(atoms, "evidence_index", "left")


def attach_nested(claims: DataFrame, dimensions: DataFrame, atoms: DataFrame) -> DataFrame:
    """Claims with their dimension and their atoms as one array, empty where there are none.

    The atoms of a claim come from a single model response, which bounds the array. They are sorted.
    """
    fields = [c for c in atoms.columns if c != "evidence_index"]
    first = ["atom_id", *[f for f in fields if f != "atom_id"]]
    lists = atoms.groupBy("evidence_index").agg(F.sort_array(F.collect_list(F.struct(*first))).alias("atoms"))
    joined = claims.join(dimensions, "evidence_index", "left").join(lists, "evidence_index", "left")
    shape = lists.schema["atoms"].dataType
    return joined.withColumn("atoms", F.coalesce("atoms", F.array().cast(shape)))


def dossier_summary(claims: DataFrame, atoms: DataFrame, themes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``evidence_summary`` of each dossier with how many atoms and themes it has."""
    counted = evidence_summary(claims, by)
    for rows, name in ((atoms, "atom_count"), (themes, "theme_count")):
        counted = counted.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), list(by), "left")
    return counted.fillna(0, ["atom_count", "theme_count"])


def dossier_documents(
    sections: Mapping[str, DataFrame], by: Sequence[str], order: Mapping[str, str], max_rows: int = 100_000
) -> DataFrame:
    """One row per dossier: each section as an array, sorted by its ``order`` column, empty where it has none.

    For dossiers that fit a document: one that has more than ``max_rows`` rows in a section is an
    error, raised before any list is built; ``write_bundle`` keeps such dossiers as rows.
    """
    whole = None
    for name, rows in sections.items():
        largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if largest > max_rows:
            raise ValueError(f"section {name!r} has a dossier of {largest} rows; write it as rows instead")
        fields = [order[name], *[c for c in rows.columns if c not in (*by, order[name])]]
        lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        whole = lists if whole is None else whole.join(lists, list(by), "full")
    for name in sections:
        whole = whole.withColumn(name, F.coalesce(name, F.array().cast(whole.schema[name].dataType)))
    return whole


def theme_claims(themes: DataFrame, claims: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` existing claims of each theme, in the order the theme cites them.

    ``themes`` is (theme_id, evidence_refs array of claim numbers)."""
    refs = themes.select("theme_id", F.posexplode("evidence_refs").alias("pos", "evidence_index"))
    found = refs.join(claims, "evidence_index")
    order = Window.partitionBy("theme_id").orderBy("pos")
    return (
        found.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .drop("pos")
    )


def write_bundle(path: str, sections: Mapping[str, DataFrame]) -> None:
    """Write each section of a dossier as JSON lines under its own folder.

    A dossier is as large as its claims, so it is not folded into a single document; readers load
    the sections they show.
    """
    for name, rows in sections.items():
        rows.write.mode("errorifexists").json(f"{path.rstrip('/')}/{name}")
