"""Every operator on odd rows: nulls everywhere, long texts, repeated rows, no rows, clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dyadflow.llm import avi, language, mixing, packing, pii, quality, secrets, simhash, topk, warc

CLASHING = [
    "pii", "secrets", "copies", "rank", "size", "score", "fp", "root", "id", "key", "length", "count", "part", "a.b",
    "_row", "_text", "_key", "_own", "_hash", "_whole", "_content", "_part", "_tie", "_v", "_hits_email", "label",
]
TEXTS = [
    None, "", " \n\t ", "...", "the quick brown fox", "the quick brown fox", "word " * 30_000, "x" * 100_000,
    "mail a@b.de or +49 30 1234567890", "漢字 ñ é " * 50,
]
ROWS = [(i if i else None, t, "s" if i % 2 else None, "en" if i % 3 else None) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = ROWS + ROWS[4:6]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    values = [F.when(F.col("doc_id") > 3, F.lit(name)).alias(name) for name in CLASHING]
    return plain.select("*", *values).withColumn("n_chars", F.length("text"))


def reports(docs, labels):
    model = secrets.train(secrets.labelled_tokens(docs))
    return {
        "pii": pii.report(docs), "secrets": secrets.report(docs, model), "mixing": mixing.report(docs),
        "quality": quality.report(docs, labels), "media": avi.report(docs), "simhash": simhash.report(docs),
        "language": language.report(docs),
    }


def test_reports_give_one_row_for_each(spark, odd):
    labels = spark.createDataFrame([(1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    for name, frame in reports(odd, labels).items():
        rows = frame.collect()
        assert len(rows) == odd.count(), name
        assert len({tuple(map(str, r)) for r in rows if r["doc_id"] == 4}) <= 2, name  # a repeated row
    assert packing.pack(odd).select("doc_id").distinct().count() == len(ROWS)
    assert packing.pack(odd).agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.CAPACITY


def test_reports_of_nothing(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for name, frame in reports(odd.limit(0), labels).items():
        assert frame.count() == 0, name
    assert packing.pack(odd.limit(0)).count() == 0
    assert topk.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.report(pages, F.lit(True), F.lit(False)).count() == 0


def test_other_columns_of_vectors_and_pages_play_no_part(spark):
    vectors = spark.createDataFrame(
        [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.1, 0.2]), (2, None), (3, [float("nan"), 1.0])],
        "vec_id long, embedding array<float>",
    )
    clashing = vectors.select("*", *[F.lit(None).cast("string").alias(c) for c in ("score", "rank", "query_id", "id")])
    found = topk.report(clashing).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, topk.report(vectors).collect()))
    assert {r["query_id"] for r in found} == {0} and len(found) == 3
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (None, None, None)], "page_id long, url string, html string")
    wide = pages.select("*", *[F.lit("x").alias(c) for c in ("start", "length", "sha256", "status", "archive", "record")])
    assert warc.report(wide, F.lit(False), F.lit(False)).count() == 3


def test_stages_keep_columns_and_clean_rows(spark, odd):
    redacted = pii.redact(odd)
    assert redacted.columns == odd.columns and redacted.count() == odd.count()
    assert {r["pii"] for r in redacted.where("doc_id > 3").collect()} == {"pii"}
    assert redacted.where("text like '%<EMAIL>%<PHONE>%'").count() == 1
    kept = simhash.distinct_documents(odd)
    assert kept.columns == odd.columns
    # one of the two equal texts stays; texts without words are kept apart by the text itself, null as empty
    # (a null key is the largest, so the empty text stays and the null one goes)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert kept.where("doc_id = 4").first()["_content"] == "_content"
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert mixed.where("doc_id > 3 and (copies <> 'copies' or _row <> '_row')").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0, name
