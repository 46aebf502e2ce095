"""Timeline files and published documents: what is rejected, and what stays as it is."""

import json

from pyspark.sql import functions as F

from captionlake.sources import outputs, timelines


def test_timelines_with_other_names_and_rejects(spark, tmp_path, monkeypatch):
    good = {"language": "en", "words": [{"index": 7, "start": " 1.5 ", "word": "a", "probability": "0.5"}, {"start": "x", "end": 2}], "segments": [], "semanticUnits": [{"id": 1.5, "start": 1, "end": "2", "text": 3, "wordStart": "0", "word_end": 2.0}]}
    files = {
        "good": json.dumps(good).encode(), "invalidUTF8": b'{"words": "\xff"}', "invalidJSON": b"[1, 2", "invalidJSON2": b"[]", "missingWords": b'{"segments": [], "semantic_units": []}',
        "missingSegments": b'{"words": [], "segments": {}, "semantic_units": []}', "missingSemanticUnits": b'{"words": [], "segments": [], "semantic_units": null, "semanticUnits": []}', "missingWords2": b'{"words": [1], "segments": [], "semantic_units": []}',
        "unexpectedlyLarge": b'{"words": [], "segments": [], "semantic_units": []}' + b" " * 3000,
    }
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_bytes(content)
    monkeypatch.setattr(timelines, "MOST_BYTES", 2000)
    read = timelines.timeline_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    assert {r.name: r.code for r in timelines.timeline_rejects(read, "name").collect()} == {n: n.rstrip("2") for n in files if n != "good"}
    assert [(r.name, r.version, r.language) for r in timelines.timeline_heads(read, "name").collect()] == [("good", "1", "en")]
    words = timelines.read_timelines(read, "words", "name").orderBy("place").collect()
    assert [(w.id, w.start_ms, w.end_ms, w.text, w.confidence) for w in words] == [("7", 1500, 1500, "a", 0.5), ("", 0, 2000, "", None)]
    unit = timelines.read_timelines(read, "semantic_units", "name").collect()
    assert [(u.id, u.start_ms, u.end_ms, u.text, u.word_start, u.word_end) for u in unit] == [("1.5", 1000, 2000, "3", 0, 2)]


def test_a_changed_destination_stays(spark, tmp_path):
    folder = str(tmp_path / "published")
    docs = lambda text, *ids: spark.createDataFrame([(i, lang, f"{text} {i}\n") for i in ids for lang in ("de", "en")], "media_id long, lang string, document string")
    none = spark.createDataFrame([], "media_id long, lang string, sha string")
    assert outputs.read_documents(spark, folder).count() == 0
    assert {r.action for r in outputs.publish(docs("first", 1, 2), none, folder).collect()} == {"create"}
    approved = spark.createDataFrame([tuple(r) for r in outputs.fingerprints(spark, folder).collect()], "media_id long, lang string, sha string")
    outputs.publish(docs("changed", 2).where("lang = 'en'"), approved, folder)  # another hand changes one of them
    got = {(r.media_id, r.lang): r.action for r in outputs.publish(docs("second", 1, 2, 3), approved, folder).collect()}
    assert got == {(1, "de"): "replace", (1, "en"): "replace", (2, "de"): "replace", (2, "en"): "conflict", (3, "de"): "create", (3, "en"): "create"}
    there = {(r.media_id, r.lang): r.document for r in outputs.read_documents(spark, folder).collect()}
    assert there == {(i, lang): f"second {i}\n" if (i, lang) != (2, "en") else "changed 2\n" for i in (1, 2, 3) for lang in ("de", "en")}
    assert {r.action for r in outputs.publish(docs("third", 1), none, folder).collect()} == {"conflict"}  # it was absent when approved, and isn't now


def test_published_documents_share_files(spark, tmp_path):
    """A file for each output is millions of files, which the driver would list and move one after another."""
    folder = str(tmp_path / "published")
    docs = spark.range(300, numPartitions=3).select(F.col("id").alias("media_id"), F.lit("en").alias("lang"), F.concat(F.lit("a\n\n"), F.col("id").cast("string"), F.lit("\n")).alias("document"))
    none = spark.createDataFrame([], "media_id long, lang string, sha string")
    outputs.publish(docs, none, folder)
    approved = outputs.fingerprints(spark, folder)
    outputs.publish(docs.where("media_id < 10").withColumn("document", F.lit("new")), approved, folder)
    got = {r.media_id: r.document for r in outputs.read_documents(spark, folder).collect()}
    assert got == {i: "new" if i < 10 else f"a\n\n{i}\n" for i in range(300)}
    assert len(list((tmp_path / "published").rglob("*.parquet"))) < 60
