"""Readers, writers and streams."""

import json

from docspark.sources import files as S
from docspark.streaming.ingest import first_seen, stream


def test_images_csv_and_annotations(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("a/x.png", "a/y.txt", "z.JPG", "b.jpg"):
        (tmp_path / n).write_bytes(b"12345")
    got = S.image_files(spark, str(tmp_path), content=True).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["x.png", "b.jpg"] and got[0].length == 5
    (tmp_path / "n").mkdir()
    (tmp_path / "n/inv1_hugg_train.json").write_text(json.dumps({"NUMBER": {"text": "7"}, "DATE": {"text": "d"}}))
    r = S.annotations(spark, str(tmp_path / "n")).first()
    assert r.stem == "inv1" and r.fields == {"NUMBER": "7", "DATE": "d"}


def test_cache_and_sinks(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text(json.dumps({"doc_id": "d1", "full_text": "x", "words": [{"word_id": 0, "text": "x", "conf": 90.0}]}))
    cache = S.ocr_cache(spark, str(tmp_path / "c"))
    assert S.ocr_parts(cache, "words").first().text == "x"
    base = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    assert [r.doc_id for r in S.missing_from_cache(base, cache).collect()] == ["d2"]
    df = spark.createDataFrame([("a", "train", None), ("b", "test", "bad")], "doc_id string, split string, error string")
    S.write_splits(df, str(tmp_path / "s"))
    S.append_failures(df, str(tmp_path / "f"))
    S.write_csv(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and spark.read.json(str(tmp_path / "f")).count() == 1


def test_stream_drops_repeats(spark, tmp_path):
    like = spark.sql("SELECT 'k1' AS k, timestamp'2024-01-01 00:00:00' AS ts")
    for i in range(2):
        like.write.mode("append").parquet(str(tmp_path / "in"))
    q = first_seen(stream(spark, str(tmp_path / "in"), like), "k", "ts").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 1
