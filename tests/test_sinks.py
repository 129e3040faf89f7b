"""What is written: documents replace themselves only, and a batch that is repeated is there once."""

from corpusloom.sources.sinks import replace_documents
from corpusloom.streaming import streams


def test_replaced_documents_leave_the_others(spark, tmp_path):
    path, schema = f"{tmp_path}/index", "document_id bigint, kb_id string, term string"
    first = [(i, "en" if i % 3 else "de", f"t{i}") for i in range(200)]
    replace_documents(spark.createDataFrame(first, schema), path)
    again = spark.createDataFrame([(1, "en", "new"), (1, "en", "newer"), (500, "fr", "x")], schema)
    for _ in range(2):
        replace_documents(again, path)
        got = sorted((r["document_id"], r["kb_id"], r["term"]) for r in spark.read.parquet(path).collect())
        assert got == sorted([r for r in first if r[0] != 1] + [(1, "en", "new"), (1, "en", "newer"), (500, "fr", "x")])
    replace_documents(again.limit(0), path)
    assert spark.read.parquet(path).count() == len(got)


def test_a_repeated_batch_is_written_once(spark, tmp_path, monkeypatch):
    spark.range(10).selectExpr("id", "cast(id as string) as v").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = type(stream.writeStream)
    plain = writer.foreachBatch
    monkeypatch.setattr(writer, "foreachBatch", lambda self, put: plain(self, lambda batch, number: (put(batch, number), put(batch, number))))
    assert sorted(r["id"] for r in streams.drained(stream, "append").collect()) == list(range(10))
