from conftest import rows
from pagewright.operators import reports
from pagewright.plans import queries
from pagewright.sources import pages
from pagewright.streaming.pages import clean_stream


def test_images(spark):
    got = rows(reports.page_image_context(queries.images(spark)))
    assert ("D1", 0, "\n[IMAGE 1: Text in image: Count the cubes here | Visual: a row of cubes]\n[IMAGE 3: Visual: a number line]\n") in got
    assert ("D1", 1, "\n[IMAGE 1: [Image: no content detected]]\n") in got and ("D2", 0, "\n[IMAGE 2: Could not extract — bad xref]\n") in got


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("page one\fpage two")
    got = pages.read_documents(spark, str(tmp_path / "in")).select("page_number", "raw_text")
    assert rows(got) == [(0, "page one"), (1, "page two")]
    concepts = spark.createDataFrame([("D", "Sums", ["Counting"])], "doc_id string, name string, prerequisites array<string>")
    reports.write_concepts(concepts, str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out")).select("value")) == [('{"concepts":[{"name":"Sums","prerequisites":["Counting"]}]}',)]
    lines = spark.createDataFrame([("D", 1, None, -1, "second"), ("D", 0, None, -1, "first")], "doc_id string, part int, concept_id bigint, ord int, line string")
    reports.write_report(lines, str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).select("value").coalesce(1).collect()] == ["first", "second"]


def test_provider_keeps_failures(spark):
    def load():
        return lambda batch: [1 / x for x in batch]

    call = pages.provider(load, "double")
    got = [r.a for r in spark.createDataFrame([(2.0,), (0.0,)], "x double").select(call("x").alias("a")).collect()]
    assert got[0].value == 0.5 and got[1].value is None and "zero" in got[1].error


def test_stream(spark, tmp_path):
    spark.createDataFrame([("D", 0, "Lesson 3\nSome good words", None)], "doc_id string, page_number int, raw_text string, loaded_at timestamp").write.parquet(str(tmp_path / "in"))
    q = clean_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("cleaned").select("text")) == [("Some good words",)]
