import time

from inkfall.sources import files, pdf
from inkfall.streaming import logs


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"a\xffb")
    (tmp_path / "in" / "B.MD").write_text("# 标题")
    (tmp_path / "in" / "c.pdf").write_bytes(b"raw\xfe bytes")
    docs = files.read_documents(spark, str(tmp_path / "in"), pdf=lambda content: 1 / 0)
    assert {r.filename: r.content_text for r in docs.collect()} == {"a.txt": "ab", "B.MD": "# 标题", "c.pdf": "raw bytes"}
    found = files.read_documents(spark, str(tmp_path / "in"), pdf=lambda content: ["one", "two"])
    assert found.where("filename = 'c.pdf'").first().content_text == "one\n\ntwo"
    one = found.first()
    assert files.get_document(found, one.id).first().filename == one.filename
    path, size = files.save_upload(b"xyz", "../../etc/passwd", str(tmp_path / "up"), "id1")
    assert path.endswith("up/id1_passwd") and size == 3 and files.upload_id(path) == "id1" and files.safe_name("..") == files.safe_name(None) == "upload"


def test_pdf_parsers_degrade(spark, tmp_path):
    bad = tmp_path / "x.pdf"
    bad.write_bytes(b"no pdf")
    assert pdf.page_count(str(bad)) == pdf.UNKNOWN_PAGES and pdf.elements_of(str(bad)) == []
    df = spark.createDataFrame([(1, str(bad), "the text"), (2, "y.txt", "other")], "doc_id int, file_path string, text string")
    from inkfall.plans import registry

    rows = registry.chunk(pdf.with_elements(df), "pdf_table_layout").orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["the text", "other"]
    text, changes = pdf.without_furniture([{"text": "h", "category": "Header"}, {"text": "b", "category": "Text"}])
    assert text == "b" and [c["op"] for c in changes] == ["layout_remove", "layout_reorder"]


def test_log_stream(spark, tmp_path):
    log, out = f"{tmp_path}/log", f"{tmp_path}/history"
    first = [{**logs.entry(f"m{i}", "info" if i % 2 else "error", "test", i, step=i), "timestamp": float(i)} for i in range(8)]
    logs.emit(spark, log, first)
    logs.keep_history(logs.subscribe(spark, log), out, limit=5).awaitTermination()
    assert [r.message for r in logs.history(logs.newest(spark, out), 3).collect()] == ["m5", "m6", "m7"]
    logs.emit(spark, log, [{**logs.entry("late", "warn"), "timestamp": 99.0}])
    logs.keep_history(logs.subscribe(spark, log), out, limit=5).awaitTermination()
    kept = logs.newest(spark, out)
    assert kept.count() == 5 and kept.where("message = 'late'").count() == 1
    assert {r.level: r.n for r in logs.level_counts(logs.of_level(kept, "info", "warn")).collect()} == {"info": 2, "warn": 1}
    stream = logs.windowed_counts(logs.subscribe(spark, log), "10 seconds", "1 minute")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("windowed").selectExpr("sum(n)").first()[0] == 9
    logs.clear(spark, out)
    assert logs.newest(spark, out).count() == 0 and logs.subscribers(spark) == 0 and time.time() > 0
