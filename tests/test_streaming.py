from quire.plans.files import text_pdf
from quire.sources import pdf
from quire.streaming.files import arriving


def test_files_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(text_pdf("one", 1))
    query = arriving(spark, f"file://{tmp_path}/in", pdf.info, "*.pdf").writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        (tmp_path / "in/b.pdf").write_bytes(b"broken")
        (tmp_path / "in/c.txt").write_bytes(b"other")
        query.processAllAvailable()
        rows = {r.doc_id.rsplit("/", 1)[1]: (r.pages, r.error) for r in spark.sql("select * from arrived").collect()}
    finally:
        query.stop()
    assert rows == {"a.pdf": (1, None), "b.pdf": (None, "syntaxerror")}
