import pytest

from quire import jobs
from quire.plans.files import text_pdf
from quire.sources import pdf, rewrite, sinks, structure
from quire.sources.pdf import Document, Ref

SQUARE = b"100 100 moveto 100 0 rlineto 0 100 rlineto -100 0 rlineto closepath fill showpage"


def test_jobs_on_files(spark):
    files = spark.createDataFrame([(1, SQUARE), (2, b"1 0 0 setrgbcolor 10 setlinewidth 0 100 moveto 200 100 lineto stroke"), (3, b"1 0 div"), (4, structure.tagged_pdf()), (5, text_pdf("Some text", 1))], "doc_id long, content binary")
    ink = {r.doc_id: r for r in jobs.inkcov(files, 200, 200).collect()}
    assert ink[1].ink_r == 0.25 and ink[2].ink_r == 0.0 and abs(ink[2].ink_g - 0.05) < 0.002
    box = {r.doc_id: (r.llx, r.lly, r.urx, r.ury) for r in jobs.bbox(files, 200, 200).collect()}
    assert box[1] == (100, 100, 200, 200)
    assert {r.doc_id: r.bytes[:4] for r in jobs.render(files, "png", 200, 200).collect()}[1] == b"\x89PNG"
    assert [(r.doc_id, r.txt) for r in jobs.text(files).where("doc_id = 5").collect()] == [(5, "Some text\r\n")]
    errors = {r.doc_id: r.error for r in jobs.validate(files).collect()}
    assert errors[1] is None and errors[3] == "undefinedresult" and errors[4] is None


def test_arguments():
    assert jobs.from_arguments(["-dBATCH", "-sDEVICE=png16m", "-r144", "-sPageList=1-3,4", "a.ps"]) == ("raster", {"dpi": 144, "pages": (1, 4), "inputs": ["a.ps"], "kind": "png"})
    assert jobs.from_arguments(["-q", "-sDEVICE=pdfimage24", "-dFirstPage=2", "-dLastPage=5", "-dDEVICEWIDTHPOINTS=50", "-f", "a.pdf"]) == ("pdfimage", {"pages": (2, 5), "width": 50, "inputs": ["a.pdf"]})
    bad = (["-sDEVICE=nope"], ["x.ps"], ["-sDEVICE=bbox", "-dOther"], ["-sDEVICE=bbox", "-sPageList=2,1"], ["-sDEVICE=jpeg"], ["-sDEVICE=bbox", "-dNOSAFER"], ["-sDEVICE=bbox", "-dSAFER=false"], ["-sDEVICE=pdfwrite", "-r72", "a"], ["-sDEVICE=bbox", "a", "b"], ["-sDEVICE=bbox", "@x"])
    for argv in bad:
        with pytest.raises(ValueError):
            jobs.from_arguments(argv)


def test_each_device_runs_from_its_arguments(spark, tmp_path):
    (tmp_path / "a.ps").write_bytes(SQUARE + b" " + SQUARE.replace(b"fill", b"0.5 setgray fill"))
    (tmp_path / "b.pdf").write_bytes(structure.tagged_pdf())
    size = ["-dDEVICEWIDTHPOINTS=200", "-dDEVICEHEIGHTPOINTS=200"]
    run = lambda device, *more: jobs.run_arguments(spark, [f"-sDEVICE={device}", *more, f"file://{tmp_path}/a.ps"]).collect()
    heads = {"png16m": b"\x89PNG", "ppmraw": b"P6\n4", "tiff24nc": b"II*\0"}
    for device, head in heads.items():
        rows = run(device, "-r144", *size)
        assert [r.page for r in sorted(rows)] == [1, 2] and all(r.bytes[:4] == head for r in rows)
    assert [(r.page, r.llx, r.ury) for r in run("bbox", "-r144", "-sPageList=2", *size)] == [(2, 100, 200)]
    assert {r.ink_r for r in run("inkcov", *size)} == {0.25}
    image = run("pdfimage24", *size)[0].bytes
    again = spark.createDataFrame([(1, image)], "doc_id long, content binary")
    first = spark.createDataFrame([(1, (tmp_path / "a.ps").read_bytes())], "doc_id long, content binary")
    assert pdf.info(again).first().pages == 2
    assert {r.offset for r in jobs.compare_pages(first, again, 200, 200).collect()} == {-1}
    assert [tuple(r)[1:] for r in jobs.compare_files(first, again).collect()] == [(False, 0, "byte")]
    written = jobs.run_arguments(spark, ["-sDEVICE=pdfwrite", f"file://{tmp_path}/b.pdf"]).first()
    assert written.error is None and written.bytes.startswith(b"%PDF-1.4")
    ps = jobs.to_postscript(first, 200, 200).first().bytes
    third = spark.createDataFrame([(1, ps)], "doc_id long, content binary")
    assert {r.offset for r in jobs.compare_pages(first, third, 200, 200).collect()} == {-1}


def test_copies_say_the_same(spark):
    raw = sinks.pdf_bytes([b"<< /Pages 2 0 R /Type /Catalog >>", b"<< /Count 1 /Kids [3 0 R] /MediaBox [0 0 20 20] /Type /Pages >>", b"<< /Contents 4 0 R /Parent 2 0 R /Resources << /XObject << /Im 5 0 R >> >> /Type /Page >>", sinks.stream(b"1 0 0 rg 0 0 9 9 re f q 4 0 0 4 9 9 cm /Im Do Q", compress=False),
                           b"<< /Length 4 /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /ASCIIHexDecode >>\nstream\n00FF\nendstream", sinks.stream(bytes([0, 80, 160, 240]), b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray")])
    raw = raw.replace(b"/Im 5 0 R", b"/Im 6 0 R")
    files = spark.createDataFrame([(1, raw), (2, b"no pdf")], "doc_id long, content binary")
    view = lambda df: [tuple(r) for r in jobs.page_pixels(df, 20, 20).orderBy("row", "col").collect()]
    want = view(files.where("doc_id = 1"))
    for level, pack in ((0, False), (1, True), (2, False), (2, True)):
        out = {r.doc_id: r for r in rewrite.rewrite(files, level, pack).collect()}
        assert out[2].error == "syntaxerror"
        if level != 1:
            assert view(spark.createDataFrame([(1, bytes(out[1].bytes))], "doc_id long, content binary")) == want
        doc = Document.open(out[1].bytes)
        assert not doc.rebuilt and (doc.get(Ref(4, 0)).dict.get("Filter") == "FlateDecode") == (level > 0)
        assert doc.get(Ref(6, 0)).dict["ColorSpace"] == ("DeviceRGB" if level == 2 else "DeviceGray")
        assert rewrite.copy(doc, pack=pack) == bytes(out[1].bytes)  # a copy of a copy is the same
    assert rewrite.rewrite(files.where("doc_id = 1"), 3).first().error == "unsupported"
