import base64
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import compare, layout, measure, raster
from quire.plans.files import text_pdf
from quire.sources import codecs, content, pdf, postscript, sinks

SQUARE = b"100 100 moveto 100 0 rlineto 0 100 rlineto -100 0 rlineto closepath fill showpage"


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_filters_round_trip(data):
    import base64

    assert codecs.lzw(codecs.lzw_encode(data)) == data
    assert codecs.lzw(codecs.lzw_encode(data, 0), 0) == data
    assert codecs.ascii85(base64.a85encode(data) + b"~>") == data
    assert codecs.ascii_hex(data.hex().encode() + b">") == data
    assert codecs.decode("Fl", zlib.compress(data)) == data
    assert codecs.eexec(codecs.eexec_encrypt(data)) == data
    assert codecs.rc4(b"key", codecs.rc4(b"key", data)) == data


def test_long_lzw_and_predictors():
    data = bytes(np.random.default_rng(1).integers(0, 40, 60_000, dtype=np.uint8))
    assert codecs.lzw(codecs.lzw_encode(data)) == data
    rows = np.random.default_rng(2).integers(0, 256, (7, 12), dtype=np.uint8)
    step = np.diff(rows.reshape(7, 4, 3).astype(int), axis=1, prepend=0).astype(np.uint8)
    assert codecs.predict(step.tobytes(), 2, columns=4, colors=3) == rows.tobytes()
    up = np.diff(rows.astype(int), axis=0, prepend=0).astype(np.uint8)
    assert codecs.predict(b"".join(b"\x02" + r.tobytes() for r in up), 12, columns=4, colors=3) == rows.tobytes()
    for name, bad in (("ASCIIHexDecode", b"4x>"), ("ASCII85Decode", b"\x80"), ("FlateDecode", b"nonsense"), ("RunLengthDecode", b"\x05ab"), ("Nope", b""), ("JPXDecode", b"")):
        with pytest.raises(codecs.FilterError):
            codecs.decode(name, bad)


def test_codecs_of_damaged_and_large_input(spark):
    assert codecs.ascii85(b"z!!\n!!!zs8W-!~>rest") == bytes(12) + b"\xff" * 4
    for bad in (b"ab z", b"s8W-\"~", b"!", b"!!!!!v"):
        with pytest.raises(codecs.FilterError):
            codecs.ascii85(bad)
    data = np.random.default_rng(3).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    coded = codecs.lzw_encode(data)
    assert codecs.lzw(coded[:-2]) == data[: len(codecs.lzw(coded[:-2]))]  # without its end code
    with pytest.raises(codecs.FilterError):
        codecs.lzw(b"\xff" + coded)
    text = b"the quick brown fox, " * 50_000
    assert codecs.lzw(codecs.lzw_encode(text)) == text and codecs.ascii85(base64.a85encode(text)) == text
    import __spark_entry__ as entry

    plan = entry.queries()["filter_round_trips"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "PythonUDF" not in plan  # texts are read once, not for each filter


def test_square_measures(spark):
    """A square of 100 points on a page of 200: box 0.25 of the page."""
    files = spark.createDataFrame([(1, SQUARE), (2, b"1 0 div"), (3, b"")], "doc_id long, content binary")
    marks = postscript.run_postscript(files)
    assert {(r.doc_id, r.error) for r in marks.where("op is null").collect()} == {(2, "undefinedresult"), (3, None)}
    points = marks.where("op = 'fill'").select(F.col("doc_id").alias("path_id"), F.posexplode("points").alias("seq", "p")).select("path_id", "seq", "p.x", "p.y", "p.move")
    px = raster.fill(raster.edges_of(points), 200, 200).select(F.lit(1).alias("page"), F.col("row").alias("r_"), F.col("col").alias("c_"), *[F.lit(0).alias(c) for c in "rgb"])
    box = measure.bounding_box(px, 200).first()
    assert (box.llx, box.lly, box.urx, box.ury) == (100.0, 100.0, 200.0, 200.0)
    assert measure.ink(px, 200 * 200).first().ink_r == 0.25


def test_even_odd_and_nonzero(spark):
    rows = [(1, i, float(x), float(y), i % 4 == 0) for i, (x, y) in enumerate([(2, 2), (18, 2), (18, 18), (2, 18), (6, 6), (14, 6), (14, 14), (6, 14)])]
    edges = raster.edges_of(spark.createDataFrame(rows, "path_id int, seq int, x double, y double, move boolean"))
    assert raster.fill(edges, 20, 20).count() == 256
    assert raster.fill(edges, 20, 20, even_odd=True).count() == 256 - 64


def test_pdf_tables_and_damage(spark):
    good, bad = text_pdf("Hello world\nsecond é line ", 1), text_pdf("Hello world\nsecond é line ", 3)
    files = spark.createDataFrame([(1, good), (2, bad), (3, b"not a file"), (4, None), (5, good[:-200])], "doc_id long, content binary")
    text = {r.doc_id: r.txt for r in layout.page_text(content.pdf_glyphs(files).where("error is null")).collect()}
    assert text[1] == text[2] == "Hello world\r\nsecond é line\r\n"
    assert {(r.doc_id, r.error) for r in pdf.objects(files).where("error is not null").collect()} >= {(3, "syntaxerror"), (4, "syntaxerror")}
    kinds = {r.num: r.kind for r in pdf.objects(files).where("doc_id = 1").collect()}
    assert kinds == {1: "dict", 2: "dict", 3: "dict", 4: "stream", 5: "dict", 6: "dict"}
    assert pdf.info(files).where("doc_id = 1").first().version == "1.7"


def test_object_and_xref_streams():
    head = b"1 0 2 39 "
    body = b"<< /Type /Catalog /Pages 2 0 R >>      << /Type /Pages /Kids [] /Count 0 >>"
    out = bytearray(b"%PDF-1.5\n")
    at3 = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d >>\nstream\n" % (len(head), len(head) + len(body)) + head + body + b"\nendstream\nendobj\n"
    at4 = len(out)
    rows = b"".join(t.to_bytes(1, "big") + a.to_bytes(2, "big") + b.to_bytes(1, "big") for t, a, b in ((0, 0, 0), (2, 3, 0), (2, 3, 1), (1, at3, 0), (1, at4, 0)))
    out += b"4 0 obj\n<< /Type /XRef /W [1 2 1] /Size 5 /Root 1 0 R /Length %d >>\nstream\n" % len(rows) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at4
    doc = pdf.Document.open(bytes(out))
    assert not doc.rebuilt and [n for n, _, _ in doc.objects()] == [1, 2, 3, 4] and doc.get(pdf.Ref(2, 0))["Count"] == 0


def test_content_operators():
    page = b"q 2 0 0 2 10 10 cm 0 1 0 rg 0 0 5 5 re f Q 0 0 m 10 0 l 10 10 l b* /OC /Off BDC 1 1 1 1 re f EMC BX weird EX 0.5 g 3 3 2 2 re B"
    objects = [b"<< /Type /Catalog /Pages 2 0 R /OCProperties << /D << /OFF [5 0 R] >> >> >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R /Resources << /Properties << /Off 5 0 R >> >> >>", sinks.stream(page), b"<< /Type /OCG >>"]
    pages, error = content.interpret(sinks.pdf_bytes(objects))
    assert error is None
    assert [m[2] for m in pages[0].canvas.marks] == ["fill", "eofill", "stroke", "fill", "stroke"]
    assert pages[0].canvas.marks[0][3][2][:2] == (20.0, 20.0) and pages[0].canvas.marks[0][4:7] == (0, 255, 0)
    for bad, name in ((b"1 2 l", "nocurrentpoint"), (b"F", "undefined"), (b"Q", "limitcheck"), (b"(x) Tj", "invalidfont"), (b"1 w w", "stackunderflow"), (b"BX", "syntaxerror")):
        objects[3] = sinks.stream(bad)
        assert content.interpret(sinks.pdf_bytes(objects))[1] == name


def test_written_files_read_back():
    img = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    assert sinks.ppm(img).endswith(img.tobytes())
    raw = sinks.png(img)
    assert zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8])[1:16] == img[0].tobytes()
    doc = pdf.Document.open(sinks.image_pdf([img, img]))
    assert len(doc.pages()) == 2 and doc.decode(doc.get(doc.get(doc.pages()[1]["Resources"])["XObject"]["Im"])) == img.tobytes()
    ps = sinks.marks_to_postscript([[("fill", [(1.0, 1.0, True), (5.0, 1.0, False), (5.0, 5.0, False)], (255, 0, 0), 0.5)]], 10, 10)
    m = postscript.Interpreter()
    m.run(ps.decode())
    assert [k[2] for k in m.canvas.marks] == ["fill"] and m.shown == 1
    assert sinks.page_path("p%d.png", 3, 9) == "p3.png"


def test_page_lists():
    assert list(compare.page_selection("2-", 4)) == [2, 3, 4] and list(compare.page_selection("-9", 3)) == [1, 2, 3]
    assert compare.contiguous_page_list("1-3,4") == (1, 4)
    for bad in ("9", "0", "x", "3-2"):
        with pytest.raises(ValueError):
            compare.page_selection(bad, 4)
    for bad in ("1-3,5", "2,1", "1,,2", ""):
        with pytest.raises(ValueError):
            compare.contiguous_page_list(bad)


def test_aes_vectors():
    from quire.sources.crypt import Aes, cbc_decrypt, cbc_encrypt

    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for key, want in (("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"), ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089")):
        aes = Aes(bytes.fromhex(key))
        assert aes.encrypt_block(plain).hex() == want and aes.decrypt_block(bytes.fromhex(want)) == plain
    assert cbc_decrypt(plain, plain, cbc_encrypt(plain, plain, bytes(48))) == bytes(48)


@pytest.mark.parametrize("aes", [False, True])
def test_files_with_the_empty_password_open(aes):
    from quire.sources.crypt import protect

    page = b"0 0 10 10 re f"
    body, streams = protect([], {4: page}, aes=aes)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R >>", sinks.stream(streams[4], compress=False), body]
    data = sinks.pdf_bytes(objects).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R /ID [<%s> <00>]" % b"0123456789abcdef".hex().encode())
    doc = pdf.Document.open(data)
    assert not doc.rebuilt and doc.contents(doc.pages()[0]) == page
    with pytest.raises(pdf.PdfError, match="invalidaccess"):
        pdf.Document.open(data.replace(b"/P -4", b"/P -8"))


def test_text_is_laid_out_where_it_is_read(spark):
    page = b"BT /F 12 Tf 0.5 Tc 2 Tw 3 Ts 1 0.1 0 1.5 36 700 Tm (a b) Tj (  ) Tj 1 0 0 1 400 702 Tm (far) Tj 1 0 0 1 36 600 Tm (AB) Tj 1 0 0 1 36 500 Tm ( ) Tj ET"
    font = b"<< /BaseFont /Helvetica /Subtype /Type1 /Type /Font >>"
    objects = [b"<< /Pages 2 0 R /Type /Catalog >>", b"<< /Count 1 /Kids [3 0 R] /Type /Pages >>", b"<< /Contents 4 0 R /Parent 2 0 R /Resources << /Font << /F 5 0 R >> >> /Type /Page >>", sinks.stream(page), font]
    rows = spark.createDataFrame([(i, i * 3) for i in range(4)], "doc_id long, n long")
    made = pdf.Made(rows, "n", lambda n, i: sinks.pdf_bytes(objects) if n else b"nothing")
    glyphs = content.pdf_glyphs(made)
    assert glyphs.where("error is not null").count() == 1
    want = {r.doc_id: r.txt for r in layout.page_text(glyphs.where("error is null")).collect()}
    got = content.pdf_text(made)
    assert {r.doc_id: r.txt for r in got.collect()} == want and want[1] == "a b  far\r\nAB\r\n" and len(want) == 3
    assert "Window" not in got._jdf.queryExecution().toString() and "Exchange" not in got._jdf.queryExecution().toString()


def test_files_are_made_and_parsed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pdf, "PIECE_BYTES", 3000)
    rows = spark.createDataFrame([(i, f"line\nof {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    made = pdf.Made(rows, "text", lambda t, i: text_pdf(t, i) if i != 7 else b"nothing")
    found = pdf.each_file(made, "n long, error string", {"n": pdf.pa.int64(), "error": pdf.pa.string()}, lambda content: [(len(content), None)] * 2)
    assert found.count() == 80
    got = {r.doc_id: tuple(r)[1:] for r in pdf.counts(made).collect()}
    assert got.pop(7) == (*[None] * 6, "syntaxerror") and set(got.values()) == {(6, 1, 6, 6, 612.0, 792.0, None)} and len(got) == 39
    import __spark_entry__ as entry

    plan = entry.queries()["pdf_objects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 4  # one kernel, in each of four plans


def test_shapes_are_cut_without_dealing_pixels(spark, monkeypatch):
    import __spark_entry__ as entry

    rng = np.random.default_rng(5)
    rows = [(None if i == 39 else i // 3, (i // 3, 1), [(float(x), float(y), k % 4 == 0) for k, (x, y) in enumerate(rng.uniform(-5, 45, (11, 2)).round(1))]) for i in range(40)]  # three rows a path
    shape = "path_id long, place struct<a:int,b:int>, points array<struct<x:double,y:double,move:boolean>>"
    paths = spark.createDataFrame(rows, shape).repartition(3)

    def edges(pts):
        subs: list[list] = []
        for x, y, move in pts:
            subs.append([]) if move else None
            subs[-1].append((x, y))
        return [(p, q) for s in subs for p, q in zip(s, s[1:] + s[:1])]

    def inside(key, odd):
        e, out = [x for k, _, pts in rows if k == key for x in edges(pts)], set()
        for r in range(40):
            cy = 40 - r - 0.5
            hits = [(x0 + (cy - y0) / (y1 - y0) * (x1 - x0), 1 if y1 > y0 else -1) for (x0, y0), (x1, y1) in e if y0 != y1 and min(y0, y1) <= cy < max(y0, y1)]
            for c in range(40):
                wind = sum(d for x, d in hits if x > c + 0.5)
                if wind % 2 if odd else wind:
                    out.add((r, c))
        return out

    def near(key, half):
        e, out = [x for k, _, pts in rows if k == key for x in edges(pts)], set()
        y, x = np.mgrid[0:40, 0:40]
        for (x0, y0), (x1, y1) in e:
            px, py, dx, dy = x + 0.5, 40 - y - 0.5, x1 - x0, y1 - y0
            t = np.clip(((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy or 1), 0, 1)
            out |= set(zip(*(v.tolist() for v in np.nonzero(np.sqrt((px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2) <= half))))
        return out

    keys = {k for k, _, _ in rows}
    segments = spark.createDataFrame([(k, float(a[0]), float(a[1]), float(b[0]), float(b[1]), 1.5) for k, _, pts in rows for a, b in edges(pts)], "path_id long, x0 double, y0 double, x1 double, y1 double, half double")
    pixel = lambda df: {k: {(r.row, r.col) for r in got if r.path_id == k} for got in [df.collect()] for k in {r.path_id for r in got}}
    for piece in (raster.PIECE, 40):  # whole, and in bands of rows
        monkeypatch.setattr(raster, "PIECE", piece)
        for odd in (False, True):
            found = raster.fill_paths(paths, F.col("points"), 40, 40, odd)
            assert found.count() == found.distinct().count()
            assert pixel(found) == {k: inside(k, odd) for k in keys}
        assert pixel(raster.stroke_wide(segments, 40, 40)) == {k: near(k, 1.5) for k in keys}
        totals = {r.path_id: (r.n, r.rows, r.cols) for r in raster.fill_paths(paths, F.col("points"), 40, 40, totals=True).collect()}
        assert totals == {k: (len(p), sum(r for r, _ in p), sum(c for _, c in p)) for k in keys for p in [inside(k, False)]}
    by_struct = raster.fill_paths(paths.where("path_id is not null").select("place", "points"), F.col("points"), 40, 40, path="place").groupBy("place.a").count().collect()
    assert {r.a: r["count"] for r in by_struct} == {k: len(inside(k, False)) for k in keys if k is not None}
    for name in ("polygon_fill", "postscript_shapes", "stroke_segments"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any(step in plan for step in ("Window", "Aggregate", "Generate"))


def test_page_lists_meet_once_in_tasks_of_bounded_size(spark, monkeypatch):
    import __spark_entry__ as entry
    from quire.plans import common

    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "a"), (3, 2, "c"), (4, 1, None), (5, 1, "q"), (None, 1, "n")], "doc_id long, page int, digest string")
    two = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "a"), (3, 1, "b"), (3, 2, "d"), (4, 1, None), (6, 3, "q"), (None, 1, "n")], "doc_id long, page int, digest string")
    got = {r.doc_id: (r.reason, r.page) for r in compare.first_failing_page(one, two).collect()}
    assert got == {1: ("equal", None), 2: ("length", None), 3: ("page", 1), 4: ("equal", None), 5: ("length", None), 6: ("length", None), None: ("page", 1)}
    monkeypatch.setattr(common, "TASK_ROWS", 500)
    df = entry.queries()["compare_page_lists"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") and "doc_id" in plan
    assert df.rdd.getNumPartitions() == -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)


def test_checksums_of_long_texts(spark):
    from quire.operators import fonts

    data = [None, b"", b"a", b"abcd", b"\xff" * 9, np.random.default_rng(7).bytes(3_000_001)]
    rows = spark.createDataFrame(list(enumerate(data)), "i int, data binary")
    got = dict(rows.select("i", fonts.checksum(F.col("data"))).collect())
    want = [sum(int.from_bytes(v[k : k + 4].ljust(4, b"\0"), "big") for k in range(0, len(v), 4)) % (1 << 32) if v else 0 for v in data]
    assert [got[i] for i in range(6)] == want
    assert "aggregate(" not in rows.select(fonts.checksum(F.col("data")))._jdf.queryExecution().optimizedPlan().toString()
