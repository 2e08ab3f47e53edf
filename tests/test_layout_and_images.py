import zlib

import numpy as np
import pandas as pd
import pytest

from quire import jobs
from quire.operators import layout
from quire.sources import images, sinks
from quire.sources.pdf import Document, Stream


def page(*runs):
    return pd.DataFrame([(1, 1, i, *map(float, r)) for i, r in enumerate(runs)], columns=["doc_id", "page", "seq", "x", "y", "w", "h"])


@pytest.mark.parametrize("gap,blocks", [(5, 1), (8, 1), (12, 1), (13.5, 1), (14, 2)])
def test_lines_join_a_block_up_to_the_gap(gap, blocks):
    out = layout.cluster_page(page((0, 100, 50, 10), (0, 100 - 10 - gap, 50, 10)))
    assert out["block"].nunique() == blocks and out["line"].nunique() == 2


def test_columns_clusters_and_order():
    # two columns, written row by row; runs of one baseline out of order; a baseline that drifts by less than half a height
    runs = [(x + 30 * k, 700 - 15 * n + (2 if k else 0), 28, 10) for n in range(3) for x in (300, 0) for k in (1, 0)]
    out = layout.cluster_page(page(*runs)).sort_values("seq")
    left = out["x"] < 200
    assert out["line"].nunique() == 6 and out["block"].nunique() == 2
    assert set(out["order"][left]) == {0} and set(out["order"][~left]) == {1}
    tall = layout.cluster_page(page((0, 100, 10, 10), (12, 94, 10, 40)))  # the newcomer's own height does not widen the cluster
    assert tall["line"].nunique() == 2
    assert len(layout.cluster_page(page())) == 0


def stream(data, entries):
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n" % (len(z := zlib.compress(data)), entries) + z + b"\nendstream"


def one_page(content, *extra, resources=b"/XObject << /Im 5 0 R >>"):
    objects = [b"<< /Pages 2 0 R /Type /Catalog >>", b"<< /Count 1 /Kids [3 0 R] /MediaBox [0 0 20 20] /Type /Pages >>", b"<< /Contents 4 0 R /Parent 2 0 R /Resources << %s >> /Type /Page >>" % resources, sinks.stream(content), *extra]
    return sinks.pdf_bytes(objects)


RGB = bytes(range(0, 240, 20))  # two by two pixels
IMAGE = b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 "


def painted(spark, *files):
    rows = jobs.page_pixels(spark.createDataFrame(list(enumerate(files)), "doc_id long, content binary"), 20, 20).collect()
    return [{(r["row"], r["col"]): (r.r, r.g, r.b) for r in rows if r.doc_id == i} for i in range(len(files))]


def test_images_masks_and_clips_are_painted(spark):
    draw = b"q 10 0 0 10 5 5 cm /Im Do Q"
    plain = one_page(draw, stream(RGB, IMAGE + b"/ColorSpace /DeviceRGB"))
    soft = one_page(draw, stream(RGB, IMAGE + b"/ColorSpace /CalRGB /SMask 6 0 R".replace(b"/CalRGB", b"[/CalRGB << >>]")), stream(bytes([255, 0, 51, 255]), IMAGE + b"/ColorSpace /DeviceGray"))
    keyed = one_page(draw, stream(bytes([0, 1, 1, 0]), IMAGE + b"/ColorSpace [/Indexed /DeviceRGB 1 <FF000000FF00>] /Mask [1 1]"))
    stencil = one_page(b"0 0 1 rg " + draw, stream(bytes([0b10000000, 0b01000000]), b"/Subtype /Image /ImageMask true /Width 2 /Height 2 /BitsPerComponent 1"))
    clipped = one_page(b"5 5 4 4 re W n 0 0 20 20 re f")
    got = painted(spark, plain, soft, keyed, stencil, clipped)
    assert len(got[0]) == 100 and got[0][(5, 5)] == (0, 20, 40) and got[0][(14, 14)] == (180, 200, 220) and got[0][(5, 14)] == (60, 80, 100)
    assert (5, 14) not in got[1] and got[1][(14, 5)] == tuple(int(np.floor((v / 255 * 0.2 + 0.8) * 255 + 0.5)) for v in (120, 140, 160))
    assert got[2] == {k: (255, 0, 0) for k in [(r, c) for r in range(5, 10) for c in range(5, 10)] + [(r, c) for r in range(10, 15) for c in range(10, 15)]}
    assert got[3] == {k: (0, 0, 255) for k in got[2]}
    assert got[4] == {(r, c): (0, 0, 0) for r in range(11, 15) for c in range(5, 9)}


def test_colour_spaces_policies_and_refusals(spark):
    spaces = b"/ColorSpace << /S [/Separation /Spot /DeviceCMYK << /FunctionType 2 /N 1 /C0 [0 0 0 0] /C1 [0 1 0 0] >>] /X [/Indexed /DeviceGray 1 <00FF>] >>"
    tint = one_page(b"/S cs 1 scn 0 0 20 20 re f", resources=spaces)
    index = one_page(b"/X cs 1 sc 0 0 20 20 re f", resources=spaces)
    got = painted(spark, tint, index)
    assert set(got[0].values()) == {(255, 0, 255)} and set(got[1].values()) == {(255, 255, 255)}
    groups = b"/Properties << /A << /Type /OCMD /OCGs [5 0 R 6 0 R] /P /%s >> >>"
    base = lambda p: one_page(b"/OC /A BDC 0 0 20 20 re f EMC", b"<< /Type /OCG >>", b"<< /Type /OCG >>", resources=groups % p).replace(b"/Type /Catalog", b"/Type /Catalog /OCProperties << /D << /OFF [5 0 R] >> >>")
    shown = [bool(x) for x in painted(spark, *map(base, (b"AnyOn", b"AllOn", b"AnyOff", b"AllOff")))]
    assert shown == [True, False, True, False]
    doc = Document.open(tint)
    with pytest.raises(ValueError, match="undefined"):
        images.pixels(doc, Stream({"Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": "Nope", "Filter": "FlateDecode"}, zlib.compress(RGB)))


def test_pages_of_many_blocks_and_of_words_that_are_not_shuffled(spark, monkeypatch):
    import __spark_entry__ as entry
    from quire.plans.common import glyph_arrays, glyphs

    for seed, (x, y, w) in enumerate(((300, 900, 20), (3000, 3000, 60), (2000, 300, 8))):
        r = np.random.default_rng(seed)
        runs = page(*zip(r.integers(0, x, 300), r.integers(0, y, 300), r.integers(1, w, 300), r.integers(3, 14, 300)))
        few = layout.cluster_page(runs)
        monkeypatch.setattr(layout, "MANY", 2)  # all blocks are compared at once beyond two
        assert layout.cluster_page(runs).equals(few) and few["block"].max() > 2
        monkeypatch.undo()
    data = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for doc_id, rows in glyphs(spark, data).orderBy("pos").toPandas().groupby("doc_id"):
        words, *numbers = glyph_arrays(text[doc_id], doc_id)
        assert words == rows["tok"].tolist() and all(v.tolist() == rows[c].tolist() for v, c in zip(numbers, ("pos", "x", "y", "w", "h")))
    for name in ("extract_text", "reading_order"):
        plan = entry.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert not any(step in plan for step in ("Window", "Generate", "FlatMapGroups"))
