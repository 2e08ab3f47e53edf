from quire.operators import rules
from quire.sources import pdf, sinks


def test_composite_fonts_and_cmyk_through_references(spark):
    head = [b"<< /Pages 2 0 R /Type /Catalog >>", b"<< /Count 0 /Kids [] /Type /Pages >>"]
    font = lambda file: [*head, b"<< /Type /Font /Subtype /Type0 /DescendantFonts [4 0 R] >>", b"<< /Type /Font /Subtype /CIDFontType2 /FontDescriptor 5 0 R >>", b"<< /Type /FontDescriptor %s >>" % file, sinks.stream(b"x")]
    space = lambda end: [*head, b"<< /ColorSpace 4 0 R >>", b"[/ICCBased 5 0 R]", b"<< /N 4 /Alternate 6 0 R /Length 0 >>\nstream\n\nendstream", end]
    files = [font(b"/FontFile2 6 0 R"), font(b""), space(b"[/Separation /Spot /DeviceCMYK 3 0 R]"), space(b"/DeviceRGB"), [*head, b"<< /ColorSpace << /A [/Indexed /DeviceCMYK 1 <00>] >> >>"], [*head, b"<< /Type /Font /Subtype /Type3 >>"]]
    rows = spark.createDataFrame([(i, sinks.pdf_bytes(f)) for i, f in enumerate(files)], "doc_id long, content binary")
    found = {r.doc_id: r.rule for r in rules.first_violation(rules.archive_violations(pdf.objects(rows))).collect()}
    assert found == {1: "font-not-embedded", 2: "cmyk-without-profile", 4: "cmyk-without-profile"}
    assert "MapInArrow" not in rules.archive_violations(pdf.objects(rows))._jdf.queryExecution().toString()  # no rule parses the files again


def test_trees_and_facts_come_of_one_parse(spark):
    from quire.plans.files import RULES
    from quire.sources import structure

    rows = spark.createDataFrame([(i, structure.tagged_pdf(r)) for i, r in enumerate(RULES)] + [(20, b"no file")], "doc_id long, content binary")
    got = structure.counted_facts(rows)
    assert got.select(structure.facts(rows).columns).exceptAll(structure.facts(rows)).count() == 0
    counts = {r.doc_id: (r.elements, r.actual, r.n_claims) for r in got.collect()}
    trees = {r.doc_id for r in structure.elements(rows).where("error is null").collect()}
    assert counts == {i: (2, "said", 1) if i in trees else (None, None, None) for i in [*range(11), 20]} and len(trees) == 10
    assert "Join" not in got._jdf.queryExecution().toString()
