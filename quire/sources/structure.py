"""Structure trees of tagged files: elements, claims on content, and the facts that accessibility rules ask for."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources import content
from quire.sources.pdf import FAULTS, Document, Made, PdfError, Ref, Stream, _scan_table, each_file, fault_name

PDF2 = "http://iso.org/pdf2/ssn"
STANDARD = set("Document DocumentFragment Part Div Aside Title Sub P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot Caption Figure Formula Form Span Quote Link Annot Note Code Em Strong Ruby Warichu Artifact Sect Art TOC TOCI Index BlockQuote NonStruct Private FENote Reference BibEntry".split())
HOPS = 16


def standard_role(role: str, roles: dict, doc: Document) -> str | None:
    """The standard type that a role stands for; None after a cycle, too many hops, or at an unknown name."""
    seen = set()
    while role not in STANDARD:
        if role in seen or len(seen) >= HOPS or role not in roles:
            return None
        seen.add(role)
        role = str(doc.get(roles[role]))
    return role


class Tree:
    def __init__(self, doc: Document):
        root = doc.get(doc.trailer["Root"])
        self.root = doc.get(root.get("StructTreeRoot"))
        self.elements: list[tuple] = []  # elem, parent, role, standard, namespace, page, actual text covering it
        self.items: list[tuple[int, int, int]] = []  # elem, page, mcid
        self.refs: dict[int, int] = {}
        if not isinstance(self.root, dict):
            raise PdfError("structtree")
        self.doc, self.roles = doc, doc.get(self.root.get("RoleMap")) or {}
        self.pages = {p["__num"]: i for i, p in enumerate(doc.pages(), 1)}
        self.walk(self.root.get("K"), -1, None, None, 0)

    def walk(self, kids, parent: int, page: int | None, actual: str | None, depth: int) -> None:
        if depth > 64:
            raise PdfError("limitcheck")
        value = self.doc.get(kids)
        for kid in value if isinstance(value, list) else [kids]:
            d = self.doc.get(kid)
            if isinstance(d, int) and not isinstance(d, bool):
                self.items.append((parent, page or 0, d))
            elif isinstance(d, dict) and d.get("Type") == "MCR":
                at = d.get("Pg")
                self.items.append((parent, self.pages.get(at.num, 0) if isinstance(at, Ref) else page or 0, int(d.get("MCID", -1))))
            elif isinstance(d, dict) and "S" in d:
                n = len(self.elements)
                if isinstance(kid, Ref):
                    if kid.num in self.refs:
                        raise PdfError("structtree")
                    self.refs[kid.num] = n
                at = d.get("Pg")
                own = self.pages.get(at.num) if isinstance(at, Ref) else page
                ns = self.doc.get(d.get("NS")) or {}
                name = self.doc.get(ns.get("NS")) if isinstance(ns, dict) else None
                text = self.doc.get(d.get("ActualText"))
                covered = text.decode("latin-1") if isinstance(text, bytes) else actual
                self.elements.append((n, parent, str(d["S"]), standard_role(str(d["S"]), self.roles, self.doc), name.decode("latin-1") if isinstance(name, bytes) else None, own, covered))
                if "K" in d:
                    self.walk(d["K"], n, own, covered, depth + 1)

    def parents(self) -> dict[int, object]:
        """The parent tree: key to element or list of elements."""
        out: dict[int, object] = {}

        def walk(node, depth: int) -> None:
            d = self.doc.get(node) or {}
            nums = self.doc.get(d.get("Nums")) or []
            out.update(zip(nums[::2], nums[1::2]))
            for kid in self.doc.get(d.get("Kids")) or []:
                if depth > 16:
                    raise PdfError("limitcheck")
                walk(kid, depth + 1)

        walk(self.root.get("ParentTree"), 0)
        return out

    def claims_agree(self) -> bool:
        """Every claim is found under its page's key in the parent tree, and names the claiming element."""
        parents, pages = self.parents(), self.doc.pages()
        for elem, page, mcid in self.items:
            key = pages[page - 1].get("StructParents") if 1 <= page <= len(pages) else None
            row = self.doc.get(parents.get(key))
            if not isinstance(row, list) or not 0 <= mcid < len(row) or not isinstance(row[mcid], Ref) or self.refs.get(row[mcid].num) != elem:
                return False
        return True


def elements(files: DataFrame | Made) -> DataFrame:
    """(doc_id, elem, parent, role, standard, namespace, page, actual, error)."""
    return _scan_table(files, "elem long,parent long,role string,standard string,namespace string,page long,actual string", lambda d: Tree(d).elements)


def items(files: DataFrame | Made) -> DataFrame:
    """(doc_id, elem, page, mcid, error): content that elements claim."""
    return _scan_table(files, "elem long,page long,mcid long", lambda d: Tree(d).items)


_FACTS = "marked boolean,tree boolean,roles boolean,claims boolean,documents long,content boolean,lang string,display boolean,uaid string,title string"


def _tree(doc: Document) -> Tree | None:
    try:
        return Tree(doc)
    except PdfError:
        return None


def _facts(doc: Document, tree: Tree | None) -> tuple:
    root = doc.get(doc.trailer["Root"])
    mark, prefs = doc.get(root.get("MarkInfo")) or {}, doc.get(root.get("ViewerPreferences")) or {}
    roles = claims = agree = False
    documents = 0
    if tree:
        roles = all(e[3] is not None for e in tree.elements)
        claims = tree.claims_agree()
        documents = sum(e[1] == -1 and e[3] == "Document" and e[4] == PDF2 for e in tree.elements)
        pages, error = content.interpret(doc.data)
        marks = {(p.number, e[3]) for p in pages for e in p.events if e[1] == "begin" and e[3] is not None}
        agree = error is None and not any(p.open for p in pages) and marks == {(page, mcid) for _, page, mcid in tree.items}
    meta = doc.get(root.get("Metadata"))
    xmp = doc.decode(meta).decode("utf-8", "replace") if isinstance(meta, Stream) else ""
    uaid = re.findall(r"(?<!/)pdfuaid:(part|rev)(?:>|=\")([^<\"]*)", xmp)
    title = re.search(r"<dc:title>.*?<rdf:li[^>]*>([^<]*)</rdf:li>", xmp, re.S)
    lang = doc.get(root.get("Lang"))
    return (mark.get("Marked") is True, tree is not None, roles, claims, documents, agree, lang.decode("latin-1") if isinstance(lang, bytes) else None, prefs.get("DisplayDocTitle") is True, ",".join(f"{k}={v}" for k, v in sorted(uaid)), title[1] if title else None)


def facts(files: DataFrame | Made) -> DataFrame:
    """(doc_id, marked, tree, roles, claims, documents, content, lang, display, uaid, title, error), one row a file."""
    return _scan_table(files, _FACTS, lambda doc: [_facts(doc, _tree(doc))])


def counted_facts(files: DataFrame | Made) -> DataFrame:
    """As ``facts``, and what ``elements`` and ``items`` hold of the file: (elements, actual, n_claims), NULL where there is none. A file is parsed once."""
    columns = [c.split() for c in f"{_FACTS},elements long,actual string,n_claims long,error string".split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def rows_of(content: bytes) -> list[tuple]:
        found, counts, error = (None,) * (len(columns) - 4), (None,) * 3, None
        try:
            doc = Document.open(content)
            tree = _tree(doc)
            if tree:
                counts = len(tree.elements) or None, max((e[6] for e in tree.elements if e[6] is not None), default=None), len(tree.items) or None
            found = _facts(doc, tree)
        except FAULTS as e:
            error = fault_name(e)
        return [(*found, *counts, error)]

    return each_file(files, ",".join(map(" ".join, columns)), {c: kinds[k] for c, k in columns}, rows_of)


def accessibility_violations(found: DataFrame, *keep: str | Column) -> DataFrame:
    """(doc_id, rule, keep): the first accessibility rule that a file breaks, in a fixed order; NULL: none."""
    lang = F.regexp_like(F.coalesce("lang", F.lit("")), F.lit("^([A-Za-z]{2,3}|[ix])(-[A-Za-z0-9]{1,8})*$"))
    rules = (
        ("ua2-marked", ~F.col("marked")), ("ua2-structtree", ~F.col("tree")), ("ua2-rolemap", ~F.col("roles")), ("ua2-mcid", ~F.col("claims")), ("ua2-document", F.col("documents") != 1), ("ua2-content", ~F.col("content")), ("ua2-lang", ~lang),
        ("ua2-displaydoctitle", ~F.col("display")), ("ua2-pdfuaid", ~F.col("uaid").isin("", "part=2,rev=2024")), ("ua2-title", F.coalesce(F.trim("title"), F.lit("")) == ""),
    )
    return found.select("doc_id", F.coalesce("error", *[F.when(bad, F.lit(name)) for name, bad in rules]).alias("rule"), *keep)


def tagged_pdf(broken: str = "") -> bytes:
    """A small tagged file that breaks one rule, or none; for tests and queries."""
    from quire.sources import sinks

    swap = lambda rule, bad, good: bad if broken == rule else good
    xmp = b"<x><dc:title><rdf:Alt><rdf:li xml:lang='x'>%s</rdf:li></rdf:Alt></dc:title><pdfuaid:part>%s</pdfuaid:part><pdfuaid:rev>2024</pdfuaid:rev></x>" % (swap("ua2-title", b" ", b"A title"), swap("ua2-pdfuaid", b"1", b"2"))
    page = b"/P << /MCID 0 >> BDC 0 0 5 5 re f EMC /Artifact BMC 1 1 1 1 re f EMC" + swap("ua2-content", b" /P << /MCID 7 >> BDC EMC", b"")
    return sinks.pdf_bytes([
        b"<< /Type /Catalog /Pages 2 0 R /MarkInfo << /Marked %s >> %s /Lang (%s) /ViewerPreferences << /DisplayDocTitle %s >> /Metadata 9 0 R >>"
        % (swap("ua2-marked", b"false", b"true"), swap("ua2-structtree", b"", b"/StructTreeRoot 5 0 R"), swap("ua2-lang", b"english_", b"en-US"), swap("ua2-displaydoctitle", b"false", b"true")),
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /StructParents 0 >>", sinks.stream(page),
        b"<< /Type /StructTreeRoot /K 6 0 R /RoleMap << /Para /P /Odd /Odder /Odder /Odd >> /ParentTree << /Nums [0 [%s]] >> >>" % swap("ua2-mcid", b"6 0 R", b"7 0 R"),
        b"<< /S /%s /NS 8 0 R /K [7 0 R] >>" % swap("ua2-document", b"Part", b"Document"), b"<< /S /%s /P 6 0 R /Pg 3 0 R /K 0 /ActualText (said) >>" % swap("ua2-rolemap", b"Odd", b"Para"),
        b"<< /Type /Namespace /NS (%s) >>" % PDF2.encode(), sinks.stream(xmp, b"/Subtype /XML /Type /Metadata"),
    ])
