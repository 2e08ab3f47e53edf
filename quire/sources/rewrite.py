"""Writing PDF again: values as bytes, copies with replaced objects, packed object streams, compression levels."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import images
from quire.sources.codecs import SHORT, FilterError
from quire.sources.graphics import Fault
from quire.sources.pdf import Document, Name, Null, PdfError, Ref, Stream

HEADER = b"%PDF-1.4\n"


def serialize(v) -> bytes:
    """A value with sorted keys: the same value gives the same bytes."""
    if v is Null or v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(v, Ref):
        return b"%d %d R" % (v.num, v.gen)
    if isinstance(v, bytes):
        return b"<" + v.hex().encode() + b">"
    if isinstance(v, str):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in v.encode("latin-1", "replace"))
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialize, v)) + b"]"
    if isinstance(v, dict):
        return b"<< " + b"".join(serialize(Name(k)) + b" " + serialize(v[k]) + b" " for k in sorted(v) if not k.startswith("__")) + b">>"
    if isinstance(v, Stream):
        return serialize(v.dict | {"Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    raise PdfError("typecheck")


def _digest(bodies: list[bytes]) -> bytes:
    d = hashlib.sha256()
    for b in bodies:
        d.update(b)
    return d.hexdigest().encode()


def bodies_of(doc: Document, changed: dict[int, object] | None = None) -> dict[int, bytes]:
    """All objects in use by number; containers of packed objects and cross-reference streams go, their numbers become free."""
    out = {}
    for num, _, v in doc.objects():
        v = (changed or {}).get(num, v)
        if isinstance(v, Stream) and v.dict.get("Type") in ("XRef", "ObjStm") or v is None:
            continue
        out[num] = serialize(v)
    return out


def copy(doc: Document, changed: dict[int, object] | None = None, pack: bool = False) -> bytes:
    """The document again: no dates, an identifier from its bodies, equal bytes for equal input."""
    root = doc.trailer["Root"].num
    bodies = bodies_of(doc, changed)
    size = max(bodies) + 1
    sum_ = _digest([bodies[n] for n in sorted(bodies)])
    ids = b"/ID [<%s><%s>]" % (sum_, sum_)
    out, at = bytearray(b"%PDF-1.5\n" if pack else HEADER), {}

    def put(num: int, body: bytes) -> None:
        at[num] = len(out)
        out.extend(b"%d 0 obj\n" % num + body + b"\nendobj\n")

    if not pack:
        for num in sorted(bodies):
            put(num, bodies[num])
        start = len(out)
        rows = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n" for n in range(1, size))
        out += b"xref\n0 %d\n0000000000 65535 f \n" % size + rows + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, ids, start)
        return bytes(out)
    inside = [n for n in sorted(bodies) if b"\nstream\n" not in bodies[n]]
    for num in sorted(set(bodies) - set(inside)):
        put(num, bodies[num])
    container, place = size, {}
    if inside:
        head, body = [], bytearray()
        for i, n in enumerate(inside):
            place[n] = i
            head.append(b"%d %d" % (n, len(body)))
            body += bodies[n] + b"\n"
        first = b" ".join(head) + b"\n"
        put(container, serialize(Stream({"Type": Name("ObjStm"), "N": len(inside), "First": len(first), "Filter": Name("FlateDecode")}, zlib.compress(first + bytes(body)))))
        size += 1
    start, rows = len(out), bytearray(b"\0" + b"\0\0\0\0" + b"\xff\xff")
    at[size] = start
    for n in range(1, size + 1):
        kind, a, b = (2, container, place[n]) if n in place else (1, at[n], 0) if n in at else (0, 0, 0)
        rows += bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
    raw = zlib.compress(bytes(rows))
    entries = {"Type": Name("XRef"), "Size": size + 1, "Root": Ref(root, 0), "W": [1, 4, 2], "ID": [bytes.fromhex(sum_.decode())] * 2, "Filter": Name("FlateDecode")}
    put(size, serialize(Stream(entries, raw)))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def level_changes(doc: Document, level: int) -> dict[int, object]:
    """Objects that a level replaces: from 1 on, page content without a filter is deflated; at 2, images are stored again as
    deflated RGB, losslessly; what cannot be decoded stays as it is. Levels beyond need a JPEG encoder and are refused."""
    if not 1 <= level <= 2:
        raise PdfError("rangecheck" if not 0 <= level <= 5 else "unsupported")
    changed: dict[int, object] = {}
    deflate = lambda d, raw: Stream({k: v for k, v in d.items() if k != "DecodeParms"} | {"Filter": Name("FlateDecode")}, zlib.compress(raw))
    for page in doc.pages():
        found = page.get("Contents")
        items = [found] if isinstance(found, Ref) and isinstance(doc.get(found), Stream) else doc.get(found) or []
        for ref in items if isinstance(items, list) else []:
            v = doc.get(ref)
            if isinstance(ref, Ref) and isinstance(v, Stream) and doc.get(v.dict.get("Filter")) is None:
                changed[ref.num] = deflate(v.dict, v.raw)
    if level == 2:
        for num, _, v in doc.objects():
            if num in changed or not isinstance(v, Stream) or v.dict.get("Subtype") != "Image":
                continue
            names = doc.get(v.dict.get("Filter"))
            one = names[0] if isinstance(names, list) and len(names) == 1 else names
            if names is None:
                changed[num] = deflate(v.dict, v.raw)
            elif isinstance(one, str) and SHORT.get(one, one) in ("FlateDecode", "LZWDecode") and not images.is_stencil(doc, v):
                try:
                    rgba = images.pixels(doc, Stream({k: x for k, x in v.dict.items() if k not in ("SMask", "Mask")}, v.raw))
                except (Fault, FilterError, PdfError):
                    continue
                entries = {k: x for k, x in v.dict.items() if k not in ("Decode",)} | {"ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}
                if isinstance(doc.get(v.dict.get("Mask")), list):
                    continue  # its ranges are about the samples as they were
                changed[num] = deflate(entries, rgba[..., :3].tobytes())
    return changed


def rewrite(files: DataFrame, level: int = 0, pack: bool = False) -> DataFrame:
    """(doc_id, bytes, error): every document copied at a level; 0 copies without change."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, errors = [], []
            for content in b.column("content").to_pylist():
                try:
                    doc = Document.open(content or b"")
                    made.append(copy(doc, level_changes(doc, level) if level else None, pack))
                    errors.append(None)
                except (PdfError, FilterError, Fault) as e:
                    made.append(None), errors.append(str(e))
                except (RecursionError, KeyError, TypeError, IndexError, ValueError, AttributeError):
                    made.append(None), errors.append("syntaxerror")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "bytes", "error"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", F.col("content").cast("binary").alias("content")).mapInArrow(kernel, f"doc_id {kind}, bytes binary, error string")
