"""Reading PDF bytes into tables: one Arrow kernel per table, errors as rows.

The parser keeps to what the tables need: values, cross-reference tables and streams with
their chains, object streams, and a scan for objects when the table is damaged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.codecs import FilterError, decode_chain
from quire.sources.crypt import Handler

DELIMITERS = b"()<>[]{}/%"
WHITE = b"\0\t\n\x0c\r "
_SPACE, _COMMENT, _NAME, _WORD = (re.compile(p) for p in (rb"[\0\t\n\x0c\r ]*", rb"[^\r\n]*", rb"/([^\0\t\n\x0c\r ()<>\[\]{}/%]*)", rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+"))
_INT, _REAL, _REF = (re.compile(p) for p in (rb"[+-]?\d+", rb"[+-]?(\d+\.\d*|\.\d+)", rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])"))


class PdfError(ValueError):
    pass


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Keyword(str):
    __slots__ = ()


class Lexer:
    """Values and keywords of a byte string."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def skip(self) -> None:
        self.pos = _SPACE.match(self.data, self.pos).end()
        while self.data[self.pos : self.pos + 1] == b"%":
            self.pos = _SPACE.match(self.data, _COMMENT.match(self.data, self.pos).end()).end()

    def value(self, depth: int = 0):
        """The next value or keyword; None at the end."""
        self.skip()
        d = self.data
        if depth > 64:
            raise PdfError("limitcheck")
        if self.pos >= len(d):
            return None
        c = d[self.pos : self.pos + 1]
        if c == b"/":
            m = _NAME.match(d, self.pos)
            self.pos = m.end()
            name = m[1] if b"#" not in m[1] else re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1])
            return Name(name.decode("latin-1"))
        if d[self.pos : self.pos + 2] == b"<<":
            self.pos += 2
            out: dict = {}
            while True:
                k = self.value(depth + 1)
                if k is None:
                    raise PdfError("syntaxerror")
                if isinstance(k, Keyword) and k == ">>":
                    return out
                if not isinstance(k, Name):
                    raise PdfError("syntaxerror")
                v = self.value(depth + 1)
                if isinstance(v, Keyword):
                    if v == ">>":
                        return out
                    raise PdfError("syntaxerror")
                out[str(k)] = v
        if d[self.pos : self.pos + 2] == b">>":
            self.pos += 2
            return Keyword(">>")
        if c == b"<":
            end = d.find(b">", self.pos)
            if end < 0:
                raise PdfError("syntaxerror")
            digits = d[self.pos + 1 : end].translate(None, WHITE)
            self.pos = end + 1
            try:
                return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))
            except ValueError:
                raise PdfError("syntaxerror") from None
        if c == b"(":
            return self._string()
        if c == b"[":
            self.pos += 1
            items: list = []
            while True:
                v = self.value(depth + 1)
                if v is None:
                    raise PdfError("syntaxerror")
                if isinstance(v, Keyword):
                    if v == "]":
                        return items
                    if v == "R" and len(items) >= 2 and isinstance(items[-1], int) and isinstance(items[-2], int):
                        gen, num = items.pop(), items.pop()
                        items.append(Ref(num, gen))
                        continue
                    raise PdfError("syntaxerror")
                items.append(v)
        if c in b"]{})":
            self.pos += 1
            return Keyword(c.decode())
        m = _WORD.match(d, self.pos)
        if not m:
            self.pos += 1
            return Keyword(c.decode("latin-1"))
        self.pos = m.end()
        t = m[0]
        if _INT.fullmatch(t):
            n = int(t)
            r = _REF.match(d, self.pos) if n >= 0 else None
            if r:
                self.pos = r.end()
                return Ref(n, int(r[1]))
            return n
        if _REAL.fullmatch(t):
            return float(t)
        return {b"true": True, b"false": False}.get(t, Keyword(t.decode("latin-1"))) if t != b"null" else Null

    def _string(self) -> bytes:
        d, out, depth, i = self.data, bytearray(), 1, self.pos + 1
        while i < len(d):
            c = d[i]
            if c == 0x5C and i + 1 < len(d):
                e = d[i + 1 : i + 2]
                o = re.compile(rb"[0-7]{1,3}").match(d, i + 1)
                if o:
                    out.append(int(o[0], 8) & 255)
                    i = o.end()
                    continue
                if e in b"\r\n":
                    i += 3 if d[i + 1 : i + 3] == b"\r\n" else 2
                    continue
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
                i += 2
                continue
            depth += (c == 0x28) - (c == 0x29)
            i += 1
            if not depth:
                self.pos = i
                return bytes(out)
            out.append(c)
        raise PdfError("syntaxerror")


class _Null:
    def __repr__(self) -> str:
        return "null"


Null = _Null()


def read_object(data: bytes, pos: int, lengths=lambda x: x):
    """``num gen obj value`` at a place: (num, gen, value, place behind)."""
    lex = Lexer(data, pos)
    num, gen, word = lex.value(), lex.value(), lex.value()
    if not isinstance(num, int) or not isinstance(gen, int) or word != "obj":
        raise PdfError("syntaxerror")
    value = lex.value()
    if isinstance(value, Keyword):
        raise PdfError("syntaxerror")
    m = re.compile(rb"[\0\t\n\x0c\r ]*stream(\r\n|\n|\r)").match(data, lex.pos)
    if m and isinstance(value, dict):
        n = lengths(value.get("Length"))
        at = m.end()
        if not isinstance(n, int) or not re.compile(rb"[\0\t\n\x0c\r ]*endstream").match(data, at + n):
            end = data.find(b"endstream", at)
            if end < 0:
                raise PdfError("syntaxerror")
            n = len(data[at:end].rstrip(b"\r\n")) if data[at:end][-1:] in b"\r\n" else end - at
        return num, gen, Stream(value, data[at : at + n]), at + n
    return num, gen, value, lex.pos


@dataclass
class Document:
    """Bytes with their cross-reference rows: num to (offset, gen, container, index)."""

    data: bytes
    rows: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    sections: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    rebuilt: bool = False
    crypt: tuple | None = None
    _cache: dict = field(default_factory=dict)
    _busy: set = field(default_factory=set)

    @classmethod
    def open(cls, data: bytes) -> Document:
        if b"%PDF-" not in data[:1024]:
            raise PdfError("syntaxerror")
        doc = cls(data)
        try:
            at = data.rindex(b"startxref")
            doc._chain(int(re.compile(rb"startxref\s+(\d+)").match(data, at)[1]))
            if not isinstance(doc.get(doc.trailer.get("Root")), dict):
                raise PdfError("syntaxerror")
        except (PdfError, ValueError, TypeError, FilterError):
            doc = cls(data, rebuilt=True)
            doc._scan()
        if "Encrypt" in doc.trailer:
            d, ids = doc.get(doc.trailer["Encrypt"]), doc.get(doc.trailer.get("ID")) or [b""]
            try:
                handler = Handler({k: doc.get(v) for k, v in d.items()}, doc.get(ids[0]))
            except (KeyError, TypeError, IndexError, AttributeError):
                raise PdfError("invalidaccess") from None
            if not handler.ok:
                raise PdfError("invalidaccess")
            doc.crypt = (handler, doc.trailer["Encrypt"].num if isinstance(doc.trailer["Encrypt"], Ref) else -1)
            doc._cache.clear()
        return doc

    def _open(self, value, num: int, gen: int):
        """Decrypt the strings and the stream of an object."""
        handler, own = self.crypt
        if num == own:
            return value
        if isinstance(value, bytes):
            return handler.decrypt(num, gen, value)
        if isinstance(value, list):
            return [self._open(v, num, gen) for v in value]
        if isinstance(value, dict):
            return {k: self._open(v, num, gen) for k, v in value.items()}
        if isinstance(value, Stream):
            plain = value.dict.get("Type") == "XRef"
            return value if plain else Stream(self._open(value.dict, num, gen), handler.decrypt(num, gen, value.raw))
        return value

    def _chain(self, at: int | None) -> None:
        seen: list[int] = []
        while at is not None:
            if at in seen or len(seen) >= 64:
                raise PdfError("syntaxerror")
            seen.append(at)
            new, trailer = self._table(at) if self.data[at : at + 4] == b"xref" else self._stream(at)
            for num, row in new.items():
                self.sections.append((len(seen) - 1, num, row[0], row[1], row[2] >= 0))
                if num not in self.rows:  # the newest definition wins, older sections fill gaps
                    self.rows[num] = row
            self.trailer = {**trailer, **self.trailer}
            if isinstance(trailer.get("XRefStm"), int):
                for num, row in self._stream(trailer["XRefStm"])[0].items():
                    self.rows.setdefault(num, row)
            at = trailer.get("Prev")

    def _table(self, at: int) -> tuple[dict, dict]:
        lex, rows = Lexer(self.data, at + 4), {}
        while True:
            first = lex.value()
            if first == "trailer":
                return rows, lex.value()
            n = lex.value()
            if not isinstance(first, int) or not isinstance(n, int):
                raise PdfError("syntaxerror")
            for i in range(n):
                offset, gen, use = lex.value(), lex.value(), lex.value()
                if use not in ("n", "f"):
                    raise PdfError("syntaxerror")
                rows.setdefault(first + i, (offset, gen, -1 if use == "n" else -2, 0))

    def _stream(self, at: int) -> tuple[dict, dict]:
        _, _, value, _ = read_object(self.data, at)
        if not isinstance(value, Stream):
            raise PdfError("syntaxerror")
        d, body, rows = value.dict, self.decode(value), {}
        w = d["W"]
        index = d.get("Index", [0, d["Size"]])
        pos = 0
        for first, n in zip(index[::2], index[1::2]):
            for i in range(n):
                f = []
                for k in w:
                    f.append(int.from_bytes(body[pos : pos + k], "big") if k else None)
                    pos += k
                kind = 1 if f[0] is None else f[0]
                if kind == 1:
                    rows.setdefault(first + i, (f[1], f[2] or 0, -1, 0))
                elif kind == 2:
                    rows.setdefault(first + i, (0, 0, f[1], f[2] or 0))
                else:
                    rows.setdefault(first + i, (f[1] or 0, f[2] or 0, -2, 0))
        return rows, d

    def _scan(self) -> None:
        """Rebuild the rows from ``num gen obj`` wherever it stands; the last trailer with a root, or the last catalog."""
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj\b", self.data):
            try:
                num, gen, value, _ = read_object(self.data, m.start())
            except PdfError:
                continue
            self.rows[num] = (m.start(), gen, -1, 0)
            if isinstance(value, Stream) and value.dict.get("Type") == "ObjStm":
                try:
                    head = Lexer(self.decode(value))
                    for i in range(value.dict["N"]):
                        self.rows.setdefault(head.value(), (0, 0, num, i))
                        head.value()
                except (PdfError, FilterError, KeyError, TypeError):
                    pass
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Lexer(self.data, m.end()).value()
            except PdfError:
                continue
            if isinstance(t, dict) and "Root" in t:
                self.trailer = t
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            found = [n for n in self.rows if isinstance(v := self._safe(n), dict) and v.get("Type") == "Catalog"]
            if not found:
                raise PdfError("syntaxerror")
            self.trailer["Root"] = Ref(found[-1], self.rows[found[-1]][1])

    def _safe(self, num: int):
        try:
            return self.get(Ref(num, self.rows[num][1]))
        except (PdfError, FilterError):
            return None

    def decode(self, s: Stream) -> bytes:
        names, params = self.get(s.dict.get("Filter", s.dict.get("F"))), self.get(s.dict.get("DecodeParms", s.dict.get("DP")))
        names = [names] if isinstance(names, str) else [self.get(n) for n in names or []]
        params = [params] if isinstance(params, dict) else [self.get(p) for p in params or []]
        return decode_chain(names, s.raw, [p if isinstance(p, dict) else None for p in params])

    def get(self, value):
        """Follow a reference; a cycle is a syntax error, a missing object null."""
        hops = 0
        while isinstance(value, Ref):
            hops += 1
            if hops > 32 or value.num in self._busy:
                raise PdfError("syntaxerror")
            value = self._load(value)
        return None if value is Null else value

    def _load(self, ref: Ref):
        if ref.num in self._cache:
            return self._cache[ref.num]
        row = self.rows.get(ref.num)
        if row is None or row[2] == -2 or (row[2] == -1 and row[1] != ref.gen and not self.rebuilt):
            return Null
        self._busy.add(ref.num)
        try:
            if row[2] >= 0:
                value = self._packed(row[2], row[3], ref.num)
            else:
                num, _, value, _ = read_object(self.data, row[0], lambda x: self.get(x) if isinstance(x, Ref) else x)
                if num != ref.num:
                    raise PdfError("syntaxerror")
                if self.crypt:
                    value = self._open(value, ref.num, row[1])
        finally:
            self._busy.discard(ref.num)
        self._cache[ref.num] = value
        return value

    def _packed(self, container: int, index: int, num: int):
        s = self.get(Ref(container, self.rows.get(container, (0, 0, 0, 0))[1]))
        if not isinstance(s, Stream):
            raise PdfError("syntaxerror")
        body = self.decode(s)
        head = Lexer(body)
        pairs = [(head.value(), head.value()) for _ in range(s.dict["N"])]
        at = next((o for n, o in pairs if n == num), pairs[index][1] if index < len(pairs) else None)
        return Lexer(body, s.dict["First"] + at).value()

    def objects(self) -> Iterator[tuple[int, int, object]]:
        for num in sorted(self.rows):
            if self.rows[num][2] != -2:
                yield num, self.rows[num][1], self.get(Ref(num, self.rows[num][1]))

    def pages(self) -> list[dict]:
        """Leaves of the page tree with inherited entries; if the tree is broken, every page object."""
        out: list[dict] = []
        keys = ("Resources", "MediaBox", "Rotate", "CropBox")

        def walk(node, inherited: dict, seen: tuple) -> None:
            d = self.get(node)
            if not isinstance(d, dict) or (isinstance(node, Ref) and node.num in seen) or len(seen) > 64:
                raise PdfError("syntaxerror")
            inherited = inherited | {k: d[k] for k in keys if k in d}
            mark = seen + ((node.num,) if isinstance(node, Ref) else (-1,))
            if "Kids" in d:
                for kid in self.get(d["Kids"]) or []:
                    walk(kid, inherited, mark)
            else:
                out.append({**inherited, **d, "__num": node.num if isinstance(node, Ref) else -1})

        try:
            walk((self.get(self.trailer["Root"]) or {}).get("Pages"), {}, ())
        except (PdfError, KeyError):
            out.clear()
        if not out:
            out = [{**v, "__num": n} for n, _, v in self.objects() if isinstance(v, dict) and v.get("Type") == "Page"]
        return out

    def contents(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = [c] if isinstance(c, Stream) else [self.get(x) for x in c or []]
        return b"\n".join(self.decode(s) for s in parts if isinstance(s, Stream))


def to_json(v) -> str:
    """A value as JSON text: names '/x', references 'n g R', strings as hex."""
    def plain(x):
        if isinstance(x, Stream):
            return {"stream": plain(x.dict), "length": len(x.raw)}
        if isinstance(x, dict):
            return {k: plain(y) for k, y in sorted(x.items())}
        if isinstance(x, list):
            return [plain(y) for y in x]
        if isinstance(x, Ref):
            return f"{x.num} {x.gen} R"
        if isinstance(x, Name):
            return f"/{x}"
        if isinstance(x, bytes):
            return x.hex()
        return None if x is Null else x

    return json.dumps(plain(v), sort_keys=True)


KINDS = ((bool, "bool"), (int, "int"), (float, "real"), (Name, "name"), (bytes, "string"), (list, "array"), (dict, "dict"), (Stream, "stream"), (Ref, "ref"))


def _kind(v) -> str:
    return next((k for t, k in KINDS if isinstance(v, t)), "null")


@dataclass(frozen=True)
class Made:
    """Files that are made where they are read, so that their bytes never leave the kernel: ``make(value, doc_id)`` gives those of a row."""

    rows: DataFrame
    column: str
    make: Callable[[object, object], bytes]


#: What a kernel holds at once: bytes of the files of a piece, and rows that come of them.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 1 << 14


def each_file(files: DataFrame | Made, schema: str, types: dict[str, pa.DataType], rows_of: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """``files``: (doc_id, content), or made. ``rows_of(content)`` gives the rows of a file, without its id, as ``schema`` and ``types`` say."""
    made = files if isinstance(files, Made) else None
    rows, column = (files.rows, files.column) if made else (files, "content")
    make = made.make if made else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, held, size = {"doc_id": b.schema.field("doc_id").type, **types}, [], 0
            send = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held) if held else [()] * len(kinds), kinds.values())], names=list(kinds))
            for at in range(len(b)):
                doc_id, content = b.column("doc_id")[at].as_py(), b.column(column)[at].as_py()
                if make:
                    content = make(content, doc_id)
                for row in rows_of(content or b""):
                    held.append((doc_id, *row))
                    if len(held) >= PIECE_ROWS:
                        yield send()
                        held, size = [], 0
                size += len(content or b"")
                if size >= PIECE_BYTES:
                    yield send()
                    held, size = [], 0
            if held:
                yield send()

    value = F.col(column) if made else F.col("content").cast("binary").alias("content")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", *([] if column == "doc_id" else [value])).mapInArrow(kernel, f"doc_id {kind}, {schema}")


#: What a damaged file may raise.
FAULTS = (PdfError, FilterError, RecursionError, KeyError, TypeError, IndexError)


def fault_name(e: Exception) -> str:
    return str(e) if isinstance(e, (PdfError, FilterError)) else "syntaxerror"


def _scan_table(files: DataFrame | Made, schema: str, make) -> DataFrame:
    """``files``: (doc_id, content), or made. ``make(document)`` yields rows; a document that fails gives one row with its error."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    columns = [c.split() for c in schema.split(",")]

    def rows_of(content: bytes) -> list[tuple]:
        try:
            return [(*r, None) for r in make(Document.open(content))]
        except FAULTS as e:
            return [(*[None] * len(columns), fault_name(e))]

    return each_file(files, f"{schema},error string", {**{c: kinds[k] for c, k in columns}, "error": pa.string()}, rows_of)


def objects(files: DataFrame | Made) -> DataFrame:
    """(doc_id, num, gen, kind, value (JSON), stream (decoded bytes), error)."""
    def make(doc: Document):
        for num, gen, v in doc.objects():
            try:
                body = doc.decode(v) if isinstance(v, Stream) else None
            except FilterError:
                body = None
            yield num, gen, _kind(v), to_json(v), body

    return _scan_table(files, "num long,gen long,kind string,value string,stream binary", make)


def xref(files: DataFrame | Made) -> DataFrame:
    """(doc_id, num, offset, gen, in_use, container, idx, error): the rows in force."""
    return _scan_table(files, "num long,offset long,gen long,in_use boolean,container long,idx long", lambda d: ((n, r[0], r[1], r[2] != -2, r[2] if r[2] >= 0 else None, r[3]) for n, r in sorted(d.rows.items())))


def _size(doc: Document, page: dict) -> tuple[float, float]:
    box = doc.get(page.get("MediaBox"))
    box = [float(doc.get(x)) for x in box] if isinstance(box, list) and len(box) == 4 else [0.0, 0.0, 612.0, 792.0]
    return abs(box[2] - box[0]), abs(box[3] - box[1])


def pages(files: DataFrame | Made) -> DataFrame:
    """(doc_id, page, width, height, contents, error)."""
    def make(doc: Document):
        for i, p in enumerate(doc.pages(), 1):
            yield i, *_size(doc, p), doc.contents(p)

    return _scan_table(files, "page long,width double,height double,contents binary", make)


def counts(files: DataFrame | Made) -> DataFrame:
    """(doc_id, objects, streams, refs, rows, width, height, error): what ``objects`` and ``xref`` hold of a file, beside each of its
    ``pages``. All three are of one file, so it is parsed once and nothing is joined."""
    def make(doc: Document):
        values = [(_kind(v), to_json(v)) for _, _, v in doc.objects()]
        refs = sum(len(re.findall(r"\d+ \d+ R", v)) for _, v in values)
        for p in doc.pages():
            yield len(values), sum(k == "stream" for k, _ in values), refs, sum(r[2] != -2 for r in doc.rows.values()), *_size(doc, p)

    return _scan_table(files, "objects long,streams long,refs long,rows long,width double,height double", make)


def info(files: DataFrame | Made) -> DataFrame:
    """(doc_id, version, pages, tagged, images, fonts, error)."""
    def make(doc: Document):
        head = re.search(rb"%PDF-(\d)\.(\d)", doc.data[:1024])
        root = doc.get(doc.trailer["Root"])
        own = re.fullmatch(r"(\d)\.(\d)", str(root.get("Version", "")))
        version = max((int(m[1]), int(m[2])) for m in (head, own) if m)
        values = [v for _, _, v in doc.objects()]
        images = sum(isinstance(v, Stream) and v.dict.get("Subtype") == "Image" for v in values)
        fonts = set()
        for v in values:
            if isinstance(v, dict) and v.get("Type") == "Font":
                d = doc.get(v.get("FontDescriptor")) or {}
                fonts.add((str(v.get("BaseFont", "")), any(k in d for k in ("FontFile", "FontFile2", "FontFile3"))))
        mark = doc.get(root.get("MarkInfo")) or {}
        yield f"{version[0]}.{version[1]}", len(doc.pages()), "StructTreeRoot" in root or mark.get("Marked") is True, images, ",".join(f"{n}:{'embedded' if e else 'outside'}" for n, e in sorted(fonts))

    return _scan_table(files, "version string,pages long,tagged boolean,images long,fonts string", make)
