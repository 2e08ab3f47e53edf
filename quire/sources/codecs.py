"""Stream filters: bytes to bytes. Each has a scalar form and an Arrow form for columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
LIMIT = 32 << 20
WHITE = b"\0\t\n\x0c\r "
_POWERS = 85 ** np.arange(4, -1, -1)
_LZW_START = [bytes([i]) for i in range(256)] + [b"", b""]


class FilterError(ValueError):
    pass


def _bounded(out: bytes) -> bytes:
    if len(out) > LIMIT:
        raise FilterError("limitcheck")
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    body = data.split(b">", 1)[0].translate(None, WHITE)
    try:
        return bytes.fromhex((body + b"0" * (len(body) % 2)).decode("ascii"))
    except ValueError:
        raise FilterError("syntaxerror") from None


def ascii85(data: bytes) -> bytes:
    body = data.split(b"~", 1)[0].translate(None, WHITE)
    # a z between groups stands for a group of zeros; a z inside a group is none, and too large for a digit
    parts = body.split(b"z")
    if len(parts) > 1:
        body = b"!!!!!".join(parts)
        at = 0
        for p in parts[:-1]:
            at += len(p)
            if at % 5:
                raise FilterError("syntaxerror")
    digits = np.frombuffer(body, dtype=np.uint8).astype(np.int64) - 33
    if len(digits) and (digits.min() < 0 or digits.max() > 84) or len(digits) % 5 == 1:
        raise FilterError("syntaxerror")
    whole = len(digits) // 5 * 5
    n = digits[:whole].reshape(-1, 5) @ _POWERS
    if len(n) and n.max() >= 1 << 32:
        raise FilterError("syntaxerror")
    out = n.astype(">u4").tobytes()
    if whole < len(digits):
        last = int(np.append(digits[whole:], [84] * (whole + 5 - len(digits))) @ _POWERS)
        out += (last & 0xFFFFFFFF).to_bytes(4, "big")[: len(digits) - whole - 1]
    return _bounded(out)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n == 128:
            break
        if n < 128:
            part = data[i + 1 : i + 2 + n]
            if len(part) < n + 1:
                raise FilterError("syntaxerror")
            out += part
            i += n + 2
        else:
            if i + 1 >= len(data):
                raise FilterError("syntaxerror")
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        if len(out) > LIMIT:
            raise FilterError("limitcheck")
    return bytes(out)


@lru_cache(maxsize=16)
def _lzw_widths(early: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the n codes behind a clear code, and of all before each: the table grows by one with each but the first."""
    widths, width = [], 9
    for i in range(n):
        widths.append(width)
        width += 258 + i + early >= 1 << width and width < 12
    widths = np.array(widths, dtype=np.int64)
    return widths, np.concatenate(([0], np.cumsum(widths)))


#: Codes that are read at once; behind the first 2**12 of a table every one has 12 bits.
_LZW_AHEAD = 1 << 12


def _lzw_codes(bits: np.ndarray, at: int, end: int, early: int, done: int) -> list[int]:
    """Up to ``_LZW_AHEAD`` codes from bit ``at`` on, of which ``done`` are behind the last clear code already."""
    if done < _LZW_AHEAD:
        widths, ahead = _lzw_widths(early, 2 * _LZW_AHEAD)
        widths, starts = widths[done : done + _LZW_AHEAD], ahead[done : done + _LZW_AHEAD] - ahead[done] + at
    else:
        widths, starts = np.full(_LZW_AHEAD, 12), at + 12 * np.arange(_LZW_AHEAD)
    n = int(np.searchsorted(starts + widths, end, side="right"))
    widths, starts = widths[:n], starts[:n]
    byte = starts >> 3
    window = bits[byte] << 16 | bits[byte + 1] << 8 | bits[byte + 2]
    return (window >> 24 - (starts & 7) - widths & (1 << widths) - 1).tolist()


def lzw(data: bytes, early: int = 1) -> bytes:
    bits, end = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64), 8 * len(data)
    table, prev, parts, size, at, done = _LZW_START.copy(), b"", [], 0, 0, 0
    while True:
        codes = _lzw_codes(bits, at, end, early, done)
        if not codes:
            return b"".join(parts)
        for i, code in enumerate(codes):
            if code == 256:
                at += int(_lzw_bits(early, done, i + 1))
                table, prev, done = _LZW_START.copy(), b"", 0
                break
            if code == 257:
                return b"".join(parts)
            if not prev:
                if code >= 256:
                    raise FilterError("syntaxerror")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(prev + entry[:1])
            elif code == len(table):
                entry = prev + prev[:1]
                table.append(entry)
            else:
                raise FilterError("syntaxerror")
            parts.append(entry)
            size += len(entry)
            if size > LIMIT:
                raise FilterError("limitcheck")
            prev = entry
        else:
            at += int(_lzw_bits(early, done, len(codes)))
            done += len(codes)


def _lzw_bits(early: int, done: int, n: int) -> int:
    """Bits of n codes of which ``done`` are ahead in their table."""
    if done >= _LZW_AHEAD:
        return 12 * n
    ahead = _lzw_widths(early, 2 * _LZW_AHEAD)[1]
    return ahead[done + n] - ahead[done]


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    codes, table, size, word = [256], {}, 258, -1
    found, put = table.get, codes.append
    for b in data:
        if word < 0:
            word = b
            continue
        key = word << 8 | b
        longer = found(key)
        if longer is not None:
            word = longer
            continue
        put(word)
        table[key] = size
        size += 1
        if size >= 4094:
            put(256)
            table.clear()
            size = 258
        word = b
    if word >= 0:
        put(word)
    put(257)
    # bits of each code: 9 for the first, then as the reader's table will have grown since the last clear code
    all_ = np.array(codes, dtype=np.int64)
    clear = np.flatnonzero(all_ == 256)
    since = np.arange(len(all_)) - 1 - np.repeat(clear, np.diff(np.append(clear, len(all_))))
    since[clear[1:]] = np.diff(clear) - 1
    widths = _lzw_widths(early, 2 * _LZW_AHEAD)[0][np.maximum(since, 0)]
    places = np.cumsum(widths) - widths
    shifted = all_ << 24 - (places & 7) - widths
    out = np.zeros((int(places[-1] + widths[-1]) + 7) // 8 + 2, dtype=np.int64)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount((places >> 3) + k, weights=shifted >> shift & 255, minlength=len(out))[: len(out)].astype(np.int64)
    return out.astype(np.uint8).tobytes()[: (int(places[-1] + widths[-1]) + 7) // 8]


def flate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, LIMIT + 1)
    except zlib.error:
        raise FilterError("ioerror") from None
    return _bounded(out)


def predict(data: bytes, predictor: int, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Undo predictor 2 (row deltas) or 10 to 15 (a filter byte before each row)."""
    if predictor < 2:
        return data
    width, step = (columns * colors * bits + 7) // 8, max(1, colors * bits // 8)
    if predictor == 2:
        if bits == 8:
            out = bytearray(data)
            for r in range(0, len(out), width):
                for i in range(r + step, min(r + width, len(out))):
                    out[i] = out[i] + out[i - step] & 255
            return bytes(out)
        if bits == 16:
            out = bytearray(data)
            for r in range(0, len(out), width):
                for i in range(r + step, min(r + width, len(out)) - 1, 2):
                    n = (out[i] << 8 | out[i + 1]) + (out[i - step] << 8 | out[i - step + 1])
                    out[i], out[i + 1] = n >> 8 & 255, n & 255
            return bytes(out)
        mask, out = (1 << bits) - 1, bytearray()
        for r in range(0, len(data), width):
            n = int.from_bytes(data[r : r + width].ljust(width, b"\0"), "big")
            total, prev = 0, [0] * colors
            for i in range(columns * colors):
                shift = width * 8 - (i + 1) * bits
                prev[i % colors] = prev[i % colors] + (n >> shift & mask) & mask
                total |= prev[i % colors] << shift
            out += total.to_bytes(width, "big")
        return bytes(out)
    out, above = bytearray(), bytearray(width)
    for r in range(0, len(data), width + 1):
        kind, row = data[r], bytearray(data[r + 1 : r + 1 + width].ljust(width, b"\0"))
        if kind > 4:
            raise FilterError("syntaxerror")
        for i in range(width):
            left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            if kind == 1:
                row[i] = row[i] + left & 255
            elif kind == 2:
                row[i] = row[i] + up & 255
            elif kind == 3:
                row[i] = row[i] + (left + up) // 2 & 255
            elif kind == 4:
                p = left + up - corner
                a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                row[i] = row[i] + (left if a <= b and a <= c else up if b <= c else corner) & 255
        out += row[: max(0, len(data) - r - 1)]
        above = row
    return _bounded(out)


def decode(name: str, data: bytes, params: dict | None = None) -> bytes:
    """One filter by its full or short name; a name that is none is ``undefined``."""
    params = params or {}
    name = SHORT.get(name, name)
    predictor = {"predictor": int(params.get("Predictor", 1)), "columns": int(params.get("Columns", 1)), "colors": int(params.get("Colors", 1)), "bits": int(params.get("BitsPerComponent", 8))}
    if name == "FlateDecode":
        return predict(flate(data), **predictor)
    if name == "LZWDecode":
        return predict(lzw(data, int(params.get("EarlyChange", 1))), **predictor)
    simple: dict[str, Callable[[bytes], bytes]] = {"ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length}
    if name not in simple:
        raise FilterError("unsupported" if name in ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode") else "undefined")
    return simple[name](data)


def decode_chain(names: list[str], data: bytes, params: list[dict | None] | None = None) -> bytes:
    for i, name in enumerate(names):
        data = decode(name, data, params[i] if params and i < len(params) else None)
    return data


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[s[i] + s[j] & 255])
    return bytes(out)


def eexec(data: bytes, key: int = 55665, skip: int = 4) -> bytes:
    """The stream cipher of Type 1 fonts."""
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out[skip:])


def eexec_encrypt(data: bytes, key: int = 55665, lead: bytes = b"\0\0\0\0") -> bytes:
    out = bytearray()
    for p in lead + data:
        c = p ^ key >> 8
        out.append(c)
        key = (c + key) * 52845 + 22719 & 0xFFFF
    return bytes(out)


def decoded(names: list[str], data: Column, params: list[dict | None] | None = None) -> Column:
    """A filter chain over a binary column: struct (bytes, error), never a failed task."""
    @F.pandas_udf("bytes binary, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            out, errors = [], []
            for raw in series:
                try:
                    out.append(None if raw is None else decode_chain(names, bytes(raw), params))
                    errors.append(None)
                except FilterError as e:
                    out.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"bytes": out, "error": errors})

    return run(data)
