"""Files that open with the empty password: key derivation, RC4 and AES in CBC mode."""

from __future__ import annotations

import hashlib

from quire.sources.codecs import rc4

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _tables() -> tuple[bytes, bytes]:
    p = q = 1
    box = [0] * 256
    while True:
        p = p ^ (p << 1 & 255) ^ (0x1B if p & 128 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 255
        if q & 128:
            q ^= 9
        r = lambda n: (q << n | q >> 8 - n) & 255  # noqa: E731, B023
        box[p] = q ^ r(1) ^ r(2) ^ r(3) ^ r(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


SBOX, INVERSE = _tables()


def _times(a: int, n: int) -> int:
    out = 0
    while n:
        if n & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 128 else 0)
        n >>= 1
    return out & 255


_MUL = {n: bytes(_times(a, n) for a in range(256)) for n in (2, 3, 9, 11, 13, 14)}


class Aes:
    def __init__(self, key: bytes):
        words, n, rcon = [list(key[i : i + 4]) for i in range(0, len(key), 4)], len(key) // 4, 1
        self.rounds = n + 6
        for i in range(n, 4 * (self.rounds + 1)):
            t = list(words[-1])
            if i % n == 0:
                t = [SBOX[x] for x in t[1:] + t[:1]]
                t[0] ^= rcon
                rcon = _times(rcon, 2)
            elif n > 6 and i % n == 4:
                t = [SBOX[x] for x in t]
            words.append([a ^ b for a, b in zip(words[i - n], t)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def encrypt_block(self, b: bytes) -> bytes:
        s = [x ^ k for x, k in zip(b, self.keys[0])]
        for r in range(1, self.rounds + 1):
            s = [SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if r < self.rounds:
                out = []
                for c in range(0, 16, 4):
                    a = s[c : c + 4]
                    out += [_MUL[2][a[i]] ^ _MUL[3][a[(i + 1) % 4]] ^ a[(i + 2) % 4] ^ a[(i + 3) % 4] for i in range(4)]
                s = out
            s = [x ^ k for x, k in zip(s, self.keys[r])]
        return bytes(s)

    def decrypt_block(self, b: bytes) -> bytes:
        s = [x ^ k for x, k in zip(b, self.keys[self.rounds])]
        for r in range(self.rounds - 1, -1, -1):
            s = [INVERSE[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [x ^ k for x, k in zip(s, self.keys[r])]
            if r:
                out = []
                for c in range(0, 16, 4):
                    a = s[c : c + 4]
                    out += [_MUL[14][a[i]] ^ _MUL[11][a[(i + 1) % 4]] ^ _MUL[13][a[(i + 2) % 4]] ^ _MUL[9][a[(i + 3) % 4]] for i in range(4)]
                s = out
        return bytes(s)


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data), 16):
        iv = aes.encrypt_block(bytes(a ^ b for a, b in zip(data[i : i + 16], iv)))
        out += iv
    return bytes(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(aes.decrypt_block(block), iv))
        iv = block
    return bytes(out)


def _unpad(data: bytes) -> bytes:
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data.endswith(bytes([n]) * n) else data


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of AES and SHA until the last byte allows to stop."""
    k, i = hashlib.sha256(password + salt + extra).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """The standard handler, opened with the empty password; ``ok`` tells whether that works."""

    def __init__(self, d: dict, file_id: bytes):
        self.v, self.r = int(d.get("V") or 0), int(d.get("R") or 0)
        n = int(d.get("Length") or 40) // 8
        o, u = d["O"], d["U"]
        self.method = "V2"
        if self.v >= 4:
            cf = (d.get("CF") or {}).get(str(d.get("StmF", "Identity"))) or {}
            self.method = str(cf.get("CFM", "None"))
            n = 16
        if self.r >= 5:
            valid, key_salt = u[32:40], u[40:48]
            make = hash_r6 if self.r >= 6 else (lambda p, s: hashlib.sha256(p + s).digest())
            self.ok = make(b"", valid) == u[:32]
            self.key = cbc_decrypt(make(b"", key_salt), bytes(16), d["UE"]) if self.ok else b""
            return
        if self.r == 2:
            n = 5
        h = hashlib.md5(PAD + o[:32] + int(d["P"]).to_bytes(4, "little", signed=True) + file_id)
        if self.r >= 4 and d.get("EncryptMetadata") is False:
            h.update(b"\xff\xff\xff\xff")
        key = h.digest()[:n]
        for _ in range(50 if self.r >= 3 else 0):
            key = hashlib.md5(key).digest()[:n]
        self.key = key
        if self.r == 2:
            self.ok = rc4(key, PAD) == u[:32]
        else:
            x = rc4(key, hashlib.md5(PAD + file_id).digest())
            for i in range(1, 20):
                x = rc4(bytes(b ^ i for b in key), x)
            self.ok = x == u[:16]

    def decrypt(self, num: int, gen: int, data: bytes) -> bytes:
        if self.method in ("None", "Identity"):
            return data
        if self.method == "AESV3":
            return _unpad(cbc_decrypt(self.key, data[:16], data[16:]))
        salt = num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.method == "AESV2" else b"")
        key = hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]
        return _unpad(cbc_decrypt(key, data[:16], data[16:])) if self.method == "AESV2" else rc4(key, data)


def protect(objects: list[bytes], streams: dict[int, bytes], file_id: bytes = b"0123456789abcdef", aes: bool = False) -> tuple[bytes, dict[int, bytes]]:
    """An /Encrypt dictionary for the empty password (128 bits), and the streams encrypted under it; for writing test files."""
    owner = rc4(hashlib.md5(PAD).digest(), PAD)
    d = {"V": 4 if aes else 2, "R": 4 if aes else 3, "Length": 128, "O": owner, "U": bytes(32), "P": -4, "CF": {"StdCF": {"CFM": "AESV2"}}, "StmF": "StdCF"}
    h = Handler(d, file_id)
    x = rc4(h.key, hashlib.md5(PAD + file_id).digest())
    for i in range(1, 20):
        x = rc4(bytes(b ^ i for b in h.key), x)
    body = b"<< /Filter /Standard /V %d /R %d /Length 128 /P -4 /O <%s> /U <%s>" % (d["V"], d["R"], owner.hex().encode(), (x + bytes(16)).hex().encode())
    body += b" /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF >>" if aes else b" >>"
    out = {}
    for num, data in streams.items():
        if aes:
            n = 16 - len(data) % 16
            key = hashlib.md5(h.key + num.to_bytes(3, "little") + b"\0\0sAlT").digest()
            out[num] = bytes(16) + cbc_encrypt(key, bytes(16), data + bytes([n]) * n)
        else:
            out[num] = h.decrypt(num, 0, data)
    return body, out
