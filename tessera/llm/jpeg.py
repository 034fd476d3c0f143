"""Baseline JPEG frames: entropy decoding of any baseline frame, and frames that hold bytes.

A byte frame keeps 63 bytes in each 8 x 8 block, one in each AC coefficient, as
a value of size 8: a byte of 128 or more is itself, one below is itself minus
255.  Its Huffman tables have one code for "size 8, no zeros before it" and
one for "DC unchanged", each a single 0 bit, so a block takes 1 + 63 * 9 bits,
71 bytes, and whole frames are coded and decoded with array operations.  All
quantisers are 1.  Any baseline decoder can read such a frame.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed order of coefficients in a block (row-major place of each), as in the standard.
ZIGZAG = np.array(
    sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
)
#: Bytes in a block and blocks in a row of a byte frame.
HELD, ACROSS = 63, 8
FRAME_BYTES = HELD * ACROSS * ACROSS
_CODED = (1 + HELD * 9) // 8


def _basis() -> np.ndarray:
    """8 x 8 inverse cosine transform for zigzag coefficients, times 2048, in whole numbers."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)[:, None]
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * 2048)


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(blocks_across: int, blocks_down: int) -> bytes:
    quant = _segment(0xDB, b"\0" + b"\1" * 64)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * blocks_down, 8 * blocks_across, 1) + b"\1\x11\0")
    dc = _segment(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x00")
    ac = _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x08")
    return b"\xff\xd8" + quant + frame + dc + ac + _segment(0xDA, b"\1\1\0\0\x3f\0")


def encode_bytes(payload: bytes) -> list[bytes]:
    """Frames of 64 x 64 pixels that hold ``payload``; the last is filled with zeros."""
    raw = np.frombuffer(payload, np.uint8)
    frames = -(-len(raw) // FRAME_BYTES)
    per = ACROSS * ACROSS
    raw = np.concatenate([raw, np.zeros(frames * FRAME_BYTES - len(raw), np.uint8)]).reshape(-1, HELD)
    head, out = _header(ACROSS, ACROSS), []
    for i in range(frames):
        bits = np.zeros((per, 1 + HELD * 9), np.uint8)
        b = raw[i * per : (i + 1) * per]
        bits[:, 1:].reshape(per, HELD, 9)[:, :, 1:] = np.unpackbits(b, axis=1).reshape(per, HELD, 8)
        out.append(head + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9")
    return out


class Frame:
    """Decoded coefficients of a frame: for each component, blocks x 64 in zigzag order, quantised."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], tuple] = {}
        self.restart, self.scan = 0, []
        self.components: list[dict] = []
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG frame")
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC0 or marker == 0xC1:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                for k in range(n):
                    c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                    self.components.append({"id": c, "h": hv >> 4, "v": hv & 15, "q": q})
            elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("only baseline frames are decoded")
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                for k in range(body[0]):
                    c, t = body[1 + 2 * k : 3 + 2 * k]
                    comp = next(x for x in self.components if x["id"] == c)
                    comp["dc"], comp["ac"] = t >> 4, t & 15
                    self.scan.append(comp)
                break
        end = data.rfind(b"\xff\xd9")
        self._decode(data[at : end if end >= at else len(data)])

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, i = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quant[i] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, counts = body[at], body[at + 1 : at + 17]
            symbols = body[at + 17 : at + 17 + sum(counts)]
            at += 17 + sum(counts)
            codes, code, k = {}, 0, 0
            for length in range(1, 17):
                for _ in range(counts[length - 1]):
                    codes[length, code] = symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.tables[kind >> 4, kind & 15] = (codes, bytes(counts), bytes(symbols))

    def _decode(self, coded: bytes) -> None:
        hmax, vmax = max(c["h"] for c in self.scan), max(c["v"] for c in self.scan)
        one = len(self.scan) == 1
        if one:
            across, down = -(-self.width // 8), -(-self.height // 8)
        else:
            across, down = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        self.across, self.down, self.hmax, self.vmax = across, down, hmax, vmax
        if one and not self.restart and self._uniform(coded):
            return
        for c in self.scan:
            c["blocks"] = np.zeros((across * down * (1 if one else c["h"] * c["v"]), 64), np.int64)
        units = across * down
        step = self.restart or units
        parts = self._intervals(coded) if self.restart else [coded.replace(b"\xff\0", b"\xff")]
        done = 0
        for part in parts:
            bits = _Bits(part)
            before = [0] * len(self.scan)
            for u in range(done, min(done + step, units)):
                for k, c in enumerate(self.scan):
                    n = 1 if one else c["h"] * c["v"]
                    for j in range(n):
                        before[k] = self._block(bits, c, c["blocks"][u * n + j], before[k])
            done += step

    def _intervals(self, coded: bytes) -> list[bytes]:
        out, start, at = [], 0, coded.find(b"\xff")
        while at >= 0:
            if 0xD0 <= coded[at + 1 : at + 2][0] <= 0xD7 if at + 1 < len(coded) else False:
                out.append(coded[start:at])
                start = at + 2
            at = coded.find(b"\xff", at + 2)
        out.append(coded[start:])
        return [p.replace(b"\xff\0", b"\xff") for p in out]

    def _uniform(self, coded: bytes) -> bool:
        """Blocks of fixed length, as byte frames have them, in array operations."""
        c = self.scan[0]
        dc, ac = self.tables[0, c["dc"]], self.tables[1, c["ac"]]
        if dc[1][0] != 1 or dc[2][:1] != b"\0" or ac[1][0] != 1 or ac[2][:1] != b"\x08":
            return False
        raw = coded.replace(b"\xff\0", b"\xff")
        n = self.across * self.down
        if len(raw) < n * _CODED:
            return False
        bits = np.unpackbits(np.frombuffer(raw[: n * _CODED], np.uint8)).reshape(n, -1)
        rest = bits[:, 1:].reshape(n, HELD, 9)
        if bits[:, 0].any() or rest[:, :, 0].any():
            return False
        value = np.packbits(np.ascontiguousarray(rest[:, :, 1:]).reshape(n, -1), axis=1).astype(np.int16)
        c["blocks"] = np.zeros((n, 64), np.int16)
        c["blocks"][:, 1:] = np.where(value >= 128, value, value - 255)
        return True

    def _block(self, bits: _Bits, c: dict, out: np.ndarray, before: int) -> int:
        size = bits.symbol(self.tables[0, c["dc"]][0])
        before += bits.value(size)
        out[0] = before
        k, codes = 1, self.tables[1, c["ac"]][0]
        while k < 64:
            s = bits.symbol(codes)
            run, size = s >> 4, s & 15
            if size == 0:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            out[k] = bits.value(size)
            k += 1
        return before

    def held(self) -> bytes:
        """The bytes of a byte frame: its AC coefficients."""
        v = self.scan[0]["blocks"][:, 1:]
        return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()

    def luma(self) -> np.ndarray:
        """Pixels of the first component, from 0 to 255, height x width of whole blocks.

        The transform is in whole numbers, so the same frame always gives the
        same pixels.
        """
        c = self.scan[0]
        q = self.quant[c["q"]]
        x = c["blocks"] * q
        exact = np.float32 if (q == 1).all() and abs(x).max(initial=0) <= 255 else np.float64
        p = x.astype(exact) @ BASIS.astype(exact)
        p = np.clip(np.floor(p / 2048 + 0.5) + 128, 0, 255).astype(np.uint8)
        h, v = (1, 1) if len(self.scan) == 1 else (c["h"], c["v"])
        p = p.reshape(self.down, self.across, v, h, 8, 8)
        return p.transpose(0, 2, 4, 1, 3, 5).reshape(self.down * v * 8, self.across * h * 8)


class _Bits:
    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist()
        self.at = 0

    def symbol(self, codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        if not size:
            return 0
        n = 0
        for b in self.bits[self.at : self.at + size]:
            n = n << 1 | b
        self.at += size
        return n if n >> (size - 1) else n - (1 << size) + 1
