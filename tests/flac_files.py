"""An encoder of FLAC files for tests: every kind of subframe, stereo layout and residual coding."""

from __future__ import annotations

import numpy as np


class Out:
    def __init__(self):
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.bits.append(format(int(value) & ((1 << n) - 1), f"0{n}b"))

    def unary(self, n: int) -> None:
        self.bits.append("0" * n + "1")

    def data(self) -> bytes:
        text = "".join(self.bits)
        text += "0" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def remainder(data: bytes, width: int, polynomial: int) -> int:
    """The checksum by long division, a bit at a time."""
    value = int.from_bytes(data) << width
    for bit in range(len(data) * 8 - 1, -1, -1):
        if value >> (bit + width) & 1:
            value ^= (1 << width | polynomial) << bit
    return value


def residual(out: Out, rest: np.ndarray, block: int, order: int, parts_log: int, escape: bool) -> None:
    wide = escape or len(rest) > 0 and int(np.abs(rest).max()).bit_length() > 14
    out.put(1 if wide else 0, 2)
    out.put(parts_log, 4)
    at = 0
    for i in range(1 << parts_log):
        n = (block >> parts_log) - (order if i == 0 else 0)
        part = rest[at : at + n].tolist()
        at += n
        if escape and i % 2 == 0:
            width = max([1, *(int(abs(x)).bit_length() + 1 for x in part)])
            out.put(31, 5)
            out.put(width, 5)
            for x in part:
                out.put(x, width)
            continue
        k = max(0, int(np.abs(part).mean()).bit_length()) if part else 0
        out.put(k, 5 if wide else 4)
        for x in part:
            u = 2 * x if x >= 0 else -2 * x - 1
            out.unary(u >> k)
            out.put(u, k)


def subframe(out: Out, x: np.ndarray, width: int, kind: str, wasted: int = 0, parts_log: int = 0, escape: bool = False) -> None:
    x, width = x >> wasted, width - wasted
    name, _, order = kind.partition("-")
    order = int(order or 0)
    out.put(0, 1)
    out.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "linear": 31 + order}[name], 6)
    out.put(1 if wasted else 0, 1)
    if wasted:
        out.unary(wasted - 1)
    if name == "constant":
        out.put(x[0], width)
    elif name == "verbatim":
        for v in x.tolist():
            out.put(v, width)
    else:
        for v in x[:order].tolist():
            out.put(v, width)
        if name == "fixed":
            rest = np.diff(x, order) if order else x
        else:
            weights, shift = [7, -3, 1, -1][:order], 2
            out.put(5 - 1, 4)
            out.put(shift, 5)
            for w in weights:
                out.put(w, 5)
            values = x.tolist()
            rest = np.array([values[i] - (sum(w * values[i - 1 - j] for j, w in enumerate(weights)) >> shift) for i in range(order, len(values))], np.int64)
        residual(out, rest, len(x), order, parts_log, escape)


def coded(n: int) -> bytes:
    """A number as UTF-8 writes code points."""
    if n < 128:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 63)
        n >>= 6
        lead = len(tail) + 1
        if n < 1 << (7 - lead):
            return bytes([(0xFF00 >> lead) & 0xFF | n, *reversed(tail)])


def encode(x: np.ndarray, rate: int = 24_000, bits: int = 16, block: int = 192, layout: str = "independent", kinds=("fixed-2",), wasted: int = 0, parts_log: int = 0, escape: bool = False, seek_every: int = 0, variable: bool = False) -> bytes:
    """A file of integer samples (frames, channels)."""
    frames, places = [], []
    for number, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block]
        channels = [part[:, c] for c in range(x.shape[1])]
        widths, code = [bits] * len(channels), len(channels) - 1
        if layout != "independent":
            left, right = channels
            side = left - right
            channels, widths, code = {"left": ([left, side], [bits, bits + 1], 8), "right": ([side, right], [bits + 1, bits], 9), "mid": ([(left + right) >> 1, side], [bits, bits + 1], 10)}[layout]
        head = bytes([0xFF, 0xF9 if variable else 0xF8, 0x70, code << 4]) + coded(at if variable else number) + (len(part) - 1).to_bytes(2)
        head += bytes([remainder(head, 8, 0x07)])
        out = Out()
        kind = kinds[number % len(kinds)]
        order = int(kind.partition("-")[2] or 0)
        for c, w in zip(channels, widths, strict=True):
            fits = len(part) % (1 << parts_log) == 0 and len(part) >> parts_log >= order
            same = "constant" if kind == "constant" and len(set(c.tolist())) == 1 else "verbatim" if kind == "constant" or len(part) <= order else kind
            subframe(out, c, w, same, wasted if layout == "independent" else 0, parts_log if fits else 0, escape)
        data = head + out.data()
        if seek_every and number % seek_every == 0:
            places.append((at, sum(map(len, frames)), len(part)))
        frames.append(data + remainder(data, 16, 0x8005).to_bytes(2))
    packed = rate << 44 | (x.shape[1] - 1) << 41 | (bits - 1) << 36 | len(x)
    stream = block.to_bytes(2) * 2 + bytes(6) + packed.to_bytes(8) + bytes(16)
    table = b"".join(a.to_bytes(8) + b.to_bytes(8) + c.to_bytes(2) for a, b, c in places)
    blocks = [(0, stream), (4, b"comment" * 3), *([(3, table)] if places else [])]
    out = b"fLaC"
    for i, (kind, body) in enumerate(blocks):
        out += bytes([kind | (128 if i == len(blocks) - 1 else 0)]) + len(body).to_bytes(3) + body
    return out + b"".join(frames)
