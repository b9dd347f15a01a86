"""FLAC files as samples: frames of fixed and linear prediction with Rice-coded residuals, as the format is published.

A frame's bits are one array. Where codes begin is found by following a table of the next set bit; the
codes' values, and sums of fixed predictors, are then array operations. Each frame's checksums are verified.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

# Codes of block sizes, rates and sample sizes in frame headers (0: see elsewhere).
BLOCK_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8_000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


class Broken(ValueError):
    """The bytes are no valid stream."""


@dataclass(frozen=True)
class Info:
    """What a stream's first block says, where its frames begin, and known places: (sample, byte from there)."""

    rate: int
    channels: int
    bits: int
    frames: int
    largest_block: int
    start: int
    seeks: tuple[tuple[int, int], ...] = ()


@cache
def crc_table(width: int, polynomial: int) -> tuple[int, ...]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        crc = byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return tuple(out)


def crc(data: bytes, width: int, polynomial: int) -> int:
    table, shift, mask, out = crc_table(width, polynomial), width - 8, (1 << width) - 1, 0
    for byte in data:
        out = (out << 8 & mask) ^ table[out >> shift ^ byte]
    return out


def info(content: bytes) -> Info:
    """Reads the blocks in front of the frames; IndexError-free: too few bytes are Broken with how many are needed."""
    if content[:4] != b"fLaC":
        raise Broken("not a FLAC file")
    at, stream, seeks = 4, None, ()
    while True:
        if len(content) < at + 4:
            raise Broken(f"header needs {at + 4} bytes")
        last, kind, size = content[at] >> 7, content[at] & 127, int.from_bytes(content[at + 1 : at + 4])
        body = content[at + 4 : at + 4 + size]
        if len(body) < size:
            raise Broken(f"header needs {at + 4 + size} bytes")
        if kind == 0:
            packed = int.from_bytes(body[10:18])
            stream = int.from_bytes(body[2:4]), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        elif kind == 3:
            places = ((int.from_bytes(body[i : i + 8]), int.from_bytes(body[i + 8 : i + 16])) for i in range(0, size - 17, 18))
            seeks = tuple(p for p in places if p[0] < (1 << 64) - 1)
        at += 4 + size
        if last:
            break
    if stream is None:
        raise Broken("no stream block")
    largest, rate, channels, bits, frames = stream
    return Info(rate, channels, bits, frames, largest, at, seeks)


class Bits:
    """Bits of bytes, read from the left."""

    def __init__(self, data: bytes):
        self.bit = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0
        ones = np.flatnonzero(self.bit)
        gaps = np.diff(ones, prepend=-1)
        self.next_one = np.full(len(self.bit) + 1, len(self.bit), np.int64)  # of each place: that of the first set bit from it on
        self.next_one[: gaps.sum()] = np.repeat(ones, gaps)

    def number(self, n: int) -> int:
        if self.at + n > len(self.bit):
            raise EOFError
        out = 0
        for b in self.bit[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def signed(self, n: int) -> int:
        x = self.number(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """Zeros before the next set bit, which is passed too."""
        one = int(self.next_one[self.at])
        if one >= len(self.bit):
            raise EOFError
        n, self.at = one - self.at, one + 1
        return n

    def numbers(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Numbers of n bits from each of these places."""
        out = np.zeros(len(starts), np.int64)
        for j in range(n):
            out = out << 1 | self.bit[starts + j]
        return out

    def signed_run(self, count: int, n: int) -> np.ndarray:
        if self.at + count * n > len(self.bit):
            raise EOFError
        x = self.numbers(self.at + np.arange(count) * n, n)
        self.at += count * n
        return np.where(x >> (n - 1) & 1, x - (1 << n), x) if n else x

    def rice(self, count: int, k: int) -> np.ndarray:
        """`count` signed numbers: a unary part, k further bits, the sign in the lowest."""
        jump, at, ones = self.next_one, self.at, []
        end = len(self.bit)
        for _ in range(count):
            one = int(jump[at]) if at <= end else end
            ones.append(one)
            at = one + 1 + k
        if at > end:
            raise EOFError
        ends = np.array(ones, np.int64)
        begins = np.concatenate(([self.at], ends[:-1] + 1 + k))[:count]
        self.at = at
        x = (ends - begins) << k | self.numbers(ends + 1, k)
        return (x >> 1) ^ -(x & 1)


def residual(bits: Bits, block: int, order: int) -> np.ndarray:
    method = bits.number(2)
    if method > 1:
        raise Broken("unknown residual coding")
    wide, parts = 4 + method, 1 << bits.number(4)
    if block % parts or block // parts < order:
        raise Broken("residual does not fit its block")
    out = []
    for i in range(parts):
        k, n = bits.number(wide), block // parts - (order if i == 0 else 0)
        out.append(bits.signed_run(n, bits.number(5)) if k == (1 << wide) - 1 else bits.rice(n, k))
    return np.concatenate(out)


def fixed(warm: np.ndarray, rest: np.ndarray, order: int) -> np.ndarray:
    """Sums of the residual, once for each order, each with its start from the first samples."""
    starts = [np.diff(warm, n)[-1] if order else 0 for n in range(order)]
    for n in reversed(range(order)):
        rest = starts[n] + np.cumsum(rest)
    return np.concatenate((warm, rest))


def linear(warm: np.ndarray, rest: np.ndarray, weights: list[int], shift: int) -> np.ndarray:
    """Each sample is its residual and the weighted sum of those before, the nearest by the first weight."""
    out, back = warm.tolist(), weights[::-1]
    order = len(weights)
    for i, e in enumerate(rest.tolist()):
        out.append(e + (sum(w * x for w, x in zip(back, out[i : i + order], strict=True)) >> shift))
    return np.array(out, np.int64)


def subframe(bits: Bits, block: int, width: int) -> np.ndarray:
    if bits.number(1):
        raise Broken("subframe begins with a set bit")
    kind = bits.number(6)
    wasted = bits.unary() + 1 if bits.number(1) else 0
    width -= wasted
    if kind == 0:
        out = np.full(block, bits.signed(width), np.int64)
    elif kind == 1:
        out = bits.signed_run(block, width)
    elif 8 <= kind <= 12:
        warm = bits.signed_run(kind - 8, width)
        out = fixed(warm, residual(bits, block, kind - 8), kind - 8)
    elif kind >= 32:
        order = kind - 31
        warm = bits.signed_run(order, width)
        precision, shift = bits.number(4) + 1, bits.signed(5)
        if precision == 16 or shift < 0:
            raise Broken("unknown predictor")
        weights = [bits.signed(precision) for _ in range(order)]
        out = linear(warm, residual(bits, block, order), weights, shift)
    else:
        raise Broken("unknown subframe")
    return out << wasted


def frame(data: bytes, stream: Info) -> tuple[int, int, np.ndarray]:
    """Bytes, first sample and samples (block, channels) of the frame that `data` begins with; EOFError if it is longer."""
    if len(data) < 6:
        raise EOFError
    if data[0] != 0xFF or data[1] >> 1 != 0x7C or data[3] & 1:
        raise Broken("no frame where one should be")
    by_sample, size_code, rate_code, layout, bits_code = data[1] & 1, data[2] >> 4, data[2] & 15, data[3] >> 4, data[3] >> 1 & 7
    lead = 8 - (data[4] ^ 255).bit_length()  # set bits in front: bytes of the number, none for one
    more = max(0, lead - 1)
    if lead == 1 or lead > 7 or layout > MID_SIDE or size_code == 0:
        raise Broken("bad frame header")
    number = data[4] & ((1 << (7 - lead)) - 1 if lead else 127)
    for byte in data[5 : 5 + more]:
        number = number << 6 | byte & 63
    at = 5 + more
    extra = {6: 1, 7: 2}.get(size_code, 0)
    block = int.from_bytes(data[at : at + extra]) + 1 if extra else BLOCK_SIZES[size_code]
    at += extra + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if len(data) <= at:
        raise EOFError
    if crc(data[:at], 8, 0x07) != data[at]:
        raise Broken("frame header's checksum is wrong")
    bits = Bits(data[at + 1 :])
    width = SAMPLE_BITS.get(bits_code, stream.bits)
    sides = {LEFT_SIDE: (0, 1), SIDE_RIGHT: (1, 0), MID_SIDE: (0, 1)}.get(layout, (0,) * (layout + 1))
    parts = [subframe(bits, block, width + more) for more in sides]
    end = at + 1 + -(-bits.at // 8)
    if len(data) < end + 2:
        raise EOFError
    if crc(data[:end], 16, 0x8005) != int.from_bytes(data[end : end + 2]):
        raise Broken("frame's checksum is wrong")
    if layout == LEFT_SIDE:
        parts[1] = parts[0] - parts[1]
    elif layout == SIDE_RIGHT:
        parts[0] = parts[0] + parts[1]
    elif layout == MID_SIDE:
        mid = parts[0] * 2 | parts[1] & 1
        parts = [(mid + parts[1]) >> 1, (mid - parts[1]) >> 1]
    return end + 2, number if by_sample else number * stream.largest_block, np.stack(parts, 1)


def frames(read, stream: Info, first: int, count: int):
    """(first sample, samples) of the frames that hold samples from `first` on, `count` of them. read(at, n): n bytes, fewer at the end, from a place after the header."""
    at = max((byte for sample, byte in stream.seeks if sample <= first), default=0)
    guess = 64 + stream.channels * (stream.largest_block * (stream.bits + 2) // 8 + 64)
    data = b""
    while True:
        if len(data) < guess:
            data += read(at + len(data), guess - len(data))
        if not data:
            return
        while True:
            try:
                size, begin, samples = frame(data, stream)
                break
            except EOFError:  # longer than thought: read as much again
                more = read(at + len(data), len(data))
                if not more:
                    raise Broken("the last frame is cut off") from None
                data += more
        if begin + len(samples) > first:
            yield begin, samples
        if begin + len(samples) >= first + count:
            return
        at, data = at + size, data[size:]


def window(read, stream: Info, first: int, count: int) -> np.ndarray:
    """Samples (frames, channels) from -1 to 1: `count` from `first` on, fewer at the end."""
    parts = [x[max(0, first - begin) : first + count - begin] for begin, x in frames(read, stream, first, count)]
    whole = np.concatenate(parts) if parts else np.zeros((0, stream.channels), np.int64)
    return whole / float(1 << (stream.bits - 1))


def decoded(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames, channels) of a whole file."""
    stream = info(content)
    body = content[stream.start :]
    return stream.rate, window(lambda at, n: body[at : at + n], stream, 0, stream.frames or 1 << 62)
