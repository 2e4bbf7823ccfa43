"""The row codecs a bit at a time: what the batched ones must equal."""

from nearfield.operators.codecs import _steps


def _ranges(ids: list[int], u: int):
    """(value - low, number of values possible) of each step of the interpolative code."""
    y, n = [x + i for i, x in enumerate(ids)], len(ids)
    for mid, below, above in _steps(n):
        low = (y[below] if below >= 0 else -1) + mid - below
        high = (y[above] if above < n else u + n - 1) - (above - mid)
        yield y[mid] - low, high - low + 1


def _minimal(v: int, r: int) -> tuple[int, int]:
    """(code, bits) of v below r; the values in the middle get the short codes."""
    b = max(1, (r - 1).bit_length())
    c, short = r - (1 << (b - 1)), (1 << b) - r
    t = (v - c) % r
    return (t, b - 1) if t < short else (t + short, b)


class Bits:
    """Bits of an integer, least significant first."""

    def __init__(self, data: bytes = b""):
        self.x, self.n, self.at = int.from_bytes(data, "little"), 0, 0

    def put(self, v: int, bits: int) -> None:
        self.x |= v << self.n
        self.n += bits

    def get(self, bits: int) -> int:
        v = (self.x >> self.at) & ((1 << bits) - 1)
        self.at += bits
        return v

    def data(self) -> bytes:
        return self.x.to_bytes(-(-self.n // 8), "little")


def check_row(ids: list[int], u: int) -> None:
    if len(ids) > 255:
        raise ValueError(f"degree {len(ids)} is over 255")
    if any(b < a for a, b in zip(ids, ids[1:])):
        raise ValueError("unsorted row")
    if ids and not 0 <= ids[0] <= ids[-1] < u:
        raise ValueError("id out of range")


def encode_row(ids: list[int], u: int, codec: str) -> tuple[bytes, int]:
    """(data, bits) of one row."""
    check_row(ids, u)
    w = Bits()
    if codec == "rowef" and ids:
        low = max(0, (u // len(ids)).bit_length() - 1)
        for x in ids:
            w.put(x & ((1 << low) - 1), low)
        before = 0
        for x in ids:
            w.put(1 << ((x >> low) - before), (x >> low) - before + 1)
            before = x >> low
    elif codec == "rowpack" and ids:
        w.put(ids[0], max(0, (u - 1).bit_length()))
        if len(ids) > 1:
            gaps = [b - a for a, b in zip(ids, ids[1:])]
            width = max(gaps).bit_length()
            w.put(width, 6)
            for g in gaps:
                w.put(g, width)
    elif codec == "rowbic":
        for v, r in _ranges(ids, u):
            w.put(*_rotated(*_minimal(v, r), r))
    elif codec in ("raw", "packed"):
        for x in ids:
            w.put(x, 32)
    return w.data(), w.n


def _rotated(code: int, bits: int, r: int) -> tuple[int, int]:
    """The first b - 1 bits of a code come first, so that a reader knows from them whether one more follows."""
    b = max(1, (r - 1).bit_length())
    return (code, bits) if bits < b else ((code >> 1) | ((code & 1) << (b - 1)), bits)


def decode_row(data: bytes, n: int, u: int, codec: str) -> list[int]:
    w = Bits(data)
    if codec == "rowef" and n:
        low = max(0, (u // n).bit_length() - 1)
        lows, out, high = [w.get(low) for _ in range(n)], [], 0
        for x in lows:
            while not w.get(1):
                high += 1
            out.append((high << low) | x)
        return out
    if codec == "rowpack" and n:
        out = [w.get(max(0, (u - 1).bit_length()))]
        width = w.get(6) if n > 1 else 0
        for _ in range(n - 1):
            out.append(out[-1] + w.get(width))
        return out
    if codec == "rowbic":
        y = [0] * n
        for mid, below, above in _steps(n):
            low = (y[below] if below >= 0 else -1) + mid - below
            r = (y[above] if above < n else u + n - 1) - (above - mid) - low + 1
            b = max(1, (r - 1).bit_length())
            c, short = r - (1 << (b - 1)), (1 << b) - r
            t = w.get(b - 1)
            if t >= short:
                t = ((t << 1) | w.get(1)) - short
            y[mid] = low + (t + c) % r
        return [x - i for i, x in enumerate(y)]
    return [w.get(32) for _ in range(n)]
