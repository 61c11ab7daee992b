"""Deterministic draws: xoshiro256** streams keyed by (seed, category, index). Arithmetic is modulo 2^64, which Spark's
checked integers cannot do, so streams run in numpy or Python integers and are pure functions of their key."""

from __future__ import annotations

MASK = (1 << 64) - 1

#: Stream categories; names may only be appended.
CATEGORIES = {
    name: i
    for i, name in enumerate(
        "DirTree GiantHeader BigHeader MedHeader OrdinaryHeader Blob Source TinyFile Unresolved Placement DenseHeader BroadToken LongLine EncodingMix PathoSymbol DupContent MutateSeed Mutate ProfileGen ProfileDir ProfileOracle CppGen Web Firmware".split(),
        1,
    )
}


def mix(z: int) -> int:
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return z ^ (z >> 31)


class Stream:
    """The stream of one key."""

    def __init__(self, seed: int, category: int, index: int):
        h = mix(0x9E3779B97F4A7C15 ^ (seed & 0xFFFFFFFF))
        h = mix(h ^ (category << 32))
        at = mix(h ^ (index & MASK))
        self.state = []
        for _ in range(4):
            at = (at + 0x9E3779B97F4A7C15) & MASK
            self.state.append(mix(at))

    def next(self) -> int:
        """A raw 64-bit value."""
        a, b, c, d = self.state
        x = (b * 5) & MASK
        out = ((((x << 7) | (x >> 57)) & MASK) * 9) & MASK
        c, d = c ^ a, d ^ b
        self.state = [a ^ d, b ^ c, c ^ ((b << 17) & MASK), ((d << 45) | (d >> 19)) & MASK]
        return out

    def below(self, bound: int) -> int:
        """A value in [0, bound)."""
        return (bound * (self.next() >> 32)) >> 32 if bound > 0 else 0

    def between(self, low: int, high: int) -> int:
        return low + self.below(high - low)

    def shuffled(self, items: list) -> list:
        """Fisher-Yates, from the end."""
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out

    def pick(self, cumulative: list[float | int]) -> int:
        """Index by weight, weights given as running sums of integers."""
        import bisect

        return bisect.bisect_right(cumulative, self.below(int(cumulative[-1])))

    def size(self, p50: int, p90: int, most: int) -> int:
        """A file size from bands below p50 (half of the draws), to p90 (four in ten) and to the largest; log-uniform in a
        band, by a doubling and a place in it, drawn again beyond the band."""
        # fixed values: the shares of the bands, 50 and 90 of 100, and the order of the draws
        p50 = max(1, p50)
        p90 = max(p50, p90)
        most = max(p90, most)
        r = self.below(100)
        low, high = (max(1, p50 // 2), p50) if r < 50 else (p50, p90) if r < 90 else (p90, most)
        if high <= low:
            return low
        doublings = (-(-high // low) - 1).bit_length()
        if doublings == 1:
            return low + self.next() % (high - low)
        while True:
            start = low << self.below(doublings)
            x = start + self.next() % start
            if x < high:
                return x


def line_selection(lines: int, density: float, seed: int, file_index: int) -> list[bool]:
    """Which lines of a file an edit takes: one draw per line, in order."""
    threshold = round(max(0.0, min(1.0, density)) * 10_000)
    stream = Stream(seed, CATEGORIES["Mutate"], 100_000 + file_index)
    return [stream.below(10_000) < threshold for _ in range(lines)]


def filled(pool: list, n: int, editable) -> list:
    """The first n editable items of a shuffled pool: what cannot be edited is made up for by the next."""
    out = []
    for item in pool:
        if len(out) == n:
            break
        if editable(item):
            out.append(item)
    return out
