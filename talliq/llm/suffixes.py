"""External induced sorting of the suffixes of a byte text, with common-prefix lengths.

Only the first DEPTH bytes of a suffix matter, so order and prefix lengths are exact up to DEPTH. Suffixes that start a
rise after a fall (leftmost S) are sorted first; scanning them in order induces all L suffixes through a priority queue,
and scanning those backwards induces all S suffixes through another. What queues carry is a suffix tuple: its position
and its common prefix with the tuple before it. A suffix induced from another gets that one's least common prefix since
the last suffix with the same first symbol, and one symbol more; so prefixes come out without comparing text.

The leftmost S suffixes themselves are sorted by recursion: their substrings are sorted by the same induction, which
gives names and says whether any two are equal; the text of names, whose symbols are whole numbers, is sorted by the same
function, down to a text with at most `base` leftmost S suffixes, which are sorted by their first DEPTH bytes at once.

A queue holds its tuples by symbol, or where there are many symbols by ranges of them, of which one at a time is split by
symbol; beyond `memory` bytes they go to a file. Logs of what was scanned, names and places are files too, and a text
beyond `memory` is read through a file mapping. So memory is a few times `memory` and 20 bytes for each of `base`, however
long the text is. All files are unnamed scratch files of the task in its executor's temporary folder; they vanish with it,
and a task that is run again makes its own. An empty text has no suffix.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

DEPTH = 50
#: Bytes of queues and logs that are held in memory; leftmost S suffixes that are sorted at once.
MEMORY, BASE = 64 << 20, 1 << 22
#: Tuples that are scanned together; ranges of symbols of a queue.
BATCH, RANGES = 1 << 16, 1 << 12
#: Bytes beyond depth that names tell apart.
_MORE = 8

Tuples = tuple[np.ndarray, np.ndarray]


class Log:
    """Tuples in the order in which they were put, read in blocks from either end."""

    def __init__(self, kind: np.dtype, memory: int):
        self.kind, self.n = np.dtype(kind), 0
        self.positions, self.lengths = (tempfile.SpooledTemporaryFile(max_size=memory) for _ in range(2))

    def put(self, positions: np.ndarray, lengths: np.ndarray) -> None:
        self.positions.seek(0, 2)
        self.positions.write(np.ascontiguousarray(positions, self.kind).tobytes())
        self.lengths.seek(0, 2)
        self.lengths.write(np.ascontiguousarray(lengths, np.uint8).tobytes())
        self.n += len(positions)

    def block(self, a: int, b: int) -> Tuples:
        self.positions.seek(a * self.kind.itemsize)
        self.lengths.seek(a)
        return np.frombuffer(self.positions.read((b - a) * self.kind.itemsize), self.kind), np.frombuffer(self.lengths.read(b - a), np.uint8)

    def forward(self) -> Iterator[Tuples]:
        for a in range(0, self.n, BATCH):
            yield self.block(a, min(a + BATCH, self.n))

    def backward(self) -> Iterator[Tuples]:
        """From the last tuple to the first; a tuple's length is now the one with the tuple that goes before it here."""
        after = 0
        for b in range(self.n, 0, -BATCH):
            positions, lengths = self.block(max(0, b - BATCH), b)
            yield positions[::-1], np.r_[lengths[1:], after].astype(np.uint8)[::-1]
            after = lengths[0]

    def close(self) -> None:
        self.positions.close()
        self.lengths.close()


class BySymbol:
    """Sorted tuples, taken symbol by symbol."""

    def __init__(self, blocks: Iterator[Tuples], level: Level):
        self.blocks, self.level, self.held = blocks, level, None
        self._next()

    def _next(self) -> None:
        self.held = next(self.blocks, None)
        if self.held is not None:
            symbols = self.level.symbols[self.held[0]]
            cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
            self.symbols, self.cuts, self.k = symbols[cuts].tolist(), [*cuts.tolist(), len(symbols)], 0

    def first(self) -> int | None:
        return None if self.held is None else self.symbols[self.k]

    def batches(self, symbol: int) -> Iterator[Tuples]:
        while self.held is not None and self.symbols[self.k] == symbol:
            a, b = self.cuts[self.k], self.cuts[self.k + 1]
            yield self.held[0][a:b], self.held[1][a:b]
            self.k += 1
            if self.k == len(self.symbols):
                self._next()


class Queue:
    """A priority queue of tuples: least symbol first, or greatest; those of one symbol in the order of pushing."""

    def __init__(self, level: Level, memory: int, greatest: bool = False):
        self.level, self.memory, self.sign = level, memory, -1 if greatest else 1
        self.shift = max(0, (level.alphabet - 1).bit_length() - RANGES.bit_length() + 1)
        self.ranges: dict[int, list] = {}
        self.heap: list[int] = []
        self.here: int | None = None  # the range that is split by symbol
        self.split: dict[int, list] = {}
        self.split_heap: list[int] = []
        self.held, self.file = 0, None

    def push(self, symbol: int, positions: np.ndarray, lengths: np.ndarray) -> None:
        key = symbol >> self.shift
        if key == self.here:
            chunks = self.split.get(symbol)
            if chunks is None:
                chunks = self.split[symbol] = []
                heapq.heappush(self.split_heap, self.sign * symbol)
            chunks.append((positions, lengths))
            return
        chunks = self.ranges.get(key)
        if chunks is None:
            chunks = self.ranges[key] = []
            heapq.heappush(self.heap, self.sign * key)
        chunks.append((positions, lengths))
        self.held += positions.nbytes + lengths.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for chunks in self.ranges.values():
            for k, chunk in enumerate(chunks):
                if isinstance(chunk[0], np.ndarray):
                    self.file.write(chunk[0].tobytes())
                    self.file.write(chunk[1].tobytes())
                    chunks[k] = (at, len(chunk[0]))
                    at += chunk[0].nbytes + len(chunk[0])
        self.held = 0

    def _read(self, chunk) -> Tuples:
        if isinstance(chunk[0], np.ndarray):
            return chunk
        kind = self.level.kind
        self.file.seek(chunk[0])
        positions = np.frombuffer(self.file.read(chunk[1] * kind.itemsize), kind)
        return positions, np.frombuffer(self.file.read(chunk[1]), np.uint8)

    def first(self) -> int | None:
        """The symbol whose turn it is."""
        if self.split_heap and self.heap and self.heap[0] < self.sign * self.here:  # an earlier range came up
            self.ranges[self.here] = [x for chunks in self.split.values() for x in chunks]
            heapq.heappush(self.heap, self.sign * self.here)
            self.split_heap = []
        if not self.split_heap:
            if not self.heap:
                return None
            self.here = self.sign * heapq.heappop(self.heap)
            chunks = self.ranges.pop(self.here)
            if not self.shift:
                self.split = {self.here: chunks}
            else:
                positions, lengths = (np.concatenate(x) for x in zip(*map(self._read, chunks), strict=True))
                symbols = self.level.symbols[positions]
                order = np.argsort(symbols, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(symbols[order]) != 0])
                self.split = {int(symbols[p[0]]): [(positions[p], lengths[p])] for p in np.split(order, cuts[1:])}
            self.split_heap = sorted(self.sign * s for s in self.split)
        return self.sign * self.split_heap[0]

    def batches(self, symbol: int) -> Iterator[Tuples]:
        """All tuples of the symbol whose turn it is, those pushed meanwhile included."""
        if self.first() != symbol:
            return
        chunks, k = self.split[symbol], 0
        while k < len(chunks):
            part, size = [], 0
            while k < len(chunks) and size < BATCH:
                part.append(self._read(chunks[k]))
                chunks[k] = None
                size += len(part[-1][0])
                k += 1
            yield part[0] if len(part) == 1 else tuple(np.concatenate(x) for x in zip(*part, strict=True))
        del self.split[symbol]
        heapq.heappop(self.split_heap)
        if not self.split_heap:
            self.here = None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Level:
    """A text of a recursion: symbols, and the place of each in the byte text, which is padded."""

    def __init__(self, symbols: np.ndarray, alphabet: int, padded: np.ndarray, end: int, depth: int, places: np.ndarray | None = None):
        self.symbols, self.alphabet, self.n = symbols, alphabet, len(symbols)
        self.padded, self.end, self.depth, self.places = padded, end, depth, places
        self.kind = np.dtype(np.int32 if end < 1 << 31 else np.int64)

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Places in the byte text."""
        return positions if self.places is None else self.places[positions]

    def common(self, a: int, b: int) -> int:
        """The common prefix of two suffixes, up to depth."""
        if self.places is not None:
            a, b = int(self.places[a]), int(self.places[b])
        most = min(self.depth, self.end - a, self.end - b)
        other = np.flatnonzero(self.padded[a : a + most] != self.padded[b : b + most])
        return int(other[0]) if len(other) else most

    def between(self, a: int, b: int) -> int:
        """The same for suffixes with different first symbols."""
        return 0 if self.places is None or a < 0 else self.common(a, b)

    def steps(self, positions: np.ndarray) -> np.ndarray | int:
        """Bytes from the symbols before positions to them."""
        return 1 if self.places is None else np.minimum(np.minimum(self.places[np.minimum(positions, self.n - 1)] + (positions == self.n) * self.depth, self.end) - self.places[positions - 1], self.depth)

    def starts(self) -> Iterator[np.ndarray]:
        """Positions of leftmost S suffixes in blocks, from the last block to the first; each block in order."""
        rises, after = False, None  # of the position behind the block
        for b in range(self.n, 0, -BATCH):
            a = max(0, b - BATCH)
            here = np.asarray(self.symbols[a:b]).astype(np.int64)
            following = np.r_[here[1:], here[-1] - 1 if after is None else after]
            known = np.flatnonzero(here != following)
            nearest = np.searchsorted(known, np.arange(len(here)))
            up = np.r_[(following > here)[known], rises][nearest]
            before = np.r_[self.symbols[a - 1] if a else here[0], here[:-1]]
            yield np.flatnonzero(up & (before > here)) + a
            rises, after = bool(up[0]), here[0]


class _Scan:
    """Pushes what scanned tuples induce, with common prefixes: for each value, it knows when the last one up to it was
    seen, and for each symbol, when something was last pushed."""

    def __init__(self, level: Level, queue: Queue):
        self.level, self.queue, self.time = level, queue, 0
        self.seen = np.full(level.depth + 1, -1, np.int64)
        if level.alphabet <= 1 << 16:
            self.pushed = np.full(level.alphabet, -1, np.int64)
        else:
            self.pushed = np.memmap(tempfile.TemporaryFile(), np.int64, "w+", shape=(level.alphabet,))
            self.pushed[:] = -1

    def __call__(self, positions: np.ndarray, lengths: np.ndarray, chars: np.ndarray, use: np.ndarray) -> None:
        """chars: the symbol before each position; use: tuples whose predecessor is to be pushed."""
        at, m, depth = np.flatnonzero(use), len(lengths), self.level.depth
        if len(at):
            chars = chars[at]
            order = np.argsort(chars, kind="stable")
            j, chars = at[order], chars[order]
            first = np.r_[True, chars[1:] != chars[:-1]]
            before = np.r_[-1, j[:-1]]
            before[first] = -1
            got = _least(lengths, before + 1, j)
            cuts = np.flatnonzero(first)
            symbols = chars[cuts]
            got[cuts] = np.minimum(got[cuts], np.minimum(np.searchsorted(self.seen, self.pushed[symbols], "right"), depth))
            ends = np.r_[cuts[1:], len(j)]
            self.pushed[symbols] = self.time + j[ends - 1]
            new, whole = (positions[j] - 1).astype(self.level.kind), np.minimum(got + self.level.steps(positions[j]), depth).astype(np.uint8)
            for a, b, c in zip(cuts.tolist(), ends.tolist(), symbols.tolist(), strict=True):
                self.queue.push(c, new[a:b], whole[a:b])
        last = np.full(depth + 1, -1, np.int64)
        np.maximum.at(last, lengths, np.arange(m))
        last = np.maximum.accumulate(last)
        self.seen = np.where(last >= 0, self.time + last, self.seen)
        self.time += m


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a..b], both included, for each pair, from a table of the least of each power of two."""
    size = b - a + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = np.zeros((int(level.max()) + 1, len(values)), np.uint8)
    table[0] = values
    for k in range(1, len(table)):
        half, n = 1 << (k - 1), len(values) - (1 << k) + 1
        np.minimum(table[k - 1, :n], table[k - 1, half : half + n], out=table[k, :n])
    return np.minimum(table[level, a], table[level, b - (1 << level) + 1]).astype(np.int64)


def _replaced(lengths: np.ndarray, first: int) -> np.ndarray:
    out = lengths.copy()
    out[0] = first
    return out


def _induced(level: Level, seeds, memory: int) -> Iterator[Tuples]:
    """All suffixes in order, from the leftmost S ones by symbol."""
    symbols = level.symbols
    falls, rising = Queue(level, memory), Queue(level, memory, greatest=True)
    lows, highs = Log(level.kind, memory), Log(level.kind, memory)
    try:
        scan, last = _Scan(level, falls), -1
        scan(np.array([level.n]), np.zeros(1, np.uint8), symbols[level.n - 1 :], np.ones(1, bool))
        while (turns := [s for s in (falls.first(), seeds.first()) if s is not None]):
            c, tail = min(turns), -1
            for positions, lengths in falls.batches(c):
                if tail < 0:
                    lengths = _replaced(lengths, level.between(last, int(positions[0])))
                lows.put(positions, lengths)
                before = symbols[np.maximum(positions - 1, 0)]
                scan(positions, lengths, before, (positions > 0) & (before >= c))
                last = tail = int(positions[-1])
            for k, (positions, lengths) in enumerate(seeds.batches(c)):
                if k == 0:
                    lengths = _replaced(lengths, level.common(tail, int(positions[0])) if tail >= 0 else level.between(last, int(positions[0])))
                scan(positions, lengths, symbols[positions - 1], np.ones(len(positions), bool))
                last = int(positions[-1])

        scan, last, back = _Scan(level, rising), -1, BySymbol(lows.backward(), level)
        while (turns := [s for s in (rising.first(), back.first()) if s is not None]):
            c, tail = max(turns), -1
            for positions, lengths in rising.batches(c):
                if tail < 0:
                    lengths = _replaced(lengths, level.between(last, int(positions[0])))
                highs.put(positions, lengths)
                before = symbols[np.maximum(positions - 1, 0)]
                scan(positions, lengths, before, (positions > 0) & (before <= c))
                last = tail = int(positions[-1])
            for k, (positions, lengths) in enumerate(back.batches(c)):
                if k == 0:
                    lengths = _replaced(lengths, level.common(tail, int(positions[0])) if tail >= 0 else level.between(last, int(positions[0])))
                before = symbols[np.maximum(positions - 1, 0)]
                scan(positions, lengths, before, (positions > 0) & (before < c))
                last = int(positions[-1])

        low, high, last = BySymbol(lows.forward(), level), BySymbol(highs.backward(), level), -1
        while (turns := [s for s in (low.first(), high.first()) if s is not None]):
            c, tail = min(turns), -1
            for k, (positions, lengths) in enumerate(low.batches(c)):
                if k == 0:
                    lengths = _replaced(lengths, level.between(last, int(positions[0])))
                yield positions, lengths
                last = tail = int(positions[-1])
            for k, (positions, lengths) in enumerate(high.batches(c)):
                if k == 0:
                    lengths = _replaced(lengths, level.common(tail, int(positions[0])) if tail >= 0 else level.between(last, int(positions[0])))
                yield positions, lengths
                last = int(positions[-1])
    finally:
        for x in (falls, rising, lows, highs):
            x.close()


def _words(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one big-endian number; the text is padded."""
    return np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))[at].astype(np.uint64)


def _sorted_starts(padded: np.ndarray, n: int, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their first bytes, at least depth of them, as an order of `at`, and prefix lengths.

    The padding behind the text's n bytes is zero: a suffix that ends there goes before one of real zeros, as the later
    of equals goes first, and no common prefix reaches beyond the end.
    """
    at = at[::-1]
    first = _words(padded, at)
    order = np.argsort(first, kind="stable").astype(np.int64)
    first = first[order]
    begins = np.r_[True, first[1:] != first[:-1]][: len(at)]  # of groups that are equal so far
    del first
    for k in range(8, depth, 8):
        group = np.cumsum(begins, dtype=np.int64)
        some = np.flatnonzero(~(begins & np.r_[begins[1:], True][: len(at)]))  # groups of more than one
        if not len(some):
            break
        value, group = _words(padded, at[order[some]] + k), group[some]
        inner = np.lexsort((value, group))
        order[some] = order[some][inner]
        value = value[inner]
        begins[some[1:]] |= (group[1:] == group[:-1]) & (value[1:] != value[:-1])
        del value, group, inner
    at = at[order]
    lengths = np.zeros(len(at), np.uint8)
    alive = np.arange(1, len(at))
    for k in range(depth):
        alive = alive[padded[at[alive] + k] == padded[at[alive - 1] + k]]
        if not len(alive):
            break
        lengths[alive] = k + 1
    short = np.minimum(n - at, depth)
    lengths[1:] = np.minimum(lengths[1:], np.minimum(short[1:], short[:-1]))
    return len(at) - 1 - order, lengths


def _sorted(level: Level, memory: int, base: int) -> Iterator[Tuples]:
    """All suffixes of a level in order."""
    count = sum(len(x) for x in level.starts())
    if count > base and level.places is None:  # substrings with equal names are longer than what must be exact
        level = Level(level.symbols, level.alphabet, level.padded, level.end, level.depth + _MORE)
    starts = np.memmap(tempfile.TemporaryFile(), level.kind, "w+", shape=(max(1, count),)) if count > base else np.empty(count, level.kind)
    end = count
    for block in level.starts():
        starts[end - len(block) : end] = block
        end -= len(block)
    seeds = Log(level.kind, memory)
    try:
        if count <= base:
            order, lengths = _sorted_starts(level.padded, level.end, np.asarray(level.at(starts)).astype(level.kind), level.depth)
            seeds.put(starts[order], lengths)
        else:
            _recursed(level, starts, seeds, memory, base)
        yield from _induced(level, BySymbol(seeds.forward(), level), memory)
    finally:
        seeds.close()


def _recursed(level: Level, starts: np.ndarray, seeds: Log, memory: int, base: int) -> None:
    """Puts the leftmost S suffixes in order, by names of their substrings."""
    loose = Queue(level, memory)  # in the order of their first symbols, all else undecided
    for a in range(0, len(starts), BATCH):
        block = np.asarray(starts[a : a + BATCH])
        symbols = level.symbols[block]
        order = np.argsort(symbols, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(symbols[order].astype(np.int64)) != 0])
        for part in np.split(order, cuts[1:]):
            loose.push(int(symbols[part[0]]), block[part], np.full(len(part), level.depth, np.uint8))
    names = np.memmap(tempfile.TemporaryFile(), level.kind, "w+", shape=(level.n // 2 + 1,))
    found, least, name, order = 0, level.depth, -1, Log(level.kind, memory)
    try:
        for positions, lengths in _induced(level, loose, memory):
            symbols = level.symbols[positions]
            before = level.symbols[np.maximum(positions - 1, 0)]
            ahead = level.symbols[np.minimum(positions + 1, level.n - 1)]
            # within one symbol, L suffixes come before S ones; which is which shows where the text stops repeating
            start = (positions > 0) & (before > symbols) & (ahead >= symbols) & (positions < level.n - 1)
            if (doubtful := np.flatnonzero(start & (ahead == symbols))).size:
                where = np.searchsorted(starts, positions[doubtful])
                start[doubtful] = (where < len(starts)) & (starts[np.minimum(where, len(starts) - 1)] == positions[doubtful])
            at = np.flatnonzero(start)
            if not len(at):
                least = min(least, int(lengths.min()))
                continue
            shared = np.minimum.reduceat(lengths[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            shared[0] = min(int(shared[0]), least) if found else 0
            rest = lengths[at[-1] + 1 :]
            least = int(rest.min()) if len(rest) else level.depth
            new = np.cumsum(shared < level.depth) + name
            names[positions[at] >> 1] = new
            name = int(new[-1])
            found += len(at)
            order.put(positions[at], shared)
        if name + 1 == found:
            for positions, lengths in order.forward():
                seeds.put(positions, lengths)
            return
        symbols = np.memmap(tempfile.TemporaryFile(), level.kind, "w+", shape=(found,))
        places = starts if level.places is None else np.memmap(tempfile.TemporaryFile(), level.kind, "w+", shape=(found,))
        for a in range(0, found, BATCH):
            block = np.asarray(starts[a : a + BATCH])
            symbols[a : a + BATCH] = names[block >> 1]
            if level.places is not None:
                places[a : a + BATCH] = level.places[block]
        inner = Level(symbols, name + 1, level.padded, level.end, level.depth, places)
        for positions, lengths in _sorted(inner, memory, base):
            seeds.put(starts[positions], lengths)
    finally:
        order.close()
        loose.close()


def sorted_suffixes(data: bytes | Iterable[bytes], depth: int = DEPTH, memory: int = MEMORY, base: int = BASE) -> Iterator[Tuples]:
    """Yields (positions, lengths) in suffix order: lengths are common prefixes with the entry before, up to depth. data
    may come in pieces, which are put on disk as they come."""
    pad = b"\0" * (depth + 16 + _MORE)
    if isinstance(data, bytes) and len(data) <= memory:
        n, padded = len(data), np.frombuffer(data + pad, np.uint8)
    else:
        file, n = tempfile.TemporaryFile(), 0
        for piece in [data] if isinstance(data, bytes) else data:
            file.write(piece)
            n += len(piece)
        file.write(pad)
        file.flush()
        padded = np.memmap(file, np.uint8, "r", shape=(n + len(pad),))
    if n:
        for positions, lengths in _sorted(Level(padded[:n], 256, padded, n, depth), memory, base):
            yield positions, np.minimum(lengths, depth).astype(np.uint8)
