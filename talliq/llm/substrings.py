"""Exact substring removal across documents by suffix arrays of shards.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id. Every such string holds
GRAMS-byte grams; the one with the least hash, the leftmost of equals, is its anchor, so all places of a string have the
same anchor, and neighbouring strings of one anchor form a segment. Rows are packed into chunks of some megabytes in the
order in which they come. First every chunk sends the hashes of its anchors, and how many segments each has, to the cells
that own them, and learns which anchors other documents have too. Then the segments of shared anchors go to the shard of
their anchor, each distinct segment of a chunk once, with the smallest id that has it. A shard sorts the suffixes of its
distinct segments by external induced sorting (suffixes.py); strings that common prefixes join get the smallest id among
them. A segment can match nothing but its copies and is left out of the sorting if no other distinct segment has its anchor
with half of what a window has besides, either before it or behind it.
What must go returns to the chunk as intervals. So frequent passages and copies cost one entry for each chunk, and nothing
is dropped or sampled.

A cell whose segments may weigh more than SHARD is dealt to several shards: by its anchors themselves, or, for an anchor
that is too frequent alone, also by what stands around it in a window. Each of STEPS steps takes half of the bytes of a
window that were not looked at yet, on the side that has them, so it cuts a segment in two at most; equal windows stay
together at every step. What a shard still weighs is sorted on disk. A cell
owns the anchors of about CELL bytes of text; so there is a message for each chunk and cell, and at hundreds of terabytes
both sizes should be raised with the executors' memory, which they fill three times over.

Null text is empty and loses nothing, as does a text shorter than LENGTH; a very long text is a chunk of its own. Repeated
rows of one id never remove each other's bytes, since no id is smaller than itself; a null id counts as larger than all
others. Each row gets a result; an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import expand, squeeze
from .suffixes import sorted_suffixes

LENGTH, GRAMS, STEPS = 50, 16, 2
#: Bytes of text whose anchors a cell owns.
CELL = 16 << 20
#: Weight of a shard at most: the bytes of its segments, and so many more for each segment and its places.
SHARD, EACH = 48 << 20, 52
#: Windows that are looked at together: what is computed of so many stays in a core's cache.
_CHUNK = 1 << 15
_LAST = (1 << 63) - 1


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    w = np.ndarray(len(x) - 7, "<u8", x, strides=(1,)).astype(np.uint64)
    return common.mixed(w[: len(w) - 8] * np.uint64(0x9E3779B97F4A7C15) ^ (w[8:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))


def anchored(text: bytes, length: int = LENGTH, grams: int = GRAMS):
    """Segments of the length-byte windows of a text: (anchor hashes, first windows, numbers of windows)."""
    hashes, _, first, many = _all_anchors([text], length, grams)
    return hashes, first, many


def _all_anchors(texts: list[bytes], length: int, grams: int):
    """Anchors of all texts of a chunk: (hash, text number, first window, windows). Texts are looked at as one; windows that
    reach from one to the next are left out. Where a block ends a segment may be cut in two."""
    whole = b"".join(texts)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=begin[1:])
    n, width = len(whole) - length + 1, length - grams + 1
    found: list[tuple] = []
    for a in range(0, n, _CHUNK):
        m = min(_CHUNK, n - a)
        h = _gram_hashes(np.frombuffer(whole, np.uint8, m + length - 1, a))
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        span, least = 1, key
        while span * 2 <= width:
            least, span = np.minimum(least[: len(least) - span], least[span:]), span * 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        new = np.ones(m, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        i, j = np.searchsorted(begin, (a, a + m))
        new[begin[i:j] - a] = True
        first = np.flatnonzero(new)
        at = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        # mixed again: the least of many hashes is small, and cells are shares of the hash's range
        found.append((common.mixed(h[at]) >> np.uint64(24), first + a, np.append(first[1:], m) + a))
    if not found:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    hashes, first, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    which = np.searchsorted(begin, first, "right") - 1
    many = np.minimum(ends, begin[which + 1] - length + 1) - first
    on = np.flatnonzero(many > 0)
    which, first = which[on], first[on]
    return hashes[on], which.astype(np.int32), first - begin[which], many[on].astype(np.int32)


def _cell_cuts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each cell's share of sorted 40-bit hashes begins."""
    return np.searchsorted((hashes >> np.uint64(8)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1))


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]][: len(starts)])
    return starts[new], ends[np.r_[new[1:], len(starts)][: len(new)] - 1]


def _merged(which: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Runs of intervals of each text number."""
    if not len(which):
        return which, starts, ends
    shift = np.int64(ends.max() + 2)
    a, b = _joined(which * shift + starts, which * shift + ends)
    return a // shift, a % shift, b - a // shift * shift


@lru_cache(1 << 16)
def _runs(anchor: int, many: int, steps: int, length: int, grams: int) -> list[tuple[int, int, int, int]]:
    """Runs of a segment's windows that are dealt by the same bytes: (first, behind the last, bytes from, bytes to). Each
    step takes half of the bytes of a window that were not looked at yet, on the side that has them."""
    out: list[tuple[int, int, int, int]] = []
    for j in range(many):
        low, high = anchor, anchor + grams
        for _ in range(steps):
            half = (length - (high - low) + 1) // 2
            if j + length - high >= half:
                high += half
            else:
                low -= half
        if out and out[-1][2:] == (low, high):
            out[-1] = (out[-1][0], j + 1, low, high)
        else:
            out.append((j, j + 1, low, high))
    return out


def _ids(ids: list[int | None]) -> np.ndarray:
    return np.array([_LAST if i is None else i for i in ids], np.int64)


def _sent(body: bytes, length: int, grams: int, n: int) -> list[tuple[int, bytes]]:
    """For each cell, a chunk's anchors that it owns: steps between sorted hashes, whether several ids have it, segments."""
    ids, texts = common.unpacked(body)
    ids = _ids(ids)
    hashes, which, _, _ = _all_anchors(texts, length, grams)
    order = np.lexsort((ids[which], hashes))
    h, i = hashes[order], ids[which][order]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    ends = np.r_[new[1:], len(h)][: len(new)]
    own, several, counts = h[new], (i[new] != i[ends - 1]).astype(np.uint8), (ends - new).astype(np.int32)
    cuts = _cell_cuts(own, n)
    parts = [(c, slice(cuts[c], cuts[c + 1])) for c in range(n) if cuts[c + 1] > cuts[c]]
    return [(c, squeeze(np.diff(own[p], prepend=np.uint64(0)), np.packbits(several[p]), counts[p])) for c, p in parts]


def _told(blobs: list[bytes], shard: int, most: int) -> list[bytes]:
    """Answers to a cell's messages: which anchors are shared, which are too frequent alone, and the cell's shards."""
    lists, flags, counts = [], [], []
    for blob in blobs:
        steps, bits, many = expand(blob)
        lists.append(np.cumsum(steps, dtype=np.uint64))
        flags.append(np.unpackbits(bits, count=len(steps)))
        counts.append(many)
    flat = np.concatenate(lists)
    values, where = np.unique(flat, return_inverse=True)
    shared = (np.bincount(where, minlength=len(values)) > 1) | (np.bincount(where, weights=np.concatenate(flags), minlength=len(values)) > 0)
    weights = np.bincount(where, weights=np.concatenate(counts), minlength=len(values)) * most * shared
    parts = max(1, int(-(-weights.sum() // shard)))
    hot, out, at = weights * 2 > shard, [], 0
    for part in lists:
        on = where[at : at + len(part)]
        out.append(squeeze(np.packbits(shared[on]), np.packbits(hot[on]), np.array([parts], np.int64)))
        at += len(part)
    return out


def _dealt(body: bytes, cells: list[int], answers: list[bytes], length: int, grams: int, steps: int, n: int) -> list[tuple[int, bytes]]:
    """A chunk's segments of shared anchors by shard, and under -1 what goes at once."""
    ids, texts = common.unpacked(body)
    ids = _ids(ids)
    hashes, which, first, many = _all_anchors(texts, length, grams)
    own_hashes, where = np.unique(hashes, return_inverse=True)
    anchors = len(own_hashes)
    cuts, shared, hot, parts = _cell_cuts(own_hashes, n), np.zeros(anchors, bool), np.zeros(anchors, bool), np.ones(anchors, np.int64)
    cell_of = np.zeros(anchors, np.int64)
    for cell, blob in zip(cells, answers, strict=True):
        a, b = cuts[cell], cuts[cell + 1]
        bits, crowded, split = expand(blob)
        shared[a:b], hot[a:b] = np.unpackbits(bits, count=b - a), np.unpackbits(crowded, count=b - a)
        parts[a:b], cell_of[a:b] = split[0], cell
    on = np.flatnonzero(shared[where])
    if not len(on):
        return []
    where, which, first, many = where[on], which[on], first[on], many[on]
    number: dict[bytes, int] = {}  # distinct segments
    known = number.setdefault
    code = np.array([known(texts[w][a:e], len(number)) for w, a, e in zip(which.tolist(), first.tolist(), (first + many + (length - 1)).tolist(), strict=True)], np.int64)
    segments, owner = list(number), ids[which]
    order = np.argsort(code, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
    least, at = np.minimum.reduceat(owner[order], new), where[order[new]]
    over = owner > least[code]
    kept = order[~over[order]]  # the places of each segment that stay, one segment after the other
    counts = np.bincount(code[kept], minlength=len(segments))
    begin = np.cumsum(counts) - counts
    which, cell = which.astype(np.int32), cell_of[at]
    sizes = np.fromiter(map(len, segments), np.int32, len(segments))
    whole = ~hot[at] | (parts[at] == 1)  # segments that aren't dealt by what stands around their anchor
    shard = cell.copy()
    many_parts = np.flatnonzero(whole & (parts[at] > 1))
    part = (own_hashes[at[many_parts]] % parts[at[many_parts]].astype(np.uint64)).astype(np.int64)
    pairs, back = np.unique(np.stack([cell[many_parts], part]), axis=1, return_inverse=True)
    shard[many_parts] = np.array([_shard(c, k) for c, k in pairs.T.tolist()], np.int64)[back.reshape(-1)]
    plain = np.flatnonzero(whole)
    plain = plain[np.argsort(shard[plain], kind="stable")]
    rows = []
    for own in np.split(plain, np.flatnonzero(np.diff(shard[plain])) + 1) if len(plain) else ():
        c = counts[own]
        places = kept[np.repeat(begin[own] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        data = np.frombuffer(b"".join([segments[k] for k in own.tolist()]), np.uint8)
        rows.append((int(shard[own[0]]), squeeze(data, sizes[own], least[own], c.astype(np.int32), which[places], first[places])))
    split: dict[int, list[tuple[bytes, int, np.ndarray, np.ndarray]]] = {}
    for k in np.flatnonzero(~whole).tolist():
        places = kept[begin[k] : begin[k] + counts[k]]
        for key, a, b in _split(segments[k], int(parts[at[k]]), length, grams, steps):
            split.setdefault(_shard(int(cell[k]), key), []).append((segments[k][a : b - 1 + length], int(least[k]), which[places], first[places] + a))
    rows += [(key, _packed(held)) for key, held in split.items()]
    gone = np.flatnonzero(over)
    if len(gone):
        rows.append((-1, squeeze(*_merged(which[gone].astype(np.int64), first[gone], first[gone] + many[gone] + length - 1))))
    return rows


def _split(segment: bytes, parts: int, length: int, grams: int, steps: int) -> list[tuple[int, int, int]]:
    """Shards of the windows of a segment whose anchor is too frequent alone, (shard, first, behind the last): by what stands
    around the anchor."""
    import xxhash

    many = len(segment) - length + 1
    hashes = _gram_hashes(np.frombuffer(segment, np.uint8)) >> np.uint64(24)
    return [(xxhash.xxh3_64_intdigest(segment[low:high]) % (parts * 16) + parts, a, b) for a, b, low, high in _runs(int(hashes.argmin()), many, steps, length, grams)]


def _shard(cell: int, key: int) -> int:
    """The number of a shard of a split cell; shards that happen to meet are one larger shard."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{cell} {key}".encode()) >> 1 | 1 << 62


def _packed(entries: list[tuple]) -> bytes:
    """(segment, id, text numbers, first windows) as one blob."""
    sizes = np.array([len(s) for s, *_ in entries], np.int32)
    counts = np.array([len(w) for _, _, w, _ in entries], np.int32)
    which, first = np.concatenate([w for _, _, w, _ in entries]), np.concatenate([f for *_, f in entries])
    return squeeze(np.frombuffer(b"".join(s for s, *_ in entries), np.uint8), sizes, np.array([i for _, i, *_ in entries], np.int64), counts, which.astype(np.int32), first.astype(np.int64))


_SEGMENTS = "cell long, chunk long, blob binary"


def _rows(rows: list[tuple[int, bytes]], chunk: int) -> pa.Table:
    return pa.table({"cell": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def shards(packed: DataFrame, *, length: int = LENGTH, grams: int = GRAMS, steps: int = STEPS, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """(cell, chunk, blob): segments by shard, and under -1 the intervals of a chunk that go without sorting."""
    n = common.cells_for(packed, cell)
    most = 2 * length - grams + EACH  # a segment has as many windows as a window has grams, at most

    def sent(batches):
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
                yield from _rows(_sent(body, length, grams, n), chunk).to_batches()

    def told(key, got):
        return pa.table({"chunk": got.column("chunk"), "cell": got.column("cell"), "blob": pa.array(_told(got.column("blob").to_pylist(), shard, most), pa.binary())})

    def dealt(key, got, answers):
        rows = _dealt(got.column("body")[0].as_py(), answers.column("cell").to_pylist(), answers.column("blob").to_pylist(), length, grams, steps, n) if len(got) else []
        return _rows(rows, key[0].as_py())

    anchors = packed.select("chunk", "body").mapInArrow(sent, _SEGMENTS)
    answers = anchors.groupBy("cell").applyInArrow(told, "chunk long, cell long, blob binary")
    return packed.select("chunk", "body").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(dealt, _SEGMENTS)


def intervals(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """(chunk, blob): bytes to remove, by chunk and the number of a text in it."""

    def sorted_out(key, got):
        if key[0].as_py() < 0:
            return got.select(["chunk", "blob"])
        return _sorted_out(got, length)

    # what goes without sorting needs no other chunk's rows: it is spread by chunk
    key = F.when(F.col("cell") < 0, -1 - F.col("chunk")).otherwise(F.col("cell"))
    dealt = segments.select(key.alias("cell"), "chunk", "blob").repartition(common.SPREAD * common.partitions(segments.sparkSession), "cell")
    return dealt.groupBy("cell").applyInArrow(sorted_out, "chunk long, blob binary")


def _sorted_out(got: pa.Table, length: int) -> pa.Table:
    """Intervals by chunk from the segments of a shard."""
    chunks = got.column("chunk").to_pylist()
    number: dict[bytes, int] = {}
    known = number.setdefault
    numbers, parts = [], []  # of a chunk's entries: numbers of their segments, ids, counts of places, places
    for blob in got.column("blob"):
        data, sizes, ids, counts, which, first = expand(blob.as_py())
        raw, ends = data.tobytes(), np.cumsum(sizes)
        numbers.append(np.array([known(raw[a:e], len(number)) for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64))
        parts.append((ids, counts, which, first))
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    owner = np.full(len(number), _LAST)
    np.minimum.at(owner, np.concatenate(numbers), np.concatenate([p[0] for p in parts]))
    segment, starts, ends = _removed_windows(list(number), sizes, owner, length)
    begin = np.searchsorted(segment, np.arange(len(owner) + 1))
    out_chunks, blobs = [], []
    for chunk, own, (ids, counts, which, first) in zip(chunks, numbers, parts, strict=True):
        whole = ids > owner[own]
        some = np.where(whole, 1, begin[own + 1] - begin[own])
        # one row for each place and run
        entry = np.repeat(np.arange(len(own)), counts)
        runs = some[entry]
        place = np.repeat(np.arange(len(entry)), runs)
        if not len(place):
            continue
        e = entry[place]
        step = np.arange(len(place)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = np.where(whole[e], 0, begin[own[e]] + step)
        a = np.where(whole[e], 0, starts[at] if len(starts) else 0)
        b = np.where(whole[e], sizes[own[e]], ends[at] if len(ends) else 0)
        out_chunks.append(chunk)
        blobs.append(squeeze(*_merged(which[place].astype(np.int64), first[place] + a, first[place] + b)))
    return pa.table({"chunk": pa.array(out_chunks, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _several(keys: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which of the keys that are there come more than once."""
    out = np.zeros(len(keys), bool)
    _, where, counts = np.unique(keys[there], return_inverse=True, return_counts=True)
    out[there] = counts[where] > 1
    return out


def _meeting(data: np.ndarray, begin: np.ndarray, length: int, grams: int) -> np.ndarray:
    """Which distinct segments may have a window that another one has too. A window has half of its bytes beside the anchor,
    at least, on one side of it; so those that meet share the anchor with so many bytes before it or behind it."""
    hashes = _gram_hashes(np.r_[data, np.zeros(grams, np.uint8)])[: len(data)]
    first, last = begin[:-1], begin[1:]
    key = hashes & np.uint64(0xFFFFFFFFFF000000)
    for k in range(1, grams):  # grams that reach beyond their segment
        key[last - k] = np.uint64(0xFFFFFFFFFF000000)
    key |= (np.arange(len(data)) - np.repeat(first, last - first)).astype(np.uint64)
    at = (np.minimum.reduceat(key, first) & np.uint64(0xFFFFFF)).astype(np.int64) + first
    half = -(-(length - grams) // 2)
    near, out = min(half, grams), np.zeros(len(first), bool)
    for there, far, close in ((at - half >= first, -half, -near), (at + half + grams <= last, half, near)):
        i = at[there]
        keys = np.zeros(len(at), np.uint64)
        keys[there] = common.mixed(hashes[i] + common.mixed(hashes[i + far] + common.mixed(hashes[i + close])))
        out |= _several(keys, there)
    return out


def _removed_windows(segments: list[bytes], sizes: np.ndarray, owner: np.ndarray, length: int, grams: int = GRAMS):
    """(segment number, first byte, behind the last) of the runs whose windows a segment of a smaller id has too."""
    none = np.zeros(0, np.int64)
    if len(segments) < 2:
        return none, none, none
    on = np.flatnonzero(_meeting(np.frombuffer(b"".join(segments), np.uint8), np.r_[0, np.cumsum(sizes)], length, grams))
    if not len(on):
        return none, none, none
    owner = owner[on]
    begin = np.r_[0, np.cumsum(sizes[on])]
    marked: list[np.ndarray] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        """What is held are whole groups of equal windows."""
        positions, group = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        segment = np.searchsorted(begin, positions, "right") - 1
        inside = positions + length <= begin[segment + 1]
        positions, segment, group = positions[inside], segment[inside], group[inside]
        if len(positions):
            new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            lowest = np.minimum.reduceat(owner[segment], new)
            lower = np.repeat(lowest, np.diff(np.r_[new, len(group)])) < owner[segment]
            marked.append(positions[lower])

    text = b"".join([segments[k] for k in on.tolist()])
    last = size = 0
    for positions, lengths in sorted_suffixes(text, length):
        if size > 1 << 18 and lengths[0] < length:  # a group may go on from one part to the next
            settle()
            size = 0
        group = last + np.cumsum(lengths < length)
        last = int(group[-1])
        several = np.r_[group[1:] == group[:-1], False] | np.r_[lengths[0] >= length, group[1:] == group[:-1]] | np.r_[np.zeros(len(group) - 1, bool), True]
        held.append((positions[several].astype(np.int64), group[several]))
        size += int(several.sum())
    if held:
        settle()
    at = np.sort(np.concatenate(marked)) if marked else none
    segment = np.searchsorted(begin, at, "right") - 1
    which, a, e = _merged(segment, at - begin[segment], at - begin[segment] + length)
    return on[which], a, e


def deduplicated(docs: DataFrame, finish, schema: str, *, id_col="doc_id", text_col="text", length: int = LENGTH, chunk: int = common.CHUNK, **options) -> DataFrame:
    """Applies finish(doc_id, text bytes, removed runs) to every document; its dicts are rows of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    packed = common.chunks(docs, id_col, text_col, chunk)
    gone = intervals(shards(packed, length=length, **options), length)
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def cut(key, got, blobs):
        if not len(got):
            return fields.empty_table()
        ids, texts = common.unpacked(got.column("body")[0].as_py())
        parts = [expand(b) for b in blobs.column("blob").to_pylist()]
        which, a, e = _merged(*[np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)]) if parts else (np.zeros(0, np.int64),) * 3
        begin = np.searchsorted(which, np.arange(len(ids) + 1)).tolist()
        runs = list(zip(a.tolist(), e.tolist(), strict=True))
        return pa.Table.from_pylist([finish(i, t, runs[begin[k] : begin[k + 1]]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], fields)

    return packed.select("chunk", "body").groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(cut, schema)


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, e in runs:
        parts.append(text[at:a])
        at = e
    return b"".join([*parts, text[at:]])


def _digest(doc_id, text, runs):
    return {
        "doc_id": doc_id, "n_bytes": len(text), "n_removed": sum(e - a for a, e in runs), "n_spans": len(runs),
        "kept_sha256": hashlib.sha256(kept_bytes(text, runs)).hexdigest(),
    }


def _kept(doc_id, text, runs):
    return {"doc_id": doc_id, "kept": kept_bytes(text, runs)}


def remaining(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, kept): the bytes that stay of each document."""
    return deduplicated(docs, _kept, "doc_id long, kept binary", **options)


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
