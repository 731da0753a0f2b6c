"""Operator 10: removal of repeated byte strings by suffix arrays per shard, with exact matches of SPAN bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Filter, RollingHash, durable, mix64

#: Bytes of a string that counts as repeated, and of the grams whose least hash keys each such string; the second
#: length is for strings whose key very many documents hold.
SPAN, GRAM, LONG_GRAM = 50, 25, 44
#: Documents from which a key is hot. Runs of hot keys are dealt out by their content, and their strings one by one, so what
#: a single task gets under one key is the runs of HOT_DOCS documents, most of them of less than 2 * SPAN bytes.
HOT_DOCS = 8000
#: Set in the keys of runs that were under a hot key; the others have 48 bits.
_HOT = np.uint64(1 << 48)
#: Most bytes of the filter of repeated keys; it is all that is broadcast. A fuller filter passes more, and stays right.
FILTER_BYTES = 64 << 20
#: Text bytes of a suffix array; text bytes a mapper holds before it lets its parts go.
BLOCK_BYTES, HELD_BYTES = 3 << 20, 48 << 20
#: Segments of the keys: one for each SEGMENT_INPUT bytes of the input's files, within these bounds. The upper one lets a segment
#: stand for 100 MB of 100 TB; segments without keys cost nothing.
LEAST_SEGMENTS, MOST_SEGMENTS, SEGMENT_INPUT = 64, 1 << 20, 8 << 20
#: Shards of the unequal runs: one for each SHARD_INPUT bytes, LEAST_SHARDS or more, so that most fit in one block.
LEAST_SHARDS, SHARD_INPUT = 16, 2 << 20
_LAST = np.iinfo(np.int64).max


# --- suffix arrays -------------------------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, the first highest; zeros follow the end."""
    w = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w[: len(text)]


def _sorted_suffixes(text: np.ndarray, depth: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (those of `at`, or all) in the order of their suffixes' first `depth` bytes, and where groups that agree in them begin.

    Larsson-Sadakane refinement: suffixes are sorted by eight bytes; then, with h doubling up to depth, only groups not yet told apart
    are sorted by the ranks of the suffixes h bytes on, in the last round depth - h bytes on. Orders are by whole groups at once, in
    numpy; of the places beside `at` a round ranks only those that a later one looks up."""
    n = len(text)
    steps, h = [], 8
    while h < depth:
        steps.append(min(h, depth - h))
        h += steps[-1]
    wanted = [np.ones(n, bool)] * (len(steps) + 1)
    if at is not None:
        wanted[-1] = np.zeros(n, bool)
        wanted[-1][at] = True
        for k in range(len(steps) - 1, -1, -1):
            wanted[k] = wanted[k + 1].copy()
            wanted[k][steps[k] :] |= wanted[k + 1][: n - steps[k]]
    w = _words(text)
    sa = np.flatnonzero(wanted[0])
    w = w[sa]
    order = np.argsort(w)
    sa, w = sa[order], w[order]
    head = np.r_[True, w[1:] != w[:-1]] if len(sa) else np.empty(0, bool)
    rank = np.zeros(n + depth + 8, dtype=np.uint64)
    for k, step in enumerate(steps):
        starts = np.flatnonzero(head)
        size = np.diff(np.r_[starts, len(sa)])
        rank[sa] = np.repeat(starts + 1, size)
        if len(starts) == len(sa):
            break
        loose = np.repeat(size > 1, size)
        if at is not None:  # the others have the ranks that are looked up; heads are drawn anew without them
            kept = wanted[k + 1][sa]
            group = np.cumsum(head)[kept]
            sa, loose = sa[kept], loose[kept]
            head = np.r_[True, group[1:] != group[:-1]] if len(sa) else np.empty(0, bool)
        loose = np.flatnonzero(loose)
        sub = sa[loose]
        key = (rank[sub] << np.uint64(32)) | rank[sub + step]
        order = np.argsort(key)
        key = key[order]
        sa[loose] = sub[order]
        head[loose[1:]] |= key[1:] != key[:-1]
        head[loose[:1]] = True
    if at is not None:  # after an early end
        kept = wanted[-1][sa]
        group = np.cumsum(head)[kept]
        sa, head = sa[kept], np.r_[True, group[1:] != group[:-1]][: len(group)]
    return sa, head


def suffix_array(text: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Places of a text in the order of their suffixes' first `depth` bytes."""
    return _sorted_suffixes(text, depth)[0]


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in `sa` with the one before it (Kasai et al., in text order).

    A place's prefix is one less than that of the place before it wherever both neighbours are preceded by one and the same
    byte; all others are compared, eight bytes at a time, together."""
    n = len(sa)
    if not n:
        return np.empty(0, np.int64)
    before = np.empty(n, dtype=np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    fresh = (i == 0) | (before <= 0)
    rest = np.flatnonzero(~fresh)
    # The place before must itself follow the same neighbour, which ties beyond the sorted depth can break.
    fresh[rest] = (text[rest - 1] != text[before[rest] - 1]) | (before[rest - 1] != before[rest] - 1)
    w = np.concatenate([_words(text), np.zeros(8, np.uint64)])
    at = np.flatnonzero(fresh & (before >= 0))
    found = np.zeros(n, dtype=np.int64)
    length = np.zeros(len(at), dtype=np.int64)
    live = np.arange(len(at))
    while len(live):
        a, b = at[live] + length[live], before[at[live]] + length[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        x = w[a] ^ w[b]
        same = x == 0
        part = live[~same]
        if len(part):
            y = x[~same]
            length[part] += sum((y < np.uint64(1 << b)).astype(np.int64) for b in range(8, 64, 8))  # leading bytes that agree
        live = live[same]
        length[live] += 8
    found[at] = np.minimum(length, n - np.maximum(at, before[at]))
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    plcp = np.maximum(np.where(before >= 0, found[last] - (i - last), 0), 0)
    return plcp[sa]


# --- keys ----------------------------------------------------------------------------------------------------------


def window_keys(hashes: RollingHash, gram: int) -> np.ndarray:
    """The key of each string of SPAN bytes: the least hash of the grams within it. Equal strings have equal keys."""
    m = hashes.windows(gram)
    width, have = SPAN - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
        have += step
    return m


class Batch:
    """Some documents' bytes one after another; strings that would cross from one into the next are left out."""

    def __init__(self, doc: list[int], mark: list[int], data: list[np.ndarray]):
        self.doc, self.mark, self.data = np.array(doc, np.int64), np.array(mark, np.int64), np.concatenate(data)
        self.begin = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in data], out=self.begin[1:])
        self.hash = RollingHash(self.data)

    def check(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes that have nothing in common with `hash`."""
        return RollingHash(self.data, 1)(start, end)

    def runs(self, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, strings, key) of the runs of strings under one key; starts count from the batch's first byte."""
        keys = window_keys(self.hash, gram)
        if not len(keys):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        edge = np.ones(len(keys) + 1, dtype=bool)
        np.not_equal(keys[1:], keys[:-1], out=edge[1:-1])
        edge[self.begin[:-1][self.begin[:-1] < len(keys)]] = True
        last = self.begin[1:] - SPAN + 1  # the first string of each document that would cross into the next
        edge[last[(last >= 0) & (last < len(keys))]] = True
        head = np.flatnonzero(edge)
        start, n = head[:-1], np.diff(head)
        of = np.searchsorted(self.begin, start, side="right") - 1
        whole = start + SPAN <= self.begin[of + 1]
        return of[whole], start[whole], n[whole], keys[start[whole]]


def batched(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[Batch]:
    """Documents (doc, mark, text) in batches of about `most` bytes; those too short for any string are left out."""
    doc, mark, data, size = [], [], [], 0
    for batch in batches:
        for d, m, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), dtype=np.uint8)
            if len(raw) >= SPAN:
                doc.append(d)
                mark.append(m)
                data.append(raw)
                size += len(raw)
            if size > most or len(doc) >= 60_000:
                yield Batch(doc, mark, data)
                doc, mark, data, size = [], [], [], 0
    if doc:
        yield Batch(doc, mark, data)


def _short(keys: np.ndarray) -> np.ndarray:
    """48 bits of a key, as they are counted and filtered."""
    return keys >> np.uint64(16)


def _by_segment(keys: np.ndarray, segments: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts keys by segment, and (segment, begin, end) in it of the segments that have any."""
    seg = (keys % np.uint64(segments)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg = seg[order]
    edges = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True]) if len(seg) else np.zeros(1, np.int64)
    return order, list(zip(seg[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def repeated_keys(documents: DataFrame, segments: int) -> tuple[Filter, Filter]:
    """Filters of the keys that two or more rows hold, and of the hot ones.

    A task sends each segment its distinct keys with their numbers of documents, packed; a segment adds them up and
    answers with two bitmaps. Only the bitmaps, FILTER_BYTES each at most in all, come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            order, cut = _by_segment(keys, segments)
            keys, times = keys[order], times[order]
            ones, more = [], []
            for _, a, b in cut:
                k, t = keys[a:b], times[a:b]
                ones.append(k[t == 1].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                more.append(k[t > 1].tobytes() + t[t > 1].astype(np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array(ones, pa.binary()), pa.array(more, pa.binary())], ["segment", "ones", "more"])

        for b in batched(batches):
            of, _, _, keys = b.runs(GRAM)
            # One key counts once for a document: 48 bits of key and 16 of the document's place in the batch.
            held.append(np.unique((_short(keys) << np.uint64(16)) | of.astype(np.uint64)) >> np.uint64(16))
            n += len(held[-1])
            if n > 4_000_000:
                yield flush()
                held, n = [], 0
        yield flush()

    def add(part):
        ones, more = part.column("ones").to_pylist(), part.column("more").to_pylist()
        raw = np.frombuffer(b"".join(ones), dtype=np.uint8).reshape(-1, 6)
        single = np.zeros((len(raw), 8), dtype=np.uint8)
        single[:, :6] = raw
        keys, times = [single.reshape(-1).view(np.uint64)], [np.ones(len(raw), dtype=np.int64)]
        for m in more:
            half = len(m) // 2
            keys.append(np.frombuffer(m[:half], dtype=np.uint64))
            times.append(np.frombuffer(m[half:], dtype=np.int64))
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        sums = np.add.reduceat(times, head) if len(head) else np.empty(0, np.int64)
        keys = keys[head]
        maps = [pa.array([Filter.build(keys[sums > n], segments, FILTER_BYTES)], pa.binary()) for n in (1, HOT_DOCS)]
        return pa.table([part.column("segment").combine_chunks()[:1], *maps], names=["segment", "repeated", "hot"])

    counted = documents.mapInArrow(count, "segment int, ones binary, more binary")
    rows = counted.groupBy("segment").applyInArrow(add, "segment int, repeated binary, hot binary").collect()
    return tuple(Filter({r["segment"]: bytes(r[k]) for r in rows}, segments) for k in ("repeated", "hot"))


# --- matching, and the passes ------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays))


def _unpack(body: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, dtype=kind, count=n // np.dtype(kind).itemsize, offset=at + 8))
        at += 8 + n
    return out


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as maximal ones."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.r_[True, start[1:] > end[:-1]]
    return start[head], end[np.r_[np.flatnonzero(head)[1:] - 1, len(end) - 1]]


def _candidates(b: Batch, known: tuple[Filter, Filter]) -> tuple[np.ndarray, ...]:
    """(document, key, start, strings, content, check) of the runs of strings that may occur in another document.

    Content and check are two hashes of a run's bytes, independent of each other: 128 bits together."""
    of, start, n, key = b.runs(GRAM)
    key = _short(key)
    may = known[0].has(key)
    of, start, n, key = of[may], start[may], n[may], key[may]
    hot = known[1].has(key)
    if hot.any():  # their strings are in runs of longer grams, which keep more of what differs apart
        longer = window_keys(b.hash, LONG_GRAM)
        wanted = np.repeat(hot, n)
        place = (np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()))[wanted]
        owner, k2 = np.repeat(of, n)[wanted], longer[place]
        head = np.append(0, np.flatnonzero((place[1:] != place[:-1] + 1) | (k2[1:] != k2[:-1])) + 1)
        cold = ~hot
        of, start = np.append(of[cold], owner[head]), np.append(start[cold], place[head])
        n, key = np.append(n[cold], np.diff(np.append(head, len(place)))), np.append(key[cold], np.full(len(head), _HOT))
    end = start + n + SPAN - 1
    content = b.hash(start, end)
    own = key == _HOT  # by their content, so that one key's many runs are dealt to many tasks
    key[own] = _short(content[own]) | _HOT
    return of, key, start, n, content, b.check(start, end)


def _entry(content: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """What stands in a filter for a content in a document."""
    return mix64(content + mix64(check ^ mix64(doc.view(np.uint64))))


def _settle(text: np.ndarray, at: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one block's chunks: each string's class, in the chunks' order, and of each class a place and its least document, by suffix array."""
    places = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
    owner = np.empty(len(text), dtype=np.int64)
    owner[places] = np.repeat(doc, n)
    sa, first = _sorted_suffixes(text, SPAN, places)
    head = np.flatnonzero(first)
    kind = np.empty(len(text), dtype=np.int64)
    kind[sa] = np.cumsum(first) - 1
    return kind[places], np.stack([sa[head], np.minimum.reduceat(owner[sa], head)])


def _stretches(gone: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, first string, strings) of the maximal stretches of strings that go; chunks have n strings each, one after another."""
    edge = np.zeros(len(gone) + 1, dtype=bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    begin = np.cumsum(n) - n
    edge[begin] = edge[-1] = True
    cut = np.flatnonzero(edge)
    cut, size = cut[:-1], np.diff(cut)
    cut, size = cut[gone[cut]], size[gone[cut]]
    of = np.searchsorted(begin, cut, side="right") - 1
    return of, cut - begin[of], size


def _shard_spans(part):
    """Removed spans of one shard's chunks: a suffix array for each block, and the blocks' sorted strings merged by binary search."""
    texts, blocks, size = [], [[]], 0
    for body in part.column("chunks").to_pylist():
        doc, mark, start, n, data = _unpack(body, np.int64, np.int64, np.int64, np.int64, np.uint8)
        at = np.r_[0, np.cumsum(n + SPAN - 1)]
        lo = 0
        while lo < len(n):  # whole chunks, up to a block's bytes
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES - size, side="right")) - 1)
            if size and at[hi] - at[lo] + size > BLOCK_BYTES:
                blocks.append([])
                size = 0
                continue
            blocks[-1].append((doc[lo:hi], mark[lo:hi], start[lo:hi], n[lo:hi], data[at[lo] : at[hi]]))
            size += at[hi] - at[lo]
            lo = hi
    settled = []
    for b in blocks:
        if not b:
            continue
        doc, mark, start, n, text = (np.concatenate(x) for x in zip(*b, strict=True))
        at = np.r_[0, np.cumsum(n + SPAN - 1)[:-1]]
        kind, (first, least) = _settle(text, at, n, doc)
        # The strings themselves, in the suffix array's order; all have SPAN bytes, so numpy compares them in full.
        names = np.lib.stride_tricks.sliding_window_view(text, SPAN)[first].view(f"S{SPAN}")[:, 0] if len(blocks) > 1 else np.empty(0, f"S{SPAN}")
        settled.append((doc, mark, start, n, kind, least, names))
    rows = []
    for k, (doc, mark, start, n, kind, least, names) in enumerate(settled):
        least = least.copy()
        for j, (_, _, _, _, _, theirs, other) in enumerate(settled):
            if j != k and len(other):
                to = np.minimum(np.searchsorted(other, names), len(other) - 1)
                np.minimum(least, np.where(other[to] == names, theirs[to], _LAST), out=least)
        gone = least[kind] < np.repeat(doc, n)
        of, place, size = _stretches(gone, n)
        texts.append((doc[of], mark[of], start[of] + place, start[of] + place + size + SPAN - 1))
    if texts:
        rows = _span_rows(*(np.concatenate(x) for x in zip(*texts, strict=True)))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc", "mark", "spans"])


def _span_rows(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A row for each document: its spans, merged and packed. All documents' spans are merged at once."""
    if not len(doc):
        return []
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]
    base = (np.cumsum(fresh) - 1) * (int(end.max()) + 1)  # keeps a document's ends above all those before it
    reach = np.maximum.accumulate(end + base)
    head = np.flatnonzero(np.r_[True, fresh[1:] | (start[1:] + base[1:] > reach[:-1])])
    spans = np.stack([start[head], (reach - base)[np.r_[head[1:], len(doc)] - 1]]).astype(np.int64)
    cut = np.append(np.flatnonzero(fresh[head]), len(head))
    at = head[cut[:-1]]
    return [(d, m, spans[:, a:b].tobytes()) for d, m, a, b in zip(doc[at].tolist(), mark[at].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _dealt(documents: DataFrame) -> tuple[int, int]:
    """How many segments the keys are dealt into, and how many shards the unequal runs: by the size that the files' own statistics give, or by a sum where they give none."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark's stand-in for an unknown size
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(LEAST_SEGMENTS, size // SEGMENT_INPUT), MOST_SEGMENTS), min(max(LEAST_SHARDS, size // SHARD_INPUT), MOST_SEGMENTS)


def _spans_table(rows: list[tuple[int, int, bytes]], segment: int | None = None, bitmap: bytes | None = None) -> pa.Table:
    """Span rows, and a row for a segment's bitmap."""
    extra = [] if bitmap is None else [(None, None, None)]
    cols = [pa.array([r[j] for r in rows + extra], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.table([*cols, pa.array([None] * len(rows) + [segment] * len(extra), pa.int32()), pa.array([None] * len(rows) + [bitmap] * len(extra), pa.binary())], names=["doc", "mark", "spans", "segment", "bitmap"])


_SPANS = "doc long, mark long, spans binary, segment int, bitmap binary"


class _Held:
    """Candidate runs of some batches: doc, mark, place in the held bytes, key, start in the document, strings, content, check."""

    def __init__(self):
        self.rows, self.data, self.size, self.n = [], [], 0, 0

    def add(self, b: Batch, got: tuple[np.ndarray, ...], bytes_too: bool) -> None:
        of, key, start, n, content, check = got
        if len(of):
            self.rows.append((b.doc[of], b.mark[of], start + self.size, key, start - b.begin[of], n, content, check))
            self.n += len(of)
            if bytes_too:
                self.data.append(b.data)
                self.size += len(b.data)

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.rows, strict=True)]


def _by_content(doc: np.ndarray, content: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one run of each content; of all runs of the least document with their content (it may hold several); and of the
    others, whose content a smaller document has too. Contents are equal if both hashes are."""
    order = np.lexsort((doc, content))
    same = content[order][1:] == content[order][:-1]
    if (same & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((doc, check, content))
    c, v = content[order], check[order]
    head = np.append(True, (c[1:] != c[:-1]) | (v[1:] != v[:-1]))[: len(order)]
    starts = np.flatnonzero(head)
    least = np.repeat(doc[order][starts], np.diff(np.append(starts, len(order))))
    later = doc[order] > least
    return order[starts], order[~later], order[later]


def equal_runs(docs: DataFrame, known, segments: int) -> DataFrame:
    """Spans of runs that a smaller document has whole, and a bitmap for each segment of the runs that are left to compare.

    Runs are compared by two hashes of all their bytes, first within a task, then, the least document's alone, by segment.
    Left are, of keys that more than one content has, each content's runs in its least document, one document for a
    content; where all of a key's runs are equal nothing is. Of hot keys all contents are left."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def flush() -> pa.RecordBatch:
            local, parts, wide = [], [], False
            if held.rows:
                doc, mark, _, key, start, n, content, check = held.columns()
                _, first, gone = _by_content(doc, content, check)
                local = _span_rows(doc[gone], mark[gone], start[gone], start[gone] + n[gone] + SPAN - 1)
                order, cut = _by_segment(key[first], segments)
                first = first[order]
                wide = bool(start.max() >= 2**32)
                for k, a, b in cut:
                    c = first[a:b]
                    parts.append((k, _pack(key[c], content[c], check[c], doc[c], mark[c], *(x[c].astype(np.int64 if wide else np.uint32) for x in (start, n)))))
            rows = [(k, wide, p, None) for k, p in parts] + [(i % segments, wide, None, r) for i, r in enumerate(local)]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())]
            cols += [pa.array([r[3] and r[3][j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, ["segment", "wide", "runs", "doc", "mark", "spans"])

        for b in batched(batches):
            held.add(b, _candidates(b, known.value), bytes_too=False)
            if held.n > 1_500_000:
                yield flush()
                held = _Held()
        yield flush()

    def match(key, part):
        passed = [r for r in zip(*(part.column(c).to_pylist() for c in ("doc", "mark", "spans")), strict=True) if r[2] is not None]
        got = [_unpack(r, np.uint64, np.uint64, np.uint64, np.int64, np.int64, *[np.int64 if w else np.uint32] * 2) for r, w in zip(part.column("runs").to_pylist(), part.column("wide").to_pylist(), strict=True) if r is not None]
        if not got:
            return _spans_table(passed)
        keys, content, check, doc, mark, start, n = (np.concatenate(x) for x in zip(*got, strict=True))
        start, n = start.astype(np.int64), n.astype(np.int64)
        one, _, gone = _by_content(doc, content, check)
        rows = _span_rows(doc[gone], mark[gone], start[gone], start[gone] + n[gone] + SPAN - 1)
        _, of, times = np.unique(keys[one], return_inverse=True, return_counts=True)
        left = one[(times[of] > 1) | (keys[one] >= _HOT)]
        return _spans_table(passed + rows, key[0].as_py(), Filter.build(_entry(content[left], check[left], doc[left]), segments, FILTER_BYTES))

    sent = docs.mapInArrow(send, "segment int, wide boolean, runs binary, doc long, mark long, spans binary")
    return sent.groupBy("segment").applyInArrow(match, _SPANS)


def unequal_runs(docs: DataFrame, known, left, shards: int) -> DataFrame:
    """Spans of strings that lie in unequal runs of one key: their bytes go to the key's shard, which sorts them.

    Strings of hot keys go one by one, each to the shard of its own hash."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def flush() -> pa.RecordBatch:
            out = []
            if held.rows:
                doc, mark, base, key, start, n, _, _ = held.columns()
                order, cut = _by_segment(mix64(key), shards)
                data = np.concatenate(held.data)
                for k, a, b in cut:
                    c = order[a:b]
                    size = n[c] + SPAN - 1
                    index = np.repeat(base[c] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    out.append((k, _pack(doc[c], mark[c], start[c], n[c], data[index])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["shard", "chunks"])

        for b in batched(batches):
            of, key, start, n, content, check = _candidates(b, known.value)
            some = left.value.has(_entry(content, check, b.doc[of]), key)
            of, key, start, n = of[some], key[some], start[some], n[some]
            one = key >= _HOT
            if one.any():
                place = np.repeat((start - np.cumsum(n * one) + n * one)[one], n[one]) + np.arange(n[one].sum())
                of, key = np.append(of[~one], np.repeat(of[one], n[one])), np.append(key[~one], b.hash(place, place + SPAN))
                start, n = np.append(start[~one], place), np.append(n[~one], np.ones(len(place), np.int64))
            held.add(b, (of, key, start, n, key, key), bytes_too=True)
            if held.size > HELD_BYTES:
                yield flush()
                held = _Held()
        yield flush()

    # As many partitions as shards: small compressed chunks make long sorts, so they are not to be put together by size.
    return docs.mapInArrow(send, "shard int, chunks binary").repartition(shards, "shard").groupBy("shard").applyInArrow(_shard_spans, "doc long, mark long, spans binary")


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for each row of documents (doc_id, text).

    A byte goes if some string of SPAN bytes that covers it also starts in a document with a smaller id; matches never cross
documents and are judged on the whole input. 1. Each string has a key, the least hash of its grams; keys that several
    rows hold are found by counting and put in a filter of bounded size: strings of other keys occur once. 2. Runs of strings under
    one key are compared by 128 bits of hashes of their bytes; those that a smaller document has whole are settled. 3. Where a key's
    runs are unequal (matches begin and end there) one document's runs of each content go, as bytes, to the key's shard. A shard sorts them
    in suffix arrays of BLOCK_BYTES, finds equal strings by common prefixes, and merges its blocks' sorted strings by binary search.
    Equal strings always share a shard, so shards need no merging among themselves. 4. Spans are joined to their texts and cut.
    Null texts are empty; texts under SPAN bytes lose nothing; rows of one id never remove from each other; rows without an id
    come after all others and never remove from each other; an empty table gives no rows; extra columns are ignored."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    segments, shards = _dealt(docs)
    known = spark.sparkContext.broadcast(repeated_keys(docs, segments))
    equal = durable(equal_runs(docs, known, segments))
    bitmaps = equal.where("segment IS NOT NULL").select("segment", "bitmap").collect()
    left = spark.sparkContext.broadcast(Filter({r["segment"]: bytes(r["bitmap"]) for r in bitmaps}, segments))
    rest = unequal_runs(docs, known, left, shards)
    spans = equal.where("segment IS NULL").select("doc", "mark", "spans").union(rest).groupBy("doc", "mark").agg(F.collect_list("spans").alias("spans"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(2)], pa.binary())], ["doc", "mark", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(body)
                s, e = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in spans or []] + [np.empty((2, 0), np.int64)], axis=1)
                s, e = _merged(s, e)
                kept, at = [], 0
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    bodies = docs.mapInArrow(squeeze, "doc long, mark long, body binary")
    out = bodies.join(spans, ["doc", "mark"], "left").select("doc", "body", "spans").mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif("doc", F.lit(_LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
