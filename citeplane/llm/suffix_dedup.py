"""Exact substring dedup: bytes covered by a SIZE-byte string that also starts earlier, by hash-compared suffix sorting.

Two equal windows of SIZE bytes hold the same GRAM-byte substring of smallest hash at the same offset: their anchor. So
a text is its runs of windows with one anchor, each with the region of bytes that they cover; windows need comparing
only where their anchors are equal. Regions that are equal as a whole form a class, whose earliest member stands for
it; all others are removed. Anchors meet by polynomial hashes, which structured bytes can make collide, so whether regions
are equal is verified by a BLAKE2b digest of their bytes, among the regions of one anchor. This is done first within a
slice of documents, so that copies leave one row for each slice, and then over all rows of an anchor. What remains are the
earliest members of anchors with several classes.

Their regions are cut from the texts and sorted as suffixes, one for each window: prefix polynomial hashes give the hash
of any substring, binary search finds the common extension of two suffixes in a logarithmic number of comparisons, and a
merge sort uses it as its order, ties by (doc_id, text, start). Neighbours that agree in SIZE bytes by hash are verified byte
by byte; where that fails, the block is sorted by its bytes. Of equal windows all but the first are removed. An anchor
with more than GROUP classes is not gathered in one task: its windows are dealt out by their own hash instead, after the
same reduction within slices.

Defined cases: null text is empty; texts of fewer than SIZE bytes lose nothing; rows of equal doc_id and text are taken
to be one document (a window is never earlier than itself), rows of equal or null doc_id with different texts are
documents in the order of their texts (ver); null doc_id comes before all others; other columns are ignored; an empty
table gives no rows. Texts longer than PIECE bytes are cut into overlapping pieces of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Polynomial, Scratch, mix64, shuffle_partitions, slices

SIZE, GRAM, PIECE, GROUP = 100, 32, 1 << 20, 4096
_SPAN = SIZE - GRAM + 1
_FIRST = -(1 << 63)


powers, prefix_hashes = Polynomial.powers, Polynomial.prefixes


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: its hash, the digest of their region, their first and last start, its place."""
    _, down = powers(len(data) + 1)
    s = prefix_hashes(data)
    n = len(data) - GRAM + 1
    gram = mix64((s[GRAM:] - s[:-GRAM]) * down[:n])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = _SPAN - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut - 1, len(place) - 1)
    at = place[first]
    raw = memoryview(np.ascontiguousarray(data))
    region = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + SIZE).tolist())]), np.uint64)
    region = mix64(region + (at - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + (last - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return gram[at], region, first, last, at


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Offset and bytes of overlapping pieces that hold each window once."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(data) - SIZE + 1), PIECE):
        yield start, data[start : start + PIECE + SIZE - 1]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(new[1:], True)]


_ROWS = "key long, kind byte, r long, doc long, ver long, at long"
_NAMES = ["key", "kind", "r", "doc", "ver", "at"]


def _batch(key, kind, r, doc, ver, at) -> pa.RecordBatch:
    arrays = [np.asarray(key).astype(np.uint64).view(np.int64), np.asarray(kind).astype(np.int8), np.asarray(r).astype(np.uint64).view(np.int64) if np.asarray(r).dtype == np.uint64 else np.asarray(r).astype(np.int64), np.asarray(doc).astype(np.int64), np.asarray(ver).astype(np.int64), np.asarray(at).astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=_NAMES)


def _doc_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document as maximal runs."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * np.int64(1 << 40)
    s, e = merged(start + shift, end + shift)
    at = np.searchsorted(start + shift, s)
    return doc[at], s - shift[at], e - shift[at]


def _repeats(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have an earlier one (doc, start) with equal keys."""
    order = np.lexsort((start, doc, *keys))
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.zeros(len(doc), bool)
    out[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    return out


def _ranked(doc: np.ndarray, ver: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each (doc, ver), and doc and ver by rank."""
    order = np.lexsort((ver, doc))
    new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (ver[order][1:] != ver[order][:-1]))[: len(order)]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, doc[order][new], ver[order][new]


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), _FIRST), dtype=np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: an anchor's run of windows, the earliest with its region in the slice. Kind 1: a removed span (at, r)."""
    for batch in slices(batches):
        found, docs = [], []
        rank, own, vers = _ranked(_ids(batch.column("doc_id")), batch.column("ver").to_numpy())
        for doc, text in zip(rank.tolist(), batch.column("text").cast(pa.binary()).to_pylist()):
            for offset, data in pieces(text or b""):
                gram, region, first, last, at = anchors(data)
                found.append((gram, region, first + offset, last - first, at - first))
                docs.append(np.full(len(gram), doc, np.int64))
        if not found:
            continue
        gram, region, first, more, place = (np.concatenate(x) for x in zip(*found))
        doc = np.concatenate(docs)
        again = _repeats([gram, region], doc, first)
        d, s, e = _doc_spans(doc[again], first[again], first[again] + more[again] + SIZE)
        yield _batch(mix64(own[d].astype(np.uint64) * np.uint64(Polynomial.base) + s.astype(np.uint64)), np.ones(len(d)), e, own[d], vers[d], s)
        on = ~again
        yield _batch(gram[on], np.zeros(on.sum()), region[on], own[doc[on]], vers[doc[on]], first[on] << 14 | more[on] << 7 | place[on])


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key, r, doc, ver, at): members after the earliest of a class become spans; the earliest ones of an
    anchor with more than one class go on. Only the last row and the earliest one of its class wait for the next batch."""
    held = None  # key, r, doc, ver, at of the earliest member of the open class; whether its anchor has an earlier class
    for batch in batches:
        if not batch.num_rows:
            continue
        key, kind, r, doc, ver, at = (batch.column(c).to_numpy() for c in _NAMES)
        spans = kind == 1
        if spans.any():
            yield _batch(key[spans], np.ones(spans.sum()), r[spans], doc[spans], ver[spans], at[spans])
        key, r, doc, ver, at = (x[~spans] for x in (key, r, doc, ver, at))
        if not len(key):
            continue
        before = False
        if held:
            key, r, doc, ver, at = (np.append(h, x) for h, x in zip(held, (key, r, doc, ver, at)))
            before = held[5]
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, r[1:] != r[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        again = (doc != doc[head]) | (ver != ver[head]) | (at >> 14 != at[head] >> 14)
        yield _batch(key[again], np.ones(again.sum()), (at[again] >> 14) + (at[again] >> 7 & 127) + SIZE, doc[again], ver[again], at[again] >> 14)
        heads = np.flatnonzero(new)
        earlier = ~new_key[heads]
        earlier[0] |= before
        follows = np.append(~new_key[heads[1:]], False)
        last = heads[-1]
        held = key[last], r[last], doc[last], ver[last], at[last], bool(earlier[-1])
        go = heads[:-1][(earlier | follows)[:-1]]
        yield _batch(key[go], np.zeros(len(go)), np.zeros(len(go)), doc[go], ver[go], at[go])
    if held and held[5]:
        yield _batch(*([x] for x in (held[0], 0, 0, held[2], held[3], held[4])))


_REGIONS = "key long, doc long, ver long, start long, place int, region binary"


def _spans_batch(own: np.ndarray, vers: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans of documents by rank, with the ids and versions of the ranks."""
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (own[doc], vers[doc], start, end)], names=["doc", "ver", "start", "end"])


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each waiting run of windows; of a crowded anchor's runs, of each window, the earliest ones of the slice.
    A negative place marks the windows that are earlier ones' copies: they are spans already."""
    for batch in slices(batches):
        key, doc, start, place, region = [], [], [], [], []
        crowd: list[tuple[int, int, bytes]] = []
        rank, own, vers = _ranked(_ids(batch.column("doc_id")), batch.column("ver").to_numpy())
        for d, text, found in zip(rank.tolist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
            for run in found:
                first, more = run["at"] >> 14, run["at"] >> 7 & 127
                if run["crowded"]:
                    crowd += [(d, s, text[s : s + SIZE]) for s in range(first, first + more + 1)]
                else:
                    key.append(run["key"])
                    doc.append(d)
                    start.append(first)
                    place.append(run["at"] & 127)
                    region.append(text[first : first + more + SIZE])
        seen: set[bytes] = set()
        for d, s, window in sorted(crowd):
            data = np.frombuffer(window, np.uint8)
            key.append(int(mix64(prefix_hashes(data)[-1:]).view(np.int64)[0]))
            doc.append(d)
            start.append(s)
            place.append(-1 if window in seen else 0)
            region.append(b"" if window in seen else window)
            seen.add(window)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own[np.array(doc, np.int64)]), pa.array(vers[np.array(doc, np.int64)]), pa.array(start, pa.int64()), pa.array(place, pa.int32()), pa.array(region, pa.binary())], names=["key", "doc", "ver", "start", "place", "region"])


class Suffixes:
    """Suffixes of one buffer, each read for SIZE bytes, compared by prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.s = data, prefix_hashes(data)
        self.up = powers(len(data) + 1)[0]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most SIZE, by binary search on substring hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), SIZE, np.int64)
        left, right = np.minimum(a, b), np.maximum(a, b)
        lift, s = self.up[right - left], self.s
        one, two = s[left], s[right]
        for _ in range(SIZE.bit_length()):
            middle = (low + high + 1) >> 1
            same = (s[left + middle] - one) * lift == s[right + middle] - two
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray, tie_a: np.ndarray, tie_b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts after b; equal ones by their ties."""
        n = self.common(a, b)
        end = n == SIZE
        n = np.where(end, 0, n)
        return np.where(end, tie_a > tie_b, self.data[a + n] > self.data[b + n])

    def sort(self, at: np.ndarray, block: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Merge sort within blocks, which are contiguous: order of at by (block, suffix, tie).

        In each round every run is merged with its neighbour of the block: an element's place is its own rank plus its
        rank in the other run, found by binary search, for all elements at once.
        """
        n = len(at)
        order = np.arange(n)
        begin = np.maximum.accumulate(np.where(np.append(True, block[1:] != block[:-1]), np.arange(n), 0))
        size = np.bincount(np.cumsum(np.append(0, block[1:] != block[:-1])))
        stop = begin + size[np.cumsum(np.append(0, block[1:] != block[:-1]))]
        width = 1
        while width < (size.max() if n else 0):
            live = np.flatnonzero(stop - begin > width)
            inside = live - begin[live]
            run = inside // width
            own = begin[live] + run * width
            other = np.where(run % 2 == 0, own + width, own - width)
            low = np.minimum(other, stop[live])
            high = np.minimum(other + width, stop[live])
            base = low.copy()
            me = order[live]
            while True:
                go = np.flatnonzero(low < high)
                if not len(go):
                    break
                middle = (low[go] + high[go]) >> 1
                it = order[middle]
                after = self.after(at[me[go]], at[it], tie[me[go]], tie[it])
                low[go] = np.where(after, middle + 1, low[go])
                high[go] = np.where(after, high[go], middle)
            to = np.minimum(own, np.where(run % 2 == 0, own, other)) + (live - own) + (low - base)
            nxt = order.copy()
            nxt[to] = me
            order = nxt
            width *= 2
        return order

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows agree byte by byte."""
        reach = np.arange(SIZE)
        out = np.empty(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            out[i : i + (1 << 16)] = (self.data[a[i : i + (1 << 16), None] + reach] == self.data[b[i : i + (1 << 16), None] + reach]).all(axis=1)
        return out


def repeated_windows(key: np.ndarray, doc: np.ndarray, start: np.ndarray, place: np.ndarray, regions: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the windows of these regions that an earlier region of the same key has too, at the same offset."""
    size = np.array([len(x) for x in regions])
    data = np.frombuffer(b"".join(regions), np.uint8)
    base = np.cumsum(size) - size
    count = size - SIZE + 1
    row = np.repeat(np.arange(len(regions)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at, group, offset = base[row] + step, np.cumsum(np.append(0, key[1:] != key[:-1]))[row], place[row] - step
    tie = np.empty(len(regions), np.int64)
    tie[np.lexsort((start, doc))] = np.arange(len(regions))
    order = np.lexsort((offset, group))
    at, row, step = at[order], row[order], step[order]
    block = np.cumsum(np.append(0, (group[order][1:] != group[order][:-1]) | (offset[order][1:] != offset[order][:-1])))
    text = Suffixes(data)
    sorted_ = text.sort(at, block, tie[row])
    at, row, step, block = at[sorted_], row[sorted_], step[sorted_], block[sorted_]
    agree = np.append(False, (block[1:] == block[:-1]))
    near = np.flatnonzero(agree)
    equal = text.common(at[near - 1], at[near]) == SIZE
    true = equal.copy()
    true[equal] = text.same(at[near[equal] - 1], at[near[equal]])
    agree[near] = true
    if (true != equal).any():
        for b in np.unique(block[near[true != equal]]):
            own = np.flatnonzero(block == b)
            by_bytes = sorted(own.tolist(), key=lambda i: (bytes(data[at[i] : at[i] + SIZE]), tie[row[i]]))
            at[own], row[own], step[own] = at[by_bytes], row[by_bytes], step[by_bytes]
            agree[own] = [k > 0 and bytes(data[at[i] : at[i] + SIZE]) == bytes(data[at[i - 1] : at[i - 1] + SIZE]) for k, i in enumerate(own)]
    head = np.maximum.accumulate(np.where(agree, 0, np.arange(len(at))))
    begin = start[row] + step
    again = agree & ((doc[row] != doc[row[head]]) | (begin != begin[head]))
    return _doc_spans(doc[row][again], begin[again], begin[again] + SIZE)


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: spans of repeated windows, for whole keys at a time."""
    names = ["key", "doc", "ver", "start", "place", "region"]
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy() for c in names[:5]] + [np.array(batch.column("region").to_pylist(), object)]
        copies = now[4] < 0
        if copies.any():
            rank, own, vers = _ranked(now[1][copies], now[2][copies])
            yield _spans_batch(own, vers, *_doc_spans(rank, now[3][copies], now[3][copies] + SIZE))
            now = [x[~copies] for x in now]
        if held is not None:
            now = [np.concatenate([h, x]) for h, x in zip(held, now)]
        key = now[0]
        if not len(key):
            continue
        cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
        held = [x[cut:] for x in now]
        yield from _compared([x[:cut] for x in now])
    if held is not None:
        yield from _compared(held)


def _compared(rows: list[np.ndarray], most: int = PIECE // 200) -> Iterator[pa.RecordBatch]:
    """Whole keys, several at a time. GROUP bounds the rows of an anchor; a window of a crowded one has at most a row for
    each slice of documents."""
    key = rows[0]
    a = 0
    while a < len(key):
        b = min(len(key), a + most)
        if b < len(key):
            first = int(np.searchsorted(np.cumsum(np.append(0, key[1:] != key[:-1])), np.cumsum(np.append(0, key[1:] != key[:-1]))[b]))
            b = first if first > a else int(a + np.argmax(np.append(key[a:] != key[a], True)))
        part = [x[a:b] for x in rows]
        if len(part[0]) > 1:
            rank, own, vers = _ranked(part[1], part[2])
            yield _spans_batch(own, vers, *repeated_windows(part[0], rank, *part[3:5], list(part[5])))
        a = b


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        size, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            text = text or b""
            if spans:
                s, e = merged(np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans]))
                gaps = zip(np.append(0, e).tolist(), np.append(s, len(text)).tolist())
                out = b"".join(text[a:b] for a, b in gaps)
            else:
                s, out = (), text
            size.append(len(text))
            removed.append(len(text) - len(out))
            runs.append(len(s))
            kept.append(out)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _versions(docs: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """doc_id, text and own (the id, or what stands for none), with ver: the place of the text where texts of one own
    differ, else 0. Only ids and digests of texts are gathered for it, and the texts of such ids."""
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("own"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    several = docs.groupBy("own").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most").select("own")
    several = scratch.keep(several, "several")
    if several.isEmpty():
        return docs.withColumn("ver", F.lit(0).cast("long"))
    texts = docs.join(several, "own", "left_semi").select("own", F.coalesce("text", F.lit("")).alias("text")).distinct()
    texts = texts.repartitionByRange(n, "own", "text").sortWithinPartitions("own", "text")
    texts = scratch.keep(texts.select("own", digest.alias("digest"), F.monotonically_increasing_id().alias("ver")), "texts")
    return docs.withColumn("digest", digest).join(texts, ["own", "digest"], "left").select("doc_id", "text", "own", F.coalesce("ver", F.lit(0).cast("long")).alias("ver"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each document."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "suffixes"), shuffle_partitions(spark)
    docs = _versions(docs, scratch, n)
    rows = docs.select("doc_id", "ver", "text").mapInArrow(_anchor_rows, _ROWS).repartition(n, "key").sortWithinPartitions("kind", "key", "r", "doc", "ver", "at")
    classes = scratch.keep(rows.mapInArrow(_class_rows, _ROWS), "classes")
    waiting = classes.where("kind = 0").select("key", "doc", "ver", "at")
    crowded = waiting.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP).select("key", F.lit(True).alias("crowded"))
    runs = waiting.join(crowded, "key", "left").select("doc", "ver", F.struct("at", "key", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("run")).groupBy(F.col("doc").alias("own"), "ver").agg(F.collect_list("run").alias("runs"))
    regions = docs.join(runs, ["own", "ver"]).select("doc_id", "ver", "text", "runs").mapInArrow(_region_rows, _REGIONS)
    regions = scratch.keep(regions, "regions")
    late = regions.repartition(n, "key").sortWithinPartitions("key", "doc", "ver", "start").mapInArrow(_sorted_rows, "doc long, ver long, start long, end long")
    late = scratch.keep(late, "late")
    early = classes.where("kind = 1").select("doc", "ver", F.col("at").alias("start"), F.col("r").alias("end"))
    spans = early.unionByName(late).groupBy(F.col("doc").alias("own"), "ver").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(spans, ["own", "ver"], "left").select("doc_id", "text", "spans").mapInArrow(_kept_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
