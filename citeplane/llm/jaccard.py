"""N-gram Jaccard join: documents whose sets of word shingles are alike enough, and what links of such pairs connect.

Two sets link when 100 * |intersection| >= percent * |union|. Only sets of similar size can link, so sizes are cut into
bands, each twice as wide as it starts, and a band's tile holds its sets and those that its largest sets can link to. In
a tile the hash space is cut into buckets, a quarter more than the shingles in which two linked sets of the tile can
differ. A difference spoils one bucket, so linked sets share the others whole; a bucket's content is a key. With the keys
that no other set has first, then by key, linked sets of at most d differences meet within their first d + 1 keys; a set
takes part with these only, and one whose first keys are all its own is done.

Keys travel packed, by cell of the key space, and a key that several sets of one slice of documents have is sent once
for the slice, so a key that a third of all sets share is met once a slice. Identical sets form classes before that, and
one document of each class has keys.

The sets that meet are compared with the smallest of their key, and the links' components found; then, round after
round, one set of each component of a key with one of the smallest component, until a round finds no link. What keys
still hold several components is compared in tiles of at most two blocks of BLOCK sets, only sets of different
components. So no pair inside a component is made that the components do not need, and no link between components is
lost. Before any exact comparison the signatures (hashed bits of each set, four to eight a shingle) bound the overlap
from above by bit counts; what remains is decided by the intersection of the sorted arrays of shingle hashes, and what
these accept by the shingles' own words.

Words are hashed by BLAKE2b. Two hash accidents could matter: one inside a pair that links is refuted by the words; sets
are identical by 128 bits over all their shingle hashes, sets of one shingle by 128 bits of its words.

Defined cases: null text is empty; a text without words has the empty set, and links with nothing, not even its like; a
text of fewer words than a shingle has one shingle of all of them; rows of equal doc_id and text are one document, rows of
equal or null doc_id with different texts are documents of their own, numbered above all ids in the order of their texts;
a component's name is its smallest doc_id, null if none of it has one; ties cannot occur; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, mix64, narrow, shuffle_partitions, slices
from .graph_components import components

WORDS, PERCENT = 5, 80
#: Most sets on each side of a tile of the last comparison; keys that a slice of documents gathers before it sends them.
BLOCK, PACK = 1024, 1 << 19
#: Most rounds in which one set of each component stands for it. The last comparison takes what is left, however much.
ROUNDS = 8
#: Bytes of text that are cut into words at once.
SLICE = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Number of each word seen; the hashes stand in a table by that number."""

    most, long = 1 << 17, 64

    def __init__(self) -> None:
        super().__init__()
        self.raw = bytearray()

    def __missing__(self, word: bytes) -> int:
        found = len(self.raw) >> 3
        self.raw += blake2b(word, digest_size=8).digest()
        if len(word) <= self.long:
            self[word] = found
        return found

    def hashes(self, words: list[list[bytes]], n: int) -> np.ndarray:
        """Hashes of the words of several texts, n in all."""
        if len(self.raw) > 8 * self.most:
            self.clear()
            self.raw = bytearray()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, n)
        return np.frombuffer(bytes(self.raw), np.uint64)[at]


_WORDS = Words()


def words_of(text: bytes | None) -> list[bytes]:
    """The words between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def shingle_rows(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, one text after the other, and where each text's end."""
    split = [words_of(t) for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(count)
    each = _WORDS.hashes(split, int(ends[-1]) if len(ends) else 0)
    size = np.minimum(count, words)
    n = np.where(count > 0, count - size + 1, 0)
    stop = np.cumsum(n)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    for k in range(1, words + 1):
        own = np.flatnonzero(size == k)
        to = np.repeat(stop[own] - n[own], n[own])
        step = np.arange(len(to)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        at = np.repeat(ends[own] - count[own], n[own]) + step
        acc = np.full(len(at), k, np.uint64)
        for i in range(k):
            acc = mix64(acc * _B + each[at + i])
        out[to + step] = acc
    for a, b in zip((stop - n)[n > 1].tolist(), stop[n > 1].tolist()):
        out[a:b].sort()
    new = np.append(True, out[1:] != out[:-1])[: len(out)]
    new[(stop - n)[n > 0]] = True
    return out[new], np.append(0, np.cumsum(new))[stop]


def shingles(text: bytes | None, words: int) -> np.ndarray:
    return shingle_rows([text], words)[0]


def shingle_words(text: bytes | None, words: int) -> set[bytes]:
    """The shingles themselves: no word holds a space."""
    each = words_of(text)
    size = min(words, len(each))
    return {b" ".join(each[i : i + size]) for i in range(len(each) - size + 1)} if each else set()


def enough(both: int, a: int, b: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (a + b - both)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)


def differences(n: int, percent: int) -> int:
    """Most shingles in which a set of n can differ from one that it links with."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def band(n: int) -> int:
    return n.bit_length() - 1


def buckets(b: int, percent: int) -> int:
    """Buckets of a band's tile."""
    return differences((2 << b) - 1, percent) * 5 // 4 + 2


def tiles(n: int, percent: int) -> list[int]:
    """Bands of the tiles that a set of n is in: its own, and the one below if it can link into it."""
    if not n or not differences(n, percent):
        return []  # it links with equal sets only
    b = band(n)
    return [b] + [b - 1] * (b > 0 and (n * percent + 99) // 100 < 1 << b)


def tile_keys(set_: np.ndarray, sums: np.ndarray, b: int, percent: int) -> tuple[int, np.ndarray]:
    """Keys of a set in a band's tile, with how many of its shared keys it must keep beyond their own number (mostly
    negative): the set has a prefix of d + 1 keys, first those that no other set has, empty buckets last. A set that lacks
    d + 1 proper keys keeps all, the empty ones too."""
    m = buckets(b, percent)
    edges = np.searchsorted(set_ >> np.uint64(32), (np.arange(m, dtype=np.uint64) << np.uint64(32)) // np.uint64(m))
    at = sums[edges]
    content = np.append(at[1:], sums[-1]) - at
    full = np.append(edges[1:], len(set_)) > edges
    keys = mix64(content * _B + (np.arange(m, dtype=np.uint64) << np.uint64(8)) + np.uint64(b))
    need, proper = min(differences(len(set_), percent), differences((2 << b) - 1, percent)) + 1, int(full.sum())
    if need > proper:
        return 1 << 30, keys
    return need - proper, keys[full]


def signature(set_: np.ndarray) -> np.ndarray:
    """Hashed bits of a set, at least four a shingle, in a number of 64-bit words that is a power of two."""
    width = 1 << min(20, max(8, (4 * len(set_) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(set_ & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The signature that the set would have in fewer words."""
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def may_link(n: np.ndarray, m: np.ndarray, only_n: np.ndarray, only_m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bit counts allow a link: a bit that only one set has stands for a shingle that only it has."""
    top = np.minimum(n - only_n, m - only_m)
    return (top > 0) & (top * 100 >= (n + m - top) * percent)


_IDENTITY = "key long, n long, identity binary"


def _identities(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            flat, ends = shingle_rows(texts, words)
            n = np.diff(ends, prepend=0)
            names = []
            for text, a, b in zip(texts, (ends - n).tolist(), ends.tolist()):
                # many texts may have one shingle each, so these are told apart by more than its 64 bits
                content = b" ".join(words_of(text)[:words]) if b - a == 1 else flat[a:b].tobytes()
                names.append(blake2b(content, digest_size=16, person=b"one" if b - a == 1 else b"").digest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(names, pa.binary())], names=["key", "n", "identity"])

    return rows


_PACK = "cell int, kind byte, keys binary, docs binary, parts binary"
_SHARED = "doc_id long, part byte, key long, slack int"


def _cells(words: int, percent: int, cells: int):
    """Packed keys. Kind 0: keys of a cell, each once a slice, with the document of one of its sets and the tile's part, plus
    2 where other sets of the slice have the key too. Kind 1: keys and documents of these others. Kind 2: in place of keys
    the slack of each document and part."""

    def packed(cell: int, kind: int, keys: np.ndarray, docs: np.ndarray, parts: np.ndarray) -> tuple:
        return cell % cells, kind, keys.tobytes(), docs.tobytes(), parts.tobytes()

    def sent(held: list[tuple], slack: list[tuple]) -> pa.RecordBatch:
        key = np.concatenate([k for k, _, _ in held])
        size = np.array([len(k) for k, _, _ in held])
        doc, part = (np.repeat(np.array([h[i] for h in held], t), size) for i, t in ((1, np.int64), (2, np.uint8)))
        order = np.argsort(key, kind="stable")
        key, doc, part = key[order], doc[order], part[order]
        first = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(first)
        several = np.diff(np.append(at, len(key))) > 1
        rest = ~first
        out = []
        one, docs, parts = key[at], doc[at], part[at] + 2 * several.astype(np.uint8)
        cell = (one >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)
        cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            out.append(packed(int(cell[a]), 0, one[a:b], docs[a:b], parts[a:b]))
        for kind, (k, d, p) in ((1, (key[rest], doc[rest], part[rest])), (2, tuple(np.array(x, t) for x, t in zip(zip(*slack), (np.int64, np.int64, np.uint8))))):
            for a in range(0, len(k), 1 << 15):
                b = a + (1 << 15)
                out.append(packed(int(d[a]) + a, kind, k[a:b], d[a:b], p[a:b]))
        types = (pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["cell", "kind", "keys", "docs", "parts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slack, size = [], [], 0
        for batch in slices(batches, most=SLICE):
            flat, ends = shingle_rows(batch.column("text").cast(pa.binary()).to_pylist(), words)
            sums = np.append(np.uint64(0), np.cumsum(mix64(flat)))
            for doc, a, b in zip(batch.column("key").to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist()):
                for part, tile in enumerate(tiles(b - a, percent)):
                    more, keys = tile_keys(flat[a:b], sums[a : b + 1], tile, percent)
                    held.append((keys, doc, part))
                    slack.append((more, doc, part))
                    size += len(keys)
            if size > PACK:
                yield sent(held, slack)
                held, slack, size = [], [], 0
        if held:
            yield sent(held, slack)

    return rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: the documents of each key that several sets have, and the slack of each document and part."""

    def given(doc: np.ndarray, part: np.ndarray, key: np.ndarray | None, slack: np.ndarray | None) -> pa.RecordBatch:
        none = lambda t: pa.nulls(len(doc), t)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array((part & 1).astype(np.int8)), none(pa.int64()) if key is None else pa.array(key.view(np.int64)), none(pa.int32()) if slack is None else pa.array(slack.astype(np.int32))], names=["doc_id", "part", "key", "slack"])

    def met(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        key, doc, part = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held), (np.uint64, np.int64, np.uint8)))
        order = np.argsort(key, kind="stable")
        key, doc, part = key[order], doc[order], part[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(key)))
        on = np.repeat((size > 1) | (np.bitwise_or.reduceat(part, at) > 1), size)
        return given(doc[on], part[on], key[on], None)

    cell, held = None, []
    for batch in batches:
        for where, kind, keys, docs, parts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if kind:
                numbers = np.frombuffer(keys, np.int64)
                yield given(np.frombuffer(docs, np.int64), np.frombuffer(parts, np.uint8), *((numbers, None) if kind == 1 else (None, numbers)))
                continue
            if where != cell and held:
                yield met(held)
                held = []
            cell = where
            held.append((keys, docs, parts))
    if held:
        yield met(held)


def _signatures(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            flat, ends = shingle_rows(batch.column("text").cast(pa.binary()).to_pylist(), words)
            begin = np.append(0, ends[:-1])
            bits = [signature(flat[a:b]).tobytes() for a, b in zip(begin.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ends - begin, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n", "bits"])

    return rows


def _bounded(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bit counts let link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, one, m, two in zip(*(batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b"))):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                width = min(len(x), len(y))
                x, y = folded(x, width), folded(y, width)
                keep.append(bool(may_link(n, m, np.bitwise_count(x & ~y).sum(dtype=np.int64), np.bitwise_count(y & ~x).sum(dtype=np.int64), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], names=["a", "b"])

    x, y = (signed.select(F.col("doc_id").alias(i), F.col("n").alias(f"n_{i}"), F.col("bits").alias(f"bits_{i}")) for i in "ab")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(x, "a").join(y, "b").where(sizes).select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(rows, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: by exact intersection of the hashes, then, where these say so, of the words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b", SLICE):
            one, two = (batch.column(f"text_{x}").cast(pa.binary()).to_pylist() for x in "ab")
            (x, x_ends), (y, y_ends) = shingle_rows(list(dict.fromkeys(one)), words), shingle_rows(two, words)
            place = {t: i for i, t in enumerate(dict.fromkeys(one))}
            keep = []
            for i, (s, t) in enumerate(zip(one, two)):
                k = place[s]
                yes = linked(x[x_ends[k - 1] if k else 0 : x_ends[k]], y[y_ends[i - 1] if i else 0 : y_ends[i]], percent)
                if yes:
                    a, b = shingle_words(s, words), shingle_words(t, words)
                    yes = enough(len(a & b), len(a), len(b), percent)
                keep.append(yes)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], names=["a", "b"])

    one, two = (texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(rows, "a long, b long")


def _tile_pairs(open_: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a key and may link. A key's sets are dealt into blocks of about
    BLOCK; each two blocks, and each with itself, are one tile."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "block", "doc_id", "root", "n", "bits")]
            for *name, block, doc, root, n, bits in zip(*columns):
                if name != tile and held:
                    yield from compared(held, tile[1] == tile[2])
                    held = []
                tile = name
                held.append((block, doc, root, n, bits))
        if held:
            yield from compared(held, tile[1] == tile[2])

    def compared(held: list[tuple], same: bool) -> Iterator[pa.RecordBatch]:
        block, doc, root, n = (np.array(x) for x in list(zip(*held))[:4])
        bits = [np.frombuffer(h[4], np.uint64) for h in held]
        width = min(map(len, bits))
        bits = np.array([folded(x, width) for x in bits])
        a, b = [], []
        for i in range(len(held)):
            other = np.flatnonzero((root != root[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent) & ((doc > doc[i]) if same else (block > block[i])))
            for part in range(0, len(other), 4096):
                to = other[part : part + 4096]
                ok = to[may_link(n[i], n[to], np.bitwise_count(bits[i] & ~bits[to]).sum(axis=1, dtype=np.int64), np.bitwise_count(bits[to] & ~bits[i]).sum(axis=1, dtype=np.int64), percent)]
                a.append(np.minimum(doc[i], doc[ok]))
                b.append(np.maximum(doc[i], doc[ok]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    blocks = F.ceil(F.col("c") / BLOCK).cast("long")
    dealt = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "doc_id"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "root").join(signed, "doc_id")
    spread = dealt.repartition(shuffle_partitions(open_.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return spread.mapInArrow(rows, "a long, b long").distinct()


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """docs with key and times, one row for each (doc_id, text) and key; and whether any id is null or shared. The key is
    the id where one row has it, else a number above all ids, by doc_id and text; times is the number of such rows, of
    which the other columns' smallest stand."""
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("shared"))
    shared = scratch.keep(shared, "shared")
    plain = docs.select(F.col("doc_id").cast("long").alias("key"), F.lit(1).cast("long").alias("times"), *docs.columns)
    if shared.isEmpty():
        return plain, False
    same, others = F.col("doc_id").eqNullSafe(F.col("shared")), [c for c in docs.columns if c not in ("doc_id", "text")]
    odd = docs.join(shared, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.lit(0).alias("_"), *others)).alias("rest"))
    odd = odd.select("times", "doc_id", "text", *(F.col("rest")[c].alias(c) for c in others))
    odd = odd.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    odd = scratch.keep(odd.select((F.monotonically_increasing_id() + F.lit(max(top, 0) + 1).cast("long")).alias("key"), "times", *docs.columns), "odd")
    return plain.join(shared, same, "left_anti").unionByName(odd), True


def _members(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """key and class_id of each document whose set others have too. Classes of more than a 256th of all documents, 256 at
    most, go to their members; the rest are met by hash."""
    hot = max(1000, signed.count() // 256)
    classes = scratch.keep(signed.where("n > 0").groupBy("identity").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("c")).where("c > 1"), "classes")
    large, small = F.broadcast(classes.where(F.col("c") > hot)), classes.where(F.col("c") <= hot)
    in_large = signed.join(large, "identity")
    in_small = signed.join(large, "identity", "left_anti").join(small, "identity")
    return scratch.keep(in_large.unionByName(in_small).select("key", "class_id"), "member")


def link_keys(nodes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """key, n (size of the set), class_id (smallest key with the same set) and root (smallest key that links reach) of nodes
    (key, text), whose keys are distinct and not null."""
    n_parts = shuffle_partitions(nodes.sparkSession)
    nodes = nodes.select("key", "text")
    signed = scratch.keep(nodes.mapInArrow(_identities(words), _IDENTITY), "signed")
    member = _members(signed, scratch)
    copies = scratch.keep(member.where("key <> class_id").select("key"), "copies")
    single = narrow(nodes, copies, "left_anti")
    packed = single.mapInArrow(_cells(words, percent, 8 * n_parts), _PACK).repartition(n_parts, "cell").sortWithinPartitions("cell")
    shared = scratch.keep(packed.mapInArrow(_shared, _SHARED), "keys")
    by_doc = shared.groupBy("doc_id", "part").agg(F.max("slack").alias("slack"), F.array_sort(F.collect_list("key")).alias("k"))
    prefix = F.least(F.size("k"), F.col("slack") + F.size("k"))
    kept = scratch.keep(by_doc.where(prefix > 0).select("doc_id", F.explode(F.slice("k", F.lit(1), prefix)).alias("key")), "kept")
    # keys of the same sets are one: which sets, by two hashes of all their ids
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "doc_id")).alias(f"x{i}") for i in range(2)]
    groups = kept.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("lead"), *marks).where("c > 1")
    groups = groups.groupBy("c", "lead", "x0", "x1").agg(F.min("key").alias("key")).select("key", "lead", "c")
    met = scratch.keep(kept.join(groups, "key").select("key", "doc_id", "lead", "c"), "met")
    ids = scratch.keep(met.select(F.col("doc_id").alias("key")).distinct(), "ids")
    texts = scratch.keep(narrow(nodes, ids, "left_semi"), "texts")
    bits = scratch.keep(texts.mapInArrow(_signatures(words), "doc_id long, n long, bits binary"), "bits")
    scratch.drop("keys", "kept")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        near = scratch.keep(_bounded(pairs, bits, percent), f"near-{name}")
        return scratch.keep(_verify(near, texts, words, percent), f"links-{name}")

    pairs = met.where("doc_id <> lead").groupBy("doc_id").agg(F.min("lead").alias("a")).select("a", F.col("doc_id").alias("b"))
    links, turn = links_of(pairs, "0"), 0
    while True:
        turn += 1
        roots = components(links, scratch, f"roots{turn}")
        rooted = met.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "c", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "low")
        open_ = scratch.keep(rooted.join(mixed, "key"), f"open-{turn}")
        if turn > ROUNDS or open_.isEmpty():
            break
        pick = F.min_by if turn % 2 else F.max_by
        best = open_.groupBy("key", "root", "low").agg(pick("doc_id", F.xxhash64(F.lit(turn), "key", "doc_id")).alias("doc_id"))
        first = best.where("root = low").select("key", F.col("doc_id").alias("one"))
        pairs = best.where("root <> low").join(first, "key").select(F.least("one", "doc_id").alias("a"), F.greatest("one", "doc_id").alias("b")).distinct()
        more = links_of(pairs, str(turn))
        if more.isEmpty():
            break
        links = links.unionByName(more)
    if not open_.isEmpty():
        near = scratch.keep(_tile_pairs(open_, bits, percent), "near-last")
        more = scratch.keep(_verify(near, texts, words, percent), "links-last")
        if not more.isEmpty():
            roots = components(links.unionByName(more), scratch, "roots")
    scratch.drop("met", "ids", "texts", "bits", "copies", "classes", *(f"open-{i}" for i in range(1, turn + 1)))
    out = signed.select("key", "n").join(member, "key", "left").withColumn("class_id", F.coalesce("class_id", "key")).join(roots, F.col("class_id") == F.col("node"), "left")
    return out.select("key", "n", "class_id", F.coalesce("root", "class_id").alias("root"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id (smallest doc_id with the same set, and that links reach) of each row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    nodes, odd = numbered(docs.select("doc_id", "text"), scratch)
    found = link_keys(nodes, words, percent, scratch)
    if not odd:
        return found.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", F.col("root").alias("component_id"))
    found = scratch.keep(found.join(nodes.select("key", "doc_id", "times"), "key"), "found")
    for name, of in (("class", "class_id"), ("component", "root")):
        least = found.groupBy(of).agg(F.min("doc_id").alias(f"least_{name}"))
        found = found.join(least, of)
    rows = found.withColumn("_", F.explode(F.expr("sequence(1L, times)")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("least_class").alias("class_id"), F.col("least_component").alias("component_id"))
