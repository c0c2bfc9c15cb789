"""BPE encoding and decoding with word ends: speculate, verify, merge only what fails.

A text is normalised (NFC, lower case by code point), cut into words (contractions, letters, single digits, other
runs), and each word becomes byte symbols of which the last carries the word end. Words not seen before are encoded
together: greedy longest match proposes tokens for all of them in lockstep over a trie, the compatibility of every
adjacent pair is checked in one vectorised pass, and only what fails is merged exactly: a word, or in a word of more than
LONG bytes, which is proposed in parts of so many, the tokens around a failing pair, more of them while a pair at their
edge fails. Results are kept by the text between two spaces or line ends, which no word crosses and which normalisation
does not join, in a cache bounded by their number and length. Special tokens are found in that text before anything else.

Letters and numbers are those of Unicode 16, by which the vocabulary's own library goes; younger ones that a newer regex
module knows count as unassigned.

Defined cases: null text is empty; an empty text has no tokens and decodes to the empty text; repeated rows give equal
values; other columns are ignored; an empty table gives no rows. The vocabulary file's path is a parameter; executors
read it where they run.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe_rules import Rules, Trie
from .common import slices, texts_of

LONG, CACHE, KEPT = 48, 100_000, 64
#: The word pattern of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Letters and numbers that Unicode 16 added, first and last of each run.
_ADDED = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E "
    "11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF "
    "1E5D0-1E5ED 1E5F0-1E5F0 10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
)


def _younger() -> str:
    """Letters and numbers of the regex module that are none up to Unicode 16, as a set of runs."""
    runs = [run.split("-") for run in _ADDED.split()]
    added = {c for first, last in runs for c in range(int(first, 16), int(last, 16) + 1)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    young = [c for c in map(ord, regex.findall(r"[\p{L}\p{N}]", every)) if unicodedata.category(chr(c)) == "Cn" and c not in added]
    ends = [i for i, c in enumerate(young) if i + 1 == len(young) or young[i + 1] != c + 1]
    begins = [0, *(i + 1 for i in ends[:-1])]
    return "".join(f"{chr(young[a])}-{chr(young[b])}" for a, b in zip(begins, ends))


_YOUNGER = _younger()
_WORDS = regex.compile(WORDS)
#: The same where younger letters and numbers occur, which belong to no class.
_STRANGE = regex.compile(f"[{_YOUNGER}]") if _YOUNGER else None
_EXACT = regex.compile(WORDS.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_YOUNGER}])").replace(r"|\p{L}+", rf"|(?:(?![{_YOUNGER}])\p{{L}})+").replace(r"|\p{N}|", rf"|(?![{_YOUNGER}])\p{{N}}|")) if _YOUNGER else _WORDS
_RARE = regex.compile("[԰-\U0010ffff]")
#: Lower case of capitals that are younger than Python's Unicode tables.
_YOUNG = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, **{0x16EA0 + i: 0x16EBB + i for i in range(25)}, **{0x10D50 + i: 0x10D70 + i for i in range(22)}}


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    if _RARE.search(text):
        text = text.translate(_YOUNG)
    return text.lower()


def words_of(text: str) -> list[str]:
    if _STRANGE and not text.isascii() and _STRANGE.search(text):
        return _EXACT.findall(text)
    return _WORDS.findall(text)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        n = max(*vocab.values(), *self.special.values()) + 1
        rank, left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs, parts = {}, {}
        shown = byte_symbols()
        base = [vocab[c] for c in shown] + [vocab[c + end] for c in shown]
        self.base = np.array(base, np.int64)
        for i, t in enumerate(base):
            parts[t] = [i]
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = vocab[a], vocab[b]
            t = vocab[a + b]
            pairs[x, y] = t
            if rank[t] < 0:
                rank[t], left[t], right[t], parts[t] = r, x, y, parts[x] + parts[y]
        self.length = np.zeros(n, np.int64)
        self.length[list(parts)] = [len(p) for p in parts.values()]
        self.rules, self.trie = Rules(rank, left, right, pairs), Trie([(p, t) for t, p in parts.items()], 512)
        self.strings = np.empty(n, object)
        for s, t in (vocab | self.special).items():
            self.strings[t] = s
        self.names = self.strings.tolist()
        self.cache: dict[str, bytes] = {}
        self.exact = self.seen = 0

    def speculate(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in lockstep: (word, token) in order of word and place."""
        lane, at, node, stop, token = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int64), starts.copy(), np.full(len(starts), -1, np.int64)
        lanes, tokens = [], []
        while len(lane):
            inside = at < ends[lane]
            node = np.where(inside, self.trie.step(node, symbols[np.minimum(at, len(symbols) - 1)]), -1)
            on = node >= 0
            at = at + on
            found = np.where(on, self.trie.token[node], -1)
            token, stop = np.where(found >= 0, found, token), np.where(found >= 0, at, stop)
            off = ~on
            lanes.append(lane[off])
            tokens.append(token[off])
            at, node, token = np.where(off, stop, at), np.where(off, 0, node), np.where(off, -1, token)
            keep = on | (at < ends[lane])
            lane, at, node, stop, token = lane[keep], at[keep], node[keep], stop[keep], token[keep]
        lanes, tokens = np.concatenate(lanes), np.concatenate(tokens)
        order = np.argsort(lanes, kind="stable")
        return lanes[order], tokens[order]

    def long_word(self, word: bytes) -> np.ndarray:
        """Tokens of a word of any length: proposed in parts of LONG bytes; around each failing pair the symbols are merged
        exactly, with twice as many tokens on each side every time a pair fails again."""
        symbols = np.frombuffer(word, np.uint8).astype(np.int64)
        symbols[-1] += 256
        starts = np.arange(0, len(symbols), LONG)
        tokens = self.speculate(symbols, starts, np.minimum(starts + LONG, len(symbols)))[1]
        reach = 2
        while True:
            bad = np.flatnonzero(~self.rules.compatible(tokens[:-1], tokens[1:])) if len(tokens) > 1 else tokens[:0]
            if not len(bad):
                return tokens
            low, high = np.maximum(bad - reach, 0), np.minimum(bad + 2 + reach, len(tokens))
            new = np.append(True, low[1:] > np.maximum.accumulate(high)[:-1])
            low, high = low[new], np.maximum.reduceat(high, np.flatnonzero(new))
            at = np.append(0, np.cumsum(self.length[tokens]))
            out, done = [], 0
            for a, b in zip(low.tolist(), high.tolist()):
                out += [tokens[done:a], np.array(self.rules.merge(self.base[symbols[at[a] : at[b]]].tolist()), np.int64)]
                done = b
            tokens = np.concatenate([*out, tokens[done:]])
            reach *= 2

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Encodes distinct words."""
        out: dict[str, bytes] = {}
        raw = [w.encode() for w in words]
        for w, b in zip(words, raw):
            if len(b) > LONG:
                out[w] = self.long_word(b).astype(np.int32).tobytes()
        words, raw = [w for w, b in zip(words, raw) if len(b) <= LONG], [b for b in raw if len(b) <= LONG]
        self.seen += len(words)
        if not words:
            return out
        ends = np.cumsum([len(b) for b in raw])
        starts = np.concatenate([[0], ends[:-1]])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        lanes, tokens = self.speculate(symbols, starts, ends)
        seam = lanes[:-1] == lanes[1:]
        fails = np.zeros(len(words), bool)
        fails[lanes[:-1][seam][~self.rules.compatible(tokens[:-1][seam], tokens[1:][seam])]] = True
        flat = tokens.astype(np.int32).tobytes()
        cut = (4 * np.searchsorted(lanes, np.arange(len(words) + 1))).tolist()
        out.update(zip(words, map(flat.__getitem__, map(slice, cut, cut[1:]))))
        again = np.flatnonzero(fails)
        self.exact += len(again)
        for i, ids in zip(again.tolist(), self.rules.merge_all(self.base[symbols], starts[again], ends[again])):
            out[words[i]] = ids.astype(np.int32).tobytes()
        return out

    def _cut(self, piece: str) -> list[str | int]:
        """Words of a piece of text; special tokens as their ids."""
        if "<" not in piece or self._special is None or not self._special.search(piece):
            return words_of(normal(piece))
        out: list[str | int] = []
        for part in self._special.split(piece):
            out += [self.special[part]] if part in self.special else words_of(normal(part))
        return out

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encodes pieces of text that hold no space or line end."""
        cut = [self._cut(p) for p in pieces]
        known = self.words(list(set().union(*cut).difference(self.special.values())))
        known |= {i: np.int32(i).tobytes() for i in self.special.values()}
        get = known.__getitem__
        return {p: get(words[0]) if len(words) == 1 else b"".join(map(get, words)) for p, words in zip(pieces, cut)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text. No word crosses a space or a line end, so the text between them is looked up whole; what
        is longer than KEPT is forgotten again."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        all_ = set().union(*cut)
        fresh = all_.difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = all_
        if fresh:
            self.cache |= self.learn(list(fresh))
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, pieces)), np.int32) for pieces in cut]
        for piece in fresh:
            if len(piece) > KEPT:
                del self.cache[piece]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with spaces between them: the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """The kept columns with ids, the tokens of the text, and, if asked for, decoded, the text they decode to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in slices(batches, most=1 << 20):
            ids = own.encode(texts_of(batch))
            ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            out = {c: batch.column(c) for c in keep} | {"ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))}
            if decoded:
                out["decoded"] = pa.array(map(own.decode, ids), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(rows, f"{fields}, ids array<int>" + ", decoded string" * decoded)


def digests(encoded: DataFrame) -> DataFrame:
    """Number of tokens and the SHA-256 of the ids and of the decoded text."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
