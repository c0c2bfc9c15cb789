"""Token counts from a compiled finite-state tokenizer.

The piece vocabulary is compiled to a deterministic automaton (a trie of the pieces with failure links) whose
transitions carry emitted-token counts: after each character the machine knows the last token of what it has read,
which is the one piece ending there that is compatible with the last token before that piece, and the count is the
count before that piece plus one. A space resets the machine, for no piece runs from a letter over a space; so the
texts between spaces run in lockstep, one lane for each distinct one, and their counts are kept in a bounded cache.

A long text is cut into chunks. The map of a chunk from the state before it to the state after it has three parts: its
head, which continues whatever came before; the count of all between its first and its last space; and its tail, the
state it leaves. Such maps compose associatively, and the maps of a text are composed as a balanced tree.

Space runs merge after everything else and among themselves only. Characters outside the vocabulary count as their
UTF-8 bytes and reset the machine. Defined cases: null text is empty and has no tokens; repeated rows give equal
values; other columns are ignored; an empty table gives no rows. The model file's path is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_rules import Rules, Trie
from .common import slices, texts_of

CHUNK, CACHE, LONG, LIMIT = 1 << 14, 400_000, 64, 4096
SPACE = "▁"


class ChunkMap(NamedTuple):
    """What a chunk does to the count: `count` and `tail` are None where no space resets the machine inside it."""

    head: str
    count: int | None
    tail: str | None


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.runs = {len(names[i]): i for i in plain if set(names[i]) == {SPACE}}
        words = [i for i in plain if names[i] == SPACE or SPACE not in names[i][1:]]
        chars = [names[i] for i in words if len(names[i]) == 1]
        self.symbol = {c: k for k, c in enumerate(chars)}
        words = [i for i in words if all(c in self.symbol for c in names[i])]
        of = {names[i]: i for i in words}
        self.single = np.array([of[c] for c in chars], np.int64)
        merged = sorted((i for i in words if len(names[i]) > 1), key=lambda i: (-model.get_score(i), i))
        rank = np.full(n + 1, -1, np.int64)
        rank[merged] = np.arange(len(merged))
        pairs = {(of[w[:k]], of[w[k:]]): i for i in merged for w in (names[i],) for k in range(1, len(w)) if w[:k] in of and w[k:] in of}
        draft = Rules(rank, np.full(n + 1, -1), np.full(n + 1, -1), pairs)
        left, right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        usable = {i for i in words if len(names[i]) == 1}
        for i in merged:
            if draft.merge([of[c] for c in names[i]]) == [i]:
                usable.add(i)
                left[i], right[i] = self._last(draft, [of[c] for c in names[i]])
        self.rules = Rules(rank, left, right, {p: t for p, t in pairs.items() if t in usable})
        self.length = np.array([len(x) for x in names] + [1], np.int64)
        self.other = n
        self._automaton([(names[i], i) for i in usable])
        self.counts: dict[str, int] = {}
        self.alone: set[str] = set()
        self.run_counts: dict[int, int] = {}

    @staticmethod
    def _last(rules: Rules, symbols: list[int]) -> tuple[int, int]:
        """The two tokens that the last merge of a piece joins."""
        token = list(symbols)
        while len(token) > 2:
            ranks = [rules.rank_of.get(p, 1 << 40) for p in zip(token, token[1:])]
            i = ranks.index(min(ranks))
            token[i : i + 2] = [rules.token_of[ranks[i]]]
        return token[0], token[1]

    def _automaton(self, pieces: list[tuple[str, int]]) -> None:
        """Failure links of the trie, the longest piece that ends at each node, and the next shorter one of each piece."""
        k = len(self.symbol) + 1
        self.trie = Trie([([self.symbol[c] for c in w], t) for w, t in pieces], k)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.trie.edges.items():
            children.setdefault(key // k, []).append((key % k, node))
        size = len(self.trie.token)
        fail, out = np.zeros(size, np.int64), self.trie.token.copy()
        shorter = np.full(len(self.length), -1, np.int64)
        queue = [node for _, node in children.get(0, [])]
        for node in queue:
            if self.trie.token[node] < 0:
                out[node] = out[fail[node]] if node and fail[node] else -1
            elif fail[node]:
                shorter[self.trie.token[node]] = out[fail[node]]
            for s, child in children.get(node, []):
                back = int(fail[node])
                while back and back * k + s not in self.trie.edges:
                    back = int(fail[back])
                fail[child] = self.trie.edges.get(back * k + s, 0)
                queue.append(child)
        self.fail, self.out, self.shorter = fail, out, shorter

    def run(self, n: int) -> int:
        """Tokens of n space marks in a row: equal rules, so always the leftmost pair first."""
        if n not in self.run_counts:
            done: list[int] = []
            for _ in range(n):
                done.append(1)
                while len(done) > 1 and done[-2] + done[-1] in self.runs:
                    done[-2:] = [done[-2] + done[-1]]
            self.run_counts[n] = len(done)
        return self.run_counts[n]

    def lanes(self, words: list[str]) -> tuple[list[int], list[bool]]:
        """Tokens of each word and whether its first character is a token of its own; all words run in lockstep."""
        length = np.array([len(w) for w in words])
        order = np.argsort(-length, kind="stable")
        width, n = int(length.max()), len(words)
        points = np.frombuffer("".join(words[i].ljust(width, "\0") for i in order).encode("utf-32-le"), np.uint32).reshape(n, width)
        unique, back = np.unique(points, return_inverse=True)
        code = np.array([self.symbol.get(chr(c), -1) for c in unique.tolist()], np.int64)
        octets = np.array([len(chr(c).encode()) for c in unique.tolist()], np.int64)
        symbols, octets = code[back].reshape(n, width), octets[back].reshape(n, width)
        last, count = np.full((n, width + 1), self.other, np.int64), np.zeros((n, width + 1), np.int64)
        node = np.zeros(n, np.int64)
        alive = np.searchsorted(-length[order], -np.arange(1, width + 1), side="right")
        for at in range(width):
            m = int(alive[at])
            s, state = symbols[:m, at], node[:m]
            known = s >= 0
            nxt = np.where(known, self.trie.step(state, s), 0)
            stuck = np.flatnonzero(nxt < 0)
            state = state.copy()
            while len(stuck):
                top = state[stuck] == 0
                nxt[stuck[top]] = 0
                stuck = stuck[~top]
                state[stuck] = self.fail[state[stuck]]
                nxt[stuck] = self.trie.step(state[stuck], s[stuck])
                stuck = stuck[nxt[stuck] < 0]
            node[:m] = nxt
            token = np.where(known, self.out[nxt], self.other)
            wait = np.flatnonzero(known)
            while len(wait):
                t = token[wait]
                start = at + 1 - self.length[t]
                before = last[wait, start]
                free = (before == self.other) | (start == 0)
                good = free.copy()
                if not free.all():
                    good[~free] = self.rules.compatible(before[~free], t[~free])
                wait = wait[~good]
                token[wait] = self.shorter[token[wait]]
            rows = np.arange(m)
            last[:m, at + 1] = token
            count[:m, at + 1] = count[rows, at + 1 - self.length[token]] + np.where(known, 1, octets[:m, at])
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        total, first = count[np.arange(n), length[order]], self._first(last, length[order])
        return total[back].tolist(), first[back].tolist()

    def _first(self, last: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the first token has one character: walks back from the last one in all lanes."""
        at = length.copy()
        rows = np.arange(len(at))
        while True:
            back = at - self.length[last[rows, at]]
            move = (at > 0) & (back > 0)
            if not move.any():
                return at == 1
            at = np.where(move, back, at)

    def _long(self, word: str) -> tuple[int, bool]:
        """The same for one long word, by exact merging between characters outside the vocabulary."""
        total, first, part = 0, False, []
        of = self.single
        for c in [*word, ""]:
            s = self.symbol.get(c, -1) if c else -1
            if s >= 0:
                part.append(int(of[s]))
                continue
            if part:
                tokens = self.rules.merge(part)
                first = first or (total == 0 and self.length[tokens[0]] == 1)
                total += len(tokens)
                part = []
            total += len(c.encode())
        return total, bool(first)

    def learn(self, words: list[str]) -> None:
        for w in words:
            if len(w) > LONG:
                self._put([w], *([x] for x in self._long(SPACE + w)))
        by_size = sorted((w for w in words if len(w) <= LONG), key=len)
        for i in range(0, len(by_size), 16384):
            part = by_size[i : i + 16384]
            self._put(part, *self.lanes([SPACE + w for w in part]))

    def _put(self, words: list[str], counts: list[int], alone: list[bool]) -> None:
        self.counts.update(zip(words, counts))
        self.alone.update(w for w, x in zip(words, alone) if x)

    def need(self, words: set[str]) -> None:
        """Makes the counts of these words known, forgetting others when there are too many."""
        new = words.difference(self.counts)
        if len(self.counts) + len(new) > CACHE:
            self.counts.clear()
            self.alone.clear()
            new = words
        self.counts[""] = 0
        if new := new - {""}:
            self.learn(list(new))

    def phrases(self, words: list[str]) -> int:
        """Tokens of words each of which follows a space mark; empty ones are further space marks."""
        counts = self.counts
        try:
            total = sum(map(counts.__getitem__, words))
        except KeyError:
            self.need(set(words))
            total = sum(map(counts.__getitem__, words))
        if "" not in words:
            return total
        marks = 0
        for w in words:
            marks += 1
            if w:
                if marks > 1:
                    total += self.run(marks) - 1 if w in self.alone else self.run(marks - 1)
                marks = 0
        return total + self.run(marks)

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The map of a chunk: it is cut where a run of space marks begins after another character."""
        inner = chunk.lstrip(SPACE)
        first = chunk.find(SPACE, len(chunk) - len(inner))
        if first < 0 or not inner:
            return ChunkMap(chunk, None, None)
        last = chunk.rstrip(SPACE).rfind(SPACE) if chunk[-1] != SPACE else len(chunk.rstrip(SPACE))
        while last > first and chunk[last - 1] == SPACE:
            last -= 1
        last = max(first, last)
        return ChunkMap(chunk[:first], self.phrases(chunk[first:last].split(SPACE)[1:]) if last > first else 0, chunk[last:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a followed by b."""
        middle = self.chunk_map((a.head if a.count is None else a.tail) + b.head)
        if a.count is None and b.count is None:
            return middle
        closed = 0 if middle.count is None else middle.count
        if a.count is None:
            if middle.count is None:
                return ChunkMap(middle.head, b.count, b.tail)
            return ChunkMap(middle.head, closed + self.phrases(middle.tail.split(SPACE)[1:]) + b.count, b.tail)
        if b.count is None:
            if middle.count is None:
                return ChunkMap(a.head, a.count, middle.head)
            return ChunkMap(a.head, a.count + self.phrases(middle.head.split(SPACE)[1:]) + closed, middle.tail)
        ends = [middle.head] if middle.count is None else [middle.head, middle.tail]
        return ChunkMap(a.head, a.count + closed + sum(self.phrases(x.split(SPACE)[1:]) for x in ends) + b.count, b.tail)

    def total(self, text: str) -> int:
        """Tokens of one text: the maps of its chunks, composed as a balanced tree."""
        if not text:
            return 0
        if len(text) <= CHUNK:
            return self.phrases(text.replace(SPACE, " ").split(" "))
        marked = SPACE + text.replace(" ", SPACE)
        maps = [self.chunk_map(marked[i : i + CHUNK]) for i in range(0, len(marked), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        ends = [maps[0].head] if maps[0].count is None else [maps[0].head, maps[0].tail]
        return (maps[0].count or 0) + sum(self.phrases(x.split(SPACE)[1:]) for x in ends)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        self.need(set().union(*(t.replace(SPACE, " ").split(" ") for t in texts)))
        return [self.total(t) for t in texts]


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches):
            texts = texts_of(batch)
            n = np.array(own.count(texts), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
