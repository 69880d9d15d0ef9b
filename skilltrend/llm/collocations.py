"""Phrases whose words stand together more often than their parts do.

Four passes over the texts. The first two count hashes of runs of words, each
run only where all runs inside it may still be frequent; what remains, in a
bitmap of fixed size, is a superset of the frequent phrases and never lacks one.
Each of them is named after one class of texts that has it, and the third pass
writes it out from texts of this class alone. The last counts
them exactly, whatever their number: they lie in double-array tries of bounded
size, dealt by their first two words. A task takes the longest run at each of its
word positions that may be frequent, folds equal ones, and sends each to the trie
of its first two words. There all runs step through the trie together, byte by
byte, and the accepting states they pass are counted by ``bincount``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skilltrend.llm.common import mixed
from skilltrend.plans.checkpoints import discard, staged_at

#: Bytes of texts that a task works on at once, and hashes that it holds before it hands them over.
BUFFER, HELD = 1 << 20, 4 << 20
#: Bits of the bitmap of runs that may be frequent: 16 MB, whatever the corpus.
BITS = 27
#: Bits of the table of classes, 16 MB as well, and classes of texts.
PLACE_BITS, CLASSES = 24, 64
#: Parts among which hashes are dealt, at least.
SLOTS = 256
#: Bytes of candidates in one trie, more or less, and bytes of runs that a task holds before it folds equal ones.
TRIE, FOLDED = 4 << 20, 8 << 20

_SPACE, _BREAK = 0x20, 0x0A
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IS_WORD = ~_IS_BREAK
_IS_WORD[[0x20, 0x09]] = False
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts: their bytes, lower case, each followed by a space or, at the end of a piece, a line break."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        is_word = _IS_WORD[data]
        edges = np.diff(is_word.astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        is_word[end] = True  # room for what follows a word
        self.bytes = _LOWER[data[is_word]]
        self.size = end - begin
        ends = np.cumsum(self.size + 1)
        self.end = ends - 1
        self.begin = self.end - self.size
        #: Number of the piece that holds each word; a text's end also ends a piece.
        self.piece = np.searchsorted(np.flatnonzero(_IS_BREAK[data]), begin)
        self.bytes[self.end] = _BREAK
        self.bytes[self.end[:-1][self.piece[1:] == self.piece[:-1]]] = _SPACE
        self.langs, codes = np.unique(np.array(langs, dtype=object), return_inverse=True)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        of = np.searchsorted(text_ends, begin, "right")
        #: Place in ``langs`` of each word, and the class of its text.
        self.lang = codes[of]
        self.kind = np.fromiter((xxhash.xxh3_64_intdigest(text) % CLASSES for text in texts), np.uint8, len(texts))[of]

    def hashes(self) -> np.ndarray:
        """One hash per word, of its bytes and language."""
        if not len(self.size):
            return np.empty(0, np.uint64)
        powers = np.cumprod(np.full(int(self.size.max()) + 1, _STEP))
        inside = np.arange(len(self.bytes)) - np.repeat(self.begin, self.size + 1)
        values = _LETTER[self.bytes] * powers[inside]
        values[self.end] = 0
        of_lang = np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang in self.langs], np.uint64)
        return mixed(np.add.reduceat(values, self.begin) + of_lang[self.lang])

    def runs(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a run of ``length`` words begins at each word, and the hashes of all runs, real or not."""
        number = max(0, len(hashes) - length + 1)
        if length == 1:
            return np.ones(number, bool), hashes
        total = np.full(number, np.uint64(length))
        for k in range(length):
            total = mixed(total * _STEP + hashes[k : k + number])
        return self.piece[length - 1 :] == self.piece[:number], total


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of the rows (``lang``, ``text``), some megabytes of texts at a time."""
    for batch in batches:
        langs, texts = (column.to_pylist() for column in batch.columns[:2])
        start, held = 0, 0
        for k, text in enumerate(texts):
            if held and held + len(text) > BUFFER:
                yield Words(texts[start:k], langs[start:k])
                start, held = k, 0
            held += len(text) + 1
        if start < len(texts):
            yield Words(texts[start:], langs[start:])


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - BITS)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _open_runs(words: Words, lengths: list[int], open_: Open | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, first words and hashes of all runs whose words and pairs of words may be frequent."""
    hashes = words.hashes()
    pair = None
    if open_ is not None:
        word = open_.passes(hashes)
        real, total = words.runs(hashes, 2)
        pair = real & word[:-1] & word[1:] & open_.passes(total) if len(total) else real
    for length in lengths:
        real, total = words.runs(hashes, length)
        if open_ is not None and length > 1:
            for k in range(length - 1):
                real = real & pair[k : k + len(real)]
        at = np.flatnonzero(real)
        yield length, at, total[at]


#: A place of the table that several classes claim.
_ANY = 255


class Open:
    """Which runs may be frequent, and the class of texts that each is to be written out from.

    Both are looked up by the first bits of a run's hash; runs that share them
    let each other pass.
    """

    def __init__(self, bitmap: np.ndarray | None = None, classes: np.ndarray | None = None) -> None:
        self.bitmap = np.zeros(1 << (BITS - 3), np.uint8) if bitmap is None else bitmap.copy()
        self.classes = np.zeros(1 << PLACE_BITS, np.uint8) if classes is None else classes.copy()

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        return _is_set(self.bitmap, hashes)

    def written_by(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        named = self.classes[hashes >> np.uint64(64 - PLACE_BITS)]
        return (named == kinds + 1) | (named == _ANY)


def _with_frequent(docs: DataFrame, lengths: list[int], least: int, before: Broadcast | None) -> Open:
    """``before`` and all runs of ``lengths`` that come ``least`` times or more.

    Tasks hand over some 40 bits of each hash with its count, cut off at
    ``least``, which changes no sum's reaching it, and one class of texts that
    has the run. Runs that share these bits add up, so what passes is too much
    rather than too little.
    """
    slots = max(SLOTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = np.uint8 if least < 256 else np.uint32 if least < 1 << 32 else np.uint64
    out = pa.schema([("slot", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("kinds", pa.binary())])
    bits_out = pa.schema([("block", pa.int32()), ("bits", pa.binary()), ("classes", pa.binary())])
    last = np.uint64(CLASSES - 1)

    def fold(held: list[np.ndarray]) -> pa.RecordBatch:
        """Hashes, the class in their last bits, as one row per slot."""
        found = np.concatenate(held)
        found.sort()
        starts = np.flatnonzero(np.diff(found & ~last, prepend=~found[0] & ~last))
        counts = np.minimum(np.diff(starts, append=len(found)), least).astype(kind)
        found = found[starts]
        slot = ((found & np.uint64(0xFFFFFFFF)) // np.uint64(CLASSES) % np.uint64(slots)).astype(np.int32)
        order = np.argsort(slot, kind="stable")
        columns = [(found >> np.uint64(32)).astype(np.uint32)[order], counts[order], (found & last).astype(np.uint8)[order]]
        names, starts = np.unique(slot[order], return_index=True)
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))
        parts = [pa.array([column[a:b].tobytes() for a, b in spans], pa.binary()) for column in columns]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *parts], schema=out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for words in _texts(batches):
            for _, at, hashes in _open_runs(words, lengths, None if before is None else before.value):
                held.append((hashes & ~last) | words.kind[at])
                number += len(hashes)
            if number >= HELD:
                yield fold(held)
                held, number = [], 0
        if number:
            yield fold(held)

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, counts, kinds = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint32(1)))
        return keys[starts], np.minimum(np.add.reduceat(counts, starts), least), kinds[order][starts]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
            chosen = counts >= least
            columns = [pa.array((keys[chosen] >> np.uint32(32 - BITS)).astype(np.int32)), pa.array(kinds[chosen].astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["bit", "kind"])

        current, parts, number = None, [], 0
        for batch in batches:
            for slot, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if slot != current and parts:
                    yield frequent(*summed(parts))
                    parts, number = [], 0
                current = slot
                parts.append(tuple(np.frombuffer(data, of) for data, of in zip(row, (np.uint32, kind, np.uint8))))
                number += len(parts[-1][0])
                if number >= HELD:
                    parts = [summed(parts)]
                    number = 0  # only what is new since the last folding counts
        if parts:
            yield frequent(*summed(parts))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of both tables that each block of 2^15 bits has a share in."""

        def block_of(number: int, bits: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([number], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([classes.tobytes()], pa.binary())], schema=bits_out)

        current, bits, classes = None, None, None
        for batch in batches:
            numbers, bit, named = (column.to_numpy() for column in batch.columns)
            starts = np.flatnonzero(np.diff(numbers, prepend=numbers[0] ^ 1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)]):
                if numbers[a] != current:
                    if current is not None:
                        yield block_of(current, bits, classes)
                    current = int(numbers[a])
                    bits, classes = np.zeros(1 << 15, bool), np.zeros(1 << (15 - BITS + PLACE_BITS), np.uint8)
                own = bit[a:b] & ((1 << 15) - 1)
                bits[own] = True
                _claim(classes, own >> (BITS - PLACE_BITS), (named[a:b] + 1).astype(np.uint8))
        if current is not None:
            yield block_of(current, bits, classes)

    found = docs.mapInArrow(hashed, "slot int, keys binary, counts binary, kinds binary")
    found = found.repartition(slots, "slot").sortWithinPartitions("slot").mapInArrow(added, "bit int, kind int")
    blocks = found.select(F.shiftright("bit", 15).alias("block"), "bit", "kind").distinct()
    blocks = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(drawn, "block int, bits binary, classes binary")
    open_ = Open() if before is None else Open(before.value.bitmap, before.value.classes)
    for row in blocks.toLocalIterator():  # 4,096 rows of 8 KB at most
        bits, classes = (np.frombuffer(row[name], np.uint8) for name in ("bits", "classes"))
        open_.bitmap[row["block"] * len(bits) :][: len(bits)] |= bits
        own = open_.classes[row["block"] * len(classes) :][: len(classes)]
        named = np.flatnonzero(classes)
        _claim(own, named, classes[named])
    return open_


def _claim(classes: np.ndarray, places: np.ndarray, named: np.ndarray) -> None:
    """Enter classes (1 and up) at their places; one that two different ones claim is anybody's."""
    low, high = np.full(len(classes), _ANY, np.uint8), np.zeros(len(classes), np.uint8)
    np.minimum.at(low, places, named)
    np.maximum.at(high, places, named)
    some = np.unique(places)
    agreed = np.where(low[some] == high[some], low[some], _ANY)
    before = classes[some]
    classes[some] = np.where((before == 0) | (before == agreed), agreed, _ANY)


def _candidates(docs: DataFrame, longest: int, open_: Broadcast) -> DataFrame:
    """``lang``, ``phrase`` and ``head`` of every run of up to ``longest`` words that passes, once each.

    The head is the hash of the first two words, or of the only one.
    """
    out = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("head", pa.int64())])
    lengths = list(range(1, longest + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.uint64)
        for words in _texts(batches):
            heads = np.empty(0, np.uint64)
            for length, at, hashes in _open_runs(words, lengths, open_.value):
                if length <= 2:
                    heads = np.zeros(len(words.size), np.uint64)
                    heads[at] = hashes
                passing = open_.value.passes(hashes) & open_.value.written_by(hashes, words.kind[at])
                hashes, first = np.unique(hashes[passing], return_index=True)
                place = np.searchsorted(seen, hashes)
                new = seen[np.minimum(place, len(seen) - 1)] != hashes if len(seen) else np.ones(len(hashes), bool)
                at = at[passing][first[new]]
                seen = hashes if len(seen) > HELD else np.sort(np.concatenate([seen, hashes[new]]))
                data = words.bytes.tobytes()
                ends = words.end[at + length - 1]
                phrases = [data[a:b] for a, b in zip(words.begin[at].tolist(), ends.tolist())]
                langs = words.langs[words.lang[at]]
                columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string(), safe=False), pa.array(heads[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(run, "lang string, phrase string, head long").distinct()


class Trie:
    """A double array: state ``base[s] + symbol`` follows ``s`` if its ``check`` is ``s``; ``accept`` names what a state ends."""

    def __init__(self, states: np.ndarray) -> None:
        #: A row per state: what is looked up together lies together.
        self.states = states
        self.base, self.check, self.accept = states.T

    @classmethod
    def of(cls, keys: list[bytes]) -> Trie:
        """The trie of sorted distinct keys, built level by level for all keys at once."""
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        flat = np.frombuffer(b"".join(keys), np.uint8)
        starts = np.cumsum(sizes) - sizes
        node = np.zeros(len(keys), np.int64)
        parents, symbols = [], []
        active, depth, number = np.flatnonzero(sizes > 0), 0, 1
        while len(active):
            symbol, parent = flat[starts[active] + depth], node[active]
            new = np.ones(len(active), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
            node[active] = number - 1 + np.cumsum(new)
            parents.append(parent[new])
            symbols.append(symbol[new])
            number += int(new.sum())
            depth += 1
            active = active[sizes[active] > depth]
        parent = np.concatenate([np.empty(0, np.int64), *parents])  # of nodes 1, 2, ...; ascending
        symbol = np.concatenate([np.empty(0, np.int64), *symbols]).astype(np.int64)
        children = np.bincount(parent, minlength=number)
        first = np.cumsum(children) - children
        # Nodes with several children get a window each, which spans their symbols.
        # The gaps in it, and then fresh places, take the children of all others.
        several, single = np.flatnonzero(children > 1), np.flatnonzero(children == 1)
        low, high = symbol[first[several]], symbol[first[several] + children[several] - 1]
        width = high - low + 1
        window = 256 + np.cumsum(width) - width  # no state plus symbol is ever negative
        base = np.zeros(number, np.int64)
        base[several] = window - low
        top = 256 + int(width.sum())
        used = np.zeros(top, bool)
        of_several = children[parent] > 1
        used[base[parent[of_several]] + symbol[of_several]] = True
        free = 256 + np.flatnonzero(~used[256:])
        free = np.concatenate([free, np.arange(top, top + max(0, len(single) - len(free)))])[: len(single)]
        base[single] = free - symbol[first[single]]
        place = np.concatenate([[0], base[parent] + symbol])
        size = int(place.max()) + 257
        states = np.full((size, 3), -1, np.int32)
        states[:, 0] = 0
        states[place, 0] = base
        states[place[1:], 1] = place[parent]
        states[place[node], 2] = np.arange(len(keys))
        return cls(states)

    def state(self, text: bytes) -> int:
        """The state after ``text``, or -1."""
        at = 0
        for symbol in text:
            after = int(self.base[at]) + symbol
            if self.check[after] != at:
                return -1
            at = after
        return at

    def ended(self, data: np.ndarray, at: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The accepting states passed from places ``at`` in ``state``, and which places pass them, at each end of a word, all places a byte further each time."""
        of = np.arange(len(at))
        while len(at):
            symbol = data[at]
            word_ends = (symbol == _SPACE) | (symbol == _BREAK)
            found = self.accept[state[word_ends]]
            yield found[found >= 0], of[word_ends][found >= 0]
            after = self.base[state] + symbol
            goes_on = (self.check[after] == state) & (symbol != _BREAK)
            at, state, of = at[goes_on] + 1, after[goes_on], of[goes_on]


#: What a row of a block holds: a candidate, single words, runs of more words, or the number of a language's words.
_CANDIDATE, _SINGLE, _RUN, _TOTAL = range(4)
_DEALT = "block int, kind int, lang string, key binary, counts binary"
_DEALT_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("lang", pa.string()), ("key", pa.binary()), ("counts", pa.binary())])


def _longest_runs(words: Words, longest: int, open_: Open) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words the longest run at each word has that passes with all it begins with, and the hashes of words and of pairs."""
    hashes = words.hashes()
    pairs = np.empty(0, np.uint64)
    length = np.zeros(len(hashes), np.int64)
    going = open_.passes(hashes)
    length[going] = 1
    for k in range(2, longest + 1):
        real, total = words.runs(hashes, k)
        going = going[: len(total)] & real & open_.passes(total)
        length[: len(total)][going] = k
        if k == 2:
            pairs = total
    return length, hashes, pairs


def _cut_out(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
    """The stretches of ``data`` one after the other, each with a line break for its last byte, some megabytes at a time."""
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff((ends - 1) // (4 * BUFFER), prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, width = ends[a:b] - (ends[a] - sizes[a]), sizes[a:b]
        flat = data[np.arange(int(own[-1])) + np.repeat(starts[a:b] - own + width, width)]
        flat[own - 1] = _BREAK
        yield flat, slice(a, b)


def _runs_dealt(docs: DataFrame, longest: int, blocks: int, open_: Broadcast) -> DataFrame:
    """Rows of all single words and longest runs that pass, with their counts, for the block of their first words; and of the number of words."""

    def fold(lang: str, kind: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Equal runs once, one row per block."""
        flat, sizes, heads = (np.concatenate(column) for column in zip(*parts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        found = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        of = found.indices.to_numpy()
        head = np.empty(len(found.dictionary), np.uint64)
        head[of] = heads
        block = (head.view(np.int64) % blocks).astype(np.int32)  # as ``pmod``
        order = np.argsort(block, kind="stable")
        counts = np.bincount(of, minlength=len(block)).astype(np.uint32)[order]
        runs = found.dictionary.take(pa.array(order))
        ends = np.frombuffer(runs.buffers()[1], np.int64)[runs.offset : runs.offset + len(runs) + 1]
        data = memoryview(runs.buffers()[2])
        names, starts = np.unique(block[order], return_index=True)
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))
        keys = pa.array([bytes(data[ends[a] : ends[b]]) for a, b in spans], pa.binary())
        uses = pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())
        columns = [pa.array(names, pa.int32()), pa.array(np.full(len(names), kind, np.int32)), pa.array([lang] * len(names), pa.string()), keys, uses]
        yield pa.RecordBatch.from_arrays(columns, schema=_DEALT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, ...]]] = {}
        totals: dict[str, int] = {}
        number = 0
        for words in _texts(batches):
            for lang, size in zip(words.langs.tolist(), np.bincount(words.lang, minlength=len(words.langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + size
            length, hashes, pairs = _longest_runs(words, longest, open_.value)
            for kind, heads, at in ((_SINGLE, hashes, np.flatnonzero(length > 0)), (_RUN, pairs, np.flatnonzero(length > 1))):
                if kind == _SINGLE:
                    sizes = words.size[at] + 1
                else:
                    sizes = words.end[at + length[at] - 1] + 1 - words.begin[at]
                order = np.argsort(words.lang[at], kind="stable")
                at, sizes = at[order], sizes[order]
                names, starts = np.unique(words.lang[at], return_index=True)
                for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
                    own = at[a:b]
                    for flat, part in _cut_out(words.bytes, words.begin[own], sizes[a:b]):
                        held.setdefault((words.langs[name], kind), []).append((flat, sizes[a:b][part], heads[own[part]]))
                        number += len(flat)
                        if number >= FOLDED:
                            for (lang, kind_), parts in held.items():
                                yield from fold(lang, kind_, parts)
                            held, number = {}, 0
        for (lang, kind), parts in held.items():
            yield from fold(lang, kind, parts)
        langs = [lang for lang, number in totals.items() if number]
        columns = [pa.array(np.zeros(len(langs), np.int32)), pa.array(np.full(len(langs), _TOTAL, np.int32)), pa.array(langs, pa.string()), pa.nulls(len(langs), pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([np.int64(totals[lang]).tobytes() for lang in langs], pa.binary())], schema=_DEALT_ARROW)

    return docs.mapInArrow(run, _DEALT)


def _counts(candidates: DataFrame, runs: DataFrame, blocks: int, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``f`` of the candidates that the runs have ``least`` times or more, and, without a phrase, of the number of words."""
    out = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])

    class Block:
        """One trie, its candidates and their counts so far."""

        def __init__(self, number: int) -> None:
            self.number, self.langs, self.keys = number, [], []
            self.trie, self.roots, self.totals = None, {}, {}
            self.held, self.size = [], 0

        def add(self, kind: int, lang: str, runs: bytes, counts: bytes) -> None:
            if not self.keys:
                return
            if self.trie is None:
                self.trie, self.counts = Trie.of(self.keys), np.zeros(len(self.keys), np.int64)
                begin = [len(lang.encode()) + 1 for lang in self.langs]
                self.single = np.fromiter((b" " not in key[at:] for key, at in zip(self.keys, begin)), bool, len(self.keys))
            if lang not in self.roots:
                self.roots[lang] = self.trie.state(lang.encode() + b"\n")
            if self.roots[lang] < 0:
                return
            uses = np.frombuffer(counts, np.uint32)
            self.held.append((np.frombuffer(runs, np.uint8), uses, np.full(len(uses), self.roots[lang], np.int32), np.full(len(uses), kind == _SINGLE)))
            self.size += len(runs)
            if self.size >= BUFFER:
                self.count()

        def count(self) -> None:
            """What is held steps through the trie, all at once: a step takes its time however few take it."""
            if not self.held:
                return
            data, uses, root, single = (np.concatenate(column) for column in zip(*self.held))
            self.held, self.size = [], 0
            starts = np.concatenate([[0], np.flatnonzero(data == _BREAK)[:-1] + 1])
            passed = list(self.trie.ended(data, starts, root))
            found, of = (np.concatenate(column) for column in zip(*passed))
            # A run's first word is among the single words as well.
            chosen = self.single[found] == single[of]
            self.counts += np.bincount(found[chosen], uses[of[chosen]], len(self.counts)).astype(np.int64)

        def rows(self) -> Iterator[pa.RecordBatch]:
            self.count()
            at = np.flatnonzero(self.counts >= least).tolist() if self.trie is not None else []
            langs, phrases = [self.langs[k] for k in at], [self.keys[k][len(self.langs[k].encode()) + 1 :] for k in at]
            f = [int(self.counts[k]) for k in at]
            columns = [[*langs, *self.totals], [*phrases, *[None] * len(self.totals)], [*f, *self.totals.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            for number, kind, lang, key, counts in zip(*(column.to_pylist() for column in batch.columns)):
                if current is None or current.number != number:
                    if current is not None:
                        yield from current.rows()
                    current = Block(number)
                if kind == _CANDIDATE:
                    current.langs.append(lang)
                    current.keys.append(key)
                elif kind == _TOTAL:
                    current.totals[lang] = current.totals.get(lang, 0) + int(np.frombuffer(counts, np.int64)[0])
                else:
                    current.add(kind, lang, key, counts)
        if current is not None:
            yield from current.rows()

    block = F.pmod("head", F.lit(blocks)).cast("int").alias("block")
    key = F.concat(F.col("lang").cast("binary"), F.lit(b"\n"), F.col("phrase").cast("binary"))
    named = candidates.select(block, F.lit(_CANDIDATE).alias("kind"), "lang", key.alias("key"), F.lit(None).cast("binary").alias("counts"))
    dealt = named.unionAll(runs).repartition(blocks, "block").sortWithinPartitions("block", "kind", "key")
    found = dealt.mapInArrow(run, "lang string, phrase binary, f long")
    return found.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def frequent_phrases(
    docs: DataFrame, least: int = 30, longest: int = 4, lang_column: str = "lang", text_column: str = "text", trie_bytes: int = TRIE
) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``f`` of all runs of up to ``longest`` words that come ``least`` times or more, and ``lang``, ``n`` of all words.

    Exact. A null language is ``und``, a null or empty text has no word, repeated
    rows count each, further columns are ignored, an empty table gives no rows.
    Four passes over the texts, however many tries there are; their number grows
    with the bytes of the candidates, ``trie_bytes`` of which go into one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"),
    )
    context = spark.sparkContext
    open_ = context.broadcast(_with_frequent(rows, list(range(1, min(2, longest) + 1)), least, None))
    if longest > 2:
        short = open_
        open_ = context.broadcast(_with_frequent(rows, list(range(3, longest + 1)), least, short))
        short.destroy()
    candidates, candidates_path = staged_at(_candidates(rows, longest, open_), "candidates")
    key_bytes = candidates.agg(F.sum(F.octet_length("lang") + F.octet_length("phrase") + 1)).first()[0] or 0
    if not key_bytes:
        open_.destroy()
        discard(spark, candidates_path)
        nothing = spark.createDataFrame([], "lang string, phrase string, f long")
        return nothing, nothing.select("lang", F.col("f").alias("n"))
    blocks = max(SLOTS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-key_bytes // trie_bytes))
    counts, _ = staged_at(_counts(candidates, _runs_dealt(rows, longest, blocks, open_), blocks, least), "phrase-counts")
    open_.destroy()
    discard(spark, candidates_path)
    words = counts.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    return counts.where("phrase is not null"), words


def collocations(
    docs: DataFrame,
    least: int = 30,
    longest: int = 4,
    top: int = 2000,
    cover: int = 80,
    lang_column: str = "lang",
    text_column: str = "text",
    trie_bytes: int = TRIE,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's first ``top`` phrases.

    A phrase of two words or more that comes ``a >= least`` times scores, at its
    worst cut into parts that come ``l`` and ``r`` times, floor(2000000 a / (l + r)).
    Phrases inside a longer one that has ``cover`` percent of their count are
    left out. See ``frequent_phrases`` for nulls, empty and repeated rows.
    """
    found, words = frequent_phrases(docs, least, longest, lang_column, text_column, trie_bytes)
    phrases, _ = staged_at(found, "phrases")
    split = phrases.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))

    def run(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    # Products of counts may pass 64 bits.
    a, whole = F.col("f").cast("decimal(20,0)"), "decimal(20,0)"
    cuts = split.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr(f"(cast(2000000 as decimal(7,0)) * cast(f as {whole})) div (cast(l as {whole}) + cast(r as {whole}))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = split.where("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    longer = inner.groupBy("lang", run(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("f").alias("longer"))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= a * cover
    kept = worst.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
