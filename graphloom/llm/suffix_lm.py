"""Language-model scores from a probabilistic suffix tree over words.

Training counts every word and every n-gram of up to DEPTH + 1 words of every training text that can matter. Contexts grow level by
level: a context of up to DEPTH words is a candidate if it occurs MIN_COUNT times, however large the corpus is, and the context without its
first word is retained; its next-symbol distribution names the symbols that follow it MIN_COUNT times, and the rest goes to the
next shorter suffix. A candidate is retained if the divergence of its smoothed distribution from its suffix's, times its count, pays
for its symbols (half a logarithm of the count each). Smoothing gives the suffix's distribution the weight SMOOTH and what the
named symbols leave. Scores use the longest retained suffix; the empty one is the base distribution, which keeps a share for
words never seen. All distributions sum to one.

Candidates and symbols have the same minimum, so the suffixes of what is named are named, too, and the logarithm of a score is a sum over
the text's n-grams: a retained context gives its weight of the way back, a named symbol what it adds to its suffix's. The grown tree
is a table of these weights by n-gram, and the words' base probabilities are rows of it as well. Its HOT most frequent rows are broadcast.
All others are looked up by an exchange: the texts' n-grams go, many in a row, to the buckets that hold the table's rows, and sums for each text
come back. Bitmaps of fixed size spare n-grams that aren't in a table the way; a full bitmap spares none, but changes no result.

Words and n-grams stand as 64-bit hashes; two of them that fall together would share their counts. Counting sums up in each task first,
then by buckets of hashes, so no word or context, however frequent, is counted in one task. The tree grows over packed arrays: n-grams pass by
the named symbols in buckets of their suffixes, then the different symbols of a context, each once with its count, meet in a bucket of contexts.

Defined results: a null or empty text is the end token alone; a null id counts as neither held out nor training, and is scored;
repeated rows are learned and scored each; without training text every probability is that of an unseen word; very long texts are
read whole; existing columns that have a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, lean, read_table, release, small_batches, staged, text_bytes

#: Bounds and weights of the tree; see above.
MIN_COUNT, DEPTH, SMOOTH = 2, 3, 20.0
#: Rows of the table that are broadcast, at most; and the bits (a power of two) of a bitmap, at most, which is made in pieces.
HOT, BITS, PIECES = 1_000_000, 28, 5
#: N-grams that a worker counts before it passes them on, text that it reads at once, and text and table rows that a bucket is to hold.
HELD, PIECE_BYTES, BUCKET_BYTES, BUCKET_ROWS = 1_000_000, 1 << 20, 8 << 20, 1_000_000

_U = np.uint64
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: The key of the end, which also stands before every text; and what turns a word's key into that of its base probability.
END, BASE = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of all but their last and all but their first words."""
    return _mixed((prefix ^ (prefix >> _U(31))) * _U(0x9E3779B97F4A7C15) + suffix * _U(0xC2B2AE3D27D4EB4F))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between starts and ends: eight bytes at a time, all words at once; long words each on its own."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    size = ends - starts
    out = _mixed(size.astype(np.uint64) * _U(0x2545F4914F6CDD1D))
    todo, k = np.flatnonzero(size <= 256), 0
    while len(todo):
        block, left = eight[starts[todo] + 8 * k], size[todo] - 8 * k
        short = left < 8
        block[short] &= (_U(1) << (_U(8) * left[short].astype(np.uint64))) - _U(1)
        out[todo] = _mixed((out[todo] ^ block) * _U(0x9E3779B97F4A7C15) + _U(k + 1))
        todo, k = todo[left > 8], k + 1
    for j in np.flatnonzero(size > 256).tolist():
        out[j] = xxhash.xxh64_intdigest(data[starts[j] : ends[j]].tobytes(), 7)
    return out


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the texts' words with an end before and after each text; the place of each in its text (0: the end before); tokens of each text."""
    data, bounds = text_bytes(texts)
    data = _LOWER[data]
    word, filled = ~_SPACE[data], bounds[1:] > bounds[:-1]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin, end = bounds[:-1][filled], bounds[1:][filled] - 1
    first[begin], last[end] = word[begin], word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.diff(np.searchsorted(starts, bounds))
    before = np.cumsum(words + 2) - (words + 2)
    place = np.arange(int((words + 2).sum())) - np.repeat(before, words + 2)
    keys = np.full(len(place), END)
    keys[np.arange(len(starts)) + 2 * np.repeat(np.arange(len(words)), words) + 1] = word_keys(data, starts, ends)
    return keys, place, words + 1


def grams(keys: np.ndarray, most: int) -> list[np.ndarray]:
    """For n = 1 to most, the keys of the n words from each place on."""
    out = [keys]
    for _ in range(1, most):
        out.append(joined(out[-1][:-1], out[-1][1:]))
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned 64-bit keys. Their high bits with their places below sort as values, which is faster, and nearly always tells them apart."""
    low = (_U(1) << _U(len(keys).bit_length())) - _U(1)
    packed = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & low).view(np.int64)
    done = keys.take(order)
    return order if not (done[1:] < done[:-1]).any() else np.argsort(keys)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the high bits of keys: sorted keys are sorted by bucket, too."""
    return ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of runs of equal values."""
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)]):
        if a < b:
            yield int(sorted_values[a]), a, b


def _by_run(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """Sorted batches in lists of slices with one value of column each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            for value, a, z in _runs(b.column(column).to_numpy()):
                if held and held[0].column(column)[0].as_py() != value:
                    yield held
                    held = []
                held.append(b.slice(a, z - a))
    if held:
        yield held


def _array(parts: list[pa.RecordBatch], column: str, kind) -> np.ndarray:
    """The binary values of a column, end to end, as one array."""
    return np.frombuffer(b"".join(x for p in parts for x in p.column(column).to_pylist() if x is not None), kind)


# ---- counting

_SUMMED = "level int, bucket long, prefix binary, suffix binary, n binary"
#: A packed row has many entries of one bucket of keys. Counts (kind 0): keys and n; p of named symbols is in more. N-grams (kind 1): more is their other part.
_PACKED = {"level": pa.int32(), "kind": pa.int32(), "bucket": pa.int64(), "keys": pa.binary(), "more": pa.binary(), "n": pa.binary(), "value": pa.binary()}
_PACKED_DDL = "level int, kind int, bucket long, keys binary, more binary, n binary, value binary"


def _dealt(level: int, kind: int, buckets: int, keys: np.ndarray, n: np.ndarray, more: np.ndarray | None = None, value: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows of entries in any order, by the buckets of their keys."""
    order = _order(keys)
    keys, n, more, value = (x if x is None else x[order] for x in (keys, n, more, value))
    rows, size = [], 0
    for b, a, z in _runs(_bucket(keys, buckets)):
        rows.append((level, kind, b, _steps(keys[a:z]), None if more is None else more[a:z].tobytes(), _planes(n[a:z]), None if value is None else value[a:z].tobytes()))
        size += 32 * (z - a)
        if size > PIECE_BYTES:
            yield _batch(rows, _PACKED)
            rows, size = [], 0
    if rows:
        yield _batch(rows, _PACKED)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(kind, keys, more, n, value) of packed rows; more and value as they are."""
    for b in batches:
        for kind, keys, more, n, value in zip(*(b.column(c).to_pylist() for c in ("kind", "keys", "more", "n", "value"))):
            yield kind, _from_steps(keys), more, _from_planes(n, "<i8"), value


class _Held:
    """Arrays that wait until there are HELD entries, for pieces that aren't small."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.parts.append(arrays)
            self.size += len(arrays[0])

    def take(self, least: int = 1) -> Iterator[list[np.ndarray]]:
        """All that is held, once, if there are least entries."""
        if self.size >= least:
            parts, self.parts, self.size = self.parts, [], 0
            yield [np.concatenate(x) for x in zip(*parts)]


def _counted(level: int, prefix: np.ndarray, suffix: np.ndarray | None, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, prefix, suffix and sum of n for each n-gram; a word is its own prefix and has no suffix."""
    key = prefix if suffix is None else joined(prefix, suffix)
    order = _order(key)
    key = key.take(order)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    if len(key) and n.max() == 1:
        sums = np.diff(first, append=len(key)).astype(n.dtype)
    else:
        sums = np.add.reduceat(n.take(order), first) if len(key) else n
    own = order.take(first)
    return key.take(first), prefix.take(own), None if suffix is None else suffix.take(own), sums


def _count(levels: tuple[int, ...], buckets: int, shared=None):
    """Packed counts of the words (level 1) and n-grams (level n) of texts. shared: bitmaps of the prefixes and suffixes that can matter."""

    kinds = {"level": pa.int32(), "bucket": pa.int64(), "prefix": pa.binary(), "suffix": pa.binary(), "n": pa.binary()}

    def summed(level, parts):
        columns = [list(x) for x in zip(*parts)]
        parts.clear()
        whole = []
        for x in columns:  # a column's parts go once they are in one array
            whole.append(None if x[0] is None else np.concatenate(x))
            x.clear()
        return _counted(level, *whole)

    def packed(level, key, prefix, suffix, n):
        rows, size = [], 0
        for b, a, z in _runs(_bucket(key, buckets)):
            if suffix is None:  # a word is its own key, and sorted
                rows.append((level, b, _steps(prefix[a:z]), None, _planes(n[a:z].astype("<u4"))))
            else:
                order = a + _order(prefix[a:z])  # sorted prefixes compress; so do counts, most of which are small
                rows.append((level, b, _steps(prefix.take(order)), suffix.take(order).tobytes(), _planes(n.take(order).astype("<u4"))))
            size += 20 * (z - a)
            if size > PIECE_BYTES:
                yield _batch(rows, kinds)
                rows, size = [], 0
        if rows:
            yield _batch(rows, kinds)

    def run(batches):
        prefixes, suffixes = shared.value if shared else (None, None)
        parts: dict[int, list] = {level: [] for level in levels}
        held = dict.fromkeys(levels, 0)
        for b in by_bytes(batches, 0, PIECE_BYTES):
            keys, place, _ = keys_of(b.column(0))
            found = grams(keys, max(max(levels) - 1, 1))
            for level in levels:
                if level == 1:
                    words = keys[place > 0]
                    parts[level].append((words, None, np.ones(len(words), np.uint32)))
                else:
                    here = np.flatnonzero(place[level - 1 :] >= level - 1)
                    prefix, suffix = found[level - 2][here], found[level - 2][here + 1]
                    if prefixes:
                        good = prefixes.has(prefix) & suffixes.has(suffix)
                        prefix, suffix = prefix[good], suffix[good]
                    parts[level].append((prefix, suffix, np.ones(len(prefix), np.uint32)))
                held[level] += len(parts[level][-1][0])
                if held[level] > HELD:
                    counted = summed(level, parts[level])
                    held[level] = len(counted[0])
                    if 2 * held[level] < HELD:  # sums that leave room stay, as those of words do
                        parts[level].append(counted[1:])
                    else:
                        yield from packed(level, *counted)
                        held[level] = 0
        for level in levels:
            if held[level]:
                yield from packed(level, *summed(level, parts[level]))

    return run


def _sum_buckets(least: int, buckets: int, depth: int):
    """Counts of whole buckets; words all stay, n-grams from least on. Counts by key, where a level can be a context; n-grams by suffix."""

    def out(level, key, prefix, suffix, n):
        if level <= depth:
            yield from _dealt(level, 0, buckets, key, n)
        if level > 1:
            yield from _dealt(level, 1, buckets, suffix, n, prefix)

    def run(batches):
        held: dict[int, _Held] = {}
        for parts in _by_run(batches, "bucket"):
            for level in sorted({x for p in parts for x in p.column("level").to_pylist()}):
                own = [p.filter(pa.array(p.column("level").to_numpy() == level)) for p in parts]
                prefix = np.concatenate([_from_steps(x) for p in own for x in p.column("prefix").to_pylist()])
                n = np.concatenate([_from_planes(x, "<u4") for p in own for x in p.column("n").to_pylist()]).astype(np.int64)
                key, prefix, suffix, n = _counted(level, prefix, None if level == 1 else _array(own, "suffix", "<u8"), n)
                keep = n >= (1 if level == 1 else least)
                waiting = held.setdefault(level, _Held())
                waiting.add(key[keep], prefix[keep], key[keep] if suffix is None else suffix[keep], n[keep])
                for whole in waiting.take(HELD):
                    yield from out(level, *whole)
        for level, waiting in held.items():
            for whole in waiting.take():
                yield from out(level, *whole)

    return run


def count(texts: DataFrame, levels: tuple[int, ...], buckets: int, least: int = MIN_COUNT, shared=None, depth: int = DEPTH) -> DataFrame:
    """Packed counts of a DataFrame with one column of texts: all words (level 1) and the n-grams that occur least times."""
    dealt = texts.mapInArrow(lean(_count(levels, buckets, shared)), _SUMMED).repartition("bucket").sortWithinPartitions("bucket")
    return staged(dealt.mapInArrow(lean(_sum_buckets(least, buckets, depth)), _PACKED_DDL), "counts")


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as planes of their differences."""
    return _planes(np.diff(sorted_keys, prepend=_U(0)).astype("<u8"))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, "<u8"), dtype=np.uint64)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))


class Bitmap:
    """Which keys may be in a set: all that are, and some others. A key's high bits and its low half's are set."""

    def __init__(self, bits: int, pieces: list[tuple[int, bytes]]):
        self.shift, self.bits = _U(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        size = len(self.bits) >> PIECES
        for k, piece in pieces:
            self.bits[k * size : (k + 1) * size] |= np.frombuffer(piece, np.uint8)

    def _one(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).view(np.int64)  # as signed places, which numpy needn't convert
        return (self.bits.take(at >> 3) >> (at & 7).astype(np.uint8)) & 1 > 0

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self._one(keys)
        some = np.flatnonzero(out)
        out[some] = self._one(keys.take(some) << _U(32))
        return out


def bitmap(packed: DataFrame) -> Bitmap:
    """A bitmap of the keys of packed rows, with 32 bits for each up to its bound; a piece of it comes from one partition."""
    n = packed.agg(F.sum(F.octet_length("n")).alias("size")).first()["size"] or 0  # eight bytes a key
    bits = min(BITS, max(16, (2 * n).bit_length()))

    def pieces(keys):
        at = np.sort(np.concatenate([keys, keys << _U(32)]) >> _U(64 - bits))
        rows = [(k, (at[a:z] & _U((1 << (bits - PIECES)) - 1)).astype("<u4").tobytes()) for k, a, z in _runs((at >> _U(bits - PIECES)).astype(np.int64))]
        return _batch(rows, {"k": pa.int64(), "bits": pa.binary()})

    def pack(batches):
        held = _Held()
        for b in batches:
            for keys in b.column(0).to_pylist():
                held.add(_from_steps(keys))
                for (whole,) in held.take(HELD):
                    yield pieces(whole)
        for (whole,) in held.take():
            yield pieces(whole)

    def unite(batches):
        for parts in _by_run(batches, "k"):
            flags = np.zeros(1 << (bits - PIECES), bool)
            for p in parts:
                for at in p.column("bits").to_pylist():
                    flags[np.frombuffer(at, "<u4")] = True
            yield _batch([(parts[0].column("k")[0].as_py(), np.packbits(flags, bitorder="little").tobytes())], {"k": pa.int64(), "bits": pa.binary()})

    dealt = packed.select("keys").mapInArrow(lean(pack), "k long, bits binary").repartition(1 << PIECES, "k").sortWithinPartitions("k")
    return Bitmap(bits, [(r["k"], r["bits"]) for r in dealt.mapInArrow(lean(unite), "k long, bits binary").collect()])


# ---- the tree


class Base:
    """What the base distribution needs besides the words' counts: tokens, distinct words."""

    def __init__(self, total: int, distinct: int):
        self.total, self.distinct = total, distinct

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def log_unseen(self) -> float:
        return float(np.log10(0.5 / self.denominator))


def _sums(batches):
    """Tokens and distinct words of packed counts."""
    for b in batches:
        n = [_from_planes(x, "<i8") for x in b.column("n").to_pylist()]
        yield _batch([(int(sum(x.sum() for x in n)), sum(map(len, n)))], {"total": pa.int64(), "distinct": pa.int64()})


def _common(base: Base, least: int):
    """The words that occur least times, with their probabilities, as named symbols."""

    def run(batches):
        for b in batches:
            rows = []
            for level, kind, bucket, keys, n in zip(*(b.column(c).to_pylist() for c in ("level", "kind", "bucket", "keys", "n"))):
                keys, n = _from_steps(keys), _from_planes(n, "<i8")
                keys, n = keys[n >= least], n[n >= least]
                rows.append((level, kind, bucket, _steps(keys), ((n + 0.5) / base.denominator).tobytes(), _planes(n), None))
            yield _batch(rows, _PACKED)

    return run


def _base_rows(base: Base):
    """Words' rows of the table."""

    def run(batches):
        for b in batches:
            rows = []
            for keys, n in zip(b.column("keys").to_pylist(), b.column("n").to_pylist()):
                keys, n = _from_steps(keys) ^ BASE, _from_planes(n, "<i8")
                order = _order(keys)
                n = n[order]
                rows.append((True, _steps(keys[order]), _planes(n), (np.log10((n + 0.5) / base.denominator) - base.log_unseen).tobytes()))
            yield _batch(rows, _WEIGHTS)

    return run


def _table_of(parts: list[tuple], column: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of entries, and what they have in a column."""
    keys = np.concatenate([x[1] for x in parts])
    values = np.concatenate([x[column] if kind is None else np.frombuffer(x[column], kind) for x in parts])
    order = _order(keys)
    return keys[order], values[order]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys in a sorted table that isn't empty, and which are there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _ups(level: int, buckets: int):
    """N-grams with their symbols' probabilities by the suffix, by prefix. In each bucket of suffixes the named symbols come first; n-grams pass by."""

    def run(batches):
        held = _Held()
        at, named, table = None, [], None
        for b in batches:
            for bucket, entry in zip(b.column("bucket").to_pylist(), _entries([b])):
                if bucket != at:
                    at, named, table = bucket, [], None
                if entry[0] == 0:
                    named.append(entry)
                    continue
                if table is None and named:
                    table, named = _table_of(named, 2, "<f8"), []
                # where the suffix context isn't retained, none of its symbols is named, so a context has all its symbols here or none
                if table is not None and len(table[0]):
                    _, suffix, prefix, n, _ = entry
                    place, hit = _found(table[0], suffix)
                    held.add(np.frombuffer(prefix, "<u8")[hit], suffix[hit], n[hit], table[1][place[hit]])
                    for prefix, suffix, n, up in held.take(HELD):
                        yield from _dealt(level, 1, buckets, prefix, n, suffix, up)
        for prefix, suffix, n, up in held.take():
            yield from _dealt(level, 1, buckets, prefix, n, suffix, up)

    return run


def _retained(level: int, buckets: int):
    """Of the contexts of each bucket those that pay: their symbols (kind 0; more is p, value the weight) and themselves (kind 1)."""

    def grown(parts):
        totals, rows = [x for x in parts if x[0] == 0], [x for x in parts if x[0] == 1]
        if not totals or not rows:
            return None
        keys, counts = _table_of(totals, 3, None)
        prefix = np.concatenate([x[1] for x in rows])
        order = _order(prefix)
        prefix, n = prefix[order], np.concatenate([x[3] for x in rows])[order]
        suffix, up = (np.concatenate([np.frombuffer(x[c], t) for x in rows])[order] for c, t in ((2, "<u8"), (4, "<f8")))
        if not len(keys) or not len(prefix):
            return None
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        symbols = np.diff(first, append=len(prefix))
        place, there = _found(keys, prefix[first])
        total = counts[place]
        bow = (SMOOTH + total - np.add.reduceat(n, first)) / (total + SMOOTH)
        p = n / np.repeat(total + SMOOTH, symbols) + np.repeat(bow, symbols) * up
        rest, rest_up = (np.maximum(1 - np.add.reduceat(x, first), 1e-12) for x in (p, up))
        divergence = np.add.reduceat(p * np.log(p / up), first) + rest * np.log(rest / rest_up)
        keep = there & (total * divergence >= 0.5 * np.log(np.maximum(total, 2)) * symbols)
        own = np.repeat(keep, symbols)
        weight = np.log10(p[own] / up[own] / np.repeat(bow[keep], symbols[keep]))
        return (joined(prefix[own], suffix[own]), n[own], p[own], weight), (prefix[first][keep], total[keep], np.log10(bow[keep]))

    def run(batches):
        named, contexts = _Held(), _Held()
        for parts in _by_run(batches, "bucket"):
            both = grown(list(_entries(parts)))
            if both:
                named.add(*both[0])
                contexts.add(*both[1])
            for key, n, p, weight in named.take(HELD):
                yield from _dealt(level, 0, buckets, key, n, p, weight)
            for key, n, weight in contexts.take(HELD):
                yield from _dealt(level, 1, buckets, key, n, None, weight)
        for key, n, p, weight in named.take():
            yield from _dealt(level, 0, buckets, key, n, p, weight)
        for key, n, weight in contexts.take():
            yield from _dealt(level, 1, buckets, key, n, None, weight)

    return run


#: The table's rows, many in one: words' (known) or n-grams'.
_WEIGHTS = {"known": pa.bool_(), "keys": pa.binary(), "n": pa.binary(), "value": pa.binary()}
_WEIGHTS_DDL = "known boolean, keys binary, n binary, value binary"


def train(texts: DataFrame, *, depth: int = DEPTH, min_count: int = MIN_COUNT) -> tuple[Base, DataFrame]:
    """The base and the whole tree as a table (known, keys, n, value) of a DataFrame with one column of texts; table_rows unpacks it.

    A known word's value is what its base probability adds to log_unseen; an n-gram's is its weight. One that is a context and a named symbol has two entries.
    """
    spark = texts.sparkSession
    small_batches(spark)
    size = texts.agg(F.sum(F.octet_length(texts.columns[0])).alias("size")).first()["size"] or 0
    buckets = max(4, int(size) // BUCKET_BYTES)

    def met(table, rows):
        """Packed rows by bucket, those of the table first."""
        both = table.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)))
        return both.repartition("bucket").sortWithinPartitions("bucket", "kind")

    counted = count(texts, (1, 2), buckets, min_count, depth=depth)
    release(spark)
    words = staged(counted.where("level = 1"), "words")
    sums = words.mapInArrow(_sums, "total long, distinct long").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    base = Base(sums["total"] or 0, sums["distinct"] or 0)
    # staged, so that a task that reads the table runs one Python worker: each holds what is broadcast, also while it waits
    parts = [staged(words.mapInArrow(lean(_base_rows(base)), _WEIGHTS_DDL), "weights")]
    counts = named = words.mapInArrow(_common(base, min_count), _PACKED_DDL)  # counts: of the n-grams that may be contexts
    for level in range(2, depth + 2):
        if level > 2:
            shared = spark.sparkContext.broadcast((bitmap(counts), bitmap(named)))
            counted = count(texts, (level,), buckets, min_count, shared, depth)
            shared.destroy()
            release(spark)
        own = counted.where(F.col("level") == level)
        rows = met(named, own.where("kind = 1")).mapInArrow(lean(_ups(level, buckets)), _PACKED_DDL)
        kept = staged(met(counts, rows).mapInArrow(lean(_retained(level, buckets)), _PACKED_DDL), "level")
        finished = [counted, counts, kept, named]
        counts = staged(own.where("kind = 0"), "counts") if level <= depth else None
        # the next level alone needs the probabilities, which are as large as the weights
        named = staged(kept.where("kind = 0").withColumn("value", F.lit(None).cast("binary")), "named") if level <= depth else None
        parts.append(staged(kept.select(F.lit(False).alias("known"), "keys", "n", "value"), "weights"))
        del own, rows, kept
        release(spark, *finished)
    return base, reduce(DataFrame.union, parts)


def table_rows(weights: DataFrame) -> DataFrame:
    """A trained table with a row for each entry: (key, n, known, value)."""

    def run(batches):
        for b in batches:
            for known, keys, n, value in zip(*(b.column(c).to_pylist() for c in _WEIGHTS)):
                keys = _from_steps(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, _from_planes(n, "<i8"), np.full(len(keys), known), np.frombuffer(value, "<f8"))], names=["key", "n", "known", "value"])

    return weights.mapInArrow(run, "key long, n long, known boolean, value double")


# ---- scoring


class Rows:
    """Rows of the table by sorted key; rows of one key are summed up."""

    def __init__(self, keys: np.ndarray, known: np.ndarray, value: np.ndarray):
        order = _order(keys)
        keys, known, value = keys.take(order), known.take(order), value.take(order)
        first = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        self.keys, which = keys[first], np.cumsum(first) - 1
        self.value, self.known = np.bincount(which, value, len(self.keys)), np.zeros(len(self.keys), bool)
        self.known[which[known]] = True
        self._index()

    def _index(self) -> None:
        bits = len(self.keys).bit_length() + 1  # few keys share these
        self.shift = _U(64 - bits)
        self.begin = np.append(0, np.cumsum(np.bincount((self.keys >> self.shift).view(np.int64), minlength=1 << bits))).astype(np.int32)

    def __getstate__(self) -> tuple:
        """What is broadcast: places by high bits are found anew from the keys."""
        return self.keys, self.value, self.known

    def __setstate__(self, state: tuple) -> None:
        self.keys, self.value, self.known = state
        self._index()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where they aren't: those that share their high bits, one after another."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        top = (keys >> self.shift).view(np.int64)
        at = self.begin.take(top)
        hit = self.keys.take(at, mode="clip") == keys
        out = np.where(hit, at, -1)
        todo = np.flatnonzero(~hit)
        at, end = at.take(todo) + 1, self.begin.take(top.take(todo) + 1)
        some = np.flatnonzero(at < end)
        todo, at, end = todo.take(some), at.take(some), end.take(some)
        asked = keys.take(todo)
        while len(todo):
            hit = self.keys.take(at) == asked
            out[todo[hit]] = at[hit]
            on = np.flatnonzero(~hit & (at + 1 < end))
            todo, at, end, asked = todo.take(on), at.take(on) + 1, end.take(on), asked.take(on)
        return out

    def sums(self, keys: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the known words, their values' sum and the sum of the n-grams' values among its keys; and which keys aren't here."""
        k = self.find(keys)
        hit = k >= 0
        here = np.flatnonzero(hit)
        k = k.take(here)
        which = 2 * text.take(here) + self.known.take(k)
        both = np.bincount(which, self.value.take(k), 2 * texts)
        return np.bincount(which, minlength=2 * texts)[1::2], both[1::2], both[::2], ~hit


def lookups(texts: pa.Array, table: Bitmap, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the texts that a table with this bitmap may have rows for, and the text of each; tokens of each text.

    From three words on, an n-gram has a row only if its last words have one.
    """
    keys, place, tokens = keys_of(texts)
    text = np.repeat(np.arange(len(tokens)), tokens + 1)
    words = np.flatnonzero(place > 0)
    asked, whose = [keys[words] ^ BASE], [text[words]]
    seen = table.has(asked[0])
    asked[0], whose[0] = asked[0][seen], whose[0][seen]
    shorter = None
    for n, own in enumerate(grams(keys, depth + 1), 1):
        # no text's last end is a context
        good = np.append(place[1:] > 0, False) if n == 1 else place[n - 1 :] >= n - 1
        if n > 2:
            good &= shorter[1 : len(own) + 1]
        at = np.flatnonzero(good)
        at = at[table.has(own[at])]
        shorter = np.zeros(len(own), bool)
        shorter[at] = True
        asked.append(own[at])
        whose.append(text[at])
    return np.concatenate(asked), np.concatenate(whose), tokens


def _sizes(n: np.ndarray) -> np.ndarray:
    """Classes of counts, eight for each power of two."""
    return np.floor(np.log2(n) * 8).astype(np.int64)


def _table_parts(batches: Iterable[pa.RecordBatch], wanted) -> Iterator[list[np.ndarray]]:
    """(keys, known, value) of the table's entries of the wanted sizes, many at once."""
    held = _Held()
    for b in batches:
        for known, keys, n, value in zip(*(b.column(c).to_pylist() for c in _WEIGHTS)):
            good = wanted(_sizes(_from_planes(n, "<i8")))
            held.add(_from_steps(keys)[good], np.full(int(good.sum()), known), np.frombuffer(value, "<f8")[good])
            yield from held.take(HELD)
    yield from held.take()


def hot_part(weights: DataFrame, most: int | None = None) -> tuple[Rows, int | None, Bitmap, int]:
    """The most frequent entries for a broadcast, their least size, a bitmap of all entries, and the number of the others."""
    most = HOT if most is None else most

    def sizes(batches):
        for b in batches:
            rows = np.bincount(np.concatenate([_sizes(_from_planes(n, "<i8")) for n in b.column("n").to_pylist()] or [np.zeros(0, np.int64)]))
            yield _batch(list(enumerate(rows.tolist())), {"size": pa.int32(), "rows": pa.int64()})

    least, held, rest = None, 0, 0
    for r in weights.mapInArrow(sizes, "size int, rows long").groupBy("size").agg(F.sum("rows").alias("rows")).where("rows > 0").orderBy(F.desc("size")).collect():
        if held + r["rows"] > most or rest:
            rest += r["rows"]
        else:
            held, least = held + r["rows"], r["size"]

    def hot(batches):
        for keys, known, value in _table_parts(batches, lambda size: size >= least):
            yield _batch([(keys.tobytes(), known.tobytes(), value.tobytes())], {"keys": pa.binary(), "known": pa.binary(), "value": pa.binary()})

    found = weights.mapInArrow(lean(hot), "keys binary, known binary, value binary").collect() if least is not None else []
    table = Rows(*(np.frombuffer(b"".join(bytes(r[c]) for r in found), t) for c, t in (("keys", "<u8"), ("known", "?"), ("value", "<f8"))))
    return table, least, bitmap(weights), rest


#: What a row of the exchange holds: a part of the table (kind 0), questions of a chunk (1), or documents as far as they are scored (2), which no bucket needs.
_ASKED = {"__gl_bucket": pa.int64(), "__gl_kind": pa.int32(), "__gl_chunk": pa.int64(), "__gl_keys": pa.binary(), "__gl_rows": pa.binary(), "__gl_knowns": pa.binary(), "__gl_values": pa.binary()}
_ASKED_DDL = "__gl_bucket long, __gl_kind int, __gl_chunk long, __gl_keys binary, __gl_rows binary, __gl_knowns binary, __gl_values binary"
#: What documents have by the words and n-grams that are looked up; and answers, for many rows of a chunk in one.
_SUMS = {"__gl_row": pa.int64(), "n_tokens": pa.int64(), "__gl_known": pa.int64(), "__gl_base": pa.float64(), "__gl_weight": pa.float64()}
_SUMS_DDL = "__gl_row long, n_tokens long, __gl_known long, __gl_base double, __gl_weight double"
_ANSWER = {"__gl_chunk": pa.int64(), "__gl_rows": pa.binary(), "__gl_knowns": pa.binary(), "__gl_bases": pa.binary(), "__gl_weights": pa.binary()}
_ANSWER_DDL = "__gl_chunk long, __gl_rows binary, __gl_knowns binary, __gl_bases binary, __gl_weights binary"


def _wide(b: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """b with the columns of schema, null where it has none."""
    return pa.RecordBatch.from_arrays([b.column(f.name) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in schema], schema=schema)


def _schema(fields: pa.Schema, *kinds: dict) -> pa.Schema:
    return pa.schema([*fields, *(pa.field(c, k) for kind in kinds for c, k in kind.items())])


def _packed_rows(least: int | None, buckets: int):
    """The table's entries that aren't broadcast, many in one row of a bucket."""

    def run(batches):
        for keys, known, value in _table_parts(batches, lambda size: size < least if least is not None else size >= 0):
            order = _order(keys)
            keys, known, value = keys[order], known[order], value[order]
            rows, size = [], 0
            for which, a, z in _runs(_bucket(keys, buckets)):
                rows.append((which, 0, None, _steps(keys[a:z]), None, known[a:z].tobytes(), value[a:z].tobytes()))
                size += 17 * (z - a)
                if size > PIECE_BYTES:
                    yield _batch(rows, _ASKED)
                    rows, size = [], 0
            yield _batch(rows, _ASKED)

    return run


def _ask(shared, buckets: int, depth: int):
    """Documents with their sums over the broadcast rows, and questions for the other rows. The last column is the text."""

    def run(batches):
        # a chunk is a run of at most TEXT_BATCH_ROWS (below 2 ** 16) rows; a row is known by its chunk and place there
        (hot, table), chunk = shared.value, TaskContext.get().partitionId() << 24
        for b in by_bytes(batches, -1, PIECE_BYTES):
            fields = pa.schema(list(b.schema)[:-1])
            schema, n = _schema(fields, _SUMS, _ASKED), b.num_rows
            asked, text, tokens = lookups(b.column(-1), table, depth)
            known, base, weight, missing = hot.sums(asked, text, n)
            own = [pa.array(x, k) for x, k in zip(((chunk << 16) + np.arange(n), tokens, known, base, weight), _SUMS.values())]
            own += [pa.array(np.full(n, x), k) for x, k in zip((-1 - chunk, 2, chunk), list(_ASKED.values())[:3])]
            yield _wide(pa.RecordBatch.from_arrays([*b.columns[:-1], *own], names=[*fields.names, *_SUMS, *list(_ASKED)[:3]]), schema)
            asked, text = asked[missing], text[missing]
            order = _order(asked)
            asked, text = asked[order], text[order].astype("<u2")
            yield _wide(_batch([(which, 1, chunk, _steps(asked[a:z]), _planes(text[a:z]), None, None) for which, a, z in _runs(_bucket(asked, buckets))], _ASKED), schema)
            chunk += 1

    return run


def _answer(batches):
    """In each bucket, the table's rows come first; then each row of questions is answered by sums for its texts. Documents go on as they are."""
    at, held, table = None, [], None
    for b in batches:
        fields = pa.schema([f for f in b.schema if f.name not in _SUMS and f.name not in _ASKED])
        schema, out = _schema(fields, _SUMS, _ANSWER), []
        kinds = b.column("__gl_kind").to_numpy()
        own = b.filter(pa.array(kinds == 2))
        if own.num_rows:
            yield _wide(own.select([*fields.names, *_SUMS, "__gl_chunk"]), schema)
        rest = b.filter(pa.array(kinds < 2))
        for bucket, kind, chunk, keys, rows, known, value in zip(*(rest.column(c).to_pylist() for c in _ASKED)):
            if bucket != at:
                at, held, table = bucket, [], None
            if kind == 0:
                held.append((_from_steps(keys).tobytes(), known, value))
                continue
            if table is None:
                table = Rows(*(np.frombuffer(b"".join(x[k] for x in held), t) for k, t in enumerate(("<u8", "?", "<f8"))))
                held = []
            which = _from_planes(rows, "<u2").astype(np.int64)
            texts = int(which.max()) + 1
            known, base, weight, missing = table.sums(_from_steps(keys), which, texts)
            some = np.bincount(which[~missing], minlength=texts) > 0
            if some.any():
                out.append((chunk, np.flatnonzero(some).astype("<u2").tobytes(), known[some].astype("<u4").tobytes(), base[some].tobytes(), weight[some].tobytes()))
        yield _wide(_batch(out, _ANSWER), schema)


def _gather(batches):
    """The documents of each chunk with all their sums."""
    for parts in _by_run(batches, "__gl_chunk"):
        whole = pa.concat_batches(parts)
        answers = whole.column("__gl_rows").is_valid()
        docs, answered = whole.filter(pa.compute.invert(answers)), [whole.filter(answers)]
        place = docs.column("__gl_row").to_numpy() & 0xFFFF
        rows = _array(answered, "__gl_rows", "<u2")
        columns = dict(zip(docs.schema.names, docs.columns))
        for c, x, t in (("__gl_known", "__gl_knowns", "<u4"), ("__gl_base", "__gl_bases", "<f8"), ("__gl_weight", "__gl_weights", "<f8")):
            more = np.bincount(rows, _array(answered, x, t), 1 << 16)[place]
            columns[c] = pa.array((columns[c].to_numpy() + more).astype(columns[c].type.to_pandas_dtype()))
        names = [c for c in columns if c not in _ANSWER]
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def score(docs: DataFrame, base: Base, weights: DataFrame, *, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """docs without their texts, with n_tokens, n_known, train_tokens, base_score and score; existing columns of these names are replaced.

    Rows are known by their places while they are looked up: docs is a table, or a DataFrame whose partitions keep their rows' order when computed anew.
    """
    spark = docs.sparkSession
    small_batches(spark)
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c not in (*new, text_col)]
    rows = docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`").alias("__gl_text"))
    hot, least, table, n_cold = hot_part(weights)
    release(spark)
    buckets = max(4, n_cold // BUCKET_ROWS)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.drop("__gl_text").schema.fields)
    asked = rows.mapInArrow(lean(_ask(spark.sparkContext.broadcast((hot, table)), buckets, depth)), f"{fields}{_SUMS_DDL}, {_ASKED_DDL}")
    parts = weights.mapInArrow(lean(_packed_rows(least, buckets)), _ASKED_DDL)
    met = asked.unionByName(parts, allowMissingColumns=True).repartition("__gl_bucket").sortWithinPartitions("__gl_bucket", "__gl_kind")
    answers = met.mapInArrow(lean(_answer), f"{fields}{_SUMS_DDL}, {_ANSWER_DDL}").repartition("__gl_chunk").sortWithinPartitions("__gl_chunk")
    out = answers.mapInArrow(lean(_gather), f"{fields}{_SUMS_DDL}")
    base_score = F.col("n_tokens") * F.lit(base.log_unseen) + F.col("__gl_base")
    return out.select(*(F.col(f"`{c}`") for c in others), "n_tokens", F.col("__gl_known").alias("n_known"), F.lit(base.total).cast("long").alias("train_tokens"), base_score.alias("base_score"), (base_score + F.col("__gl_weight")).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of documents that training never sees."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 1


def op6_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, token counts, base score and the tree's score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    base, weights = train(docs.where(~held_out()).select("text"))
    return score(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), base, weights)
