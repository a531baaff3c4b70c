"""Bounded-space online packing of tokenised documents into sequences of at most CAPACITY tokens.

Each partition streams its documents through a fixed number of open windows. What exceeds a window is cut off into full
windows; the rest goes to the open window that it fills best. If it fits none, the fullest window is filled up with the head of
the piece and emitted. What stays open at a partition's end is leftover: leftovers of a group of neighbouring partitions are packed
again in the same way, and the last of a group are cut into lengths that are powers of two, which need no padding.
So every sequence has CAPACITY tokens or a power of two, and nothing is padded.

Leftover windows are bounded (OPEN windows per partition, GROUP partitions per group), as is all that a task holds.

Defined results: a null or empty text is the end token alone; repeated rows are packed each on its own; a null id stays null;
no documents: no pieces. Texts are never cut before tokenising.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, read_table, small_batches, staged, text_bytes

CAPACITY, OPEN, GROUP = 1024, 8, 64
END = 0
#: Words that a worker remembers the ids of; a full memory is emptied.
REMEMBERED = 1_000_000
#: Bytes of text that are tokenised together; a longer text stands alone.
PIECE_BYTES = 4 << 20

#: The published pattern by which byte-level tokenizers of this kind part a text. Fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def part_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin that the tokenizer never joins; the texts lie one after another in data, between bounds.

    A run of white space is one part but for its last character before other text: a blank there goes with the word after it, and
    any other white space is a part of its own. White space beyond ASCII isn't looked at.
    """
    filled = bounds[1:] > bounds[:-1]
    space = _SPACE[data]
    after = np.zeros(len(data), bool)  # after white space, or after white space other than a blank
    after[1:] = space[:-1]
    joined = np.zeros(len(data), bool)
    joined[1:] = data[:-1] == 32
    last = np.zeros(len(data), bool)
    last[:-1] = ~space[1:]
    last[bounds[1:][filled] - 1] = False
    starts = (space & (~after | last)) | (~space & after & ~joined)
    starts[bounds[:-1][filled]] = True
    return np.flatnonzero(starts)


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = data[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    single = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return at[two | general | single]


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if they alone tell the order of merges and the tokenizer does nothing but part, map bytes and merge; else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow 0xFF in order
    byte = {chr(c): c for c in shown} | {chr(0x100 + k): c for k, c in enumerate(c for c in range(256) if c not in set(shown))}
    vocab = model["vocab"]
    merges = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    singles = [vocab.get(c) for c in byte]
    if None in singles or None in merges or any(x >= y for x, y in zip([max(singles), *merges], merges)):
        return None
    by_id = {k: t for t, k in vocab.items()}
    return {bytes(byte[c] for c in by_id[k]): k for k in (*singles, *merges)}


class WordTokenizer:
    """Ids of texts by a byte-level BPE tokenizer, remembered part by part.

    Such a tokenizer never joins characters over the borders of part_starts, so a text's ids are those of its parts. The parts of many
    texts are told apart at once, by a dictionary that Arrow makes of them; those not known yet are encoded together, a line
    each, and told apart by the line breaks' ids. Where the file's ids give the order of merges, these lines are encoded from the same
    vocabulary as ranks, which gives the same ids in less time; if not, by the tokenizer itself, as are texts with white space beyond ASCII.
    """

    def __init__(self, path: str, remember: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.line = self._ids("\n")
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space but a leading blank, one after another, and their numbers."""
        text = b"\n".join(words).decode("utf-8", "replace")
        ids = np.array(self.fast.encode_ordinary(text) if self.fast else self._ids(text), np.uint32)
        breaks = np.flatnonzero(ids == self.line[0])
        if len(self.line) != 1 or len(breaks) != len(words) - 1:  # not a tokenizer that keeps a line break apart
            return self._singly(words)
        return ids[ids != self.line[0]], np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1

    def _singly(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids(w.decode("utf-8", "replace")) for w in words]
        return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64)

    def _learn(self, words: list[bytes], blank: np.ndarray) -> np.ndarray:
        """Numbers of new words; blank: which of them are white space."""
        order = np.argsort(~blank, kind="stable")
        words, cut = [words[k] for k in order.tolist()], int(blank.sum())
        found = [self._singly(words[:cut])]
        for at in range(cut, len(words), 4096):
            found.append(self._encoded(words[at : at + 4096]))
        first = len(self.begin) - 1
        self.known.update(zip(words, range(first, first + len(words))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate([n for _, n in found]))])
        self.flat = np.concatenate([self.flat, *(x for x, _ in found)])
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(first, first + len(words))
        return numbers

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null is empty."""
        data, bounds = text_bytes(texts)
        if not len(data):
            return [b""] * len(texts)
        starts = part_starts(data, bounds)
        offsets = np.append(starts, len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        firsts = np.empty(len(distinct), np.int64)
        place = words.indices.to_numpy()
        firsts[place[::-1]] = np.arange(len(place) - 1, -1, -1)  # of each word, its first place in the texts
        if len(self.known) + len(distinct) > self.remember:
            self._forget()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn(distinct[new].tolist(), _SPACE[data[offsets[firsts[new] + 1] - 1]])
        which = number[place]
        sizes = self.begin[which + 1] - self.begin[which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[which] - (ends - sizes), sizes) + np.arange(ends[-1])].astype("<u4", copy=False)
        cuts = np.append(0, ends)[np.searchsorted(starts, bounds)].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(np.searchsorted(bounds, wide_spaces(data), "right") - 1).tolist():
            out[k] = np.array(self._ids(texts[k].as_py()), "<u4").tobytes()
        return out


@cache
def _tokenizer(path: str, remember: int) -> WordTokenizer:
    """One for all tasks of a worker, with the words that it knows."""
    return WordTokenizer(path, remember)


class Packer:
    """Open windows of pieces (doc_id, start, ids, doc_tokens); full ones come out as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, windows: int = OPEN):
        self.capacity, self.windows = capacity, windows
        self.open: list[list] = []  # [tokens, pieces]

    def add(self, doc_id, start: int, ids: bytes, total: int) -> Iterator[list[tuple]]:
        cap = self.capacity
        while len(ids) >= 4 * cap:
            yield [(doc_id, start, ids[: 4 * cap], total)]
            start, ids = start + cap, ids[4 * cap :]
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] + n <= cap]
            if fits:
                w = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(w := [0, []])
            else:
                w = max(self.open, key=lambda w: w[0])
                n = cap - w[0]
            w[1].append((doc_id, start, ids[: 4 * n], total))
            w[0] += n
            if w[0] == cap:
                self.open.remove(w)
                yield w[1]
            start, ids = start + n, ids[4 * n :]

    def rest(self) -> Iterator[list[tuple]]:
        """What is open, packed together and cut into full windows and powers of two."""
        pieces = [p for _, ps in sorted(self.open, key=lambda w: -w[0]) for p in ps]
        self.open = []
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            out = []
            while size:
                doc_id, start, ids, total = pieces.pop(0)
                n = min(size, len(ids) // 4)
                out.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc_id, start + n, ids[4 * n :], total))
                size -= n
            yield out


_KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary(), "part": pa.int64()}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(_KINDS), _KINDS.values())], names=list(_KINDS))


def _sequence(pieces: list[tuple], sequence: int, part: int | None = None, keep: bool = False) -> Iterator[tuple]:
    """Rows of one sequence's pieces. keep: with their ids."""
    offset = 0
    for doc_id, start, ids, total in pieces:
        yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids if keep else None, part
        offset += len(ids) // 4


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = OPEN, group: int = GROUP, tokenizer: str | None = None, keep_ids: bool = False, remember: int = REMEMBERED) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids also ids (little-endian 32-bit).

    remember: words whose ids a worker keeps, at about 200 bytes each; fewer take more time. capacity is a power of two. tokenizer: path of a byte-level BPE file that every executor can open; by default that of public_tokenizers.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)

    def first(batches):
        part = TaskContext.get().partitionId()
        words, packer, n = _tokenizer(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), remember), Packer(capacity, windows), 0
        end = np.array([END], "<u4").tobytes()
        for b in by_bytes(batches, 1, PIECE_BYTES):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), words.batch(b.column(1))):
                ids += end
                for done in packer.add(doc_id, 0, ids, len(ids) // 4):
                    rows += _sequence(done, (part << 33) + 2 * n, keep=keep_ids)
                    n += 1
            yield _row_batch(rows)
        yield _row_batch([row for k, (_, pieces) in enumerate(packer.open) for row in _sequence(pieces, k, part, True)])

    def second(batches):
        at, packer, n, rows = None, None, 0, []
        for b in batches:
            for g, doc_id, start, ids, total in zip(*(b.column(x).to_pylist() for x in ("group", "doc_id", "start", "ids", "doc_tokens"))):
                if g != at:
                    rows += tail(packer, at, n)
                    at, packer, n = g, Packer(capacity, windows), 0
                for done in packer.add(doc_id, start, ids, total):
                    rows += _sequence(done, (at * group << 33) + 2 * n + 1, keep=keep_ids)
                    n += 1
            yield _row_batch(rows)
            rows = []
        yield _row_batch(tail(packer, at, n))

    def tail(packer, at, n):
        return [row for k, done in enumerate(packer.rest()) for row in _sequence(done, (at * group << 33) + 2 * (n + k) + 1, keep=keep_ids)] if packer else []

    schema = SCHEMA + ", ids binary, part long"
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(chosen.mapInArrow(first, schema), "pieces")
    left = pieces.where("part is not null").withColumn("group", F.floor(F.col("part") / group).cast("long"))
    merged = left.repartition("group").sortWithinPartitions("group", "part", "sequence_id", "offset").mapInArrow(second, schema)
    out = pieces.where("part is null").unionByName(merged).drop("part")
    return out if keep_ids else out.drop("ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with the digest of its ids and its place."""
    return pack(read_table(spark, sf_dir, "documents"))
