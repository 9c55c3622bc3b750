"""Substring dedup by fixed-block anchors: remove words covered by a window of WINDOW words that also starts elsewhere.

1. Documents are written once as blocks of some megabytes (their text, unchanged), so that later steps can come back to them. Words are found, hashed and dropped in a block's bytes, all at once.
2. Every document's non-overlapping reference blocks of ANCHOR words are the index, every rolling window of ANCHOR words is a
   probe. A window of WINDOW = 2 * ANCHOR - 1 words always holds a whole reference block of its own document, so of two equal windows
   each is hit by the other. Index and probes meet by hash, counted within each block first: a passage that
   is in every document costs one entry a block, not one a document.
3. Hits are extended: only windows around a hit are candidates; their full 127-bit hashes are counted over all documents (again within
   each block first), and runs of windows found twice are the maximal exact repeats (the two halves of a hash come from independent hashes of each word). No pairs of documents are made, so a passage
   shared by n documents costs n, not n squared.
4. Each block gets its repeated windows back and drops the words they cover.

What is shuffled is packed arrays, a row per block and task; the number of tasks follows from the number of words. What a task answers is
one bit for each entry that a block sent, in the order sent: the block, whose text is unchanged, makes the same entries again. Beyond a few thousand tasks entries first go to groups of tasks,
where those of many blocks are merged into super-blocks that ask in their place: so rows stay large, their number in proportion to the input, and a passage that
is in every block is one entry a super-block.

Defined cases: null and empty texts have no words; a text shorter than WINDOW loses nothing; all texts are judged on the input, so all occurrences
of a repeat go, the first included, and there are no ties to break; repeated rows are documents of their own and so remove each other's windows; a very long text is a block of its own;
extra columns, also of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.common import COARSE, arrow_batches, groups_of, materialize, partitions, release, table

WINDOW = 35
BLOCK_BYTES = 1 << 22
TASK_ENTRIES = 1 << 21
ROWS_BYTES = 1 << 25
#: Blocks that are written or read at once.
TOGETHER = 2
#: Words over so many bytes are hashed one by one.
LONG_WORD = 64
_LOW = np.uint64((1 << 46) - 1)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


def _mixed(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """x with its bits mixed, one to one, in place."""
    x ^= x >> np.uint64(32)
    x *= keys[0]
    x ^= x >> np.uint64(29)
    x *= keys[1]
    x ^= x >> np.uint64(32)
    return x


def rolling(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every window of `width` word hashes: windows of 1, 2, 4, ... words from two halves each, then those that make up the width."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    keys = _constants(4 * width.bit_length() + 2, seed)

    def both(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        out = x[: len(y)] * keys[k]
        out += y * keys[k + 1]
        out ^= out >> np.uint64(29)
        return out

    out, done, power = None, 0, hashes
    for bit in range(width.bit_length()):
        size = 1 << bit
        if width & size:
            out = power if out is None else both(out, power[done:], 4 * bit)
            done += size
        if done < width:
            power = both(power, power[size:], 4 * bit + 2)
    return _mixed(out[: len(hashes) - width + 1].copy(), keys[-2:])


class Block:
    """The words of a block's documents: where they are in its bytes, and two independent hashes of each."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        self.data = np.frombuffer(joined + b"\n" * (16 + -len(joined) % 8), np.uint8)  # whole eights, and a separator after each word
        word = np.zeros(len(self.data) + 1, bool)
        np.logical_and(self.data != 32, self.data - np.uint8(9) > 4, out=word[1:])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        self.ends = np.searchsorted(self.begin, np.cumsum([len(t) + 1 for t in texts]))
        self.lengths = np.diff(self.ends, prepend=0)
        self.length = np.repeat(self.lengths, self.lengths)  # of the document that a word is in
        self.at = np.arange(len(self.begin)) - np.repeat(self.ends - self.lengths, self.lengths)
        self.left = self.length - self.at  # words from here to the document's end

    def _eights(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Up to eight bytes from there on as numbers."""
        words, place, shift = self.data.view("<u8"), at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        out = words[place] >> shift
        out |= words[place + 1] << np.uint64(1) << (np.uint64(63) - shift)
        out &= _MASKS[np.minimum(sizes, 8)]
        return out

    def _hashed(self, seed: int) -> np.ndarray:
        """Words of up to eight bytes and equal length never share a hash."""
        keys, sizes = _constants(3, seed), self.end - self.begin
        out = _mixed(self._eights(self.begin, sizes) ^ sizes.astype(np.uint64) * keys[2], keys)
        rest, done = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD)), 8
        while len(rest):
            out[rest] = _mixed(out[rest] ^ self._eights(self.begin[rest] + done, sizes[rest] - done), keys)
            done += 8
            rest = rest[sizes[rest] > done]
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.begin[k] : self.end[k]], int(keys[2]))
        return out

    @cached_property
    def hashes(self) -> np.ndarray:
        return self._hashed(4)

    @cached_property
    def second(self) -> np.ndarray:
        return self._hashed(5)

    def windows(self, width: int) -> np.ndarray:
        """Whether a window that starts here ends within the document."""
        return self.left[: max(0, len(self.left) - width + 1)] >= width

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """How many words of each document stay, and those, joined by one space."""
        pieces = np.empty((len(keep), 2), np.int64)  # what lies before a word, then the word with the separator after it
        pieces[:, 1] = self.end + 1 - self.begin
        pieces[:, 0] = np.diff(self.end + 1, prepend=0) - pieces[:, 1]
        stays = np.zeros((len(keep), 2), bool)
        stays[:, 1] = keep
        mask = np.repeat(stays.ravel(), pieces.ravel())
        out = self.data[: len(mask)][mask]
        spaces = np.cumsum(pieces[:, 1][keep]) - 1
        out[spaces] = 32
        before = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], self.ends))]
        counts = np.diff(before)
        sizes = np.diff(np.concatenate(([0], spaces + 1))[before]) - (counts > 0)
        out = np.delete(out, spaces[before[1:][counts > 0] - 1])
        return counts, _strings(out, sizes, pa.string())


def _strings(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Strings or binary values that lie one after the other."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values, one after the other, and their sizes."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32, len(values) + 1, 4 * values.offset)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, seq = [], [], 0, 0
        place = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(place << 32) + seq], pa.int64()), pa.array([len(Block(texts).begin)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))],
                ["block", "words", "ids", "texts"],
            )

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                texts.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
                size += len(texts[-1])
                if size >= limit:
                    yield out()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield out()

    return run


class Deal:
    """Which task each entry of a block goes to, by ranges of hashes, and in what order: that of the entries, if they are sorted."""

    def __init__(self, hashes: np.ndarray, parts: int, together: int = 1):
        part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        if together > 1:
            part //= np.uint64(together)
        self.order = np.arange(len(part)) if (part[1:] >= part[:-1]).all() else np.argsort(part, kind="stable")
        part = part[self.order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)])
        self.parts, self.sizes = part[first].astype(np.int32), np.diff(first, append=len(part))
        self.places = dict(zip(self.parts.tolist(), zip(first.tolist(), (first + self.sizes).tolist(), strict=True), strict=True))

    def rows(self, block: int, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each task that gets something: the task, the block, and its packed entries. packed: a row of bytes for each entry."""
        width = packed.shape[1]
        turn = np.cumsum(self.sizes) * width // ROWS_BYTES  # so that no batch is much over that size
        for k in np.unique(turn).tolist():
            a, b = np.searchsorted(turn, [k, k + 1]).tolist()
            mine = packed[self.order[self.places[int(self.parts[a])][0] : self.places[int(self.parts[b - 1])][1]]]
            yield pa.RecordBatch.from_arrays([pa.array(self.parts[a:b]), pa.array(np.full(b - a, block, np.int64)), _strings(mine.ravel(), self.sizes[a:b] * width, pa.binary())], ["part", "block", "packed"])

    def flags(self, replies: pa.StructArray) -> np.ndarray:
        """What the tasks answered, by entry."""
        parts, packed = replies.flatten()
        data, sizes = _bytes(packed)
        bits, ends = np.unpackbits(data).view(bool), (8 * np.cumsum(sizes)).tolist()
        inner, at = np.zeros(len(self.order), bool), 0
        for part, end in zip(parts.to_pylist(), ends, strict=True):
            a, b = self.places[part]
            inner[a:b] = bits[at : at + b - a]
            at = end
        out = np.empty_like(inner)
        out[self.order] = inner
        return out


class ProbeWire:
    """Entries of the index: a hash with two flags, whether a reference block is among them and whether they are several. Six bytes hold what a task needs; where groups of
    tasks come between, eight keep the bits that name the task, too."""

    def __init__(self, wide: bool):
        self.width = 8 if wide else 6

    def entries(self, hashes: np.ndarray, anchored: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
        base = hashes & ~np.uint64(3) if self.width == 8 else (hashes & _LOW) << np.uint64(2)
        return [base | anchored.astype(np.uint64) << np.uint64(1) | many.astype(np.uint64)]

    def write(self, cols: list[np.ndarray]) -> np.ndarray:
        return np.ascontiguousarray(cols[0].view(np.uint8).reshape(-1, 8)[:, : self.width])

    def read(self, data: np.ndarray) -> list[np.ndarray]:
        wide = np.zeros((len(data) // self.width, 8), np.uint8)
        wide[:, : self.width] = data.reshape(-1, self.width)
        return [wide.view(np.uint64).ravel()]

    keys = staticmethod(lambda cols: (cols[0] >> np.uint64(2),))
    flags = staticmethod(lambda cols: cols[0] & np.uint64(3))
    flagged = staticmethod(lambda cols, f: [cols[0] & ~np.uint64(3) | f])
    #: Those that hold a reference block and are found twice.
    yes = staticmethod(lambda f: f == 3)


class WindowWire:
    """Entries of the full windows: two hashes, the lowest bit of the second tells whether they are several."""

    width = 16

    def write(self, cols: list[np.ndarray]) -> np.ndarray:
        return np.column_stack(cols).view(np.uint8)

    def read(self, data: np.ndarray) -> list[np.ndarray]:
        both = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2)
        return [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]

    keys = staticmethod(lambda cols: (cols[1] & ~np.uint64(1), cols[0]))
    flags = staticmethod(lambda cols: cols[1] & np.uint64(1))
    flagged = staticmethod(lambda cols, f: [cols[0], cols[1] & ~np.uint64(1) | f])
    yes = staticmethod(lambda f: f == 1)


def _counted(order_by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, index of each group's first row in it, group size) of rows with equal keys; the last key sorts first. The order within a group is left open."""
    order = np.argsort(order_by[-1])
    new = np.ones(len(order), bool)
    s = order_by[-1][order]
    new[1:] = s[1:] != s[:-1]
    if len(order_by) > 1:
        more = new.copy()
        for k in order_by[:-1]:
            s = k[order]
            more[1:] |= s[1:] != s[:-1]
        if (more != new).any():  # rows that differ share the last key: rare, as it is a hash
            order = np.lexsort(order_by)
            new[1:] = False
            for k in order_by:
                s = k[order]
                new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(first, append=len(order))


def _merged(wire: ProbeWire | WindowWire, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size, flags) of groups of equal entries; the lowest flag is set where there are several."""
    order, first, size = _counted(wire.keys(cols))
    f = np.bitwise_or.reduceat(wire.flags(cols)[order], first) if len(first) else np.zeros(0, np.uint64)
    return order, first, size, f | (size > 1).astype(np.uint64)


@dataclass(frozen=True)
class Layout:
    """How many tasks there are, how many of them a group has (1: no groups), and the sizes of blocks and windows."""

    parts: int
    together: int
    anchor: int
    window: int

    @property
    def wire(self) -> ProbeWire:
        return ProbeWire(self.together > 1)


class Probes:
    """A block's entries for the index: a row for each distinct window of `anchor` words in documents that are long enough."""

    def __init__(self, b: Block, to: Layout):
        self.block, self.to = b, to
        self.valid = b.windows(to.anchor)
        self.valid &= b.length[: len(self.valid)] >= to.window
        every = rolling(b.hashes, to.anchor, 1)[self.valid]
        if to.together > 1:
            every &= ~np.uint64(3)  # equal as they are sent
        self.order, self.first, self.size = _counted((every,))
        self.hashes = every[self.order][self.first]
        self.deal = Deal(self.hashes, to.parts, to.together)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        if not len(self.hashes):
            return iter(())
        anchored = self.block.at[: len(self.valid)][self.valid] % self.to.anchor == 0
        anchored = np.logical_or.reduceat(anchored[self.order], self.first)
        return self.deal.rows(number, self.to.wire.write(self.to.wire.entries(self.hashes, anchored, self.size > 1)))

    def candidates(self, replies: pa.StructArray) -> np.ndarray:
        """Starts of the full windows that hold a hit."""
        hit = np.zeros(len(self.valid), bool)
        inner = np.zeros(len(self.order), bool)
        inner[self.order] = np.repeat(self.deal.flags(replies), self.size)
        hit[self.valid] = inner
        before = np.concatenate(([0], np.cumsum(hit)))
        valid = self.block.windows(self.to.window)
        reach = self.to.window - self.to.anchor + 1
        return np.flatnonzero(valid & (before[reach : reach + len(valid)] > before[: len(valid)]))


class Windows:
    """A block's candidate windows, a row for each distinct one."""

    def __init__(self, probes: Probes, replies: pa.StructArray):
        block, to = probes.block, probes.to
        self.starts = probes.candidates(replies)
        one, two = rolling(block.hashes, to.window, 2)[self.starts], rolling(block.second, to.window, 3)[self.starts] & ~np.uint64(1)
        self.order, self.first, self.size = _counted((two, one))
        self.one, self.two = one[self.order][self.first], two[self.order][self.first]
        self.deal = Deal(self.one, to.parts, to.together)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        return self.deal.rows(number, WindowWire().write([self.one, self.two | (self.size > 1).astype(np.uint64)])) if len(self.starts) else iter(())

    def repeated(self, replies: pa.StructArray) -> np.ndarray:
        """Starts of the windows that are found twice."""
        out = np.zeros(len(self.order), bool)
        out[self.order] = np.repeat(self.deal.flags(replies), self.size)
        return self.starts[out]


def _each(batches: Iterator[pa.RecordBatch], *replies: str) -> Iterator[dict]:
    """Rows; replies are left as arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(n)[k].values if n in replies else batch.column(n)[k].as_py() for n in batch.schema.names}


def _probe(to: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            yield from Probes(Block(r["texts"]), to).rows(r["block"])

    return run


def _extend(to: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches, "hits"):
            if r["hits"]:
                yield from Windows(Probes(Block(r["texts"]), to), r["hits"]).rows(r["block"])

    return run


def _answered(blocks: np.ndarray, parts: np.ndarray, yes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A bit for each entry of each row; rows without any are left out."""
    sizes, starts = (counts + 7) // 8, np.cumsum(counts) - counts
    bits = np.zeros(8 * sizes.sum(), bool)
    at = np.flatnonzero(yes)
    row = np.searchsorted(starts, at, "right") - 1
    bits[at + (8 * (np.cumsum(sizes) - sizes) - starts)[row]] = True
    found = np.zeros(len(counts), bool)
    found[row] = True
    rows = pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), _strings(np.packbits(bits), sizes, pa.binary())], ["block", "part", "packed"])
    return rows.filter(pa.array(found))


def _judge(wire: ProbeWire | WindowWire):
    """Of the entries of a task, those that the wire says yes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, blocks, data, sizes = [], [], [], []
        for batch in batches:
            parts.append(batch.column("part").to_numpy())
            blocks.append(batch.column("block").to_numpy())
            for to, x in zip((data, sizes), _bytes(batch.column("packed")), strict=True):
                to.append(x)
        if not blocks:
            return
        cols = wire.read(np.concatenate(data))
        data.clear()
        order, _, size, f = _merged(wire, cols)
        yes = np.zeros(len(order), bool)
        yes[order] = np.repeat(wire.yes(f), size)
        yield _answered(np.concatenate(blocks), np.concatenate(parts), yes, np.concatenate(sizes) // wire.width)

    return run


def _gather(wire: ProbeWire | WindowWire, limit: int):
    """Rows of a group of tasks as super-blocks of up to about `limit` entries: block, part (the group), blocks, packed (a list)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(place << 32) + seq], pa.int64()), pa.array([held[0][0]], pa.int32()), pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([[h[2] for h in held]], pa.list_(pa.binary()))],
                ["block", "part", "blocks", "packed"],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                part, block, packed = (batch.column(n)[k].as_py() for n in ("part", "block", "packed"))
                if held and (size >= limit or held[0][0] != part):
                    yield out()
                    seq, held, size = seq + 1, [], 0
                held.append((part, block, packed))
                size += len(packed) // wire.width
        if held:
            yield out()

    return run


class Super:
    """The entries of a super-block, each distinct one once."""

    def __init__(self, packed: list[bytes], wire: ProbeWire | WindowWire, parts: int):
        cols, self.counts = wire.read(np.frombuffer(b"".join(packed), np.uint8)), np.array([len(x) // wire.width for x in packed])
        self.order, first, self.size, f = _merged(wire, cols)
        self.cols = wire.write(wire.flagged([c[self.order][first] for c in cols], f))
        self.deal = Deal(cols[0][self.order][first], parts)


def _ask(wire: ProbeWire | WindowWire, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            own = Super(r["packed"], wire, parts)
            yield from own.deal.rows(r["block"], own.cols)

    return run


def _pass_on(wire: ProbeWire | WindowWire, parts: int):
    """The answers that a super-block got, as answers to its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches, "replies"):
            if r["replies"]:
                own = Super(r["packed"], wire, parts)
                yes = np.zeros(len(own.order), bool)
                yes[own.order] = np.repeat(own.deal.flags(r["replies"]), own.size)
                yield _answered(np.array(r["blocks"]), np.full(len(r["blocks"]), r["part"]), yes, own.counts)

    return run


def _remove(to: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches, "hits", "repeats"):
            b = Block(r["texts"])
            keep = np.ones(len(b.begin), bool)
            if r["repeats"]:
                found = Windows(Probes(b, to), r["hits"]).repeated(r["repeats"])
                edges = np.bincount(found, minlength=len(keep) + 1) - np.bincount(found + to.window, minlength=len(keep) + 1)
                keep = np.cumsum(edges)[:-1] == 0
            counts, kept = b.kept(keep)
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(b.lengths, pa.int64()), pa.array(b.lengths - counts, pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _replied(blocks: DataFrame, **replies: DataFrame) -> DataFrame:
    """Each block with what was answered to it, under the name given."""
    for name, rows in replies.items():
        mine = rows.groupBy("block").agg(F.collect_list(F.struct("part", "packed")).alias(name))
        blocks = blocks.join(mine.hint("shuffle_hash"), "block", "left")
    return blocks


_ROWS = "part int, block long, packed binary"
_REPLIES = "block long, part int, packed binary"


def _exchange(entries: DataFrame, wire: ProbeWire | WindowWire, to: Layout, tag: str) -> DataFrame:
    """block, part, packed: what the tasks answered to the entries (part, block, packed) of every block."""
    meet = _judge(wire)
    if to.together == 1:
        out = materialize(entries.repartitionById(to.parts, "part").mapInArrow(meet, _REPLIES), tag)
    else:
        groups = -(-to.parts // to.together)
        supers = materialize(entries.repartitionById(groups, "part").mapInArrow(_gather(wire, TASK_ENTRIES), "block long, part int, blocks array<long>, packed array<binary>"), f"{tag}-super", TOGETHER)
        replies = materialize(supers.mapInArrow(_ask(wire, to.parts), _ROWS).repartitionById(to.parts, "part").mapInArrow(meet, _REPLIES), f"{tag}-fine")
        out = materialize(_replied(supers, replies=replies).mapInArrow(_pass_on(wire, to.parts), _REPLIES), tag)
    release(entries.sparkSession)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, parts: int | None = None, coarse: int = COARSE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row. window: odd. parts and coarse are found from the input and set by tests."""
    spark, anchor = docs.sparkSession, (window + 1) // 2
    arrow_batches(spark, megabytes=8)
    blocks = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(BLOCK_BYTES), "block long, words long, ids array<long>, texts array<binary>"), "substring-blocks", TOGETHER
    )
    total = blocks.agg(F.sum("words")).first()[0] or 0
    parts = parts or max(partitions(spark), -(-total // TASK_ENTRIES))
    to = Layout(parts, groups_of(parts, coarse), anchor, window)
    texts = blocks.select("block", "texts")
    hits = _exchange(texts.mapInArrow(_probe(to), _ROWS), to.wire, to, "substring-hits")
    repeats = _exchange(_replied(texts, hits=hits).mapInArrow(_extend(to), _ROWS), WindowWire(), to, "substring-repeats")
    return _replied(blocks.drop("words"), hits=hits, repeats=repeats).mapInArrow(_remove(to), "doc_id long, n_words long, n_removed long, kept_text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES = {
    "op9_substring_dedup": f"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') g from (select rid, w, unnest(range(1, len(w) - {WINDOW - 2})) i from d where len(w) >= {WINDOW})),
t as (select rid, i from (select rid, i, count(*) over (partition by md5(g)) k from s) where k > 1),
c as (select distinct rid, i + k as i from t, range({WINDOW}) r(k)),
u as (select rid, unnest(w) word, unnest(range(1, len(w) + 1)) i from d),
k as (select u.rid, count(*) filter (c.rid is null) n_kept, string_agg(word, ' ' order by u.i) filter (c.rid is null) kept from u left join c on c.rid = u.rid and c.i = u.i group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n_kept, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (rid)
"""
}
