"""Adaptive context-mixing range coder for token ids: what was learnt in a block and the chances of its frame, in three orders.

A frame has a code book, made from all its ids: the distinct ones with their chances (order 0), and for each id the chances of
those that often follow it (order 1). Both orders are mixed by what is known: the counts behind an id weigh as many as
they are, against ``PRIOR`` counts dealt out by the chances of order 0. What saves less than its place in the
book is not listed; all that is not listed behind an id has one chance there, the rest, and then its chance in order 0. Order 0 knows every id,
in two steps (the higher bits of its number, then the lower). The book has chances as small floating-point
numbers; both sides make the same 16-bit shares of them, with integers only, so every machine decodes alike.

A block learns while it is coded. It keeps what last followed two ids, and how often in a row (order 2); before an id is coded by the
book, the one that its last two ids call for is offered. Whether it is that one is predicted in three orders, each by a
cell that learns: by how often it followed the last two ids in a row, by the share that the book gives it behind the last id, and by
its share of all ids. The three are mixed in the logistic domain. If it is another id, the
book codes it, without the share of the one that was offered. Only what the book lists behind an id is kept and offered.

So an id takes one or two steps of a range coder with 64-bit bounds and 32-bit words, or some more where nothing is listed for it. No
bit is stored as it is. An entry of a context knows the context that comes after it; a step of decoding is a look-up of the entry that a
share belongs to.

Ids are cut into blocks. Each block is coded on its own, beginning in order 0 with nothing learnt, and a CRC-32 of its ids and bytes stands in
the header. Blocks are coded in step, one id of each at a time, as numpy vectors over ``GROUP`` blocks; that
changes nothing in a block's bytes.

A frame: ``TIDS``, version, ids, blocks, block length, bytes of the code book, then for each block CRC-32 and bytes (little-endian), then
the code book, then the bytes of the blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

MAGIC, VERSION = b"TIDS", 5
HEAD = struct.Struct("<4sIQIII")
#: Ids of a block, at least and at most; a frame is cut into ``LANES`` blocks where these bounds allow.
SHORTEST, LONGEST, LANES = 1024, 4096, 4096
#: Counts of order 0 that are mixed into those of order 1.
PRIOR = 0.5
#: Bits that an entry takes in the book, about: what saves less is not listed.
PRICE = 14
#: Ids below this are counted and numbered by a table.
TABLE = 1 << 20
#: Blocks that are coded in step.
GROUP = 4096
#: Places for what follows two ids in a block, as a power of two.
SLOTS = 10
#: How fast a cell learns, as a shift, and how much each order's vote weighs.
RATE, WEIGHT = 5, 0.5
#: What a cell comes near at most and at least.
_YES, _NO = np.int32(65504), np.int32(32)
#: Bits of a share: those of a context add up to 1 << SHARE.
SHARE = 16
_SHARE, _HALF, _LOW = np.uint64(SHARE), np.uint64(32), np.uint64(0xFFFFFFFF)
_MOST = np.uint64((1 << SHARE) - 1)
_START, _ONE, _FIVE, _SHIFT = np.uint64(48), np.uint64(1), np.uint64(5), np.uint64(31)
_ALL, _PLACE = np.uint64(1 << SHARE), np.uint64(64 - SLOTS)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cell's vote, by its upper 12 bits; the 16-bit chances by the votes' sum; and how the cells of a block begin: 16 of each order, by count and by shares."""
    chance = (np.arange(1 << 12) + 0.5) / (1 << 12)
    votes = np.round(np.log(chance / (1 - chance)) * 256 * WEIGHT).astype(np.int32)
    most = int(votes[-1])
    x = np.arange(-3 * most, 3 * most + 1)
    chances = np.clip(np.round(65536 / (1 + np.exp(-x / 256.0))), 64, 65472).astype(np.uint64)
    count = np.arange(16)
    cells = np.concatenate([(count + 1) / (count + 3), 2.0 ** (count - 15.5), np.full(16, 0.5)])
    return votes + most, chances, np.clip(np.round(cells * 65535), _NO, _YES).astype(np.int32)


VOTES, CHANCES, CELLS = _tables()


def _level(x: np.ndarray) -> np.ndarray:
    """Numbers from 8 on as bytes: 5 bits of exponent, 3 of mantissa."""
    mantissa, exponent = np.frexp(np.maximum(x, 8.0))
    return ((exponent - 4) * 8 + np.minimum(np.round(mantissa * 16), 15).astype(np.int64) - 8).astype(np.uint8)


def _value(level: np.ndarray) -> np.ndarray:
    level = level.astype(np.int64)
    return (8 + (level & 7)) << (level >> 3)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and which of them each value is."""
    d = pa.array(x).dictionary_encode()
    return d.dictionary.to_numpy(), d.indices.to_numpy()


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct ids, ascending, and how often each stands there; and which of them each is, if ids are too large for a table."""
    if ids.max() < TABLE:
        counts = np.zeros(int(ids.max()) + 1, np.int64)
        for a in range(0, len(ids), TABLE):
            counts += np.bincount(ids[a : a + TABLE], minlength=len(counts))
        known = np.flatnonzero(counts)
        return known.astype(np.uint32), counts[known], None
    known, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return known, counts, which


def _spread(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A table from each known id to its value."""
    table = np.zeros(int(known[-1]) + 1, values.dtype)
    table[known] = values
    return table


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Byte by byte, so that equal high bytes stand together."""
    return np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


class Book:
    """The contexts of a frame and their entries, made alike by both sides from what the book says.

    Numbers of ids go from frequent to rare. Context 0 and those up to ``high`` are the two steps of order 0; context ``1 + high + x`` follows
    the id of number x, and is context 0 if nothing is listed there.
    """

    def __init__(self, ids: np.ndarray, levels: np.ndarray, listed: np.ndarray, after: np.ndarray, chances: np.ndarray, rests: np.ndarray):
        """Distinct ids, ascending, and their levels; by number: how many are listed behind it; the numbers listed and their levels; levels of the rests."""
        self.said = ids, levels, listed, after, chances, rests
        order = np.lexsort((ids, -levels.astype(np.int64)))
        self.ids, weight, v = ids[order], _value(levels[order]), len(ids)
        self.shift = max(8, (v - 1).bit_length() - 16)
        high = np.arange(v) >> self.shift
        self.high = h = int(high[-1]) + 1
        own = np.flatnonzero(listed)
        #: Listed contexts come behind order 0, each with its rest at its end.
        sizes = listed[own].astype(np.int64) + 1
        ends = h + v + np.cumsum(sizes)
        self.first = np.zeros(v, np.int64)  # a number's first entry
        self.first[own] = ends - sizes
        self.rest = np.zeros(v, np.int64)
        self.rest[own] = ends - 1
        n = h + v + int(sizes.sum())
        context = np.concatenate([np.zeros(h, np.int64), 1 + high, np.repeat(1 + h + own, sizes)])
        weights, follows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        weights[:h], follows[:h] = np.add.reduceat(weight, np.arange(h) << self.shift), 1 + np.arange(h)
        weights[h : h + v], follows[h : h + v] = weight, 1 + h + np.arange(v)
        is_rest = np.zeros(n, bool)
        is_rest[ends - 1] = True
        plain = ~is_rest
        plain[: h + v] = False
        weights[plain], follows[plain] = _value(chances), 1 + h + after.astype(np.int64)
        weights[is_rest] = _value(rests)
        starts = np.flatnonzero(np.diff(context, prepend=-1))
        count = np.diff(starts, append=n)
        group = np.repeat(np.arange(len(starts)), count)
        upto = np.cumsum(weights)
        before = (upto - weights) - (upto - weights)[starts][group]
        total = np.add.reduceat(weights, starts)
        place = np.arange(n) - starts[group]
        begin = place + before * ((1 << SHARE) - count[group]) // total[group]
        width = np.diff(begin, append=0)
        width[starts[1:] - 1] = (1 << SHARE) - begin[starts[1:] - 1]
        width[-1] = (1 << SHARE) - begin[-1]
        #: Of each entry, and of none behind the last: the beginning and the width of its share, and the context that follows.
        self.start, self.width, self.follows = np.append(begin, 0).astype(np.uint64), np.append(width, 0).astype(np.uint64), np.append(follows, 0)
        #: Of an entry that is listed behind an id: its context; and the cells for the size of its share there, and of its id's share in order 0.
        self.owner = np.append(np.where(plain, context, -1), -1)
        part = np.frexp(np.maximum(weight * (1 << SHARE) // weight.sum(), 1).astype(float))[1] - 1
        self.sizes = np.zeros((2, n + 1), np.int64)
        self.sizes[0, :n][plain] = 16 + (np.frexp(width[plain].astype(float))[1] - 1).clip(0, 15)
        self.sizes[1, :n][plain] = 32 + part.clip(0, 15)[after]
        self.bits = np.float32(SHARE) - np.log2(width.astype(np.float32))
        self._grouped = context[starts], count, group, begin

    def look_up(self) -> None:
        """What decoding needs: for each context equal slots of its shares, and the entry at the beginning of each slot."""
        contexts, count, group, begin = self._grouped
        bits = np.minimum(np.frexp(4.0 * count - 1)[1], SHARE).astype(np.int64)
        slots = np.int64(1) << bits
        base = np.cumsum(slots) - slots
        self.keys = group << SHARE | begin
        of = np.repeat(np.arange(len(count)), slots)
        at = of << SHARE | (np.arange(len(of)) - base[of]) << (SHARE - bits)[of]
        self.slots = (np.searchsorted(self.keys, at, "right") - 1).astype(np.int32)
        self.places = np.full(1 + self.high + len(self.ids), base[0] << 5 | (SHARE - bits[0]), np.uint64)
        self.places[contexts] = base << 5 | (SHARE - bits)
        self.groups = np.zeros(len(self.places), np.int64)
        self.groups[contexts] = np.arange(len(count))

    @classmethod
    def of(cls, ids: np.ndarray, length: int) -> tuple["Book", np.ndarray, np.ndarray]:
        """The book of a frame; the numbers of its ids, and the entry that is listed for each behind the one before (-1: none)."""
        known, counts, which = _counted(ids)
        levels = _level(16.0 * counts)
        order = np.lexsort((known, -levels.astype(np.int64)))
        number = np.empty(len(known), np.uint32 if len(known) < 1 << 16 else np.int64)  # a pair in one number
        number[order] = np.arange(len(known))
        which = number.take(which) if which is not None else _spread(known, number).take(ids)
        counts, v, total = counts[order].astype(float), len(known), len(ids)

        pairs = which[:-1] * which.dtype.type(v)
        pairs += which[1:]
        pairs[length - 1 :: length] = v * v  # a block does not know the one before
        pairs, pair = _distinct(pairs)
        times = np.bincount(pair, minlength=len(pairs)).astype(float)
        pairs = pairs.astype(np.int64)
        times[pairs == v * v] = 0
        first, second = np.minimum(pairs // v, v - 1), pairs % v
        seen = np.bincount(first, times, v)
        lower = counts[second] / total  # the chance in order 0
        with np.errstate(divide="ignore", invalid="ignore"):
            worth = (times > 1) & (times * np.log2(times / (seen[first] * lower)) > PRICE)
        worth &= times * ((1 << SHARE) - 1) > seen[first]  # a share at least, so there are fewer of them than shares
        rank = np.flatnonzero(worth)
        rank = rank[np.argsort(pairs[rank])]
        listed = np.bincount(first[rank], minlength=v)
        mixed = times[rank] + PRIOR * lower[rank]
        rests = seen + PRIOR - np.bincount(first[rank], mixed, v)
        has = listed > 0
        book = cls(known, levels, listed, second[rank], _level(16 * mixed), _level(16 * rests[has]))

        entry = np.full(len(pairs), -1, np.int32)
        entry[rank] = book.first[first[rank]] + np.arange(len(rank)) - (np.cumsum(listed) - listed)[first[rank]]
        return book, which, np.append(np.int32(-1), entry.take(pair))  # the frame's first id follows none

    def coded(self, which: np.ndarray, direct: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some whole blocks, from the numbers of their ids and the entry listed for each: the entries of all; how many each has, and the bits they take."""
        few = 128 * length
        return tuple(np.concatenate(x) for x in zip(*(self._coded(which[a : a + few], direct[a : a + few], length) for a in range(0, len(which), few))))

    def _coded(self, which: np.ndarray, direct: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        miss = np.flatnonzero(direct < 0)
        rest = self.rest.take(which.take(miss - 1)) * (miss % length > 0)
        steps = np.ones(len(which), np.int64)
        steps[miss] = 2 + (rest > 0)
        ends = np.cumsum(steps) - 1
        out = np.empty(int(ends[-1]) + 1, np.int32)
        out[ends] = direct
        at = ends[miss]
        out[at] = self.high + which[miss]
        out[at - 1] = which[miss] >> which.dtype.type(self.shift)
        k = rest > 0
        out[at[k] - 2] = rest[k]
        begin = ends[::length] + 1 - steps[::length]
        return out, np.diff(begin, append=len(out)), np.add.reduceat(self.bits.take(out), begin, dtype=float)

    def packed(self) -> bytes:
        ids, levels, listed, after, chances, rests = self.said
        gaps = np.diff(ids.astype(np.int64), prepend=0)
        firsts = np.cumsum(listed) - listed
        steps = np.diff(after, prepend=0)
        steps[firsts[listed > 0]] = after[firsts[listed > 0]]
        planes = _planes(gaps, "<u4") + levels.tobytes() + _planes(listed, "<u4") + _planes(steps, "<u4") + chances.tobytes() + rests.tobytes()
        return struct.pack("<II", len(ids), len(after)) + zlib.compress(planes, 6)

    @classmethod
    def unpacked(cls, data: bytes) -> "Book":
        v, n = struct.unpack_from("<II", data)
        raw = np.frombuffer(zlib.decompress(data[8:]), np.uint8)
        at = 0

        def take(count: int, width: int) -> np.ndarray:
            nonlocal at
            at += count * width
            return np.ascontiguousarray(raw[at - count * width : at].reshape(width, count).T).view(f"<u{width}").ravel()

        ids, levels, listed, steps, chances = take(v, 4), take(v, 1), take(v, 4).astype(np.int64), take(n, 4).astype(np.int64), take(n, 1)
        rests = raw[at:]
        if len(rests) != np.count_nonzero(listed) or listed.sum() != n:
            raise ValueError("a code book does not add up")
        firsts = np.cumsum(listed) - listed
        upto = np.cumsum(steps)
        after = upto - np.repeat((upto - steps)[firsts[listed > 0]], listed[listed > 0])
        return cls(np.cumsum(ids, dtype=np.int64).astype(np.uint32), levels, listed, after, chances, rests)


class _Learnt:
    """What blocks that are coded in step have learnt, and the context that each of them is in."""

    def __init__(self, book: Book, lanes: int):
        self.book, self.context, self.id = book, np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.base = np.arange(lanes) << SLOTS
        self.slot, self.inside = self.base, np.zeros(lanes, bool)
        #: What followed two ids, as 16 times its entry and how often in a row.
        self.told = np.full(lanes << SLOTS, len(book.owner) - 1 << 4, np.int32)
        self.cells = np.tile(CELLS, lanes)
        self.place = np.arange(lanes) * len(CELLS)

    def offer(self) -> np.ndarray:
        """The blocks that are offered an id. Of those: its entry, the 16-bit chance that it is the one, and the beginning and width of its share."""
        book = self.book
        self.old = self.told.take(self.slot)
        offered = self.old >> 4
        self.has = k = (book.owner.take(offered) == self.context).nonzero()[0]
        self.offered, place = offered.take(k), self.place.take(k)
        self.at = np.empty((3, len(k)), np.int64)
        np.add(self.old.take(k) & 15, place, out=self.at[0])
        np.add(book.sizes.take(self.offered, axis=1), place, out=self.at[1:])
        self.cell = self.cells.take(self.at)
        self.chance = CHANCES.take(np.add.reduce(VOTES.take(self.cell >> 4), 0))
        self.start, self.taken = book.start.take(self.offered), book.width.take(self.offered)
        return k

    def learn(self, hit: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Take in an entry of each block, and which of those that were offered one it was; the blocks whose id ends with it."""
        self.cells[self.at] = self.cell + ((np.where(hit, _YES, _NO) - self.cell) >> RATE)
        self.context = self.book.follows.take(entry)
        ended = self.context > self.book.high
        new = entry << 4 | 1
        again = self.has[hit]
        old = self.old.take(again)
        new[again] = old + ((old & 15) < 15)
        self.told[self.slot] = np.where(ended & self.inside, new, self.old)
        two = (self.context.view(np.uint64) * _FIRST + self.id.view(np.uint64)) * _SECOND
        self.slot = self.base + (two >> _PLACE).view(np.int64)
        self.id, self.inside = np.where(ended, self.context, self.id), ended
        return ended

    def keep(self, k: np.ndarray) -> None:
        """Go on with some blocks only."""
        for name in ("context", "id", "base", "slot", "inside", "place"):
            setattr(self, name, getattr(self, name)[k])


def _shape(n: int) -> tuple[int, int]:
    """Blocks and block length of a frame of ``n`` ids."""
    length = min(LONGEST, max(SHORTEST, -(-n // LANES)))
    return -(-n // length), length


def encode(ids: np.ndarray) -> bytes:
    """A frame of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    lanes, length = _shape(len(ids))
    if not len(ids):
        return HEAD.pack(MAGIC, VERSION, 0, 0, length, 0)
    book, which, direct = Book.of(ids, length)
    packed, body = book.packed(), []
    for a in range(0, len(ids), GROUP * length):
        body += _coded(book, which[a : a + GROUP * length], direct[a : a + GROUP * length], length)
    head = [HEAD.pack(MAGIC, VERSION, len(ids), lanes, length, len(packed))]
    head += [struct.pack("<II", zlib.crc32(b, zlib.crc32(ids[k * length : (k + 1) * length])), len(b)) for k, b in enumerate(body)]
    return b"".join([*head, packed, *body])


def _coded(book: Book, which: np.ndarray, direct: np.ndarray, length: int) -> list[bytes]:
    """The bytes of some whole blocks."""
    coded, steps, bits = book.coded(which, direct, length)
    lanes = len(steps)
    room = int(bits.max() / 32 + length / 2) + 8  # whether it is the one offered takes 10 bits at most
    out, size = np.zeros(lanes * room, np.uint32), np.arange(lanes) * room
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    lane, at, learnt, least = np.arange(lanes), np.cumsum(steps) - steps, _Learnt(book, lanes), int(steps.min())

    def put(k: np.ndarray) -> None:
        to = lane[k]
        out[size[to]] = low[k] >> _HALF
        size[to] += 1
        low[k] <<= _HALF

    for t in range(1, int(steps.max()) + 1):
        e, k = coded.take(at), learnt.offer()
        share, start, width = wide >> _SHARE, book.start.take(e), book.width.take(e)
        split = share[k] * learnt.chance
        hit = e[k] == learnt.offered
        own, begin = (wide[k] - split) // (_ALL - learnt.taken), start[k]
        begin -= learnt.taken * (begin > learnt.start)
        more, wide = share * start, share * width
        more[k] = np.where(hit, 0, split + own * begin)
        wide[k] = np.where(hit, split, own * width[k])
        low += more
        k = (low < more).nonzero()[0]
        if len(k):  # carried into the words before
            back = size[lane[k]] - 1
            while len(back):
                out[back] += np.uint32(1)
                back = back[out[back] == 0] - 1
        k = (wide <= _LOW).nonzero()[0]
        put(k)
        wide[k] <<= _HALF
        learnt.learn(hit, e)
        at += 1
        if t >= least:
            more = steps[lane] > t
            if not more.all():
                put(~more)
                put(~more)
                learnt.keep(more)
                at, lane, low, wide = at[more], lane[more], low[more], wide[more]
    words = out.astype("<u4", copy=False)
    return [words[k * room : n].tobytes() for k, n in enumerate(size.tolist())]


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; an error if a block does not have its checksum."""
    magic, version, count, lanes, length, packed = HEAD.unpack_from(frame)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a frame of token ids")
    if not count:
        return np.zeros(0, np.uint32)
    blocks = np.frombuffer(frame, "<u4", 2 * lanes, HEAD.size).reshape(lanes, 2)
    first = HEAD.size + 8 * lanes
    sizes = blocks[:, 1].astype(np.int64)
    if first + packed + int(sizes.sum()) > len(frame) or (sizes % 4).any():
        raise ValueError("a frame is cut short")
    try:
        book = Book.unpacked(frame[first : first + packed])
        book.look_up()
    except (zlib.error, struct.error, ValueError, IndexError) as e:
        raise ValueError("a frame has a broken code book") from e
    data = np.frombuffer(frame, "<u4", int(sizes.sum()) // 4, first + packed)
    data = np.concatenate([data, np.zeros(8, np.uint32)]).astype(np.uint64)
    pos = (np.cumsum(sizes) - sizes) // 4
    told = np.append(np.zeros(1 + book.high, np.uint32), book.ids)
    ids = np.concatenate([told.take(_told(book, data, pos[a : a + GROUP], min(count - a * length, GROUP * length), length)) for a in range(0, lanes, GROUP)])
    for k, begin in enumerate((first + packed + np.cumsum(sizes) - sizes).tolist()):
        if zlib.crc32(frame[begin : begin + int(sizes[k])], zlib.crc32(ids[k * length : (k + 1) * length])) != blocks[k, 0]:
            raise ValueError(f"block {k} does not have its checksum")
    return ids


def _told(book: Book, data: np.ndarray, pos: np.ndarray, count: int, length: int) -> np.ndarray:
    """The contexts behind the ids of some blocks, whose words begin at ``pos``."""
    lanes, edge = len(pos), len(data) - 1
    code, wide = data[pos] << _HALF | data[np.minimum(pos + 1, edge)], np.full(lanes, 2**64 - 1, np.uint64)
    pos = pos + 2
    out = np.zeros(lanes * (length + 1), np.uint32)  # one place more for what comes behind a block's end
    at = np.arange(lanes) * (length + 1)
    ends = at + np.minimum(length, count - np.arange(lanes) * length)
    learnt = _Learnt(book, lanes)
    for t in range(3 * length):
        has, share = learnt.offer(), wide >> _SHARE
        value = np.minimum(code // share, _MOST)
        split, kept = share[has] * learnt.chance, code[has]
        hit, every = kept < split, _ALL - learnt.taken
        own, rest = (wide[has] - split) // every, kept - split
        v = np.minimum(rest // own, every - _ONE)
        v += learnt.taken * (v >= learnt.start)
        value[has], share[has], code[has] = v, own, rest
        place = book.places.take(learnt.context)
        e = book.slots.take((place >> _FIVE) + (value >> (place & _SHIFT)))
        start, width = book.start.take(e), book.width.take(e)
        k = (value - start >= width).nonzero()[0]
        if len(k):  # the next one, or whichever it is
            n, v = e[k] + 1, value[k]
            start[k], width[k] = book.start.take(n), book.width.take(n)
            j = (v - start[k] >= width[k]).nonzero()[0]
            if len(j):
                key = book.groups.take(learnt.context[k[j]]) << SHARE | v[j].astype(np.int64)
                n[j] = np.searchsorted(book.keys, key, "right") - 1
                start[k[j]], width[k[j]] = book.start.take(n[j]), book.width.take(n[j])
            e[k] = n
        begin = start[has]
        start[has] = begin - learnt.taken * (begin > learnt.start)
        code -= share * start
        wide = share * width
        k = has[hit]
        code[k], wide[k], e[k] = kept[hit], split[hit], learnt.offered[hit]
        k = (wide <= _LOW).nonzero()[0]
        wide[k] <<= _HALF
        code[k] = code[k] << _HALF | data.take(np.minimum(pos[k], edge))
        pos[k] += 1
        ended = learnt.learn(hit, e)
        out[at] = learnt.context
        at += ended  # else no id is told yet
        np.minimum(at, ends, out=at)
        if t + 1 >= length and t % 16 == 15:  # go on with the blocks that are not done
            k = (at < ends).nonzero()[0]
            if not len(k):
                break
            if len(k) < 0.9 * len(at):
                learnt.keep(k)
                code, wide, at, ends, pos = code[k], wide[k], at[k], ends[k], pos[k]
    return out.reshape(lanes, length + 1)[:, :length].ravel()[:count]
