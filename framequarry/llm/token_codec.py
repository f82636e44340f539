"""An adaptive context-mixing range coder for token ids, with many blocks coded side by side in numpy.

A block is a byte string that is read alone: a head, a checksum of its ids, and the coder's words.
All models start anew with it.  Order 2 and order 1 each predict the id that followed their
context last, with a confidence; how often they were right in the block so far, by both
confidences, gives their shares of the interval that the range coder narrows to.  The rest is order
0's: it counts the ids that neither predicts, and ids without a count follow a fixed law.  The
counts are summed up anew every few ids, alike by coder and decoder.  A block's ids are cut into
STRANDS strands of neighbours, which share its models and have a range coder each.  One step codes
one id of each strand of each block; a table has a row a slot and a column a block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from functools import cache

import numpy as np

#: Ids of a block at most, and blocks that are coded side by side.
BLOCK, LANES = 1 << 13, 1 << 10
#: Strands of a block.
STRANDS = 8
#: Ids of a block at least, unless there are fewer in all.
LEAST_BLOCK = 3000
#: Ids that are coded side by side.
RUN = 1 << 23
#: Steps between two sums of the counts: an eighth of the steps so far, within these bounds.
OFTEN, SELDOM = 2, 32
_HEAD = struct.Struct(f"<III{STRANDS}H")  # ids, vocabulary, checksum, words of each strand
_ALL = 1 << 24  # parts of the interval
_SHARE = 224  # parts of a prediction that always held, over 2**16
_LAW = 1 << 17  # parts of the law; ids without a count have as many at least
_WIDE, _LOW = 1 << 48, 1 << 32  # the range is the first at first, and never under the second
_SLOTS1, _SLOTS2 = 1 << 11, 1 << 12  # contexts of a block
_SPAN = 4  # children of a node of the search, whose sums of 15 bits are compared in one word
_LEVELS = 3
_EACH, _FLAGS = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
#: Trials and hits that a context begins with: hits of order 2, then of order 1, by order 1's confidence and order 2's, where the predictions differ; then where they agree.
_TRIALS = 32
_HITS2 = [1, 6, 12, 18] * 4 + [6, 16, 24, 28] * 4
_HITS1 = [x for x in (2, 4, 6, 8) for _ in range(4)] + [0] * 16


@cache
def _law(vocab: int) -> np.ndarray:
    """Where each id's part of _LAW begins, and the end: a vocabulary lists its ids by frequency, so the share falls with the id."""
    if not 0 < vocab <= 1 << 16:
        raise ValueError("a vocabulary has 1 to 65,536 ids")
    share = 1 / (np.arange(vocab) + 700.0)
    parts = 1 + np.floor(share / share.sum() * (_LAW - vocab)).astype(np.int64)
    parts[0] += _LAW - int(parts.sum())
    return np.concatenate(([0], np.cumsum(parts)))


@cache
def _lawful(vocab: int) -> np.ndarray:
    """The id of each part of _LAW."""
    return np.repeat(np.arange(vocab, dtype=np.uint16), np.diff(_law(vocab)))


def _slot(x: np.ndarray, by: int, slots: int, lanes: int) -> np.ndarray:
    """Of ids the row of their slot among so many; a product that is too large keeps the bits that count."""
    return ((x * np.int32(by) >> 7) & np.int32(slots - 1)) * np.int32(lanes)


def _slots(x: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id the row of its slot as order 1's context, and the two parts of order 2's."""
    return _slot(x, 40503, _SLOTS1, lanes), _slot(x, 50333, _SLOTS2 // 2, lanes), _slot(x, 27361, _SLOTS2 // 2, lanes)


class _Models:
    """The models of so many blocks, for steps of an id a strand; a context's entry is an id and four bits, two of them its confidence: the lower ones for order 2."""

    def __init__(self, lanes: int, steps: int, search: bool):
        self.lanes, self.lane, self.search = lanes, np.tile(np.arange(lanes, dtype=np.int32), STRANDS), search
        self.t1, self.t2 = np.zeros(_SLOTS1 * lanes, np.int32), np.zeros(_SLOTS2 * lanes, np.int32)
        self.at_context = self.lane * np.int32(32)
        self.trials = np.full(32 * lanes, _TRIALS, np.int32)
        self.hits2, self.hits1 = (np.tile(np.array(h, np.int32), lanes) for h in (_HITS2, _HITS1))
        # A row a rank, and one for what is not counted.
        self.rows = (-(-steps * STRANDS // _SPAN**_LEVELS) + 1) * _SPAN**_LEVELS
        self.counts, self.nowhere = np.zeros((self.rows + 1) * lanes, np.uint16), self.rows * lanes
        self.every_sum = np.zeros((self.rows + 1, lanes), np.uint16)
        self.known = np.zeros(lanes, np.int64)  # ranks so far
        self.fresh = np.full(lanes, 0.9, np.float32)  # how often an id had no count
        self.sum_up()

    def sum_up(self) -> None:
        """Make the counts so far those that the shares go by."""
        ranks = (int(self.known.max()) // _SPAN**_LEVELS + 1) * _SPAN**_LEVELS  # one more than there are
        sums = self.every_sum[: ranks + 1]
        for before, count, after in zip(sums, self.counts[: ranks * self.lanes].reshape(ranks, -1), sums[1:]):
            np.add(before, count, out=after)
        total = sums[-1].astype(np.int32)
        if self.search:
            # Of each node, whose children are nodes or ranks, a word of the sums before its children.
            self.top = sums[: -1 : _SPAN**_LEVELS, None]
            self.nodes = [self._words(sums[: -1 : _SPAN**k]) for k in reversed(range(_LEVELS))]
        # Of what the predictions leave the share of one occurrence; counted ids, and those without a count, have a sixteenth at least.
        each = np.clip(1 - self.fresh, np.float32(0.0625), np.float32(0.9375)) / np.maximum(total, 1).astype(np.float32)
        self.total, self.each = np.tile(total, STRANDS), np.tile(each, STRANDS)
        part = np.float32(_SHARE << 16) / (self.trials + 2)
        share2 = ((self.hits2 + np.float32(0.25)) * part).astype(np.int64)
        self.shares = (share2 << 32 | share2 + ((self.hits1 + np.float32(0.25)) * part).astype(np.int64)).astype("<i8")

    def _words(self, sums: np.ndarray) -> np.ndarray:
        parts = [x.astype(np.uint64) << np.uint64(16 * k) for k, x in enumerate(sums.reshape(-1, _SPAN, self.lanes).transpose(1, 0, 2))]
        return (parts[0] | parts[1] | parts[2] | parts[3]).ravel()

    def learn(self, counted: np.ndarray, new: np.ndarray, contexts: np.ndarray, hits1: np.ndarray, hits2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add the steps since the last sum: places in the counts, ids without one, contexts and what held there.

        Ids without a count get the next ranks and their places; returns where they are and these ranks.
        """
        lanes = self.lanes
        i = new.ravel().nonzero()[0]
        rank, upto = np.zeros((len(new) * STRANDS, lanes), np.int16), np.full(lanes, -1, np.int16)
        for more, ranked in zip(new.reshape(rank.shape), rank):
            upto = np.add(upto, more, out=ranked)
        lane = i % lanes
        rank = rank.ravel().take(i) + self.known.take(lane)
        counted.ravel()[i] = rank * lanes + lane
        np.add.at(self.counts, counted.ravel(), np.uint16(1))
        context = contexts.ravel()
        for held, own in ((self.trials, context), (self.hits2, context[hits2.ravel()]), (self.hits1, context[(hits1 > hits2).ravel()])):
            held += np.bincount(own, minlength=len(held)).astype(np.int32)
        n = len(new) * STRANDS - self._by_lane(hits1 | hits2)
        fresh = upto.astype(np.int32) + 1
        self.known += fresh
        self.fresh += (fresh - n * self.fresh) / (n + np.float32(128)).astype(np.float32)
        self.sum_up()
        return i, rank

    def _by_lane(self, flags: np.ndarray) -> np.ndarray:
        return flags.reshape(-1, self.lanes).sum(0, dtype=np.int32)

    def predict(self, s1: np.ndarray, s2: np.ndarray, context: np.ndarray) -> None:
        """Shares for the contexts in these places; context: where to put that of both confidences."""
        self.s1, self.s2 = s1, s2
        self.e1, self.e2 = self.t1.take(s1, mode="clip"), self.t2.take(s2, mode="clip")
        self.p1, self.p2 = self.e1 >> 4, self.e2 >> 4
        self.c1, self.c2 = self.e1 & 12, self.e2 & 3
        np.add((self.p1 == self.p2) << np.int8(4) | self.c1 | self.c2, self.at_context, out=context)
        self.w, self.w2 = np.ascontiguousarray(self.shares.take(context, mode="clip").view(np.int32).reshape(-1, 2).T)
        self.unit = ((_ALL - self.w).astype(np.float32) * self.each).astype(np.int32)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The place in the counts of the rank that holds the v-th occurrence."""
        node = (self.top <= v.astype(np.uint16).reshape(STRANDS, -1)).view(np.uint8).sum(0, dtype=np.uint8).ravel().astype(np.int64) - 1
        flagged = v.astype(np.uint64) * _EACH | _FLAGS
        for level in self.nodes:
            # A flag stays where the child's sum is v at most.
            child = np.bitwise_count(flagged - level.take(node * self.lanes + self.lane, mode="clip") & _FLAGS)
            node = node * _SPAN + child - 1
        return node * self.lanes + self.lane

    def update(self, x: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """Learn the ids of a step; hit: whether order 1, and order 2, predicted them."""
        moved = x << 4
        # A hit raises the confidence to 3 at most, a miss lowers it; without any, the new id moves in.
        self.t2[self.s2] = np.where(hit2, self.e2 + (self.c2 < 3), np.where(self.c2, self.e2 - 1, moved))
        self.t1[self.s1] = np.where(hit1, moved + np.minimum(self.c1 + 4, 12), np.where(self.c1, self.e1 - 4, moved))


def _parts(wide: np.ndarray) -> np.ndarray:
    """The width of one of _ALL parts; unsigned numbers are shifted many at once."""
    return (wide.view(np.uint64) >> np.uint64(24)).view(np.int64)


def _shape(n: int) -> tuple[int, int]:
    """Blocks of a run of n ids, and their ids at most: all have as many, or one less."""
    lanes = max(1, min(LANES, n // LEAST_BLOCK), -(-n // BLOCK))
    return lanes, -(-n // lanes)


def _strand(n: int) -> int:
    """Ids of each strand of a block of n ids; the last may have fewer."""
    return -(-n // STRANDS)


def _laid(ids: np.ndarray, n: int) -> np.ndarray:
    """Blocks of n ids each as their steps, strands and blocks; zeros follow the last strand's end."""
    length = _strand(n)
    padded = np.zeros((len(ids) // n if n else 0, length * STRANDS), np.uint16)
    padded[:, :n] = ids.reshape(len(padded), n)
    return padded.reshape(-1, STRANDS, length).transpose(2, 1, 0)


def _stretches(steps: int) -> list[tuple[int, int]]:
    """Ranges of steps between two sums."""
    ends = [0]
    while ends[-1] < steps:
        k = ends[-1]
        ends.append(min(steps, k + min(max(k >> 3, min(OFTEN, k)), SELDOM)) if k else 1)
    return list(zip(ends[:-1], ends[1:]))


def encode(ids: np.ndarray, vocab: int) -> list[bytes]:
    """Blocks of ids in order, each id under vocab (at most 2**16)."""
    ids = np.asarray(ids)
    if len(ids) and not (0 <= ids.min() and ids.max() < vocab):
        raise ValueError("ids lie outside the vocabulary")
    return [b for at in range(0, len(ids), RUN) for b in _encode_run(ids[at : at + RUN], vocab)]


def _encode_run(ids: np.ndarray, vocab: int) -> list[bytes]:
    law = _law(vocab)
    lanes, most = _shape(len(ids))
    # So many blocks are full, the others have one id less; zeros that follow a strand's end are coded and not read.
    full, steps, across = len(ids) - lanes * (most - 1), _strand(most), lanes * STRANDS
    sizes = np.where(np.arange(lanes) < full, most, most - 1)
    grid = np.zeros((steps + 2, STRANDS, lanes), np.uint16)  # two zeros are before
    grid[2:, :, :full] = _laid(ids[: full * most], most)
    if most > 1:
        grid[2 : 2 + _strand(most - 1), :, full:] = _laid(ids[full * most :], most - 1)
    grid = grid.reshape(-1, across)
    m = _Models(lanes, steps, False)
    lane, nowhere = m.lane, m.nowhere
    # Places of counts by id, the commonest ids in the first rows.
    often = np.bincount(ids, minlength=vocab)
    often[0] += 1
    row = np.zeros(vocab, np.int64)
    row[np.argsort(-often, kind="stable")] = np.arange(vocab) * lanes
    # Ranks, of 15 bits, as a column an id would be twice as large with places.
    seats = np.full(int((often > 0).sum()) * lanes, m.rows, np.int16)
    low, wide = np.zeros(across, np.int64), np.full(across, _WIDE, np.int64)
    room = steps * 2 + 8
    out, spot = np.zeros(room * across, np.uint16), np.arange(across)  # a strand's next word

    def add(more: np.ndarray) -> np.ndarray:
        total = low + more
        carry = (total >= _WIDE).nonzero()[0]
        if len(carry):
            total[carry] -= _WIDE
            back = spot[carry] - across
            while len(back):
                out[back] += 1
                back = back[out[back] == 0] - across
        return total

    for begin_step, end_step in _stretches(steps):
        every = grid[begin_step : end_step + 2].astype(np.int32)
        before, last, xs = every[:-2], every[1:-1], every[2:]
        s1s, s2s, _ = _slots(last, lanes)
        s1s, s2s = s1s + lane, s2s + _slots(before, lanes)[2] + lane
        # What order 0 says of all ids of the stretch.
        held = row.take(xs) + lane
        ranks = seats.take(held)
        lacks = ranks == m.rows
        places = np.where(lacks, nowhere, ranks * np.int32(lanes) + lane)
        firsts, owns = m.every_sum.take(places, mode="clip").astype(np.int32), m.counts.take(places, mode="clip").astype(np.int32)
        contexts, hits1, hits2 = np.zeros(xs.shape, np.int32), np.zeros(xs.shape, bool), np.zeros(xs.shape, bool)
        for k, x in enumerate(xs):
            m.predict(s1s[k], s2s[k], contexts[k])
            hit1, hit2 = np.equal(m.p1, x, out=hits1[k]), np.equal(m.p2, x, out=hits2[k])
            begin, width = m.w + firsts[k] * m.unit, owns[k] * m.unit
            hit = hit1 | hit2
            if len(i := hit.nonzero()[0]):
                w2, second = m.w2.take(i), hit2.take(i)
                begin[i], width[i] = np.where(second, 0, w2), np.where(second, w2, m.w.take(i) - w2)
            if len(i := (lacks[k] > hit).nonzero()[0]):
                old, y = (m.w[i] + m.unit[i] * m.total[i]).astype(np.int64), x[i]
                lo = law.take(y) * (_ALL - old) >> 17
                begin[i], width[i] = old + lo, (law.take(y + 1) * (_ALL - old) >> 17) - lo
            part = _parts(wide)
            low = add(part * begin)
            wide = part * width
            # Every block's top word is written; it stays where the range has become too narrow.
            narrow = wide < _LOW
            out[spot] = low.view("<u2")[2::4]
            spot += narrow * across
            by = narrow * 16
            low <<= by
            low &= _WIDE - 1
            wide <<= by
            while len(i := (wide < _LOW).nonzero()[0]):  # seldom a second word
                out[spot[i]] = low[i] >> 32
                spot[i] += across
                low[i] = (low[i] << 16) & _WIDE - 1
                wide[i] <<= 16
            m.update(x, hit1, hit2)
        hit = hits1 | hits2
        new = lacks > hit
        np.copyto(places, nowhere, where=hit)
        i, rank = m.learn(places, new, contexts, hits1, hits2)
        seats[held.ravel().take(i)] = rank
    # The last word names a point of the range with zeros behind it.
    low = add(np.full(across, _LOW - 1))
    out[spot] = low >> 32
    spot += across
    counts = spot // across
    words = np.ascontiguousarray(out.reshape(room, across)[: int(counts.max())].T).astype("<u2")
    ends = np.cumsum(sizes).tolist()
    blocks = []
    for k, (n, e, own) in enumerate(zip(sizes.tolist(), ends, counts.reshape(STRANDS, lanes).T.tolist(), strict=True)):
        head = _HEAD.pack(n, vocab, zlib.crc32(ids[e - n : e].astype("<u4")), *own)
        blocks.append(head + b"".join(words[j * lanes + k, :c].tobytes() for j, c in enumerate(own)))
    return blocks


def decode(blocks: Sequence[bytes]) -> np.ndarray:
    """The ids of blocks in order, of any number and choice; ValueError if a checksum doesn't hold."""
    out: list[np.ndarray] = []
    heads = [_head(b) for b in blocks]
    at = 0
    while at < len(blocks):
        # Side by side: neighbours of one vocabulary whose lengths differ by one at most.
        (n, vocab, *_), upto = heads[at], at + 1
        longest, shortest = n, n
        while upto < len(blocks) and upto - at < LANES:
            n, v, *_ = heads[upto]
            if v != vocab or max(longest, n) - min(shortest, n) > 1:
                break
            longest, shortest, upto = max(longest, n), min(shortest, n), upto + 1
        out += _decode_run(blocks[at:upto], longest, vocab)
        at = upto
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def _head(block: bytes) -> tuple[int, ...]:
    if len(block) < _HEAD.size:
        raise ValueError("a block is damaged")
    n, vocab, crc, *words = _HEAD.unpack_from(block)
    if not 0 < n <= BLOCK or not 0 < vocab <= 1 << 16 or len(block) != _HEAD.size + 2 * sum(words):
        raise ValueError("a block is damaged")
    return n, vocab, crc, *words


@np.errstate(over="ignore")  # in damaged blocks
def _decode_run(blocks: Sequence[bytes], most: int, vocab: int) -> list[np.ndarray]:
    lanes, steps = len(blocks), _strand(most)
    across = lanes * STRANDS
    law, lawful = _law(vocab), _lawful(vocab)
    heads = [_head(b) for b in blocks]
    words = np.zeros((STRANDS, lanes, max(max(own) for _, _, _, *own in heads) + 4), np.uint16)
    for k, (b, (_, _, _, *own)) in enumerate(zip(blocks, heads, strict=True)):
        at = _HEAD.size
        for j, c in enumerate(own):
            words[j, k, :c] = np.frombuffer(b, "<u2", c, at)
            at += 2 * c
    words = np.ascontiguousarray(words.reshape(across, -1).T).ravel()
    m = _Models(lanes, steps, True)
    lane, nowhere = m.lane, m.nowhere
    ids = np.zeros((m.rows + 1) * lanes, np.uint16)  # by rank
    spot = np.arange(across)
    # Whole numbers under 2**53, of which doubles hold each.
    code, wide = np.zeros(across), np.full(across, float(_WIDE))
    for _ in range(3):
        code = code * 65536 + words.take(spot)
        spot += across
    grid = np.zeros((steps, across), np.uint16)
    s1, s2, before = lane, lane, lane
    for begin_step, end_step in _stretches(steps):
        shape = (end_step - begin_step, across)
        places, contexts = np.zeros(shape, np.int64), np.zeros(shape, np.int32)
        news, hits1, hits2 = (np.zeros(shape, bool) for _ in range(3))
        most = np.maximum(m.total - 1, 0)
        for k in range(shape[0]):
            m.predict(s1, s2, contexts[k])
            part = np.floor(wide * (1 / _ALL))
            # Quotients of numbers under 2**53, and under 2**24 in single precision, are exact.
            v = np.minimum(code / part, _ALL - 1).astype(np.int32)
            over = v - m.w
            guess, guess2 = over < 0, v < m.w2  # by order 1 or 2, by order 2
            nth = (over.astype(np.float32) / np.maximum(m.unit, 1).astype(np.float32)).astype(np.int32)
            new = np.greater(nth >= m.total, guess, out=news[k])
            place = m.find(np.minimum(np.maximum(nth, 0), most))
            width = m.counts.take(place, mode="clip") * m.unit
            begin = m.w + m.every_sum.take(place, mode="clip") * m.unit
            x = ids.take(place, mode="clip").astype(np.int32)
            if len(i := guess.nonzero()[0]):
                w2, second = m.w2.take(i), guess2.take(i)
                begin[i], width[i] = np.where(second, 0, w2), np.where(second, w2, m.w.take(i) - w2)
                x[i], place[i] = np.where(second, m.p2.take(i), m.p1.take(i)), nowhere
            if len(i := new.nonzero()[0]):
                old = (m.w[i] + m.unit[i] * m.total[i]).astype(np.int64)
                y = lawful.take((((v[i] - old + 1) * _LAW - 1) / (_ALL - old)).astype(np.int64)).astype(np.int64)
                lo = law.take(y) * (_ALL - old) >> 17
                begin[i], width[i] = old + lo, (law.take(y + 1) * (_ALL - old) >> 17) - lo
                x[i] = y
            places[k] = place
            code -= part * begin
            wide = part * width
            # A block's next word moves in where the range has become too narrow.
            narrow = wide < _LOW
            by = np.where(narrow, 65536.0, 1.0)
            code *= by
            wide *= by
            code += words.take(spot, mode="clip") * narrow
            spot += narrow * across
            while len(i := (wide < _LOW).nonzero()[0]):  # seldom a second word
                code[i] = code[i] * 65536 + words.take(spot[i], mode="clip")
                spot[i] += across
                wide[i] *= 65536
            m.update(x, np.equal(m.p1, x, out=hits1[k]), np.equal(m.p2, x, out=hits2[k]))
            grid[begin_step + k] = x
            s1, own, after = _slots(x, lanes)
            s1, s2, before = s1 + lane, own + before, after + lane
        i, _ = m.learn(places, news, contexts, hits1, hits2)
        ids[places.ravel().take(i)] = grid[begin_step:end_step].ravel().take(i)
    out = []
    grid = np.ascontiguousarray(grid.reshape(steps, STRANDS, lanes).transpose(2, 1, 0))
    for (n, _, crc, *_), x in zip(heads, grid, strict=True):
        x = x[:, : _strand(n)].ravel()[:n]
        if zlib.crc32(x.astype("<u4")) != crc:
            raise ValueError("a block is damaged")
        out.append(x)
    return out
