"""Adaptive context-mixing range coder for token ids.

A block starts from an empty model and carries checksums, so it is read alone. Its
ids lie in parallel lanes which share one model: at step t the t-th id of each lane
is coded, then all of them update the model. An id's probability mixes three
predictions: order 0 (adaptive counts), order 1 and order 2 (the id last seen in
the context, trusted as much as its confidence class has been right so far). The
mix is in integers, so that reading repeats it exactly; numpy runs a step over all
lanes at once.

Layout, little endian: magic, then the header fields, the document table (zlib), words
per lane (u32), lanes' 16-bit words.
"""

import struct
import zlib

import numpy as np

MAGIC = b"QTB1"
HEADER = struct.Struct("<4sIQIIIIIQ")
MAX_LANES, LANE_STEPS = 8192, 256
BLOCK_TOKENS = MAX_LANES * LANE_STEPS
ORDER2_BITS = 18
CONF_BITS = 4
CONF = 1 << CONF_BITS
GAIN = 32
#: A count table of a larger sum is halved, so sums stay below 2**31 in a block of any length.
FULL = 1 << 30
ONE = 4096
#: By confidence, wrong then right: does the candidate stay, and its confidence after that.
STAYS = np.array([k > 1 for k in range(CONF)] + [k > 0 for k in range(CONF)])
THEN = np.array([max(k >> 1, 1) for k in range(CONF)] + [min(k + 1, CONF - 1) for k in range(CONF)], np.int32)
U64 = np.uint64
LOW_BITS = U64(48)
LEAST = U64(1) << LOW_BITS
MASK = LEAST - U64(1)


class Model:
    """Counts and context tables; the same calls in the same order on both sides."""

    def __init__(self, vocabulary: int, lanes: int):
        self.v = vocabulary
        self.count = np.ones(vocabulary, np.int32)
        self.pending: list[np.ndarray] = []
        self.rebuild()
        # a context's last id and its confidence in one number: id * CONF + confidence
        self.last = [np.zeros(vocabulary + 1, np.int32), np.zeros(1 << ORDER2_BITS, np.int32)]
        # times a confidence class was wrong and right: class, then class + CONF
        self.seen = [np.concatenate([np.full(CONF, 3), np.arange(CONF) * 2 + 1]) for _ in range(2)]
        self.one = np.full(lanes, vocabulary, np.int32)
        self.two = np.full(lanes, vocabulary, np.int32)

    def rebuild(self) -> None:
        if self.pending:
            self.count += (GAIN * np.bincount(np.concatenate(self.pending), minlength=self.v)).astype(np.int32)
            self.pending = []
        self.cum = np.zeros(self.v + 1, np.int32)
        np.cumsum(self.count, out=self.cum[1:])
        if self.cum[-1] > FULL:
            self.count = (self.count + 1) >> 1
            np.cumsum(self.count, out=self.cum[1:])
        self.total = int(self.cum[-1])

    def predict(self, n: int) -> None:
        """Contexts, candidates and weights of the first n lanes."""
        one = self.one[:n]
        hashed = one * np.int32(0x1E3779B1) ^ self.two[:n] * np.int32(0x45EBCA77)
        hashed >>= 10
        hashed &= (1 << ORDER2_BITS) - 1
        self.at = [one, hashed]
        self.packed = [np.take(t, i) for t, i in zip(self.last, self.at, strict=True)]
        self.c = [p >> CONF_BITS for p in self.packed]
        self.k = [p & (CONF - 1) for p in self.packed]
        trust = [ONE * s[CONF:] // (s[:CONF] + s[CONF:]) for s in self.seen]
        for t in trust:
            t[0] = 0
            np.minimum(t, ONE - 64, out=t)
        # all pairs of classes: the weights of orders 0, 1 and 2, the last two times the total
        w2 = np.broadcast_to(trust[1][None, :], (CONF, CONF))
        w1 = ((ONE - w2) * trust[0][:, None]) >> 12
        pair = (self.k[0] << CONF_BITS) | self.k[1]
        self.w0 = np.take((ONE - w1 - w2).ravel(), pair)
        self.w1, self.w2 = np.take((w1 * self.total).ravel(), pair), np.take((w2 * self.total).ravel(), pair)
        self.scale = self.total * ONE

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of x in units of 1 / scale."""
        start = np.take(self.cum, x) * self.w0
        width = np.take(self.count, x) * self.w0
        for c, w in zip(self.c, (self.w1, self.w2), strict=True):
            start += w * (c < x)
            width += w * (c == x)
        return start, width

    def find(self, v: np.ndarray) -> np.ndarray:
        """The id whose interval holds v."""
        c1, c2 = self.c
        a, b = np.minimum(c1, c2), np.maximum(c1, c2)
        swap = c2 < c1
        wa, wb = np.where(swap, self.w2, self.w1), np.where(swap, self.w1, self.w2)
        start = self.w0 * np.take(self.cum, a)
        in_a = v >= start
        start += self.w0 * np.take(self.count, a)
        start += wa
        start += wb * (a == b)
        past_a = v >= start
        v = v - wa * past_a
        start = self.w0 * np.take(self.cum, b)
        in_b = v >= start
        in_b &= past_a
        start += self.w0 * np.take(self.count, b)
        start += wb
        past_b = v >= start
        past_b &= past_a
        v -= wb * past_b
        in_a &= ~past_a
        in_b &= ~past_b
        x = np.where(in_a, a, b)
        plain = np.flatnonzero(~(in_a | in_b))
        # below 2**53 and far enough from whole numbers: the division rounds to the right side
        u = (v[plain] / self.w0[plain]).astype(np.int32)
        order = np.argsort(u)  # ascending searches stay in cache
        x[plain[order]] = np.searchsorted(self.cum, u[order], "right") - 1
        return x

    def update(self, x: np.ndarray, step: int) -> None:
        n = len(x)
        fresh = x << CONF_BITS
        for c, k, p, at, last, seen in zip(self.c, self.k, self.packed, self.at, self.last, self.seen, strict=True):
            case = k + ((c == x).view(np.int8) << CONF_BITS)
            seen += np.bincount(case, minlength=2 * CONF)
            last[at] = np.where(np.take(STAYS, case), p & ~(CONF - 1), fresh) | np.take(THEN, case)
        self.pending.append(x)
        if step < 16 or step % 4 == 3:
            self.rebuild()
        self.two[:n], self.one[:n] = self.one[:n], x


def lanes_of(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, n // 64))
    return lanes, -(-n // lanes)


def active(n: int, steps: int, t: int) -> int:
    """Lanes that have a t-th id; they are the first ones."""
    return max(0, -(-(n - t) // steps))


def ready(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes whose upper 16 bits are settled, or whose range is too small; their low and range. A
    range that is small because it lies over a carry is cut there."""
    open_ = (low ^ (low + rng)) >= LEAST
    todo = np.flatnonzero(~open_ | (rng < LEAST))
    a, b = low[todo], rng[todo]
    over = open_[todo]
    if over.any():
        b[over] = (~a[over] + U64(1)) & MASK
    return todo, a, b


def encode(ids: np.ndarray, vocabulary: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """lanes, steps, words per lane, words of all lanes in order."""
    n = len(ids)
    lanes, steps = lanes_of(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps).T.copy()
    m = Model(vocabulary, lanes)
    low, rng = np.zeros(lanes, U64), np.full(lanes, ~U64(0), U64)
    out, used = np.zeros((lanes, max(16, steps * 2)), np.uint16), np.zeros(lanes, np.int64)
    for t in range(steps):
        k = active(n, steps, t)
        if k <= 0:
            break
        x = grid[t, :k]
        m.predict(k)
        start, width = m.interval(x)
        r = rng[:k] // U64(m.scale)
        lo, ra = low[:k] + r * start.astype(U64), r * width.astype(U64)
        todo, a, b = ready(lo, ra)
        while len(todo):
            if int(used[todo].max()) >= out.shape[1]:
                out = np.concatenate([out, np.zeros_like(out)], axis=1)
            out[todo, used[todo]] = (a >> LOW_BITS).astype(np.uint16)
            used[todo] += 1
            a, b = a << U64(16), b << U64(16)
            lo[todo], ra[todo] = a, b
            more, a, b = ready(a, b)
            todo = todo[more]
        low[:k], rng[:k] = lo, ra
        m.update(x, t)
    if out.shape[1] < int(used.max(initial=0)) + 4:
        out = np.concatenate([out, np.zeros((lanes, 4), np.uint16)], axis=1)
    for j in range(4):  # what is left of low
        out[np.arange(lanes), used + j] = (low >> U64(48 - 16 * j)).astype(np.uint16)
    used += 4
    words = out[np.arange(out.shape[1])[None, :] < used[:, None]]
    return lanes, steps, used.astype(np.uint32), words


def decode(n: int, vocabulary: int, lanes: int, steps: int, used: np.ndarray, words: np.ndarray) -> np.ndarray:
    m = Model(vocabulary, lanes)
    end = np.cumsum(used.astype(np.int64))
    at = end - used
    words = np.concatenate([words, np.zeros(4, np.uint16)]).astype(U64)
    low, rng, code = np.zeros(lanes, U64), np.full(lanes, ~U64(0), U64), np.zeros(lanes, U64)
    for _ in range(4):
        code = (code << U64(16)) | words[at]
        at += 1
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        k = active(n, steps, t)
        if k <= 0:
            break
        m.predict(k)
        r = rng[:k] // U64(m.scale)
        v = np.minimum((code[:k] - low[:k]) // r, U64(m.scale - 1)).astype(np.int64)
        x = m.find(v)
        start, width = m.interval(x)
        lo, ra, co = low[:k] + r * start.astype(U64), r * width.astype(U64), code[:k]
        todo, a, b = ready(lo, ra)
        while len(todo):
            co[todo] = (co[todo] << U64(16)) | words[np.minimum(at[todo], len(words) - 1)]
            at[todo] += 1
            a, b = a << U64(16), b << U64(16)
            lo[todo], ra[todo] = a, b
            more, a, b = ready(a, b)
            todo = todo[more]
        low[:k], rng[:k], code[:k] = lo, ra, co
        grid[t, :k] = x
        m.update(x, t)
    return grid.T.reshape(-1)[:n]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def write_block(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError("an id is outside the vocabulary")
    lanes, steps, used, words = encode(ids, vocabulary)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    table = zlib.compress(null.tobytes() + docs.tobytes() + np.array(sizes, "<u8").tobytes())
    body = table + used.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    head = HEADER.pack(MAGIC, len(doc_ids), len(ids), vocabulary, lanes, steps, crc(ids), zlib.crc32(body), len(table))
    return head + body


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, tokens of each, all ids; raises ValueError if a checksum is wrong."""
    if len(data) < HEADER.size or data[:4] != MAGIC:
        raise ValueError("no token block")
    _, n_docs, n, vocabulary, lanes, steps, ids_crc, body_crc, table_size = HEADER.unpack_from(data)
    body = data[HEADER.size :]
    if zlib.crc32(body) != body_crc:
        raise ValueError("block damaged")
    table = zlib.decompress(body[:table_size])
    null = np.frombuffer(table, np.uint8, n_docs)
    docs = np.frombuffer(table, "<i8", n_docs, n_docs)
    sizes = np.frombuffer(table, "<u8", n_docs, n_docs * 9).astype(np.int64)
    used = np.frombuffer(body, "<u4", lanes, table_size)
    words = np.frombuffer(body, "<u2", -1, table_size + 4 * lanes)
    ids = decode(n, vocabulary, lanes, steps, used, words)
    if crc(ids) != ids_crc:
        raise ValueError("ids differ from those written")
    return [None if z else int(d) for z, d in zip(null, docs, strict=True)], sizes, ids
