"""Words of some texts as byte spans, without hashes."""

import numpy as np


class Spans:
    """start and end bytes of the words, ``first`` word of each text (one more at the end), lowered bytes.

    ``lut`` maps separators to 0 and A-Z to a-z, see ``common.table``.
    """

    def __init__(self, texts: list[bytes], lut: np.ndarray):
        self.bytes = lut[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
        inside = self.bytes != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.inside, self.start, self.end = inside, edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.searchsorted(self.start, np.concatenate([[1], 1 + np.cumsum(sizes + 1)]))
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self):
        return len(self.start)
