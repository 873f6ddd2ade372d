"""Token ids of whole texts, with a table of words where the tokenizer drops white space."""

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from quirefold.llm.common import span_hashes, table

#: Words that an encoder keeps; about 25 bytes each. Longer words are encoded anew each time.
KEPT, LONGEST = 1_000_000, 64
#: Words that are kept apart until they are merged into the others.
RECENT = 1 << 16
#: A word of its own that stands between the words of a joined batch.
MARK = "\x01"
#: Fixed value: a split pattern where a run of letters ends before ASCII punctuation.
LETTER_RUNS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_CASE = table(b"")
_LETTER[97:123] = True
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Words of a-z and of the letters U+00C0 to U+00FF, all of which are composed.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Second bytes of those: upper case to lower case.
_LOWER = bytes(b + 32 if 0x80 <= b <= 0x9E else b for b in range(256))
_SECOND = np.zeros(256, bool)
_SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes are themselves, the others letters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in printable)}


_LETTERS = byte_letters()


class WordTable:
    """Ids of words by the words' 64-bit hashes: sorted keys with places in a pool of ids.

    New words are sorted apart and merged in when there are RECENT of them. Beyond KEPT words, those
    not met since the last such time go, and all go if that leaves too many.
    """

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.pool, self.end = np.empty(1 << 16, self.kind), 0
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool))
        self.levels = [none, none]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending keys: place and number of ids, and which aren't there."""
        at, size, missing = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32), np.ones(len(keys), bool)
        for known, place, n, met in self.levels:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                i = i[hit]
                at[hit], size[hit] = place[i], n[i]
                met[i] = True
                missing &= ~hit
        return at, size, missing

    def put(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Appends ids to the pool: place and number of each."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        n = int(size.sum())
        if self.end + n > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.empty(max(n, len(self.pool)), self.kind)])
        self.pool[self.end : self.end + n] = np.fromiter(chain.from_iterable(ids), self.kind, n)
        place = self.end + np.cumsum(size) - size
        self.end += n
        return place, size.astype(np.int32)

    def add(self, keys: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """Ascending keys that find() didn't know."""
        self.merge(1, keys, place, size, np.zeros(len(keys), bool))
        if len(self.levels[1][0]) > RECENT:
            self.merge(0, *self.levels[1])
            self.levels[1] = tuple(x[:0] for x in self.levels[1])
            if len(self.levels[0][0]) > KEPT:
                self.shrink()

    def merge(self, level: int, keys, place, size, met) -> None:
        old = self.levels[level]
        at = np.searchsorted(old[0], keys)
        self.levels[level] = tuple(np.insert(x, at, y) for x, y in zip(old, (keys, place, size, met), strict=True))

    def shrink(self) -> None:
        keys, place, size, met = self.levels[0]
        if met.sum() > KEPT // 2:
            met = np.zeros(len(met), bool)
        keys, place, size = keys[met], place[met], size[met].astype(np.int64)
        flat = self.pool[np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.clear()
        self.pool, self.end = np.concatenate([flat, self.pool]), len(flat)
        self.levels[0] = (keys, np.cumsum(size) - size, size.astype(np.int32), np.zeros(len(keys), bool))


class Encoder:
    """``ids(texts)``: as the tokenizers library gives them, without special tokens added.

    A tokenizer that replaces white space by a blank and drops it between words gives
    a text the ids of its parts between blanks and newlines; each distinct part is
    encoded once and kept within a bound. Of one that lowers case
    and ends words at punctuation, parts that differ in no more than that are one. Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        replaces = any(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in norm.get("normalizers", []))
        splits = [p for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
        drops = bool(splits) and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        plain = not any(t["lstrip"] or t["rstrip"] or " " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"])
        self.by_words = replaces and drops and plain
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        lowers = norm.get("type") == "Sequence" and norm["normalizers"][-1:] == [{"type": "Lowercase"}]
        self.by_letters = self.by_words and lowers and splits[0].get("pattern") == LETTER_RUNS
        self.kind = np.dtype(np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)
        self.table = WordTable(self.kind)
        self.mark = self.encode_all([MARK])[0] if self.by_words else []

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: bytes) -> bool:
        """May the text spell an added token or compose a letter with a mark (U+0300 to U+037F)?"""
        if b"\xcc" in text or b"\xcd" in text:
            return True
        low = text.lower()
        return any(s in low for s in self.special)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case bytes of all texts, start and end of each word there, and each text's first word.
        Words end at blanks, newlines and, where the tokenizer ends them so too, before the punctuation
        after a letter."""
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        inside = (raw != 32) & (raw != 10)
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        low = raw
        if self.by_letters:
            low = _CASE[raw]
            letter = _LETTER[low]
            letter[1:] |= (raw[:-1] == 0xC3) & _SECOND[raw[1:]]
            start[1:] |= letter[:-1] & _PUNCTUATION[raw[1:]]
        a = np.flatnonzero(start)
        z = np.flatnonzero(inside[:-1] & (start[1:] | ~inside[1:])) + 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return low, a, z, np.searchsorted(a, np.concatenate([[1], 1 + np.cumsum(sizes + 1)]))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. One of plain lower-case letters is itself to the model, one of Latin
        letters by its bytes; others go through the whole tokenizer in texts of many words with
        marks between them."""
        if not self.by_letters:
            return self.encode_joined(words)
        merge, latin = self.tokenizer.model.tokenize, LATIN.fullmatch
        names = [
            w.decode() if w.isalpha() and w.islower() else w.translate(_LOWER).decode("latin-1").translate(_LETTERS) if latin(w) else None for w in words
        ]
        others = iter(self.encode_joined([w for w, n in zip(words, names, strict=True) if n is None]))
        return [next(others) if n is None else [t.id for t in merge(n)] for n in names]

    def encode_joined(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 4096):
            part = [w.decode("utf-8", "replace") for w in words[i : i + 4096]]
            if len(self.mark) == 1 and not any(MARK in w for w in part):
                ids = self.encode_all([f" {MARK} ".join(part)])[0]
                cut = [-1, *np.flatnonzero(np.array(ids) == self.mark[0]).tolist(), len(ids)]
                if len(cut) == len(part) + 1:
                    out += [ids[a + 1 : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    continue
            out += self.encode_all(part)
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Invalid UTF-8 reads as replacement characters."""
        whole = [i for i, t in enumerate(texts) if not self.by_words or (self.by_letters and self.whole(t))]
        out: list[np.ndarray] = [np.empty(0, self.kind)] * len(texts)
        for i, x in zip(whole, self.encode_all([texts[i].decode("utf-8", "replace") for i in whole]) if whole else [], strict=True):
            out[i] = np.array(x, self.kind)
        rest = sorted(set(range(len(texts))) - set(whole))
        for i, x in zip(rest, self.ids_by_words([texts[i] for i in rest]) if rest else [], strict=True):
            out[i] = x
        return out

    def ids_by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        low, a, z, first = self.words(texts)
        table, n = self.table, z - a
        word = lambda i: low[a[i] : z[i]].tobytes()
        key = span_hashes(low, a, z)
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        one = order[new]  # a word of each key, by key
        at, size, missing = table.find(key[one])
        unknown = np.flatnonzero(missing & (n[one] <= LONGEST))
        at[unknown], size[unknown] = fresh = table.put(self.encode_words([word(i) for i in one[unknown].tolist()]))
        kind = np.empty(len(key), np.int64)
        kind[order] = np.cumsum(new) - 1
        at, size, end = at[kind], size[kind].astype(np.int64), table.end
        if len(long := np.flatnonzero(n > LONGEST)):  # by their bytes, and not kept
            names = [word(i) for i in long.tolist()]
            number = {w: k for k, w in enumerate(dict.fromkeys(names))}
            place, length = table.put(self.encode_words(list(number)))
            which = np.array([number[w] for w in names])
            at[long], size[long] = place[which], length[which]
        edge = np.concatenate([[0], np.cumsum(size)])
        flat = table.pool[np.repeat(at - edge[:-1], size) + np.arange(edge[-1])]
        table.end = end
        table.add(key[one[unknown]], *fresh)  # may move all places
        return [flat[x:y] for x, y in zip(edge[first[:-1]], edge[first[1:]], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder that this worker keeps for its tasks."""
    return Encoder(path)
