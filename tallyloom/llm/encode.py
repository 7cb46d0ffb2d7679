"""Token ids of texts, by a public byte-level vocabulary of the tokenizers library."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex

from . import text

_ASCII_SPACE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
#: Bytes that may end, and that may begin, a character of white space.
_ENDS_SPACE = np.isin(np.arange(256), [*_ASCII_SPACE, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
_BEGINS_SPACE = np.isin(np.arange(256), [*_ASCII_SPACE, 0xC2, 0xE1, 0xE2, 0xE3])

#: How byte-level vocabularies of this kind part a text before merging.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Results kept in a worker by part, and as many by piece, at about 200 bytes each.
KEPT = 400_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Results by key. When there are many, they become the old ones, of which those that are asked for again are kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict[str | bytes, bytes] = {}

    def __missing__(self, key: str | bytes) -> bytes:
        if len(self) >= KEPT // 2:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


def _parted(file: dict) -> bool:
    """Whether a tokenizer's file is a byte-level BPE that parts texts as _PARTS does and changes nothing before."""
    parts, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = not any(model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return (
        file.get("normalizer") is None and parts.get("type") == "ByteLevel" and not parts.get("add_prefix_space", True) and parts.get("use_regex", True)
        and model.get("type") == "BPE" and plain and file.get("truncation") is None and file.get("padding") is None
    )


def _same(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes from each place on are those from the other place, of equally many."""
    from_here, same = text.eights(buf), np.ones(len(begin), bool)
    todo, step = np.flatnonzero(begin != other), 0
    while len(todo):
        left = size[todo] - step
        mask = text.LOW[np.minimum(left, 8)]
        equal = ((from_here[begin[todo] + step] ^ from_here[other[todo] + step]) & mask) == 0
        same[todo[~equal]] = False
        todo, step = todo[equal & (left > 8)], step + 8
    return same


class Encoder:
    """Ids in the narrowest of 16 and 32 bits that holds the vocabulary, the same that the library gives for each text.

    Byte-level BPE merges nothing across the parts of a text, so ids are kept by
    part, and by piece: a space with what follows up to the next. Each distinct
    piece of a batch is looked up once. Only a text with a space amid a run of
    white space may have a part that spans two pieces; such are encoded whole,
    and so are texts that hold the string of an added token, and all texts if
    the tokenizer is of another kind. If special is False, such strings are
    ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = not special
        file = json.loads(self.own.to_str())
        self.parted = _parted(file)
        self.added = [t["content"].encode() for t in file.get("added_tokens", []) if special or not t["special"]]
        narrow = max(self.own.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16
        self.dtype, self.code = ("<u2", "H") if narrow else ("<u4", "I")
        self.letters = _byte_letters()
        self.model = self.own.model
        self.parts = _Kept(self._part)
        self.pieces = _Kept(self._piece)

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        value = piece.decode()
        if value[0] == " " and value[1:].isalpha():
            return self._part(value)
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(value)))

    def whole(self, value: str | None) -> np.ndarray:
        return np.array(self.own.encode(value or "", add_special_tokens=False).ids, self.dtype)

    def _by_pieces(self, buf: np.ndarray, raw: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and where those of each begin."""
        end = np.append(begin[1:], len(buf))
        _, one, which = np.unique(text.span_hashes(buf, begin, end), return_index=True, return_inverse=True)
        # pieces of equal hash and other bytes are looked up by themselves
        odd = np.flatnonzero(~_same(buf, begin, end - begin, begin[one][which]) | (end - begin != (end - begin)[one][which]))
        which[odd] = len(one) + np.arange(len(odd))
        one = np.concatenate([one, odd])
        got = list(map(self.pieces.__getitem__, [raw[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist())]))
        size = np.fromiter(map(len, got), np.int64, len(got)) // np.dtype(self.dtype).itemsize
        flat = np.frombuffer(b"".join(got), self.dtype)
        many = size[which]
        done = np.cumsum(many)
        ids = flat[np.repeat((np.cumsum(size) - size)[which] - (done - many), many) + np.arange(done[-1])]
        return ids, np.concatenate([[0], done])

    def _held(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold the string of an added token."""
        found = [m.start() for content in self.added for m in re.finditer(re.escape(content), raw)]
        return np.searchsorted(off, np.array(found, np.int64), "right") - 1

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column one after another, and the n + 1 places where texts begin; nulls have none."""
        buf, off = text.flat(col)
        n = len(buf)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        raw = buf.tobytes()
        odd = range(len(off) - 1)
        if self.parted:
            space = buf == 32
            last = np.zeros(n, bool)
            last[off[1:][off[1:] > off[:-1]] - 1] = True
            follows = np.concatenate([_BEGINS_SPACE[buf[1:]], [True]]) | last
            leads = np.concatenate([[False], _ENDS_SPACE[buf[:-1]]])
            odd = {*(np.searchsorted(off, np.flatnonzero(space & leads & follows), "right") - 1).tolist(), *self._held(raw, off).tolist()}
            space[off[:-1][off[:-1] < n]] = True
            begin = np.flatnonzero(space)
            ids, before = self._by_pieces(buf, raw, begin)
            places = before[np.searchsorted(begin, off)]
            if not odd:
                return ids, places
        each = [self.whole(col[i].as_py()) if i in odd else ids[places[i] : places[i + 1]] for i in range(len(off) - 1)]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]
