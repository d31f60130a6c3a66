"""Whole-text encoding by a public tokenizer through a cache of its pre-tokens.

The ids of a text are the ids of its pre-tokens, one after another, and texts repeat their pre-tokens. The bytes of many texts are
divided at once, in NumPy, into units that the tokenizer treats by themselves whatever stands around them: a run of letters,
digits or marks (with the blank before it, where the vocabulary keeps blanks), or a run of white space. Arrow's dictionary
encoding leaves each distinct unit of a group once; a worker keeps the ids (or the count) of those that it has met, and hands
the others to the tokenizer. Words with characters or marks whose treatment isn't plain are one unit each; texts with
unusual white space go another way where blanks matter. The results are the library's own in each case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from threadloom.llm.common import CACHES

#: Python splits at these four controls, the tokenizers' patterns don't.
ODD = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(r"\s*\S+|\s+")
LONG = 64
GROUP_BYTES = 2 << 20
#: Characters of which every Unicode version agrees what they are, and which normal forms and lower-casing treat one by one.
SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]*")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The two vocabularies' patterns for such characters (fixed values; see the tokenizers' files).
BYTE_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \t\n\r{_L}{_N}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ \t\n\r{_L}{_N}]+")
LETTER, DIGIT, MARK, BLANK, ODD_SPACE, OTHER, LEAD = range(7)
_codecs: dict = {}
CACHES.append(_codecs)


def _byte_chars() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next free character from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + k for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def _class_tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of single bytes, and of the characters from U+0080 to U+017F, by the patterns above."""
    letter, digit = re.compile(f"[{_L}]"), re.compile(f"[{_N}]")

    def of(code: int) -> int:
        c = chr(code)
        if c in "\t\n\r ":
            return BLANK
        if c.isspace():
            return ODD_SPACE
        if not SAFE.fullmatch(c):
            return OTHER
        return LETTER if letter.match(c) else DIGIT if digit.match(c) else MARK

    one = np.array([of(b) if b < 128 else LEAD if 0xC2 <= b <= 0xC5 else OTHER for b in range(256)], np.uint8)
    return one, np.array([of(c) for c in range(128, 384)], np.uint8)


CLASS, CLASS_2 = _class_tables()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Last two bytes of the white space characters of three bytes, by the first byte.
SPACE_3 = {0xE1: [0x9A80], 0xE2: [*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F], 0xE3: [0x8080]}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character in UTF-8 data; BLANK for the four plain ones, ODD_SPACE for all other white space."""
    cls = CLASS[data]
    lead = np.flatnonzero(cls == LEAD)
    if len(lead):
        c = CLASS_2[((data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F) - 128]
        cls[lead], cls[lead + 1] = c, c
    at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    if len(at):
        rest = data[at + 1].astype(np.int64) << 8 | data[at + 2]
        for first, values in SPACE_3.items():
            cls[at[(data[at] == first) & np.isin(rest, values)]] = ODD_SPACE
    return cls


class _Store:
    """Ids of pre-tokens, one after another; a pre-token's slot says where its own are."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.start, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.slots = self.used = 0

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> range:
        """Slots of new entries with these lengths, whose ids are given one after another."""
        a, b = self.slots, self.slots + len(lengths)
        while b > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.length[a:b] = lengths
        self.start[a:b] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.slots, self.used = b, self.used + len(ids)
        return range(a, b)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the slots, and their ids one after another."""
        n = self.length[slots]
        end = np.cumsum(n)
        at = np.arange(end[-1] if len(end) else 0)
        at += np.repeat(self.start[slots] - end + n, n)
        return n, self.flat[at]


class WordCodec:
    """keep: "ids" for arrays of ids, "count" for numbers of tokens only.

    About max_entries pre-tokens are cached, in two generations: when the young one is half of that (or holds very many ids, as
    those of long pre-tokens, which no later text finds) it becomes the old one, and what is met again moves back. `seed` gives counts that are looked up before the cache and never leave.
    """

    def __init__(self, path: str, keep: str = "ids", max_entries: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.keep, self.max_entries = keep, max_entries
        self.drops_space = "ByteLevel" != type(self.tok.pre_tokenizer).__name__
        self.base: dict[bytes, int] = {}
        self.young, self.old = _Store(), _Store()
        self.seeded = ""

    def seed(self, base: dict[bytes, int], key: str) -> None:
        """Counts of frequent pre-tokens; key names them, so that a worker takes them over once."""
        self.base, self.seeded = base, key

    # dividing texts

    def units(self, data: np.ndarray, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of texts that lie one after another in UTF-8 data, and how many units each text has. Texts with odd white space must not be among them if blanks matter."""
        n = len(data)
        starts = ends - np.diff(ends, prepend=0)
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first = first[:n]
        cls = classes(data)
        blank = cls == BLANK
        if not n:
            return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(ends), np.int64)
        after_blank = np.concatenate([[True], blank[:-1]]) | first
        word = ~blank & after_blank
        bad = (cls >= ODD_SPACE) | (data == 39)
        bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        change = np.concatenate([[False], cls[1:] != cls[:-1]])
        if self.drops_space:
            change |= (cls == DIGIT) & ((data & 0xC0) != 0x80)
        inner = np.flatnonzero(change & ~blank & ~after_blank)
        bad = np.flatnonzero(bad)
        if len(bad):
            words = np.flatnonzero(word)
            plain = np.ones(len(words), bool)
            plain[np.searchsorted(words, bad, "right") - 1] = False
            inner = inner[plain[np.searchsorted(words, inner, "right") - 1]]
        if self.drops_space:
            word[inner] = True
            kept = ~blank
            at, data = np.flatnonzero(word[kept]), LOWER[data[kept]]
            ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        else:
            # white space: its last character goes with the word behind it if it is a blank, and is a unit else
            mark = first | (blank & ~np.concatenate([[False], blank[:-1]]))
            behind = np.flatnonzero(word & ~first)
            mark[behind - 1] = True
            mark[behind[data[behind - 1] != 32]] = True
            mark[inner] = True
            at = np.flatnonzero(mark)
        offsets = np.append(at, len(data)).astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return array.dictionary_encode(), np.diff(np.searchsorted(at, ends), prepend=0)

    # looking up

    def learn(self, keys: list[bytes]) -> list[list[int]]:
        """Ids of new units. Plain ones go part by part to the model, others to the tokenizer as they are."""
        out: list = [None] * len(keys)
        rest, tokenize, chars = [], self.model.tokenize, BYTE_CHARS
        parts, lowers = (WORD_PARTS if self.drops_space else BYTE_PARTS).findall, self.drops_space
        for i, key in enumerate(keys):
            s = key.decode()
            if len(key) > LONG or "<|" in s or not SAFE.fullmatch(s):
                rest.append(i)
                continue
            ids: list[int] = []
            for p in parts(s.lower() if lowers else s):
                ids += [t.id for t in tokenize(p.encode().decode("latin-1").translate(chars))]
            out[i] = ids
        if rest:
            for i, e in zip(rest, self.tok.encode_batch_fast([keys[i].decode() for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def _values(self, keys: list[bytes]) -> np.ndarray:
        """Per key its count, or its slot in the young generation. Long keys' slots are good for this call only."""
        if len(self.young.index) > self.max_entries // 2 or self.young.used > 8 * self.max_entries:
            self.young, self.old = _Store(), self.young
        young, old = self.young, self.old
        value = np.fromiter(map(young.index.get, keys, repeat(-1)), np.int64, len(keys))
        if self.base:
            near = np.fromiter(map(self.base.get, keys, repeat(-1)), np.int64, len(keys))
            value = np.where(near >= 0, near, value)
        miss = np.flatnonzero(value < 0)
        if not len(miss):
            return value
        if old.index:
            names = [keys[i] for i in miss.tolist()]
            was = np.fromiter(map(old.index.get, names, repeat(-1)), np.int64, len(names))
            again = np.flatnonzero(was >= 0)
            if len(again):
                value[miss[again]] = was[again] if self.keep == "count" else young.add(*old.gather(was[again]))
                young.index.update((keys[i], v) for i, v in zip(miss[again].tolist(), value[miss[again]].tolist()))
            miss = miss[was < 0]
        if len(miss):
            names = [keys[i] for i in miss.tolist()]
            learned = self.learn(names)
            lengths = np.fromiter(map(len, learned), np.int64, len(learned))
            value[miss] = lengths if self.keep == "count" else young.add(lengths, np.fromiter((x for ids in learned for x in ids), np.uint32, int(lengths.sum())))
            young.index.update((k, v) for k, v in zip(names, value[miss].tolist()) if len(k) <= LONG)
        return value

    def _texts(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units, n = self.units(data, ends)
        value = self._values(units.dictionary.to_pylist())[np.asarray(units.indices)]
        if self.keep == "count":
            lengths, ids = value, np.empty(0, np.uint32)
        else:
            lengths, ids = self.young.gather(value)
        total = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n)])]
        return np.diff(total), ids

    def _odd(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text with unusual white space, where blanks matter: divided by Python's idea of white space, or not at all if that isn't the tokenizer's."""
        text = data.tobytes().decode()
        if ODD.search(text):
            ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array([len(ids)]), ids
        value = self._values([x.encode() for x in CHUNK.findall(text)])
        if self.keep == "count":
            return np.array([value.sum()]), np.empty(0, np.uint32)
        n, ids = self.young.gather(value)
        return np.array([n.sum()]), ids

    def _odd_texts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the texts that units() can't take."""
        if self.drops_space:
            return np.empty(0, np.int64)
        return np.unique(np.searchsorted(ends, np.flatnonzero(classes(data) == ODD_SPACE), "right"))

    def plain(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that units() can take."""
        odd = self._odd_texts(data, ends)
        if not len(odd):
            return data, ends
        sizes = np.diff(ends, prepend=0)
        keep = np.ones(len(ends), bool)
        keep[odd] = False
        return data[np.repeat(keep, sizes)], np.cumsum(sizes[keep])

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text (which lie one after another in UTF-8 data, up to `ends`) its number of tokens; and all ids, if they are kept."""
        odd = self._odd_texts(data, ends)
        if not len(odd):
            return self._texts(data, ends)
        lengths, ids, a = [], [], 0
        for k in [*odd.tolist(), len(ends)]:
            if k > a:
                begin = int(ends[a - 1]) if a else 0
                got = self._texts(data[begin : int(ends[k - 1])], ends[a:k] - begin)
                lengths.append(got[0])
                ids.append(got[1])
            if k < len(ends):
                got = self._odd(data[int(ends[k - 1]) if k else 0 : int(ends[k])])
                lengths.append(got[0])
                ids.append(got[1])
            a = k + 1
        return np.concatenate(lengths), np.concatenate(ids)

    def encode_texts(self, texts: list[str]) -> list:
        """Per text an array of ids, or the count."""
        raw = [t.encode() for t in texts]
        n, ids = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64))
        return n.tolist() if self.keep == "count" else np.split(ids, np.cumsum(n)[:-1])

    def groups(self, batch: pa.RecordBatch, column: str = "text", limit: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, numbers of tokens, ids) of groups of the batch's rows, of about `limit` bytes. Null texts are empty; a longer text is divided before a blank and is a group by itself."""
        for first, data, ends in text_bytes(batch.column(batch.schema.get_field_index(column)), limit):
            if len(data) <= 2 * limit or len(ends) > 1:
                yield first, *self.encode(data, ends)
                continue
            got, a = [], 0
            if not self.drops_space and (classes(data) == ODD_SPACE).any():
                got = [self.encode(data, ends)]
                a = len(data)
            while a < len(data):
                b = _cut(data, a + limit)
                got.append(self.encode(data[a:b], np.array([b - a])))
                a = b
            yield first, np.array([sum(int(n.sum()) for n, _ in got)]), np.concatenate([ids for _, ids in got])


def _cut(data: np.ndarray, at: int, step: int = 1 << 16) -> int:
    """The first place from `at` on where a plain blank follows something else; the end if there is none."""
    while at < len(data):
        blank = CLASS[data[at - 1 : at + step]] == BLANK
        found = np.flatnonzero(blank[1:] & ~blank[:-1])
        if len(found):
            return at + int(found[0])
        at += step
    return len(data)


def text_bytes(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, ends) of groups of a string column's rows, at most `limit` bytes each unless a row by itself is longer; null texts are empty."""
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def codec(path: str, keep: str = "ids", max_entries: int = 1_000_000) -> WordCodec:
    """This worker's codec; it outlives a task. A worker keeps one: another vocabulary's goes when a new one is asked for."""
    key = (path, keep, max_entries)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = WordCodec(*key)
    return _codecs[key]
