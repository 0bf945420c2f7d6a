"""Token ids of whole texts by the tokenizers library's model, word by word.

No pre-token spans white space in the models this is for, so a text's ids are those of its words.
Words are found in the bytes of a column, A-Z in lower case, and looked up by two 64-bit hashes in a
flat table, in which a worker keeps the ids of the words it has seen (a bounded number of them). New
words of plain Latin characters are cut into their pre-tokens, which repeat much more and are kept
too; new pre-tokens of byte-level BPE models are merged all at once in flat arrays. The library
encodes what is left, many in one string with a special token between them. A model for which a text's
ids are not those of its words is refused, and one for which a word's are not those of these
pre-tokens, or a pre-token's not those of these merges, is left to the library there.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from slotledger.llm.arrays import Words, mix, ragged
from slotledger.llm.pieces import PairTable

MOST_WORDS = 1_000_000
UNITS_PER_WORD = 0.5
CHUNK = 20_000
#: Words that are looked up at once, and the bytes that are hashed at once. A longer word is not kept.
AT_ONCE, SPAN, LONG_WORD = 400_000, 1 << 18, 1 << 16
#: Bytes of a pre-token that is merged in flat arrays.
LONG_UNIT = 64
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_LINES = re.compile("[!-~À-ÖØ-öø-ÿ\n]*")
_UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_UNIT_PROBES = ["It's", "WE'RE", "x1y22", "a.b,c!!", "Éa-ß_Ñ", "''s'", "$$$%&", "ÄÖÜ'll", "token=\"04db\"", "o'd've"]
_PROBES = ["a b", "it 's", "e ́", "a \n\t b  c", " x ", "1 2", "! ?", "Σ Σ"]
_U = np.uint64
_NO_RANK = np.int64(1 << 40)


def _powers(step: int) -> np.ndarray:
    out = np.ones(SPAN + LONG_WORD + 1, _U)
    out[1:] = np.multiply.accumulate(np.full(len(out) - 1, step, _U))
    return out


class WordHashes:
    """Two 64-bit hashes of the bytes of words, from running sums of their polynomials."""

    def __init__(self):
        self.parts = []
        for step in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15):
            letters = mix(np.arange(1, 257, dtype=_U) * _U(step))
            self.parts.append((letters, _powers(step), _powers(pow(step, -1, 1 << 64))))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        out = [np.empty(len(start), _U) for _ in self.parts]
        size, at = (end - start).astype(_U), 0
        while at < len(start):
            low = int(start[at])
            stop = int(np.searchsorted(start, low + SPAN))
            part, span = slice(at, stop), data[low : int(end[stop - 1])]
            here, there = start[part] - low, end[part] - low
            for found, (letters, powers, inverse) in zip(out, self.parts, strict=True):
                upto = np.zeros(len(span) + 1, _U)
                np.cumsum(letters[span] * powers[: len(span)], out=upto[1:])
                found[part] = mix((upto[there] - upto[here]) * inverse[here] + size[part])
            at = stop
        return out


class WordTable:
    """Lists of ids by the two hashes of a word, in open addressing and flat arrays."""

    def __init__(self, most: int):
        self.bits = max(8, (2 * (most + AT_ONCE)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = [np.zeros(0, _U), np.zeros(0, _U)]
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.starts)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        found, rest = np.full(len(first), -1, np.int64), np.arange(len(first))
        at = (first >> _U(64 - self.bits)).astype(np.int64)
        while len(rest):
            slot = self.slots[at]
            used = slot >= 0
            rest, at, slot = rest[used], at[used], slot[used]
            hit = (self.keys[0][slot] == first[rest]) & (self.keys[1][slot] == second[rest])
            found[rest[hit]] = slot[hit]
            rest, at = rest[~hit], (at[~hit] + 1) & (len(self.slots) - 1)
        return found

    def add(self, first: np.ndarray, second: np.ndarray, kept: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Entries for words that are not there; those that are not ``kept`` cannot be found again."""
        base = len(self)
        self.keys = [np.concatenate(pair) for pair in zip(self.keys, (first, second), strict=True)]
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
        rest = base + np.flatnonzero(kept)
        at = (self.keys[0][rest] >> _U(64 - self.bits)).astype(np.int64)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            left = self.slots[at] != rest
            rest, at = rest[left], (at[left] + 1) & (len(self.slots) - 1)


class Merges:
    """The merges of a byte-level BPE model with a mark at a word's end, over many words at once."""

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        # bytes that print stand for themselves, the others for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = dict(zip(shown, map(chr, shown), strict=True))
        letters |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pairs[vocabulary[left], vocabulary[right]] = vocabulary[left + right], rank
        self.pairs = PairTable(pairs)

    @staticmethod
    def of(path: str) -> Merges | None:
        """The merges of the model at ``path``, if it is of the kind that these are for."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        )
        if not plain or "ByteLevel" not in json.dumps(whole["pre_tokenizer"]):
            return None
        try:
            return Merges(model)
        except KeyError:  # some byte or merge is not in the vocabulary
            return None

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, and how many each has."""
        lengths = np.array([len(u) for u in units], np.int64)
        flat = np.frombuffer(b"".join(units), np.uint8)
        symbols, owner = self.inner[flat], np.repeat(np.arange(len(units)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # the entry of each symbol with the next one of its unit
        entry = np.full(len(symbols), -1, np.int64)
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        entry[joined] = self.pairs.find(symbols[joined], symbols[joined + 1])
        while len(symbols):
            rank = np.where(entry >= 0, self.pairs.rank[entry], _NO_RANK)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            counts = np.diff(np.append(first, len(owner)))
            best = np.minimum.reduceat(rank, first)
            closed = np.repeat(best == _NO_RANK, counts)
            if closed.any():
                done.append((owner[closed], symbols[closed]))
                keep = ~closed
                symbols, owner, entry, rank = symbols[keep], owner[keep], entry[keep], rank[keep]
                counts, best = counts[best < _NO_RANK], best[best < _NO_RANK]
            if not len(symbols):
                break
            # the leftmost best pair of each unit
            hits = np.flatnonzero(rank == np.repeat(best, counts))
            at = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]
            symbols[at] = self.pairs.merged[entry[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, entry = symbols[keep], owner[keep], entry[keep]
            at = at - np.arange(len(at))
            changed = np.concatenate((at[at > 0] - 1, at))
            changed = changed[changed + 1 < len(symbols)]
            entry[at] = -1
            same = owner[changed] == owner[changed + 1]
            entry[changed] = -1
            changed = changed[same]
            entry[changed] = self.pairs.find(symbols[changed], symbols[changed + 1])
        owner, symbols = (np.concatenate(parts) for parts in zip(*done, strict=True)) if done else (owner, symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(owner, minlength=len(units))


class Ragged:
    """Lists of ids by string, in one flat array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, ids))

    def get(self, lists: list[list[str]], learn) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists of names one after the other, and how many each list has.

        ``learn`` is called with the names that are not known, each once, and must add them.
        """
        counts = np.array([len(x) for x in lists], np.int64)
        names = list(chain.from_iterable(lists))
        index = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            wanted = [names[k] for k in missing]
            learn(list(set(wanted)))
            index[missing] = np.fromiter(map(self.known.__getitem__, wanted), np.int64, len(wanted))
        sizes = self.sizes[index]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        return self.ids[ragged(self.starts[index], sizes)], np.diff(ends)


class WordEncoder:
    def __init__(self, path: str, most_words: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.most_words, self.most_units = most_words, int(UNITS_PER_WORD * most_words)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        special = [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = max(special) if special else (-1, "")
        self.special = [content for _, content in special]
        check_by_word(self)
        self.by_unit = all(self.whole(w) == [k for u in _units(w) for k in self.whole(u)] for w in _UNIT_PROBES)
        self.hashes, self.words, self.units = WordHashes(), WordTable(most_words), Ragged()
        self.merges = Merges.of(path)
        if self.merges:
            units = list(chain.from_iterable(map(_units, _UNIT_PROBES)))
            ids, sizes = self.merges([u.encode() for u in units])
            if (ids.tolist(), sizes.tolist()) != ([k for u in units for k in self.whole(u)], [len(self.whole(u)) for u in units]):
                self.merges = None

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_units(self, units: list[str]) -> None:
        if self.merges and self.by_unit:
            own, units = units, []
            whole = _PLAIN_LINES.fullmatch("\n".join(own)) and not any(x in u for x in self.special for u in own)
            short = [u for u in own if len(u) <= LONG_UNIT and (whole or self._is_unit(u))]
            if len(short) < len(own):
                units = list(set(own) - set(short))
            if short:
                self.units.add(short, *self.merges([u.encode() for u in short]))
        plain = [u for u in units if self.mark and self.mark not in u]
        for begin in range(0, len(plain), CHUNK):
            part = plain[begin : begin + CHUNK]
            joined = self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, np.uint32)
            marks = ids == self.mark_id
            cuts = np.concatenate(([-1], np.flatnonzero(marks), [len(ids)]))
            if len(cuts) != len(part) + 1:
                raise ValueError("the special token does not part words in this model")
            self.units.add(part, ids[~marks], np.diff(cuts) - 1)
        for unit in (u for u in units if not self.mark or self.mark in u):
            ids = np.array(self.whole(unit), np.uint32)
            self.units.add([unit], ids, np.array([len(ids)]))

    def _cuttable(self, word: str) -> bool:
        return self.by_unit and _PLAIN.fullmatch(word) is not None and not any(x in word for x in self.special)

    def _is_unit(self, unit: str) -> bool:
        return self._cuttable(unit) and _UNIT.fullmatch(unit) is not None

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        lines = "\n".join(words)
        if self.by_unit and _PLAIN_LINES.fullmatch(lines) and not any(x in lines for x in self.special):
            units = list(map(_UNIT.findall, lines.lower().split("\n")))
        else:
            units = [_units(w) if self._cuttable(w) else [w] for w in words]
        if len(self.units.known) > self.most_units:
            self.units = Ragged()
        return self.units.get(units, self._learn_units)

    def _of_words(self, words: Words, part: slice) -> tuple[np.ndarray, np.ndarray]:
        start, end = words.start[part], words.end[part]
        kept = end - start <= LONG_WORD
        first, second = (np.zeros(len(start), _U) for _ in range(2))
        first[kept], second[kept] = self.hashes(words.data, start[kept], end[kept])
        # words too long to keep are told apart by where they are
        first[~kept], second[~kept] = start[~kept].astype(_U), 0
        if len(self.words) > self.most_words:
            self.words = WordTable(self.most_words)
        index = self.words.find(first, second)
        index[~kept] = -1
        missing = np.flatnonzero(index < 0)
        if len(missing):
            order = missing[np.lexsort((second[missing], first[missing], ~kept[missing]))]
            new = np.ones(len(order), bool)
            new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            new |= ~kept[order]
            index[order] = len(self.words) + np.cumsum(new) - 1
            one = order[new]
            whole = words.data[start[0] : end[-1]].tobytes()
            low = int(start[0])
            texts = [whole[a - low : b - low].decode("utf-8", "replace") for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            self.words.add(first[one], second[one], kept[one], *self._learn(texts))
        sizes = self.words.sizes[index]
        return self.words.ids[ragged(self.words.starts[index], sizes)], sizes

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with ``end_id`` after it, and n + 1 offsets."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        words = Words(column)
        data = words.data.tobytes()
        if any(x.lower().encode() in data for x in self.special):
            words = Words(column, lower=False)  # a special token is one in its own case only
        parts = [self._of_words(words, slice(k, k + AT_ONCE)) for k in range(0, len(words.start), AT_ONCE)]
        ids, sizes = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum(sizes)))[words.first]
        if end_id is not None:
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        return ids, offsets


def _units(word: str) -> list[str]:
    return _UNIT.findall(word.lower())


def check_by_word(encoder: WordEncoder) -> None:
    """Refuse a model in which the ids of a text are not those of its words."""
    for text in _PROBES:
        if encoder.whole(text) != [k for word in text.split() for k in encoder.whole(word)]:
            raise ValueError("this model's tokens depend on white space; encode its texts whole")


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def load(path: str, most_words: int = MOST_WORDS) -> WordEncoder:
    """The model at ``path``, read once by each worker, with a cache of about ``most_words`` words."""
    if (path, most_words) not in _ENCODERS:
        _ENCODERS[path, most_words] = WordEncoder(path, most_words)
    return _ENCODERS[path, most_words]


def crc32(ids: np.ndarray) -> int:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
