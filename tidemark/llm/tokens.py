"""Whole texts to token ids with the tokenizers library, each distinct piece of a text once.

A text falls apart, without change of its ids, before every run of white space that follows another character: neither
pre-tokenizer of the public vocabularies joins characters across such a place. Such a unit (white space and the word after it)
of plain Latin characters is cut further as the vocabulary's own pre-tokenizer cuts it (letters, digits, other). The cuts of a
slice of texts are found by numpy over its bytes, Arrow finds the distinct pieces, a bounded dictionary has the place of
each one's ids, and those that are new go to the library's model, many in one call. Any other unit is looked up as one and goes to
the whole library when it is new; one of plain characters with a quote or more white space is cut by the pre-tokenizer's expression.
Texts with unusual white space, and texts that hold the string of one of the vocabulary's added tokens, are encoded as
a whole by the library, which makes one id of such a string; none of them is held.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from tidemark.llm.workers import held

#: Pieces, and units that are looked up as one, held by a worker: some 60 MB each. A full dictionary starts anew, which changes speed and no result.
MOST_UNITS = 350_000
#: Pieces that go to the library's model in one call.
CALL = 10_000
#: What these expressions cut alike in every Unicode version.
_plain = re.compile(r"[ -~\n\t\r\xa1-į]*")
#: The cuts of the two public vocabularies' pre-tokenizers. Fixed values.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Kinds of characters: white space between units, letters, digits, others, and what the cuts by kind do not settle.
BLANK, LETTER, DIGIT, OTHER, HARD = range(5)
_kinds = np.full(256, HARD, np.uint8)
_kinds[list(b" \n\t\r")] = BLANK
#: White space that no unit holds.
_odd = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n\t\r"]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary on this machine; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def distinct(data: bytes | np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings between the offsets, and which of them each is."""
    found = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()


class Ids:
    """Numbers of byte strings and, end to end, the ids of each; ``most`` of them; then all but those asked for go."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start = np.zeros(1, np.int64)  # one more than there are strings
        self.flat = np.zeros(0, np.uint32)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings with these numbers, end to end, and how many each has."""
        start = self.start[numbers]
        size = self.start[numbers + 1] - start
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def numbers(self, words: list[bytes], most: int, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of distinct strings; ``learn`` gives the ids of new ones, end to end, and how many each has."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        new = [words[i] for i in missing]
        flat, size = learn(new)
        if len(self.known) + len(new) > most:
            kept = np.flatnonzero(found >= 0)
            self.flat, sizes = self.take(found[kept])
            self.start = np.concatenate([[0], np.cumsum(sizes)])
            self.known = {words[i]: n for n, i in enumerate(kept)}
            found[kept] = np.arange(len(kept))
        n = len(self.known)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        found[missing] = np.arange(n, n + len(new))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        return found


class Encoder:
    """``encode(texts)``: for each text the library's ids as little-endian unsigned 32-bit integers, nothing added; null is empty."""

    def __init__(self, name: str, most: int = MOST_UNITS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(vocabulary(name))
        self.units, self.pieces = Ids(), Ids()
        spec = json.loads(self.library.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        steps = [spec["pre_tokenizer"], *(spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        pattern = next((x["pattern"].get("Regex") for x in steps if x and x["type"] == "Split"), None)
        self.lower = spec["normalizer"] is not None
        self.cut = None
        if spec["model"]["type"] == "BPE" and not spec["model"].get("continuing_subword_prefix"):
            if not self.lower and steps[0] and steps[0]["type"] == "ByteLevel" and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
                self.cut = regex.compile(BYTE_LEVEL)
            elif self.lower and pattern == LOWER_WORDS and [x["type"] for x in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.cut = regex.compile(LOWER_WORDS)
        #: The library's model, which knows a piece by the printable form of its bytes, with pieces between spaces.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.printable = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)} | {0: " "}
        if self.cut:
            suffix = spec["model"].get("end_of_word_suffix") or ""
            vocab = self.library.get_vocab(with_added_tokens=True)
            #: Bytes that a token stands for.
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.width[i] = len(token.removesuffix(suffix))
            kind = [next(k for k, p in enumerate((r"\s", r"\p{L}", r"\p{N}", r"(?s:.)")) if regex.match(p, chr(c))) if _plain.fullmatch(chr(c)) and c != 39 else HARD for c in range(0x130)]
            #: Kinds by byte, and by the two bytes of U+0080 to U+013F; small letters by the latter.
            self.kinds = np.array(kind[:128] + [HARD] * 128, np.uint8)
            self.kinds_2 = np.array(kind[128:] + [HARD] * 16, np.uint8)
            self.small_2 = np.array([ord(chr(c).lower()) if c < 0x130 else c for c in range(0x80, 0x140)], np.int64)

    @classmethod
    def of(cls, name: str, most: int = MOST_UNITS) -> Encoder:
        out = held(f"encoder {name}", lambda: cls(name))
        out.most = most
        return out

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = []
        for i in range(0, len(texts), 2000):
            ids += [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _learn_units(self, missing: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        units = [u.decode() for u in missing]
        is_plain = [self.cut is not None and _plain.fullmatch(u) is not None for u in units]
        cuts = [self.cut.findall(u.lower() if self.lower else u) for u, p in zip(units, is_plain, strict=True) if p]
        pieces = [p.encode() for unit in cuts for p in unit]
        names = list(dict.fromkeys(pieces))
        places = dict(zip(names, self.pieces.numbers(names, self.most, self._learn_pieces).tolist(), strict=True))
        flat, size = self.pieces.take(np.array([places[p] for p in pieces], np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(np.array([len(c) for c in cuts], np.int64))]
        rest, sizes = self._library([u for u, p in zip(units, is_plain, strict=True) if not p])
        made = Ids()
        made.flat = np.concatenate([flat, rest])
        made.start = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(ends, prepend=0), sizes]))])
        back = np.argsort(np.argsort(~np.array(is_plain), kind="stable"))
        return made.take(back)

    def _learn_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for i in range(0, len(pieces), CALL):
            some = pieces[i : i + CALL]
            if self.lower:
                some = [p.lstrip(b" \n\t\r") for p in some]
            text = b"\0".join(some).decode("latin-1").translate(self.printable)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends, stops = np.concatenate([[0], np.cumsum(self.width[ids])]), np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            after = np.searchsorted(ends[1:], stops, "right")
            if ends[-1] != stops[-1] or (ends[after] != stops).any():
                raise ValueError("the model's tokens do not add up to their pieces")
            flat.append(ids)
            sizes.append(np.diff(after, prepend=0))
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, some, size = [], [], 0
        for text in texts:
            some.append(text or "")
            size += len(text or "")
            if size > 4_000_000:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, text in enumerate(texts) if any(t in text for t in self.added) or any(c in text for c in _odd)]
        parts = [text.encode() for text in texts]
        for i in whole:
            parts[i] = b""
        data = b"".join(parts)
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        nonempty = np.concatenate([[0], stops])[[i for i, part in enumerate(parts) if part]]
        begins, hard, low = self._cuts(data, nonempty)
        flat, start, size = self._look_up(data, low, begins, hard)
        ends = np.cumsum(size)
        ids = flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4", copy=False).tobytes()
        at = (4 * np.concatenate([[0], ends])[np.searchsorted(begins, stops)]).tolist()
        out = [ids[i:j] for i, j in zip([0, *at], at)]  # noqa: B905
        for i in whole:
            out[i] = self._library([texts[i]])[0].astype("<u4", copy=False).tobytes()
        return out

    def _cuts(self, data: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces and hard units begin, which of them are hard, and the bytes as the pieces have them. ``texts``: where texts begin."""
        raw = np.frombuffer(data, np.uint8)
        low = np.frombuffer(data.lower(), np.uint8) if self.lower else raw
        kind = _kinds.take(raw) if self.cut is None else self.kinds.take(raw)
        blank = kind == BLANK
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[texts] = True
        starts = np.flatnonzero(first)
        if self.cut is None:
            return starts, np.ones(len(starts), bool), low
        two = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC4))
        char = (raw[two].astype(np.int64) - 0xC2) << 6 | raw[two + 1] & 0x3F
        kind[two] = kind[two + 1] = self.kinds_2[char]
        if self.lower and len(two):
            small = self.small_2[char]
            low = low.copy()
            low[two], low[two + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
        hard = np.zeros(len(starts), bool)
        bad = np.flatnonzero(kind == HARD)
        if not self.lower:  # white space is kept: one space joins what follows, one line end or tab stands alone
            bad = np.concatenate([bad, np.flatnonzero(blank[1:] & blank[:-1] & ~first[1:]), np.append(starts[1:], len(raw))[: len(starts)][blank[starts]] - 1])
            bad = bad[(kind[bad] == HARD) | blank[bad]]
        hard[np.searchsorted(starts, bad, "right") - 1] = True
        cut = first
        cut[1:] |= (kind[1:] != kind[:-1]) & ~blank[:-1]
        if self.lower:
            digit = np.flatnonzero(kind[1:] == DIGIT) + 1
            cut[digit[~blank[digit - 1]]] = True
            cut[two + 1] = False
        else:
            lines = np.flatnonzero(blank & (raw != 32))
            cut[lines[lines + 1 < len(raw)] + 1] = True
        if hard.any():
            length = np.diff(starts, append=len(raw))
            cut &= ~np.repeat(hard, length)
            cut[starts[hard]] = True
        begins = np.flatnonzero(cut)
        is_hard = np.zeros(len(begins), bool)
        is_hard[np.searchsorted(begins, starts[hard])] = True
        return begins, is_hard, low

    def _look_up(self, data: bytes, low: np.ndarray, begins: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place and number of the ids of each piece and hard unit, and the ids that these places are in."""
        length = np.diff(begins, append=len(data))
        start, size = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        flat = np.zeros(0, np.uint32)
        if hard.any():
            inside = np.repeat(hard, length)
            names, which = distinct(np.frombuffer(data, np.uint8)[inside], np.concatenate([[0], np.cumsum(length[hard])]))
            at = self.units.numbers(names, self.most, self._learn_units)[which]
            start[hard], size[hard] = self.units.start[at], self.units.start[at + 1] - self.units.start[at]
            flat, low, length = self.units.flat, low[~inside], length[~hard]
        easy = ~hard
        names, which = distinct(low, np.concatenate([[0], np.cumsum(length)]))
        at = self.pieces.numbers(names, self.most, self._learn_pieces)[which]
        start[easy], size[easy] = len(flat) + self.pieces.start[at], self.pieces.start[at + 1] - self.pieces.start[at]
        return np.concatenate([flat, self.pieces.flat]) if len(flat) else self.pieces.flat, start, size
