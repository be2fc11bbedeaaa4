"""Token counts (operator 12): the exact number of tokens of every prefix of a text, by prefix dynamic programming.

``PrefixCounts.table(text)[k]`` is what the library counts for ``text[:k]`` alone, so how many tokens a text has, where to cut it
for a budget and what a slice at word ends costs are look-ups, without encoding again. A text's table is that of its words, each
added to what stands before it, since the pre-tokenizer never joins characters across white space. Within a word the
pre-tokenizer's pieces follow each other alike. Pieces that begin alike share their beginnings' counts: the library's model counts
each distinct beginning of a short piece once. Within a long piece the programme runs over its bytes: merges make at most one
encoding of a beginning, so the last token of a beginning is the one vocabulary entry that ends there and that merges leave
apart from the token before it; its count is one more than that of what stands before it. Whether two tokens stay apart is
remembered. At the ends of characters the same step is done with the end-of-word mark, which gives the count of the cut text.

Counts equal the tokenizers library's, strings of added tokens included (one id each). It reads vocabularies with byte
pairs, an end-of-word mark and letters, single digits and other signs as pieces (``word_bpe_49k.json``); another is refused.

A task holds a dictionary of words, bounded in characters, and works through very long texts part by part. A single word of
more than a thousand characters is not held; if normalising changes its length, its beginnings are counted one by one by the library.

Nulls: a null text is empty: no bytes, no tokens; a null ``doc_id`` stays null. Repeated rows give equal rows; an empty table gives
an empty result; further columns are ignored. No shuffle.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.tokens import LOWER_WORDS, vocabulary
from tidemark.llm.workers import held

LIMIT = 2048
#: Characters of words, pairs of tokens and beginnings of pieces that a worker holds.
MOST_CHARS, MOST_PAIRS, MOST_BEGUN = 3_000_000, 500_000, 600_000
#: Characters of a piece whose beginnings are counted once each and remembered; in longer ones the programme goes byte by byte.
SHORT = 40
#: Words worked on at once.
WORDS = 1 << 17
#: White space of Unicode: what the pre-tokenizer takes as such.
BLANK = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and not "\x1c" <= c <= "\x1f")
_unit = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
_plain = re.compile(r"[ -~\xa1-į]*")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"


class PrefixCounts:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(name))
        spec = json.loads(self.library.to_str())
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps[0].get("pattern", {}).get("Regex") != LOWER_WORDS:
            raise ValueError(f"no prefix counts for {name}: byte pairs of lower-case words with an end mark are needed")
        self.end, self.vocabulary = model["end_of_word_suffix"], model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocabulary))
        self.cut = regex.compile(LOWER_WORDS)
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = re.compile(f"({'|'.join(added)})") if added else None
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.printable = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[str, bytes] = {}
        self.held, self.pairs, self.begun, self.pieces = 0, {}, {}, {}
        self.model = self.library.model

    def merged(self, signs: list[str]) -> list[str]:
        while len(signs) > 1:
            ranks = [self.rank.get(pair, sys.maxsize) for pair in zip(signs, signs[1:])]
            if (best := min(ranks)) == sys.maxsize:
                break
            i = ranks.index(best)
            signs[i : i + 2] = [signs[i] + signs[i + 1]]
        return signs

    def apart(self, first: str, second: str) -> bool:
        """Whether merges leave the tokens side by side; ``first`` may be empty."""
        if (known := self.pairs.get((first, second))) is not None:
            return known
        body = second.removesuffix(self.end)
        signs = [*first, *body]
        signs[-1] += second[len(body) :]
        out = self.merged(signs) == ([first, second] if first else [second])
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[first, second] = out
        return out

    def piece(self, piece: str) -> list[int]:
        """Counts of the beginnings of one piece, of 1, 2, ... characters."""
        if len(piece) > SHORT:
            return self.programme(piece)
        if known := self.pieces.get(piece):
            return known
        if len(self.begun) > MOST_BEGUN:
            self.begun.clear()
            self.pieces.clear()
        begun, out = self.begun, []
        for k in range(1, len(piece) + 1):
            if not (n := begun.get(beginning := piece[:k])):
                n = begun[beginning] = len(self.model.tokenize(beginning.encode().decode("latin-1").translate(self.printable)))
            out.append(n)
        self.pieces[piece] = out
        return out

    def programme(self, piece: str) -> list[int]:
        """As ``piece``, of any length, in time linear in it: byte by byte, with the last token of every beginning."""
        signs = piece.encode().decode("latin-1").translate(self.printable)
        ends = set(accumulate(len(c.encode()) for c in piece))
        last, count, out = [""], [0], []
        entries, apart, mark = self.vocabulary, self.apart, self.end
        for i in range(1, len(signs) + 1):
            lowest = max(0, i - self.longest)
            if i in ends:
                for j in range(lowest, i):
                    if (token := signs[j:i] + mark) in entries and apart(last[j], token):
                        out.append(count[j] + 1)
                        break
            for j in range(lowest, i):
                if (token := signs[j:i]) in entries and apart(last[j], token):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        return out

    def _counted(self, texts: list[str]) -> list[int]:
        out = []
        for i in range(0, len(texts), 500):
            out += [len(e.ids) for e in self.library.encode_batch_fast(texts[i : i + 500], add_special_tokens=False)]
        return out

    def word(self, word: str) -> list[int]:
        """Counts of the beginnings of a word without white space and added tokens."""
        plain = _plain.fullmatch(word)
        low = word.lower() if plain else "".join(c.lower() for c in word)
        if not plain and (len(low) != len(word) or not unicodedata.is_normalized("NFC", word) or len(word) <= 64):
            return self._counted([word[:k] for k in range(1, len(word) + 1)])
        pieces = self.cut.findall(low) if plain else [low[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(low)]
        out, before = [], 0
        for piece in pieces:
            short = len(piece) > 1 and piece[0] == "'" and piece[1].isalpha()  # 's and the like are no piece when cut
            own = self._counted([piece[:k] for k in range(1, len(piece) + 1)]) if short else self.piece(piece)
            out += [before + n for n in own]
            before = out[-1]
        return out

    def learn(self, unit: str) -> bytes:
        word = unit.lstrip(BLANK)
        counts = np.array([0] * (len(unit) - len(word)) + self.word(word), "<i4").tobytes()
        if len(unit) <= 1000:
            if self.held > MOST_CHARS:
                self.known.clear()
                self.held = 0
            self.known[unit] = counts
            self.held += len(unit)
        return counts

    def _units(self, text: str) -> Iterator[tuple[str, bytes | None]]:
        """Units, and the counts of those that are added tokens: one at the end, while a beginning is text that joins the word before."""
        if self.added is None or not self.added.search(text):
            yield from ((m.group(), None) for m in _unit.finditer(text))
            return
        last = ""
        for k, part in enumerate(self.added.split(text)):
            if k % 2:
                joined = [0, *self.word(last + part[:-1])]
                yield part, np.array([*(n - joined[len(last)] for n in joined[len(last) + 1 :]), 1], "<i4").tobytes()
            else:
                last = part[max(map(part.rfind, BLANK)) + 1 :]
                yield from ((m.group(), None) for m in _unit.finditer(part))

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """The table of the text without its first place, part by part."""
        known, learn, before = self.known, self.learn, 0
        text = text or ""
        if len(text) <= 4 * WORDS and not (self.added and self.added.search(text)):
            counts = [known.get(u) or learn(u) for u in _unit.findall(text)]
            lists = [counts] if counts else []
        else:
            units = self._units(text)
            lists = iter(lambda: [c or known.get(u) or learn(u) for u, c in islice(units, WORDS)], [])
        for counts in lists:
            table = np.frombuffer(b"".join(counts), "<i4").astype(np.int64)
            lengths = np.fromiter(map(len, counts), np.int64, len(counts)) // 4
            totals = table[np.cumsum(lengths) - 1]
            ends = np.cumsum(totals)
            yield table + np.repeat(ends - totals + before, lengths)
            before += int(ends[-1])

    def table(self, text: str | None) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), *self.parts(text)])

    def count(self, text: str | None, limit: int = LIMIT) -> tuple[int, int]:
        """The number of tokens, and the length of the longest beginning with ``limit`` tokens at most."""
        n = at = cut = 0
        for part in self.parts(text):
            fitting = np.flatnonzero(part <= limit) if n or part.max() > limit else [len(part) - 1]
            cut = at + int(fitting[-1]) + 1 if len(fitting) else cut
            at, n = at + len(part), int(part[-1])
        return n, cut


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT, tables: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``SCHEMA``: bytes, tokens, whether they exceed ``limit``, and the characters that a cut to ``limit`` keeps.

    ``tables`` adds ``prefix_tokens``: counts of the beginnings of 0, 1, ... characters as little-endian 32-bit integers.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["prefix_tokens"] * tables
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()] + [pa.binary()] * tables

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held(f"prefixes {tokenizer}", lambda: PrefixCounts(tokenizer))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                n, cut = counts.count(text, limit)
                rows.append((doc_id, len(text.encode()), n, n > limit, cut, *([counts.table(text).astype("<i4").tobytes()] if tables else [])))
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(each, SCHEMA + ", prefix_tokens binary" * tables)


def op12_prefix_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
