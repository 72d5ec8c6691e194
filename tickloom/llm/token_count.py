"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name
from tickloom.llm.hashing import frugal

#: Pre-token counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000
#: Bytes of new pre-tokens merged in one go.
MERGED_BYTES = 4_000_000
#: Longest pre-token, in bytes, whose count is remembered.
REMEMBERED_BYTES = 64

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, to its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Merges of a tokenizer file: for a pair of symbols its rank and the symbol it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.n = max(vocab.values()) + 1
        split = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        code = np.array([vocab[a] * self.n + vocab[b] for a, b in split], np.int64)
        made = np.array([vocab[a + b] for a, b in split], np.int64)
        bits = int(np.ceil(np.log2(max(2, len(code)) * 4)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        self.made = made
        slot, todo = self._slot(code), np.arange(len(code))
        while len(todo):  # open addressing: of those that want one free slot, one gets it a round
            free = self.key[slot[todo]] < 0
            at, who = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][who]
            self.key[at], self.value[at] = code[put], put
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = np.where(self.key[slot[todo]] >= 0, (slot[todo] + 1) & self.mask, slot[todo])
        self.special = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t, _ in sorted(self.special, key=lambda t: -len(t[0])))) if self.special else None
        self.known: dict[str, int] = {}

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, code: np.ndarray) -> np.ndarray:
        """Rank of each pair code; the number of merges where there is none."""
        none, slot = len(self.made), self._slot(code)
        key = self.key[slot]
        out = np.where(key == code, self.value[slot], none)
        on = np.flatnonzero((key >= 0) & (key != code))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            key = self.key[slot[on]]
            hit = key == code[on]
            out[on[hit]] = self.value[slot[on[hit]]]
            on = on[(key >= 0) & ~hit]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word. All words merge at once, each the pair that has its own lowest rank."""
        size = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        left = np.zeros(len(words), np.int64)
        none = len(self.made)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            rank[pair] = self.ranks(symbols[pair] * self.n + symbols[pair + 1])
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(symbols)])
            low = np.minimum.reduceat(rank, start)
            done = low == none
            left[owner[start[done]]] = length[done]
            hit = (rank == np.repeat(low, length)) & (rank < none)
            at = np.flatnonzero(hit)  # of overlapping hits, as in aaa, the first, third, ... merge
            run = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stay = np.repeat(~done, length)
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return left

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside a text are one token each, as is the library's default."""
        split, extra, known = [], [], self.known
        for text in texts:
            n = 0
            if self.special_pattern is not None and "<|" in text:
                pieces = self.special_pattern.split(text)
                n = len(pieces) - 1
                found = [w for p in pieces for w in self.pattern.findall(p)]
            else:
                found = self.pattern.findall(text)
            split.append(found)
            extra.append(n)
        new = list({w for found in split for w in found if w not in known})
        local: dict[str, int] = {}
        at = 0
        while at < len(new):
            end, size, raw = at, 0, []
            while end < len(new) and size < MERGED_BYTES:
                raw.append(new[end].encode("utf-8"))
                size += len(raw[-1])
                end += 1
            for word, b, n in zip(new[at:end], raw, self.counts(raw).tolist()):
                (known if len(b) <= REMEMBERED_BYTES else local)[word] = n
            at = end
        if local:
            out = [sum([known[w] if w in known else local[w] for w in found]) + n for found, n in zip(split, extra)]
        else:
            out = [sum(map(known.__getitem__, found)) + n for found, n in zip(split, extra)]
        if len(known) > REMEMBERED:
            known.clear()
        return out


_tables: dict[str, MergeTable] = {}


def _table(path: str) -> MergeTable:
    """A file's merges, read once a worker: tasks reach this function, and with it the worker's own memory, by its name."""
    if path not in _tables:
        _tables[path] = MergeTable(path)
    return _tables[path]


def token_counts(docs: DataFrame, tokenizer_file: str, text: str = "text", into: str = "n_tokens", batch_chars: int = 4_000_000) -> DataFrame:
    """`docs` with the number of tokens of each whole text in column `into` (long), which replaces one of that name.

    `tokenizer_file` is a byte-level BPE file in the tokenizers JSON format, present on every executor. Null and
    empty texts have 0 tokens. Rows are independent: repeated rows and ties get equal counts, order plays no part,
    and nothing is shuffled. Texts are taken in groups of about `batch_chars` characters; one longer text is a group
    of its own.
    """
    carried = [c for c in docs.columns if c.lower() != into.lower()]
    source = free_name(docs, "counted_text")
    rows = docs.select(*carried, F.col(text).alias(source))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer_file)
        for batch in batches:
            out, group, size = [], [], 0
            for x in batch.column(batch.num_columns - 1):
                group.append(x.as_py() or "")
                size += len(group[-1])
                if size >= batch_chars:
                    out += table.count_texts(group)
                    group, size = [], 0
            out += table.count_texts(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], [*carried, into])

    return rows.mapInArrow(frugal(count), f"{schema}{', ' if schema else ''}`{into}` bigint")
