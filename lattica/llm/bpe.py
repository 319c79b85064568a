"""Operator 2: BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs by binary search over
sorted pair keys, finds the lowest rank of every word and merges it everywhere in that word; words without a
known pair leave the array. Only words that a worker hasn't met are encoded; a bounded memo holds the others.

Defined cases: a null text is encoded as the empty text (no ids, empty decoded text); a null id column stays null;
extra columns are ignored; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks
from .tokens import LETTERS, NUMBERS, SPACES, UNVETTED

#: The word pattern of the vocabulary's pre-tokenizer; white space is dropped.
WORD_PATTERN = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
NEVER = np.int64(1) << 40


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with word-end suffix."""

    memo_limit = 300_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.memo: dict[str, tuple[bytes, str]] = {}
        self._library = None
        self._path = path

    @property
    def library(self):
        """The library's normaliser and splitter, for texts with characters on which regex engines may differ."""
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each non-empty word, given as its UTF-8 bytes."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, owner = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[flat[last]]
        done_symbols, done_owner = [], []
        while len(symbols):
            keys = np.full(len(symbols), -1, dtype=np.int64)
            keys[:-1] = np.where(owner[:-1] == owner[1:], symbols[:-1] * self.size + symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(self.keys[at] == keys, self.ranks[at], NEVER)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.r_[starts, len(symbols)]))
            over = best == NEVER
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
            hit = np.flatnonzero((rank == best) & ~over)
            if len(hit) > 1:  # of pairs that overlap ("aaa") every other one is merged, from the left
                heads = np.r_[True, np.diff(hit) != 1]
                place = np.arange(len(hit)) - np.maximum.accumulate(np.where(heads, np.arange(len(hit)), 0))
                hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.split(symbols[order], np.flatnonzero(np.diff(owner[order])) + 1)

    def words(self, text: str) -> list[str | int]:
        """Runs without white space, or pre-tokens where characters are unusual; special tokens appear as their id."""
        if self.special_split and any(s in text for s in self.special):
            found: list[str | int] = []
            for part in self.special_split.split(text):
                found += [self.special[part]] if part in self.special else self._plain(part)
            return found
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not UNVETTED.search(text):
            return text.split()
        normal = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(byte_chars())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return ["\0" + bytes(back[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    @staticmethod
    def _pre_tokens(run: str) -> list[str]:
        """Pre-tokens of a run without white space; those marked by the library's splitter stay whole."""
        return [run[1:]] if run[0] == "\0" else WORD_PATTERN.findall(run.lower())

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text the ids (little-endian unsigned 32-bit) and the text decoded from them."""
        split = [self.words(t) for t in texts]
        memo = self.memo
        if len(memo) > self.memo_limit:
            memo.clear()
        new = {w for ws in split for w in ws if w not in memo}
        parts = {w: self._pre_tokens(w) for w in new if isinstance(w, str)}
        plain = sorted({p for ps in parts.values() for p in ps})
        known = dict(zip(plain, self.encode_words([w.encode("utf-8", "surrogateescape") for w in plain]), strict=True))
        for w in new:
            ids = [w] if isinstance(w, int) else [i for p in parts[w] for i in known[p].tolist()]
            memo[w] = np.array(ids, dtype="<u4").tobytes(), self.decode(ids)
        out = []
        for ws in split:
            found = [memo[w] for w in ws]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out

    def decode(self, ids) -> str:
        """Tokens joined by blanks, as a vocabulary without a decoder is decoded; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i < self.size])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids BINARY, decoded STRING): whole texts encoded, and decoded again from the ids."""
    schema = pa.schema([("key", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                found = bpe.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], schema=schema)

    source = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("value"))
    return source.mapInArrow(run, "key long, ids binary, decoded string").withColumnRenamed("key", id_col)
