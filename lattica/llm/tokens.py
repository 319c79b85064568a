"""Byte-level BPE with a public vocabulary, as the tokenizers library encodes, faster by a memo of pre-tokens."""

from __future__ import annotations

import functools
import os
import re

from .common import Memo

#: Characters that every regex engine and Unicode version classes alike; a text with others goes to the library whole.
UNVETTED = re.compile(r"[^\t-\r -~\xa0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
#: Among the vetted characters: letters, numbers, white space.
LETTERS, NUMBERS, SPACES = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \xa0"
#: Split before the merges: contractions, letters, numbers, other signs, white space.
PRE_TOKEN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?(?:[{LETTERS}]+|[{NUMBERS}]+|[^{SPACES}{LETTERS}{NUMBERS}]+)|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; an absolute path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokenizer:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, runs: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [(t.content, i.to_bytes(4, "little")) for i, t in self.library.get_added_tokens_decoder().items()]
        self.memo = Memo(self._merge_function(path), 100_000)
        self.chunks = Memo(self._run, runs)

    def _merge_function(self, path: str):
        """Encoder of one pre-token: tiktoken's merges where the file's ids are its merge ranks, else the library."""
        import json
        from array import array

        import tiktoken

        from .bpe import byte_chars

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(byte_chars())}
        in_order = (x if isinstance(x, str) else " ".join(x) for x in model["merges"])
        ranked = all(model["vocab"].get(x.replace(" ", "")) == 256 + i for i, x in enumerate(in_order))
        if not ranked or any(model["vocab"].get(c, 256) > 255 for c in back) or array("I").itemsize != 4:
            return self._whole
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(model["merges"])}
        core = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return lambda piece: array("I", core.encode_single_piece(piece.encode())).tobytes()

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunk(self, text: str) -> bytes:
        return b"".join([self.memo[x] for x in PRE_TOKEN.findall(text)])

    def _run(self, run: str) -> bytes:
        """Ids of a blank and the run that follows it; a run of letters is one pre-token."""
        return self.memo[" " + run] if run.isalpha() else self._chunk(" " + run)

    def _parts(self, text: str) -> list[bytes]:
        # control characters are signs to every engine, so ASCII needs no look at its characters
        if not text.isascii() and UNVETTED.search(text) or any(content in text for content, _ in self.special):
            return [self._whole(text)]
        if "  " in text:
            return [self._chunk(text)]
        first, *rest = text.split(" ")  # a single blank always begins a pre-token
        return [self._chunk(first), *map(self.chunks.__getitem__, rest)]

    def encode(self, text: str) -> bytes:
        return b"".join(self._parts(text))

    def count(self, text: str) -> int:
        """Number of ids."""
        return sum(map(len, self._parts(text))) // 4


@functools.cache
def byte_tokenizer(path: str, runs: int = 600_000) -> ByteTokenizer:
    """One tokenizer for each worker process, which remembers at most ``runs`` runs between blanks."""
    return ByteTokenizer(path, runs)
