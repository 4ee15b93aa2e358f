"""Byte-level BPE over whole Arrow batches, with the public vocabulary files."""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

#: The folder must lie at the same path on every machine; TOKENIZERS_DIR names another one.
DEFAULT_VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern knows it, in runs that its lookahead would need too deep a stack for.
LONG_RUN = 50_000
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)

_loaded: dict[str, "Bpe"] = {}


class Bpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.token_bytes = np.zeros(self.size, np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts in a row, first token of each text and the end). A null counts as empty."""
        lists = [self.ids(t) if t else [] for t in texts.to_pylist()]
        off = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=off[1:])
        return np.fromiter(chain.from_iterable(lists), np.int32, int(off[-1])), off

    def ids(self, text: str) -> list[int]:
        """Ids of one text of any length.

        The pattern takes a run of white space before other text as one piece but for its last character, and a run at
        the end whole. Long runs are cut out just there and encoded as the piece they are, so the ids are the plain encoder's.
        """
        encode = self.encoding.encode_ordinary
        if len(text) < LONG_RUN:
            return encode(text)
        out, at = [], 0
        for run in _RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += encode(text[at : run.start()])
            out += self.encoding._core_bpe.encode_single_piece(text[run.start() : stop].encode())
            at = stop
        return out + encode(text[at:])

    def decode(self, ids) -> str:
        return self.encoding.decode(list(ids))


def load(path: str = DEFAULT_VOCABULARY) -> Bpe:
    """The vocabulary file's encoder, read once by each worker process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
