"""Tokenizers of the public vocabularies, loaded once in each worker.

The folder of the vocabulary files is a parameter everywhere; it must be
readable at the same path on all nodes.  Nothing is trained here.
"""

from __future__ import annotations

import base64
import os
import re

FOLDER = "/opt/tokenizers"
#: The pre-tokenising pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def byte_bpe(name: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER):
    """A byte-level BPE encoding without special tokens."""
    path = os.path.join(folder, name)
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


class PieceEncoder:
    """SentencePiece encoding and decoding with a bounded cache of word encodings.

    No piece has the space mark after another character, so merges never leave
    a run of spaces and the word after it; words are encoded one by one and
    their ids joined.  ``encode`` equals the library's result.
    """

    def __init__(self, path: str, cache_rows: int = 60_000, cache_chars: int = 48):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache_rows, self.cache_chars = cache_rows, cache_chars
        self.cache: dict[str, list[int]] = {}
        self.split = re.compile(r" +[^ ]*").findall
        self.bytes: list[bytes] = []
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of this model cross words")
        for i, p in enumerate(pieces):
            if self.sp.is_byte(i):
                self.bytes.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes.append(b"" if self.sp.is_control(i) else p.replace("▁", " ").encode())
        self.space = self.sp.piece_to_id("▁")

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "▁" in text or "\0" in text:
            return self.sp.encode(text)
        words = self.split(" " + text)
        cache = self.cache
        new = [w for w in {*words} if w not in cache]
        if new:
            if len(cache) > self.cache_rows:
                cache.clear()
                new = [*{*words}]
            known = dict(zip(new, self.sp.encode([w[1:] for w in new], num_threads=1)))
            if " " in known:
                known[" "] = [self.space]
            own = {w: ids for w, ids in known.items() if len(w) <= self.cache_chars}
            cache.update(own)
            if len(own) < len(known):
                out = []
                for w in words:
                    out += cache[w] if len(w) <= self.cache_chars else known[w]
                return out
        out = []
        for w in words:
            out += cache[w]
        return out

    def decode(self, ids) -> str:
        raw = b"".join([self.bytes[i] for i in ids])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def pieces(name: str = "piece_bpe_32k.model", folder: str = FOLDER) -> PieceEncoder:
    path = os.path.join(folder, name)
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]
