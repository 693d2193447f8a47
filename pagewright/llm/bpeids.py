"""Ids of whole texts by a byte-level BPE file of the tokenizers library, as packed little-endian 32-bit numbers.

A text is cut where white space follows something else; the pre-tokenizer always cuts there too, and looks no further back, so the
chunks can be encoded one by one. A worker keeps the ids of chunks that it has seen, MEMO of them at most. Unknown chunks are
encoded together by tiktoken from the same file's vocabulary if they consist of characters below U+0250, on whose classes all
versions of Unicode agree; others by the tokenizers library itself. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Chunks whose ids a worker keeps; when it has more, it starts anew.
MEMO = 300_000
#: Characters of unknown chunks that are encoded at once.
TOGETHER = 1 << 18
#: White space is what Unicode calls so: Python's class without the four separators of ASCII.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
PLAIN = re.compile("[\0-ɏ]*").fullmatch
_loaded: dict[str, Ids] = {}


class Ids:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = self._bytes()
        ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if all(c in byte for c in token)}
        self.quick = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, n in ranks.items():
            self.width[n] = len(token)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _bytes() -> dict[str, int]:
        """The byte for which each character of the vocabulary stands: printable ones for themselves, the others from U+0100 on."""
        own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        rest = [b for b in range(256) if b not in own]
        return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of these distinct chunks into the memo."""
        plain, held = [], 0
        for c in chunks:
            if not PLAIN(c):
                self.memo[c] = np.array(self.whole.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            elif c[0].isspace() and not c[-1].isspace():
                plain.append(c)
                held += len(c)
                if held > TOGETHER:
                    self._together(plain)
                    plain, held = [], 0
            else:
                self.memo[c] = np.array(self.quick.encode_ordinary(c), "<u4").tobytes()
        if plain:
            self._together(plain)

    def _together(self, chunks: list[str]) -> None:
        """Chunks that begin with white space and end with something else: one text, whose ids are parted by their bytes."""
        ids = np.array(self.quick.encode_ordinary("".join(chunks)), "<u4")
        ends = np.cumsum([len(c.encode()) for c in chunks])
        cuts = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1).tolist()
        data, at = ids.tobytes(), 0
        for c, z in zip(chunks, cuts, strict=True):
            self.memo[c] = data[4 * at : 4 * z]
            at = z

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out = []
        for text in texts:
            chunks = CHUNK.findall(text)
            new = {c for c in chunks if c not in self.memo}
            if new:
                if len(self.memo) + len(new) > MEMO:
                    self.memo.clear()
                    new = set(chunks)
                self.learn(list(new))
            out.append(b"".join([self.memo[c] for c in chunks]))
        return out


def loaded(path: str | None = None) -> Ids:
    """The encoder of a file, kept by the worker; without a path, that of the byte-level file with 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]
