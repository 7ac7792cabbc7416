"""Exact tokenization of whole texts with a memo of chunks.

The tokenizer splits at white space before anything else looks at a text, so the ids of a
text are the ids of its white-space-free chunks, one after the other. Each chunk is encoded
by the tokenizers library and looked up from then on. When the memo is full, chunks that were
not met lately leave it, and a task that ends may empty it, which changes no result."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

END_ID = 1
MEMO_CHUNKS = 500_000
LONG_CHUNK = 200
# Marks of ASCII, and what Python takes for white space but the tokenizer doesn't.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NOT_SPACE = "\x1c\x1d\x1e\x1f\x85"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _latin(text: str) -> bool:
    """Up to U+00FF, where lowering a whole text is lowering its letters one by one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Memo(dict):
    """ids of chunks as bytes; a chunk that isn't there yet is learnt as it is asked for. Long ones aren't kept."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn
        self.before = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.learn(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids

    def turn(self) -> None:
        """Drops what wasn't asked for since the turn before."""
        self.before = dict(self)
        self.clear()

    def forget(self) -> None:
        self.before = {}
        self.clear()


class ChunkEncoder:
    """ids(text) for whole texts; path names a tokenizers file that splits at white space."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model.tokenize
        self.memo = _Memo(self._learn)
        self.stems = _Memo(self._stem)
        self.tails = _Memo(self._whole)
        self.memo_chunks = memo_chunks
        self.letters = self._byte_letters()

    def _byte_letters(self) -> dict[int, str]:
        """What the tokenizer writes for each letter up to U+00FF, found by asking it."""
        out = {}
        for c in map(chr, range(0x100)):
            if c.isalpha() and c == c.lower():
                (piece, _), *more = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)
                if not more:
                    out[ord(c)] = piece
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _stem(self, stem: str) -> bytes:
        return array("I", [t.id for t in self.bpe(stem if stem.isascii() else stem.translate(self.letters))]).tobytes()

    def _learn(self, chunk: str) -> bytes:
        """A chunk of letters and then marks has the ids of the letters and those of the
        marks, as the tokenizer parts the two; capitals up to U+00FF have the ids of their
        small letters. Any other chunk is encoded as it stands."""
        stem = chunk.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or max(stem) <= "\xff") and len(chunk) <= LONG_CHUNK:
            tail = chunk[len(stem) :]
            return self.stems[stem.lower()] + (self.tails[tail] if tail else b"")
        return self._whole(chunk)

    def forget(self) -> None:
        """Empties the memo, as a task does at its end: its worker goes on to other stages."""
        for held in (self.memo, self.stems, self.tails):
            held.forget()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text, END_ID last."""
        ids = self.memo.__getitem__
        end = array("I", [END_ID]).tobytes()
        out = []
        for t in texts:
            if any(c in t for c in NOT_SPACE):
                out.append(np.frombuffer(self._whole(t) + end, dtype="<u4"))
                continue
            if 2 * len(self.memo) > self.memo_chunks:
                for held in (self.memo, self.stems, self.tails):
                    held.turn()
            words = (t.lower() if _latin(t) and "<|" not in t else t).split()
            out.append(np.frombuffer(b"".join(map(ids, words)) + end, dtype="<u4"))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, memo_chunks: int = MEMO_CHUNKS) -> ChunkEncoder:
    """One encoder for each worker process; Spark uses workers again."""
    return ChunkEncoder(path, memo_chunks)
