"""Token ids and counts by the public ``tokenizers`` library, with a memo of space-separated chunks.

Both byte-level and word-end BPE files cut a text before every space that follows a character which
is not white space, and encode what lies between two cuts on its own. Splitting at single spaces and
encoding each distinct chunk once therefore gives the library's ids; a text in which white space
precedes a space is encoded whole. The memo is bounded and per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Distinct chunks that one worker remembers before it starts afresh (about 200 bytes each).
MEMO_CHUNKS = 1_000_000

#: Characters whose chunks are looked up together.
SLICE_CHARS = 1_000_000

#: Runs of these after letters are one piece of their own; the apostrophe is left out as it can bind letters.
MARKS = '!"#$%&()*+,-./:;<=>?@[]^_`{|}~'


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def version_digest(path: str) -> str:
    """SHA-256 of the vocabulary file, the tokenizer's version in the digest cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ChunkMemo:
    """Encodes texts without added special tokens; ``pack`` turns a chunk's ids into what is remembered."""

    def __init__(self, path: str, counts_only: bool):
        self.tokenizer = load(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65_536 else "<u4")
        self.pack = len if counts_only else lambda ids: np.array(ids, self.dtype).tobytes()
        self.merge = sum if counts_only else b"".join
        self.spaced: dict[str, int | bytes | None] = {}
        self.tail = lru_cache(maxsize=4096)(self._whole)
        spec = json.loads(self.tokenizer.to_str())
        splits = spec["pre_tokenizer"] or {}
        steps = splits.get("pretokenizers", [splits])
        #: Spaces are part of the pieces, or fall away. None: every chunk goes through the whole encoder.
        self.space: str | None = None
        if spec["normalizer"] is None and steps[-1].get("type") == "ByteLevel" and steps[-1].get("use_regex"):
            self.space = " "
        elif len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel":
            self.space = ""

    def _whole(self, text: str):
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str):
        """A space and letters only, which both kinds of file take as one piece; else through the encoder."""
        piece = word
        if self.space == "":
            piece = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
        if self.space is None or not piece.isalpha():
            return self._whole(f" {word}")
        letters = (self.space + piece).encode().decode("latin-1").translate(BYTE_LETTERS)
        return self.pack([t.id for t in self.tokenizer.model.tokenize(letters)])

    def _learn(self, chunk: str):
        """What a space and ``chunk`` encode to; None where the space after it is no sure cut."""
        if not chunk or chunk[-1].isspace():
            return None
        if chunk.isalpha():
            return self._word(chunk)
        if self.space is not None and (word := chunk.rstrip(MARKS)).isalpha():
            if (start := self.spaced.get(word)) is None:
                start = self.spaced[word] = self._word(word)
            return start + self.tail(chunk[len(word) :])
        return self._whole(f" {chunk}")

    def _slice(self, texts: list[str]) -> list:
        split = [t.split(" ") for t in texts]
        if len(self.spaced) > MEMO_CHUNKS:
            self.spaced.clear()
        known, local = self.spaced, {}
        for p in set().union(*split):
            if (value := known.get(p, 0)) == 0:
                value = known[p] = self._learn(p)
            local[p] = value
        out = []
        for text, (head, *rest) in zip(texts, split, strict=True):
            try:
                if head and head[-1].isspace():
                    raise TypeError
                out.append(self.tail(head) + self.merge(map(local.__getitem__, rest)))
            except TypeError:  # white space before a space
                out.append(self._whole(text))
        return out

    def encode_all(self, texts: Iterable[str | None]) -> list:
        """Each text's token count, or its ids as bytes of ``dtype``; null counts as empty."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > SLICE_CHARS:
                out += self._slice(held)
                held, size = [], 0
        return out + self._slice(held)


@lru_cache(maxsize=4)
def memo(path: str, counts_only: bool) -> ChunkMemo:
    return ChunkMemo(path, counts_only)


#: Characters on which the two libraries' regular expressions surely agree (letters and spaces of old standing).
COMMON = re.compile("[^\t\n\r\x20-\x7e\xa0-ͷЀ-ҁҊ-ԯ‐-‧ぁ-ゖァ-ヺ一-龥]")


class ByteLevelIds:
    """Ids of a byte-level vocabulary as the ``tokenizers`` library gives them, without added special tokens.

    ``rank_path`` names the same vocabulary as ranks. Where its merges are the JSON file's, ordinary
    texts go through the faster rank encoder, which gives the same ids; texts with a special token's
    string or with characters that the libraries may class differently go through ``tokenizers``.
    """

    def __init__(self, path: str, rank_path: str | None):
        self.tokenizer = load(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65_536 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = None
        if rank_path:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            letters = {c: b for b, c in BYTE_LETTERS.items()}
            own = {k: v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items() if k not in self.special}
            if {bytes(letters[c] for c in k): v for k, v in own.items()} == ranks:
                self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is None or COMMON.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.asarray(self.ranks.encode_to_numpy(text, disallowed_special=())).astype(self.dtype)


@lru_cache(maxsize=2)
def byte_level(path: str, rank_path: str | None) -> ByteLevelIds:
    return ByteLevelIds(path, rank_path)
