"""Token ids of the lower-casing word BPE, with a memory for words already met.

No token of this tokenizer reaches across white space, so a text's ids are its
words' ids in a row.  Words are kept with their ids, packed, in the worker.
Words of plain Latin letters, digits and signs that are new go to the byte-pair
encoder of tiktoken, given the same vocabulary; all others go to the tokenizer
itself, and so does every word if the vocabulary isn't laid out as expected.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

#: White space on which every part of the tokenizer agrees; and what else Python takes for it.
PLAIN, OTHER = re.compile(r"[ \n\t\r]+"), re.compile(r"[^\S \n\t\r]")
#: The tokenizer's own pattern for what it keeps together.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters only need no normalisation but lower case.
SIMPLE = re.compile(r"[\x21-\x3b\x3d-\x7e\xa1-\xac\xae-ɏ]+")
#: Words kept in a worker before it starts anew.
KEPT_WORDS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The usual letters for bytes in byte-level vocabularies, and their bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """``packed(text)``: the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.fast = self._fast(path)

    def _fast(self, path: str):
        """tiktoken's encoder for one word, with byte 0 as the word's end; None if it doesn't apply."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if model.get("end_of_word_suffix") != "</w>" or any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(pairs)):
            return None
        letters, ranks = _byte_letters(), {}
        for token, i in vocab.items():
            core, end = (token[:-4], b"\0") if token.endswith("</w>") else (token, b"")
            if i < 512 + len(pairs):
                ranks[bytes(letters[c] for c in core) + end] = i
        core = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core.encode_single_piece

    def _exact(self, word: str) -> bytes:
        return np.array(self.exact.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self.fast is None or not SIMPLE.fullmatch(word):
            return self._exact(word)
        out = []
        for piece in PIECES.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = np.array(self.fast(piece.encode() + b"\0"), "<u4").tobytes()
                self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = PLAIN.split(text) if OTHER.search(text) else text.split()
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > KEPT_WORDS:
                known.clear()
                self.pieces.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = self._word(w)
                    found[i] = ids
        return b"".join(found)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker and vocabulary."""
    return WordEncoder(path)
