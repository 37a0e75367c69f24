"""Token ids of a byte-level BPE vocabulary, by a bounded cache of text pieces."""

from __future__ import annotations

import json

import numpy as np
import regex
import tiktoken

#: The split of the vocabulary's family of byte-level tokenizers; `public_tokenizers.PATTERN` is the same.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers at most; then it begins anew. It bounds memory, not results.
CACHE_PIECES = 300_000
_CUT = regex.compile(r" (?=\S)")
_ODD = regex.compile(r" \s| $")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The ranks of a tokenizers file with a byte-level BPE model, and its added tokens."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    added = {x["content"]: x["id"] for x in said["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in said["added_tokens"]):
        raise ValueError("added tokens that match by their surroundings aren't covered")
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in token): k for token, k in said["model"]["vocab"].items() if token not in added}, added


class PieceIds(dict):
    """Little-endian ids of pieces of text, encoded on a first use.

    Added tokens are found in a text first, the longest of those at a place, and have their own ids; what lies
    between two of them is encoded by itself. It is cut before each space that text follows. No match of the pattern
    crosses such a cut and none depends on what lies beyond it, so the pieces' ids in order are the text's ids.
    """

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int] | None = None, pattern: str = PATTERN):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max([*ranks.values(), *(added or {}).values()]) < 1 << 16 else "<u4")
        self.added = {token: np.array([k], self.kind).tobytes() for token, k in (added or {}).items()}
        names = "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.parts = regex.compile(f"({names})") if names else None

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.encoding.encode_ordinary(piece), self.kind).tobytes()
        if len(piece) < 64:
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
        if any(x in text for x in self.added):
            return b"".join(self.added[x] if x in self.added else self.plain(x) for x in self.parts.split(text) if x)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        pieces = text.split(" ") if not _ODD.search(text) else _CUT.split(text)
        return self[pieces[0]] + b"".join([self[" " + p] for p in pieces[1:]])


_loaded: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    if path not in _loaded:
        _loaded[path] = PieceIds(*load_json(path))
    return _loaded[path]
