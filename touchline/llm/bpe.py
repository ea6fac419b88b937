"""Byte-level BPE vocabularies, and cuts of a text at which pre-tokens surely begin."""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array

import public_tokenizers
import tiktoken
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CUT = re.compile(r" (?=\S)")
Ranks = dict[bytes, int]


class Vocabulary(dict[bytes, int]):
    """Ranks, and the ids of added tokens, which stand for themselves wherever a text holds them."""

    added: dict[str, int]

    def __init__(self, ranks: Ranks, added: dict[str, int]):
        super().__init__(ranks)
        self.added = added

    def __reduce__(self):
        return Vocabulary, (dict(self), self.added)


def public_path(name: str) -> str:
    return public_tokenizers.path(name)


def rank_file(path: str) -> Ranks:
    """Ranks of a file with a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def json_ranks(path: str) -> Vocabulary:
    """Ranks and added tokens of a byte-level BPE in JSON, whose ids follow the order of its merges.

    Such files write each byte as a printable character: a byte that is printable in Latin-1 as
    itself, the others in order from code point 256 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    added = {token["content"]: token["id"] for token in whole.get("added_tokens", ())}
    vocabulary = whole["model"]["vocab"]
    return Vocabulary({bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token not in added}, added)


def encoding(ranks: Ranks, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def little_endian(ids: list[int], width: str) -> bytes:
    """Ids as bytes of ``<u2`` or ``<u4``; for a few ids much cheaper than a numpy array."""
    packed = array("H" if width == "<u2" else "I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def added_pattern(added: dict[str, int]) -> re.Pattern | None:
    """Finds added tokens, the longest at a place."""
    if not added:
        return None
    return re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")


def chunks(text: str) -> list[str]:
    """``text`` cut before every space that a visible character follows.

    Such a space always begins a pre-token: white space patterns stop before it, and every other
    pattern may only have a space in front. So the pre-tokens of a text are those of its chunks.
    """
    parts = text.split(" ")
    if all(part and not part[0].isspace() for part in parts[1:]):
        return [parts[0], *(" " + part for part in parts[1:])]
    starts = [0, *(match.start() for match in _CUT.finditer(text))]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
