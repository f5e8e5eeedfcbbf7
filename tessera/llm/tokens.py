"""Ids of a byte-level BPE vocabulary for blocks of texts.

The split pattern of this vocabulary always breaks where a run of white space begins after a visible
character, so a text is a sequence of chunks (white space and the visible characters after it) that are
encoded on their own. The distinct chunks of a block are encoded in one call and cut apart by the
lengths of their ids. Texts with white space beyond ASCII, or with a
special token's string, are encoded whole.
"""

from __future__ import annotations

import base64
import os
from itertools import chain

import numpy as np

from . import vec


def vocabulary_path(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _wide_space(buf: np.ndarray) -> np.ndarray:
    """Places where the UTF-8 bytes of white space beyond ASCII may begin."""
    lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    lead = lead[lead + 1 < len(buf)]
    a, b = buf[lead], buf[lead + 1]
    return lead[((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))]


class Encoder:
    """ranks: the vocabulary as ranks; full: the same as a tokenizer file, which alone knows the special tokens."""

    def __init__(self, ranks: str = "byte_bpe_50k.tiktoken", full: str = "byte_bpe_50k.json", special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        self.size[list(table.values())] = [len(k) for k in table]
        self.special, self.full, self.json = special.encode(), full, None

    def whole(self, raw: bytes) -> list[int]:
        if self.special not in raw:
            return self.plain.encode_ordinary(raw.decode())
        if self.json is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.json = Tokenizer.from_file(vocabulary_path(self.full))
        return self.json.encode(raw.decode(), add_special_tokens=False).ids

    def encode_block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        n = len(offs) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        space = ~vec.NON_SPACE[buf]
        begins = np.zeros(len(buf), bool)
        begins[1:] = space[1:] & ~space[:-1]
        begins[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(buf))
        _, index, which = np.unique(vec.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        # the distinct chunks one after the other; a line feed goes before those that do not begin with white space,
        # and those of white space alone (at the end of a text) are encoded by themselves
        at, size = starts[index], (ends - starts)[index]
        alone = np.flatnonzero(space[at + size - 1])
        blanks = [self.plain.encode_ordinary(buf[at[k] : at[k] + size[k]].tobytes().decode()) for k in alone]
        size[alone] = 0
        bare = ((size > 0) & ~space[at]).astype(np.int64)
        place = np.cumsum(size + bare) - size
        joined = np.full(int((size + bare).sum()), 10, np.uint8)
        inner = np.arange(int(size.sum()))
        before = np.cumsum(size) - size
        joined[np.repeat(place - before, size) + inner] = buf[np.repeat(at - before, size) + inner]
        flat = np.array(self.plain.encode_to_numpy(joined.tobytes().decode()), np.uint32)
        last = np.cumsum(self.size[flat])
        low = np.searchsorted(last, place, "right")
        sizes = np.where(size > 0, np.searchsorted(last, place + size, "left") + 1 - low, 0)
        for k, blank in zip(alone, blanks, strict=True):
            low[k], sizes[k] = len(flat), len(blank)
            flat = np.append(flat, np.array(blank, np.uint32))
        which = which.ravel()
        count = sizes[which]
        ids = flat[np.repeat(low[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        first = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, offs)]

        raw = buf.tobytes()
        odd = np.unique(np.searchsorted(offs, _wide_space(buf), "right") - 1).tolist()
        at = raw.find(self.special)
        while at >= 0:
            odd.append(int(np.searchsorted(offs, at, "right")) - 1)
            at = raw.find(self.special, at + 1)
        if odd:
            parts = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for t in set(odd):
                parts[t] = np.array(self.whole(raw[offs[t] : offs[t + 1]]), np.uint32)
            ids, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, first


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    """The encoder of this process."""
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, first[1:], end_id), first + np.arange(len(first))
