"""Whole-text token ids with a byte-level BPE file, fast enough for a scan.

A space with a non-space on both sides always begins a new piece of the
byte-level split, so a text may be cut there and each part encoded alone.
Parts repeat far more often than texts do; their ids are kept in a bounded
cache, and the library encodes each unseen part once. A text that holds an
added token, such as an end-of-text marker, is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import partial
from itertools import compress, islice
from operator import is_

import numpy as np

#: Parts kept by each worker (some 200 MB at most, as long parts are not kept);
#: they stay as long as the worker does, also while it serves other operators.
CACHE_PARTS = 1_000_000
KEPT_PART_CHARS = 48
_NEAR_SPACE = re.compile(r"\s | \s| \Z")
_OTHER_SPACES = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(map(chr, range(0x2000, 0x200B)))
#: Stands for the first part of a text, which has no space before it.
_NO_PART = "\0 "
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _touching_spaces(text: str) -> bool:
    """A space next to white space or at the end: such a text is not cut."""
    if "  " in text or "\n " in text or " \n" in text or text[-1] == " ":
        return True
    return any(map(text.__contains__, _OTHER_SPACES)) and _NEAR_SPACE.search(text) is not None


_is_none = partial(is_, None)


class Encoder:
    """``encode(text)`` equals the library's ids of the whole text."""

    def __init__(self, path: str, parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.parts = parts
        self.cache: dict[str, bytes] = {_NO_PART: b""}
        pre = self.tok.pre_tokenizer
        sizes = sorted((i, len(t)) for t, i in self.tok.get_vocab().items())
        self.token_bytes = np.zeros(sizes[-1][0] + 1, np.int64)
        self.token_bytes[[i for i, _ in sizes]] = [n for _, n in sizes]
        # an added token is found in the whole text before it is split
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.splits = "ByteLevel(add_prefix_space=False" in str(pre) and "use_regex=True" in str(pre) and self.tok.normalizer is None and not any(" " in t for t in self.added)

    def _encode_spaced(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, each after one space: one call for all of them, cut
        where the byte lengths of tokens reach the next space."""
        joined = " " + " ".join(parts)
        ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        starts = np.cumsum(self.token_bytes[ids]) - self.token_bytes[ids]
        at = np.searchsorted(starts, np.flatnonzero(np.frombuffer(joined.encode(), np.uint8) == 32)) * self.dtype.itemsize
        raw, at = ids.astype(self.dtype).tobytes(), [*at.tolist(), len(ids) * self.dtype.itemsize]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], self.dtype)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        cache, get, cut, unseen = self.cache, self.cache.get, [], set()
        for text in texts:
            if not text or not self.splits or any(map(text.__contains__, self.added)) or _touching_spaces(text):
                cut.append((text or "", None, None))
                continue
            parts = text.split(" ")
            first = parts[0]
            parts[0] = _NO_PART
            found = list(map(get, parts))
            if None in found:
                unseen.update(compress(parts, map(_is_none, found)))
            else:
                parts = None
            cut.append((first, parts, found))
        fresh: dict[str, bytes] = {}
        unseen = list(unseen)
        for i in range(0, len(unseen), 20_000):
            part = unseen[i : i + 20_000]
            fresh.update(zip(part, self._encode_spaced(part), strict=True))
        out = self._encode([first for first, _, _ in cut])
        for i, (_, parts, found) in enumerate(cut):
            if parts:
                found = [fresh[p] if v is None else v for p, v in zip(parts, found)]
            if found:
                out[i] += b"".join(found)
        room = self.parts - len(cache)
        if room > 0:  # the parts met first are the frequent ones
            cache.update(islice(((p, v) for p, v in fresh.items() if len(p) <= KEPT_PART_CHARS), room))
        return out


def encoder(path: str, parts: int = CACHE_PARTS) -> Encoder:
    """One encoder in each worker process."""
    if (path, parts) not in _ENCODERS:
        _ENCODERS[path, parts] = Encoder(path, parts)
    return _ENCODERS[path, parts]


def forget() -> None:
    """Drops this worker's encoders, with the ids they keep."""
    _ENCODERS.clear()
