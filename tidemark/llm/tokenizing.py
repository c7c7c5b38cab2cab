"""Batch encoding with a public tokenizer file: each distinct piece of a run of texts is encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank before anything but white space always begins a token of the byte-level pattern.
PIECE = re.compile(r" (?=\S)")
#: A blank before white space or the end, for RE2; where none is, every blank begins a token.
ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
#: Bytes of text that are split at once, and of remembered pieces with their ids.
SLICE_BYTES, MEMORY_BYTES = 4_000_000, 32_000_000
#: Pieces that the library gets as one text, and whose ids are gathered at once.
JOINED, GATHERED = 2000, 500_000


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about SLICE_BYTES each, of one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


class Encoder:
    """Encodes whole texts without special tokens; special strings in a text are ordinary text.

    Where the tokenizer has no normaliser and splits with the byte-level pattern, no token
    crosses a blank that white space does not follow. Texts are cut there by Arrow, the distinct
    pieces of a run of texts are encoded by the library unless they are remembered, and ids are
    gathered by numpy. Other tokenizers encode whole texts. Beside the vocabulary an encoder
    holds MEMORY_BYTES of pieces and what a run of SLICE_BYTES needs; when the memory is full it
    starts anew from the latest run's pieces.
    """

    _shared: dict = {}

    @classmethod
    def shared(cls, path: str, dtype: str) -> "Encoder":
        """One encoder for each Python worker, whose memory the next task finds filled."""
        if (path, dtype) not in cls._shared:
            cls._shared = {(path, dtype): cls(path, dtype)}
        return cls._shared[path, dtype]

    def __init__(self, path: str, dtype: str = "uint16"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype(dtype)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if self.cuts:
            self.opens = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)  # ids whose bytes begin with a blank
            self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "Ġ"]] = True
        self.words, self.pool, self.stops = pa.array([], pa.string()), np.empty(0, self.dtype), np.empty(0, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, one after the other, and where each text ends."""
        ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.dtype), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)

    def _tails(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that stand behind a blank each; where no piece holds a blank, ids that begin with one tell them apart."""
        if any(" " in x for x in pieces):
            return self._each([" " + x for x in pieces])
        found, starts, at = [np.empty(0, self.dtype)], [], 0
        for lo in range(0, len(pieces), JOINED):
            ids = self._each([" " + " ".join(pieces[lo : lo + JOINED])])[0]
            starts.append(at + np.flatnonzero(self.opens[ids]))
            found.append(ids)
            at += len(ids)
        return np.concatenate(found), np.append(np.concatenate(starts), at)[1:] if pieces else np.empty(0, np.int64)

    def _gathered(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts cut into pieces, one after the other, and where each text ends."""
        bounds = pieces.offsets.to_numpy()
        flat = pieces.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        heads, head_stops = self._each(flat.take(pa.array(bounds[:-1])).to_pylist())  # a text's first piece has no blank
        coded = flat.cast(pa.string()).dictionary_encode()
        names = coded.dictionary
        place = pc.index_in(names, value_set=self.words)
        new = names.filter(place.is_null())
        own, own_stops = self._tails(new.to_pylist())
        place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        pool = np.concatenate([self.pool, own, heads])
        stops = np.concatenate([self.stops, len(self.pool) + own_stops, len(self.pool) + len(own) + head_stops])
        long = np.diff(stops, prepend=0)

        def ids_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = []
            for lo in range(0, len(code), GATHERED):
                some = code[lo : lo + GATHERED]
                n = long[some]
                at = np.repeat(stops[some] - np.cumsum(n), n)
                at += np.arange(len(at))
                out.append(pool[at])
            return np.concatenate([np.empty(0, self.dtype), *out]), np.cumsum(long[code])

        if self.words.nbytes + new.nbytes + self.dtype.itemsize * (len(self.pool) + len(own)) + 8 * (len(self.words) + len(new)) <= MEMORY_BYTES:
            known = len(self.words) + len(new)
            self.words, self.pool, self.stops = pa.concat_arrays([self.words, new]), pool[: len(self.pool) + len(own)], stops[:known]
        else:
            self.words, (self.pool, self.stops) = names, ids_of(place)
        code = place[coded.indices.to_numpy()]
        code[bounds[:-1]] = len(stops) - len(head_stops) + np.arange(len(head_stops))
        ids, stop = ids_of(code)
        return ids, stop[bounds[1:] - 1]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array; null is ''."""
        texts = pc.fill_null(texts, "")
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        for rows in (np.flatnonzero(~odd), np.flatnonzero(odd)):
            if len(rows):
                some = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
                if not self.cuts:
                    ids, stops = self._each(some.to_pylist())
                elif odd[rows[0]]:
                    ids, stops = self._gathered(pa.array([PIECE.split(t) for t in some.to_pylist()], pa.list_(pa.string())))
                else:
                    ids, stops = self._gathered(pc.split_pattern(some, " "))
                for i, x in zip(rows, np.split(ids, stops[:-1]), strict=True):
                    out[i] = x
        return out
