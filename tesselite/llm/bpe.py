"""Token ids of whole texts by the tokenizers library, each distinct chunk of a batch encoded once.

The byte-level splitter always cuts where white space follows something that isn't white space, so the ids
of a text are the ids of its chunks (cut before each such space) laid end to end. Texts are split and their
chunks numbered by Arrow; chunks that this worker hasn't met are encoded together; ids are then laid out by
array arithmetic. Texts in which white space stands before a space, with control characters on which splitters
disagree, or with anything like a special token are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

#: Chunks that a worker remembers (some 150 bytes each while a batch is looked up), the longest of them, and characters
#: handled at once.
MEMO, LONGEST, AT_ONCE = 2_000_000, 64, 16_000_000
_WHOLE = "[\\x1c-\\x1f\u0085]|<\\||[\\s\\x0b   -     　] "
_MADE: dict[str, Encoder] = {}


def _ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each (s, n), end to end."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class Encoder:
    def __init__(self, path: str, memo: int = MEMO, at_once: int = AT_ONCE):
        from tokenizers import Tokenizer

        self.memo, self.at_once = memo, at_once
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Ids whose token begins with a space: one of them opens each chunk that follows a space.
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: list[pa.Array] = []
        self.count = 0
        self.flat: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_spaces(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for chunks as they stand after one space. Chunks that neither are empty nor end in
        white space are encoded as one text, which costs half as much, and cut where a token begins with a space."""
        parts, lengths = [], []
        for k in range(0, len(chunks), 2000):
            some = chunks[k : k + 2000]
            if all(c and not c[-1].isspace() for c in some):
                ids = self.whole([" " + " ".join(some)])[0]
                at = np.flatnonzero(self.opens[ids])
                if len(at) == len(some) and at[0] == 0:
                    parts.append(ids)
                    lengths.append(np.diff(at, append=len(ids)))
                    continue
            each = self.whole([" " + c for c in some])
            parts += each
            lengths.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(parts or [np.zeros(0, np.uint32)]), np.concatenate(lengths or [np.zeros(0, np.int64)])

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array of ids, and where in it each word's ids start and how many they are."""
        if self.count > self.memo:
            self.forget()
        if len(self.known) > 1:
            self.known, self.flat, self.lengths = [pa.concat_arrays(self.known)], [np.concatenate(self.flat)], [np.concatenate(self.lengths)]
        at = pc.index_in(words, value_set=self.known[0]) if self.known else pa.nulls(len(words), pa.int32())
        new = words.filter(at.is_null())
        # Chunks that can't be encoded jointly come last, so that they don't hold up the others.
        odd = pc.or_(pc.equal(pc.utf8_length(new), 0), pc.match_substring_regex(new, "[\\s\\x0b\\p{Z}\u0085]$"))
        new = pa.concat_arrays([new.filter(pc.invert(odd)), new.filter(odd)])
        ids, lengths = self._after_spaces(new.to_pylist())
        flat = np.concatenate([*self.flat, ids])
        counts = np.concatenate([*self.lengths, lengths]).astype(np.int64)
        starts = np.cumsum(counts) - counts
        place = np.where(at.is_null().to_numpy(zero_copy_only=False), 0, at.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        if len(new):
            missed = at.is_null().to_numpy(zero_copy_only=False)
            place[missed] = self.count + pc.index_in(words.filter(at.is_null()), value_set=new).to_numpy(zero_copy_only=False)
        short = pc.less_equal(pc.utf8_length(new), LONGEST).to_numpy(zero_copy_only=False)
        if short.all():
            self.known.append(new)
            self.flat.append(ids)
            self.lengths.append(lengths)
            self.count += len(new)
        elif short.any():
            own = np.cumsum(lengths) - lengths
            self.known.append(new.filter(pa.array(short)))
            self.flat.append(_ragged(ids, own[short], lengths[short]))
            self.lengths.append(lengths[short])
            self.count += int(short.sum())
        return flat, starts[place], counts[place]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Per text (no nulls) its ids as unsigned 32-bit integers."""
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        k = 0
        while k < len(texts):
            stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + self.at_once, side="right")))
            yield from self._encode(texts.slice(k, stop - k))
            k = stop

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.match_substring_regex(texts, _WHOLE)
        alone = whole.to_numpy(zero_copy_only=False)
        aside = iter(self.whole(texts.filter(whole).to_pylist()))
        lists = pc.split_pattern(texts.filter(pc.invert(whole)).cast(pa.large_string()), " ")
        bounds = lists.offsets.to_numpy()
        numbered = lists.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.string()) if len(numbered.dictionary) else pa.array([], pa.string())
        flat, starts, lengths = self._ids_of(words)
        chunk = numbered.indices.to_numpy(zero_copy_only=False)
        # The first chunk of a text follows no space.
        lead = chunk[bounds[:-1]]
        kinds, which = np.unique(lead, return_inverse=True)
        first = self.whole(words.take(pa.array(kinds)).to_pylist())
        k = 0
        for skip in alone:
            if skip:
                yield next(aside)
                continue
            inner = chunk[bounds[k] + 1 : bounds[k + 1]]
            yield np.concatenate([first[which[k]], _ragged(flat, starts[inner], lengths[inner])])
            k += 1


def encoder(path: str | None = None, memo: int = MEMO, at_once: int = AT_ONCE) -> Encoder:
    """This process's encoder for a tokenizer file (by default the public 50k byte-level vocabulary)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    key = f"{path} {memo} {at_once}"
    if key not in _MADE:
        _MADE[key] = Encoder(path, memo, at_once)
    return _MADE[key]
