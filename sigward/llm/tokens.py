"""Token ids of whole texts, made by the tokenizers library.

Prose repeats its words, and both public vocabularies split a text at white space before they merge. A text is cut where
the pre-tokenizer always cuts, every distinct piece of a run of texts is encoded once, and the ids are put together in
numpy. Texts with a place that is not surely such a cut, or with the content of an added token (<|endoftext|>, which the library finds
in texts), are encoded whole. The ids are those of encoding the text whole
(tests/llm/test_operators.py and test_findings.py compare them on odd texts).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of Unicode as pre-tokenizers see it; two in a row make a cut at a blank unsure.
TWO_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
# Pieces that a worker remembers between runs, and the longest of them; the rest is encoded once per run.
REMEMBERED, LONGEST = 800_000, 64
SEPARATOR = "\x00"


class Encoder:
    """Ids of texts by one tokenizer file. `blank_joins`: a blank belongs to the word after it (byte-level vocabularies)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.blank_joins = self._whole([" x"])[0] != self._whole(["x"])[0]
        self.opens = np.zeros(self.vocabulary, dtype=bool)
        if self.blank_joins:
            for token, i in self.tokenizer.get_vocab().items():
                self.opens[i] = token.startswith("Ġ")
        self.separator = self._whole([SEPARATOR])[0]
        self.memory: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces of texts without an added token; lower case may make a marker of what was none, so none is looked for."""
        self.tokenizer.encode_special_tokens = True
        out = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.tokenizer.encode_special_tokens = False
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as bytes; of many pieces in one call."""
        out: list[bytes] = [b""] * len(pieces)
        odd = [i for i, p in enumerate(pieces) if not p or SEPARATOR in p]
        for i in odd:
            out[i] = self._bytes(self._whole([" " + pieces[i] if self.blank_joins else pieces[i]])[0])
        skip = set(odd)
        plain = [i for i in range(len(pieces)) if i not in skip]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            if self.blank_joins:
                ids = np.array(self._whole([" " + " ".join(pieces[i] for i in some)])[0], dtype=self.dtype)
                starts, gap = np.flatnonzero(self.opens[ids]), 0
            elif len(self.separator) == 1:
                ids = np.array(self._whole([f" {SEPARATOR} ".join(pieces[i] for i in some)])[0], dtype=self.dtype)
                starts, gap = np.concatenate([[0], np.flatnonzero(ids == self.separator[0]) + 1]), 1
            else:
                starts = np.array([])
            if len(starts) != len(some):
                for i, x in zip(some, self._whole([(" " if self.blank_joins else "") + pieces[i] for i in some]), strict=True):
                    out[i] = self._bytes(x)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            ends = np.append(starts[1:] - gap, len(ids)) * size
            for i, s, e in zip(some, (starts * size).tolist(), ends.tolist(), strict=True):
                out[i] = raw[s:e]
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _lookup(self, pieces: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all distinct pieces on end, where each starts, how many it has."""
        keys, memory = pieces.dictionary.to_pylist(), self.memory
        found = [memory.get(k) for k in keys]
        new = [i for i, f in enumerate(found) if f is None]
        for i, b in zip(new, self._pieces([keys[i] for i in new]), strict=True):
            found[i] = b
        if len(memory) < REMEMBERED:
            memory.update((keys[i], found[i]) for i in new if len(keys[i]) <= LONGEST)
        lengths = np.fromiter((len(f) for f in found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        return np.frombuffer(b"".join(found), dtype=self.dtype), np.cumsum(lengths) - lengths, lengths

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end and the number of ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        if self.blank_joins:
            unsure = pc.match_substring_regex(texts, TWO_SPACES).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(texts, " ")
        else:
            unsure = np.zeros(len(texts), dtype=bool)
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        for content in self.added:
            unsure = unsure | pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if pa.types.is_large_list(lists.type):
            lists = lists.cast(pa.list_(pa.string()))
        offsets = lists.offsets.to_numpy()
        pieces = lists.flatten().dictionary_encode()
        index = pieces.indices.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        flat, starts, lengths = self._lookup(pieces)
        counts, at = lengths[index], starts[index]
        whole: dict[int, np.ndarray] = {}
        if self.blank_joins and len(texts):
            first = offsets[:-1]
            heads = pieces.dictionary.take(pa.array(index[first])).to_pylist()
            distinct = sorted(set(heads))
            own = dict(zip(distinct, map(self._bytes, self._whole(distinct)), strict=True))
            extra = np.frombuffer(b"".join(own[h] for h in heads), dtype=self.dtype)
            sizes = np.array([len(own[h]) for h in heads], dtype=np.int64) // self.dtype.itemsize
            at[first] = len(flat) + np.cumsum(sizes) - sizes
            counts[first] = sizes
            flat = np.concatenate([flat, extra])
        for i in np.flatnonzero(unsure):
            counts[offsets[i] : offsets[i + 1]] = 0
            whole[int(i)] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=self.dtype)
        ends = np.cumsum(counts)
        ids = flat[np.repeat(at - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offsets]
        per_text = np.diff(bounds)
        if whole:
            parts = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            ids, per_text = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return ids, per_text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int, dtype: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with the end id after each text, and the new counts."""
    out = np.empty(len(ids) + len(counts), dtype=dtype)
    last = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), dtype=bool)
    keep[last] = False
    out[keep] = ids
    out[last] = end
    return out, counts + 1
