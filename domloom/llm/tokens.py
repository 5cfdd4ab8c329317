"""Token ids of whole texts by a public tokenizer, one word at a time.

The tokenizer used by the queries drops white space and never joins what stands
on either side of it (its normaliser and pre-tokenizer act inside words), so the
ids of a text are the ids of its words in order.  Each distinct word is encoded
once by the library and remembered under its 64-bit hash; a text is then a gather.
The memory is emptied when it holds ``limit`` words, so it stays bounded.

Two more facts of its pre-tokenizer save distinct words: a full stop or comma at
the end of a word is a piece of its own if a letter stands before it, and case of
ASCII words does not matter (a word with ``<`` may name a special token and keeps
its case).  Words of Latin letters only are one piece each and go to the library
many at a time; their ids are told apart by the end-of-word mark.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from . import textbytes as tb


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Latin-1 letters: always one piece, in lower case too.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_MARK = "</w>"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def spans(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the block's words, a closing stop or comma apart."""
    data, starts, ends = block.data, block.starts, block.ends
    last, before, lead = (data[np.maximum(ends - k, 0)] for k in (1, 2, 3))  # a word too short is ruled out below
    long = ends - starts
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (long > 2)
    cut = ((last == 0x2E) | (last == 0x2C)) & (long > 1) & (_ASCII_LETTER[before] | latin)
    at = np.flatnonzero(cut)
    return np.insert(starts, at + 1, ends[at] - 1), np.insert(ends, at, ends[at] - 1)


class Encoder:
    def __init__(self, path: str, end_id: int, limit: int = 800_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.limit = Tokenizer.from_file(path), end_id, limit
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith(_MARK)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # known hashes, ascending, and their words' places
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lens = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.used = self.known = 0

    def _learn(self, words: list[str]) -> np.ndarray:
        """Remember the ids of new words; their places."""
        places = np.empty(len(words), np.int32)
        plain = np.array([_PLAIN(w) is not None for w in words], bool)
        some = np.flatnonzero(plain)
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):  # not the tokenizer described above
                plain[part] = False
                continue
            places[part] = self._keep(ids, np.diff(ends, prepend=0))
        rest = np.flatnonzero(~plain)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)]
            places[part] = self._keep(np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found]))
        return places

    def _keep(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        n, used = self.known, self.used
        for name, new, at in (("ids", ids, used), ("starts", np.cumsum(lens) - lens + used, n), ("lens", lens, n)):
            held = getattr(self, name)
            if at + len(new) > len(held):
                held = np.concatenate((held, np.zeros(max(len(held) // 2, len(new)), held.dtype)))
                setattr(self, name, held)
            held[at : at + len(new)] = new
        self.used, self.known = used + len(ids), n + len(lens)
        return np.arange(n, self.known, dtype=np.int32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ascending hashes, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.places[at], self.keys[at] == hashes

    def encode(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's documents, each closed by end_id, and their n + 1 offsets."""
        starts, ends = spans(block)
        hashes = tb.span_hashes(tb._LOWER[block.data], starts, ends)
        odd = np.zeros(256, bool)
        odd[0x80:] = odd[ord("<")] = True
        total = np.concatenate(([0], np.cumsum(odd[block.data], dtype=np.int32)))
        cased = total[ends] != total[starts]
        hashes[cased] = tb.span_hashes(block.data, starts[cased], ends[cased])
        hashes, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.known > self.limit:
            self.forget()
        at, known = self._find(hashes)
        if not known.all():
            new = np.flatnonzero(~known)
            raw, a, b = block.data.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            at[new] = self._learn([raw[i:j].decode("utf-8", "replace") for i, j in zip(a, b, strict=True)])
            keys, places = np.concatenate((self.keys, hashes[new])), np.concatenate((self.places, at[new]))
            order = np.argsort(keys, kind="stable")  # two ascending runs: a merge
            self.keys, self.places = keys[order], places[order]
        at = at[inverse]
        lens = self.lens[at].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(lens)))
        flat = self.ids[np.repeat(self.starts[at] - before[:-1], lens) + np.arange(before[-1])]
        closing = before[np.searchsorted(starts, block.offsets[1:])]
        offsets = np.concatenate(([0], closing + np.arange(1, len(block) + 1)))
        out = np.full(offsets[-1], self.end_id, np.uint32)
        inside = np.ones(offsets[-1], bool)
        inside[offsets[1:] - 1] = False
        out[inside] = flat
        return out, offsets


@lru_cache(2)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its memory of words serves them all."""
    return Encoder(path, end_id)
