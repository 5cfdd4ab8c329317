"""Operator 6: language-model scores from sharded Elias-Fano n-gram tries.

The model is a bigram model with a Dirichlet prior,

    P(w | v) = (n(v, w) + mu p0(w)) / (n(v) + mu),   p0(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)),

over lower-cased words with one end token a document; a start symbol precedes the
first.  It is learned from the training documents and scores all of them.  As usual
for interpolated models, a trie holds the smoothed probability of a seen bigram
without its unigram share, n(v, w) / (n(v) + mu), quantised to 1/64 of a decade; the
share mu / (n(v) + mu) p0(w) that every bigram has is added where tokens are scored,
from the counts of words, which the contract wants exact.

The n-grams grow with the corpus, so no machine holds the model.  A shard is a trie
of its own: a level of contexts, pointers to their successors, the shard's successor
vocabulary and a level of successors, each an Elias-Fano sequence in one
memory-mapped file, and the codes of the bigrams.  A lookup finds the context and the
word, takes the context's range from the pointers, and searches that range for the
successor of the context-relative number ``context * vocabulary + word``.  All of this
works on the compressed levels, for many bigrams at once; no level is decoded.

1. Texts are cut into blocks of about 4 MB; each block's distinct words by frequency,
   and its tokens as numbers among them, are written to the shared folder once.
2. A bigram lives in the shard of its context, unless the context is hot (more than
   1/2^17 of the tokens as summed over the blocks where it is that frequent - at most
   2^17 words, so that list is broadcast with their counts); then in a shard of the
   pair, so no context can fill a shard.
3. Every block sends its distinct words and bigrams with their training counts to the
   shards, FAN of them at most.  With more shards than that, a lane is a range of
   shards, the requests of some blocks in one lane are combined (counts of equal bigrams
   added) and dealt to the lanes inside it, and so on.  There are as many lanes as blocks
   combined, the same in every round: so a task holds about what one block asks, whatever
   the number of shards, and the rows sent grow with the corpus, not with blocks x shards.
4. A shard adds the counts of all requests, writes and maps its trie, and looks the
   requested bigrams up.  Answers go back the way that requests came.
5. Blocks and answers meet by block; tokens are scored and summed by document.

Counts cover all training documents: no pruning, no sample.  Hashes of words are 64-bit.

Defined cases: null and empty texts hold the end token only; a null doc_id is not
trained on (its fold is unknown), is scored, and has held_out null; repeated rows
count and are scored each; without training documents N = V = 0, every base
probability is 1 and scores are 0.  Extra columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano
from . import textbytes as tb
from .common import documents, fold, shared_folder, stage

BLOCK_BYTES = 1 << 22
SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 64
FAN = 1 << 12
HOT = 1 << 17
MU = 400.0
STEPS, LEAST = 64, -16.0  # codes per decade of probability, and the least log10 kept
START, END = np.uint64(1), np.uint64(2)  # hashes of the two symbols; a word's is never so small
_U = np.uint64

BLOCKS = "block long, doc_ids array<long>, trains array<boolean>, words binary, word_n binary, tokens binary, n_train long, n_docs long, n_tokens long, frequent array<struct<word:bigint,n:bigint>>"


# ---- blocks

def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents and the n + 1 offsets of documents among them."""
    column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for block in tb.blocks(column):
        hashes.append(np.maximum(block.hashes(lower=True), _U(16)))
        counts.append(block.n_words())
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


class Ask:
    """Words and bigrams that are asked for, with training counts to add.

    words: distinct hashes; home: those whose counts are asked for, with n; a bigram is
    (words[context], pair_word) with pair_n, each pair once, pairs ascending by context.
    """

    def __init__(self, words: np.ndarray, home: np.ndarray, n: np.ndarray, context: np.ndarray, pair_word: np.ndarray, pair_n: np.ndarray) -> None:
        self.words, self.home, self.n, self.context, self.pair_word, self.pair_n = words, home, n, context, pair_word, pair_n

    def deal(self, shards: int, width: int, hot: np.ndarray) -> Dealt:
        home = (tb.mix(self.words) % _U(shards)).astype(np.int64) // width
        is_hot = np.isin(self.words, hot, assume_unique=True) | (self.words == START)
        at = home[self.context]
        apart = np.flatnonzero(is_hot[self.context])
        at[apart] = (tb.mix(self.words[self.context[apart]] ^ tb.mix(self.pair_word[apart])) % _U(shards)).astype(np.int64) // width
        return Dealt(self, at << 32 | self.context, home << 32 | np.arange(len(home)))


class Dealt:
    """An Ask by lanes: entries (lane, word) in order, whether each is the word's home, and the pairs' order and entry."""

    def __init__(self, ask: Ask, pairs: np.ndarray, homes: np.ndarray) -> None:
        homes = homes[ask.home]
        entries = np.unique(np.concatenate((pairs, homes)))
        self.ask, self.lane, self.word = ask, entries >> 32, entries & 0xFFFFFFFF
        self.is_home = np.zeros(len(entries), bool)
        self.is_home[np.searchsorted(entries, homes)] = True
        self.order = np.argsort(pairs, kind="stable")
        self.entry = np.searchsorted(entries, pairs[self.order])

    def requests(self, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
        ask, cuts = self.ask, np.flatnonzero(np.diff(self.lane, prepend=-1, append=self.lane[-1] + 1 if len(self.lane) else -1))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            p, q = np.searchsorted(self.entry, (a, z))
            pairs, word, is_home = self.order[p:q], self.word[a:z], self.is_home[a:z]
            n = np.where(is_home, ask.n[word], 0).astype("<u4")
            succ = np.bincount(self.entry[p:q] - a, minlength=z - a).astype("<u4")
            words, pair_words = _shorten(ask.words[word], hot), _shorten(ask.pair_word[pairs], hot)
            yield int(self.lane[a]), _pack(*words, n, np.packbits(is_home), succ, *pair_words, ask.pair_n[pairs].astype("<u4"))

    def gather(self, lanes: list[int], answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ask.words (0 where not asked for) and codes of its bigrams, from the lanes' answers."""
        n, codes = np.zeros(len(self.ask.words), np.int64), np.zeros(len(self.order), "<u2")
        if len(answers):
            got = [_unpack(answers[i], "<u8", "<u2") for i in np.argsort(lanes)]
            counts = np.concatenate([x[0] for x in got])
            n[self.word[self.is_home]] = counts[self.is_home]
            codes[self.order] = np.concatenate([x[1] for x in got])
        return n, codes


def read_request(raw: bytes, hot: np.ndarray) -> Ask:
    a, b, c, n, home, succ, d, e, f, pair_n = _unpack(raw, "u1", "u1", "<u8", "<u4", "u1", "<u4", "u1", "u1", "<u8", "<u4")
    words, home = _lengthen(a, b, c, len(n), hot), np.unpackbits(home, count=len(n)).astype(bool)
    return Ask(words, home, n, np.repeat(np.arange(len(n)), succ), _lengthen(d, e, f, len(pair_n), hot), pair_n)


class Combined(Ask):
    """Several asks as one, and what tells each its answer; the order of asks does not change the sum."""

    def __init__(self, asks: list[Ask]) -> None:
        words, self.entry_of = np.unique(np.concatenate([a.words for a in asks]), return_inverse=True)
        self.entry_ends = np.cumsum([len(a.words) for a in asks])
        self.pair_ends = np.cumsum([len(a.pair_n) for a in asks])
        asked = np.concatenate([a.home for a in asks])
        home = np.zeros(len(words), bool)
        home[self.entry_of[asked]] = True
        n = np.bincount(self.entry_of[asked], weights=np.concatenate([a.n for a in asks])[asked], minlength=len(words)).astype(np.int64)
        context = np.concatenate([self.entry_of[z - len(a.words) + a.context] for a, z in zip(asks, self.entry_ends, strict=True)])
        vocabulary, word = np.unique(np.concatenate([a.pair_word for a in asks]), return_inverse=True)
        size = max(len(vocabulary), 1)
        keys, self.pair_of = np.unique(context * size + word, return_inverse=True)
        pair_n = np.bincount(self.pair_of, weights=np.concatenate([a.pair_n for a in asks]), minlength=len(keys)).astype(np.int64)
        super().__init__(words, home, n, keys // size, vocabulary[keys % size], pair_n)
        self.asks = asks

    def answers(self, n: np.ndarray, codes: np.ndarray) -> list[bytes]:
        out, e, p = [], 0, 0
        for a, f, q in zip(self.asks, self.entry_ends.tolist(), self.pair_ends.tolist(), strict=True):
            out.append(_pack(np.where(a.home, n[self.entry_of[e:f]], 0).astype("<u8"), codes[self.pair_of[p:q]].astype("<u2")))
            e, p = f, q
        return out


class Bigrams(Ask):
    """A block's distinct words and bigrams, in a fixed order."""

    def __init__(self, words: np.ndarray, token: np.ndarray, n: np.ndarray, trains: np.ndarray) -> None:
        """words: the distinct hashes, both symbols among them; token: numbers among words; n: tokens of each document."""
        self.doc = np.repeat(np.arange(len(n)), n)
        self.token = token
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[(np.cumsum(n) - n)] = np.flatnonzero(words == START)[0]
        keys, self.pair_of = np.unique(before << 32 | token, return_inverse=True)
        self.word = keys & 0xFFFFFFFF
        learned = trains[self.doc]
        pair_n = np.bincount(self.pair_of[learned], minlength=len(keys))
        word_n = np.bincount(token[learned], minlength=len(words))
        super().__init__(words, words > END, word_n, keys >> 32, words[self.word], pair_n)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a.tobytes()) for a in arrays], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 8 * len(types), []
    for size, kind in zip(np.frombuffer(raw, "<u8", len(types)).tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _shorten(words: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hot words as numbers (two bytes and one), others as hashes; bits tell which."""
    at = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
    known = hot[at] == words if len(hot) else np.zeros(len(words), bool)
    number = at[known].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    return np.packbits(known), np.ascontiguousarray(number), words[~known]


def _lengthen(bits: np.ndarray, number: np.ndarray, rest: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    known = np.unpackbits(bits, count=n).astype(bool)
    out = np.empty(n, np.uint64)
    b = number.reshape(3, -1).astype(np.int64)
    out[known] = hot[b[0] | b[1] << 8 | b[2] << 16]
    out[~known] = rest
    return out


def tokens_of(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with both symbols by falling frequency, tokens as numbers among them (an end token after each document), tokens of each document."""
    h, at = word_hashes(block.data, block.offsets)
    n = np.diff(at) + 1
    tokens = np.full(len(h) + len(n), END)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(n) - 1] = False
    tokens[inside] = h
    words, ids, count = np.unique(np.concatenate((tokens, np.array([START, END], np.uint64))), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return words[order], rank[ids[: len(tokens)]], n


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about so many bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in gathered(batches, BLOCK_BYTES):
        for block in tb.blocks(batch.column("text"), BLOCK_BYTES):
            some = batch.slice(block.first, len(block))
            trains = some.column("trains").to_numpy(zero_copy_only=False).astype(bool)
            words, token, n = tokens_of(block)
            learned = int(n[trains].sum())
            count = np.bincount(token[np.repeat(trains, n)], minlength=len(words))
            often = np.flatnonzero((count * HOT >= learned) & (count > 0) & (words > END))
            planes = token.astype("<u4").view(np.uint8).reshape(-1, 4).T
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": part << 32 | seq,
                        "doc_ids": some.column("doc_id").to_pylist(),
                        "trains": trains.tolist(),
                        "words": _pack(words),
                        "word_n": _pack(count.astype("<u4")),
                        "tokens": _pack(planes, n.astype("<i8")),
                        "n_train": learned,
                        "n_docs": int(trains.sum()),
                        "n_tokens": len(token),
                        "frequent": [{"word": int(w), "n": int(c)} for w, c in zip(words[often].view(np.int64), count[often], strict=True)],
                    }
                ],
                schema=_BLOCK_TYPE,
            )
            seq += 1


_BLOCK_TYPE = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("trains", pa.list_(pa.bool_())),
        ("words", pa.binary()),
        ("word_n", pa.binary()),
        ("tokens", pa.binary()),
        ("n_train", pa.int64()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("frequent", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))),
    ]
)


def _bigrams(row: dict) -> Bigrams:
    (words,), (planes, n) = _unpack(row["words"], "<u8"), _unpack(row["tokens"], "u1", "<i8")
    token = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
    return Bigrams(words, token, n, np.array(row["trains"], bool))


def _hot_counts(hot: np.ndarray) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hot), np.int64)
        for batch in batches:
            for raw, raw_n in zip(batch.column("words"), batch.column("word_n"), strict=True):
                (words,), (n,) = _unpack(raw.as_py(), "<u8"), _unpack(raw_n.as_py(), "<u4")
                at = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
                known = hot[at] == words if len(hot) else np.zeros(len(words), bool)
                total += np.bincount(at[known], weights=n[known], minlength=len(hot)).astype(np.int64)
        yield pa.record_batch({"place": pa.array(np.arange(len(hot)), pa.int32()), "n": pa.array(total)})

    return count


# ---- requests and shards

ASKED = "lane int, block long, asked binary"
ANSWERS = "block long, lane int, answer binary, distinct long"


def _asked(dealt: Dealt, block: int, hot: np.ndarray) -> pa.RecordBatch:
    rows = list(dealt.requests(hot))
    return pa.record_batch([pa.array([x[0] for x in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["lane", "block", "asked"])


def _answered(block: list[int], lane: list[int], answer: list[bytes], distinct: list[int]) -> pa.Table:
    columns = zip((block, lane, answer, distinct), (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)
    return pa.table([pa.array(c, t) for c, t in columns], ["block", "lane", "answer", "distinct"])


def _ask(sent, shards: int, width: int) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value[0]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _asked(_bigrams(row).deal(shards, width, hot), row["block"], hot)

    return ask


def _requests(table: pa.Table, hot: np.ndarray) -> Combined:
    return Combined([read_request(x.as_py(), hot) for x in table.column("asked")])


def _combine(sent, shards: int, width: int) -> Callable:
    """The requests of one lane and some blocks, dealt to the lanes inside it."""

    def combine(table: pa.Table) -> pa.Table:
        hot = sent.value[0]
        return pa.Table.from_batches([_asked(_requests(table, hot).deal(shards, width, hot), table.column("group")[0].as_py(), hot)])

    return combine


def _expand(sent, shards: int, width: int) -> Callable:
    """The answers to what _combine asked, as answers to the requests that it combined."""

    def expand(asked: pa.Table, answered: pa.Table) -> pa.Table:
        both = _requests(asked, sent.value[0])
        n, codes = both.deal(shards, width, sent.value[0]).gather(answered.column("lane").to_pylist(), answered.column("answer").to_pylist())
        size = asked.num_rows
        return _answered(asked.column("block").to_pylist(), asked.column("lane").to_pylist(), both.answers(n, codes), [0] * size)

    return expand


class Trie:
    """The levels of one shard, mapped from a file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.contexts = elias_fano.Sequence(self.map)
        self.pointers = elias_fano.Sequence(self.map, self.contexts.end)
        self.words = elias_fano.Sequence(self.map, self.pointers.end)
        self.successors = elias_fano.Sequence(self.map, self.words.end)
        self.codes = np.frombuffer(self.map, "<u2", len(self.successors), self.successors.end)

    @staticmethod
    def write(path: str, contexts: np.ndarray, context: np.ndarray, word: np.ndarray, p: np.ndarray) -> None:
        """contexts: distinct hashes, ascending; bigrams, each once: context: its number among them, word: hash, p: probability.

        Contexts without a bigram are left out.
        """
        used = np.flatnonzero(np.bincount(context, minlength=len(contexts)))
        rank = np.zeros(len(contexts), np.uint64)
        rank[used] = np.arange(len(used), dtype=np.uint64)
        words, w = np.unique(word, return_inverse=True)
        size = _U(max(len(words), 1))
        keys = rank[context] * size + w.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        pointers = np.searchsorted(keys, np.arange(len(used) + 1, dtype=np.uint64) * size)
        with open(path, "wb") as f:
            for level in (contexts[used], pointers.astype(np.uint64), words, keys):
                f.write(elias_fano.encode(level))
            f.write(quantise(p[order]).astype("<u2").tobytes())

    def codes_of(self, contexts: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of many bigrams (contexts[context], word); 0 where the trie has none."""
        c, (words, at) = self.contexts.find(contexts)[context], np.unique(word, return_inverse=True)
        w, out = self.words.find(words)[at], np.zeros(len(context), "<u2")
        known = np.flatnonzero((c >= 0) & (w >= 0))
        c, w = c[known], w[known]
        bounds = self.pointers.get(np.arange(len(self.pointers))).astype(np.int64) if len(c) > len(self.pointers) else None
        begin, end = (bounds[c], bounds[c + 1]) if bounds is not None else (self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64))
        place, hit = self.successors.search(c.astype(np.uint64) * _U(max(len(self.words), 1)) + w.astype(np.uint64), begin, end)
        out[known[hit]] = self.codes[place[hit]]
        return out

    def close(self) -> None:
        for s in (self.contexts, self.pointers, self.words, self.successors):
            s.lows = s.bits = s.ones = None
        self.codes = None
        self.map.close()


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes from 1; 0 stands for no bigram."""
    return 1 + np.rint((np.maximum(np.log10(np.maximum(p, 1e-300)), LEAST) - LEAST) * STEPS).astype(np.int64)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 1) / STEPS + LEAST), 0.0)


def _serve(sent, n_docs: int) -> Callable:
    def serve(table: pa.Table) -> pa.Table:
        hot, hot_n = sent.value
        shard, both = table.column("lane")[0].as_py(), _requests(table, hot)
        # a training token has one follower, so n(v) is the sum over a context's bigrams, unless they are dealt over shards
        n_v = np.bincount(both.context, weights=both.pair_n, minlength=len(both.words))
        at = np.minimum(np.searchsorted(hot, both.words), max(len(hot) - 1, 0))
        known = hot[at] == both.words if len(hot) else np.zeros(len(both.words), bool)
        n_v[known] = hot_n[at[known]]
        n_v[both.words == START] = n_docs
        seen = np.flatnonzero(both.pair_n)
        path = os.path.join(tempfile.gettempdir(), f"trie-{os.getpid()}-{shard}")
        try:
            context = both.context[seen]
            Trie.write(path, both.words, context, both.pair_word[seen], both.pair_n[seen] / (n_v[context] + MU))
            trie = Trie(path)
            codes = trie.codes_of(both.words, both.context, both.pair_word)
            trie.close()
        finally:
            if os.path.exists(path):
                os.remove(path)
        size = table.num_rows
        distinct = [int((both.n > 0).sum())] + [0] * (size - 1)
        return _answered(table.column("block").to_pylist(), [shard] * size, both.answers(both.n, codes), distinct)

    return serve


# ---- scores

def _score(sent, shards: int, width: int, total: int, vocabulary: int, n_docs: int) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _bigrams(row)
                n, codes = b.deal(shards, width, sent.value[0]).gather([x["lane"] for x in row["answers"]], [x["answer"] for x in row["answers"]])
                n[b.words <= END] = n_docs
                p0 = (n + 0.5) / (total + 0.5 * (vocabulary + 1))
                smoothed = restore(codes) + MU * p0[b.word] / (n[b.context] + MU)
                size = len(row["doc_ids"])
                by_doc = lambda x: np.bincount(b.doc, weights=x, minlength=size)
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "n_tokens": pa.array(np.bincount(b.doc, minlength=size), pa.int64()),
                        "n_known": pa.array(by_doc(n[b.token] > 0).astype(np.int64)),
                        "base_score": pa.array(by_doc(np.log10(p0)[b.token])),
                        "score": pa.array(by_doc(np.log10(smoothed)[b.pair_of])),
                    }
                )

    return score


def lanes(shards: int) -> tuple[int, list[int]]:
    """How many lanes a sender reaches, FAN at most, and how many shards a lane holds in each round, one in the last.

    The rounds are as few as FAN allows; the lanes are then made even over them, since a first round of few lanes
    would put a large share of many blocks into one task.
    """
    rounds, fan = 1, 1
    while FAN**rounds < shards:
        rounds += 1
    while fan**rounds < shards:
        fan += 1
    return fan, [fan**k for k in reversed(range(rounds))]


def score_documents(docs: DataFrame, trains, *, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); trains: a boolean column of docs."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(trains, F.lit(False)).alias("trains"))
    blocks = stage(rows.mapInArrow(tb.tidy(make_blocks), BLOCKS), "blocks", folder)
    n_blocks, total, n_docs, n_tokens = (int(x or 0) for x in blocks.agg(F.count("*"), F.sum("n_train"), F.sum("n_docs"), F.sum("n_tokens")).first())
    often = blocks.select(F.explode("frequent").alias("f")).groupBy("f.word").agg(F.sum("f.n").alias("n")).where(F.col("n") * HOT >= total)
    hot = np.sort(often.select("word").toArrow().column("word").to_numpy().astype(np.int64).view(np.uint64))  # at most HOT words
    hot_n = np.zeros(len(hot), np.int64)
    counted = blocks.select("words", "word_n").mapInArrow(tb.tidy(_hot_counts(hot)), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    hot_n[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    sent, shards = spark.sparkContext.broadcast((hot, hot_n)), max(LEAST_SHARDS, -(-n_tokens // shard_tokens))

    fan, widths = lanes(shards)
    asked = blocks.select("block", "trains", "words", "tokens").mapInArrow(tb.tidy(_ask(sent, shards, widths[0])), ASKED)
    passed, groups = [], n_blocks
    for k, width in enumerate(widths[1:]):
        groups = -(-groups // fan)
        asked = stage(asked, f"asked-{k}", folder).withColumn("group", F.pmod(F.xxhash64("block", F.lit(k)), F.lit(max(groups, 1))))
        passed.append(asked)
        asked = asked.groupBy("lane", "group").applyInArrow(_combine(sent, shards, width), ASKED)
    served = stage(asked.groupBy("lane").applyInArrow(_serve(sent, n_docs), ANSWERS), "answers", folder)
    vocabulary = int(served.agg(F.sum("distinct")).first()[0] or 0) + (n_docs > 0)
    for width, before in zip(reversed(widths[1:]), reversed(passed), strict=True):
        back = served.withColumn("inside", F.floor(F.col("lane") / fan).cast("int"))
        served = before.groupBy("lane", "group").cogroup(back.groupBy("inside", "block")).applyInArrow(_expand(sent, shards, width), ANSWERS)
    answers = served.groupBy("block").agg(F.collect_list(F.struct("lane", "answer")).alias("answers"))  # FAN lanes at most
    joined = blocks.select("block", "doc_ids", "trains", "words", "tokens").join(answers, "block")
    scored = joined.mapInArrow(tb.tidy(_score(sent, shards, widths[0], total, vocabulary, n_docs)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(documents(spark, sf_dir), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

