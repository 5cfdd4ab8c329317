"""Words, base counts, n-gram tries and token ids against plain Python."""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from domloom.llm import bradley_terry, compression_rules, elias_fano, lm, minhash, packing, planes, toxicity
from domloom.llm import textbytes as tb
from domloom.llm.tokens import Encoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.one_of(st.sampled_from("ab AB\n\t.,#|é漢"), st.characters(codec="utf-8")), max_size=60)
TEXTS = st.lists(st.one_of(st.none(), TEXT), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words(texts, size):
    found = []
    for b in tb.blocks(pa.array(texts, pa.string()), size):
        h = b.hashes(lower=True)
        for d in range(len(b)):
            found.append(([b.text(k).decode() for k in range(b.word_offsets[d], b.word_offsets[d + 1])], h[b.word_offsets[d] : b.word_offsets[d + 1]].tolist()))
    want = [WORD.findall(t or "") for t in texts]
    assert [f[0] for f in found] == want
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen: dict[str, int] = {}
    for words, hashes in found:
        for w, h in zip(words, hashes, strict=True):
            assert seen.setdefault(w.translate(low), h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_differ():
    a, b = "x" * 5000 + "y", "y" + "x" * 5000
    h = next(tb.blocks(pa.array([f"{a} {b} {a}"]))).hashes(lower=False)
    assert h[0] == h[2] != h[1]


def _base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(covered)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_rule_counts(texts):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    rows = [r for b in compression_rules.score_batches([batch]) for r in b.to_pylist()]
    for t, r in zip(texts, rows, strict=True):
        counts = _base(t)
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_compression_bands():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(words, 900))
    noise = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 3000))
    noise = " ".join(noise[i : i + 20] for i in range(0, 3000, 20))
    repetitive = " ".join(f"{a} {b}" for a in "abcdefg" for b in "hijklmn") * 2 + " ".join(["lorem ipsum dolor"] * 10) + "z" * 5000
    batch = pa.record_batch({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": [prose, noise, repetitive]})
    kept = [r["kept"] for b in compression_rules.score_batches([batch]) for r in b.to_pylist()]
    assert kept == [True, False, False]


@pytest.mark.parametrize("size,chunks", [(0, []), (4096, []), (4097, [4096, 1]), (8191, [4096, 4095]), (8192, [4096] * 2), (12287, [4096, 4096, 4095])])
def test_all_bytes_are_chunked(size, chunks):
    whole, each = compression_rules.ratios(b"q" * size, zlib.compress)
    assert (whole is None) == (size == 0) and [n for n, _ in each] == chunks


def test_chunk_limits_depend_on_length():
    rng = np.random.default_rng(2)
    prose = " ".join("".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(700))[:3000]
    code = base64.b64encode(rng.bytes(4000)).decode()  # words of 60, whose bytes do not compress
    spaced = " ".join(code[i : i + 60] for i in range(0, len(code), 60))
    batch = pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "text": [spaced[:4096] + prose, prose]})
    rows = [r for b in compression_rules.score_batches([batch]) for r in b.to_pylist()]
    assert [(r["n_chunks"], r["n_bad_chunks"], r["kept"]) for r in rows] == [(2, 1, False), (0, 0, True)]


def _shingles(text, k):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles(texts, k):
    sets = [_shingles(t, k) for t in texts]
    found = [np.split(v, o[1:-1]) for b in tb.blocks(pa.array(texts, pa.string())) for v, o in [minhash.shingle_sets(b, k)]]
    found = [set(x.tolist()) for f in found for x in f][: len(texts)]
    for i in range(len(texts)):
        assert len(found[i]) == len(sets[i])
        for j in range(i):
            assert len(found[i] & found[j]) == len(sets[i] & sets[j])


def test_circulant_signatures():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    offsets = np.array([0, 10, 10, 4000, len(values)])
    scatter, runs = minhash._tables(64)
    sig = minhash.signatures(values, offsets, 64, step=700)
    shifted = runs[:, 0]
    for row, (a, z) in zip(sig, ((0, 10), (10, 4000), (4000, len(values))), strict=True):
        place = scatter[(values[a:z] & np.uint64(minhash.UNIVERSE - 1)).astype(int)]
        assert row.tolist() == [int(shifted[(place + s) % minhash.UNIVERSE].min()) for s in range(64)]
    # coordinates agree about as often as the sets do
    pool = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:])
    two = minhash.signatures(np.concatenate((a, b)), np.array([0, 1000, 2000]), 420)
    assert abs((two[0] == two[1]).mean() - 800 / 1200) < 0.1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=8), st.integers(0, 8))
def test_meeting_joins_what_links(sets, cut):
    items = [(i, i, np.array(sorted(s), np.uint64)) for i, s in enumerate(sets)]

    def groups(links):
        parent = list(range(len(sets)))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in range(len(sets))]

    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    n = len(sets)
    got = minhash.meeting(items, None, 80)
    assert all(linked(a, b) for a, b in got) and groups(got) == groups([(a, b) for a in range(n) for b in range(a) if linked(a, b)])
    first, second = items[:cut], items[cut:]
    if first and second:
        assert groups(minhash.meeting(first, second, 80)) == groups([(a, b) for a in range(cut) for b in range(cut, n) if linked(a, b)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 63))
def test_elias_fano(values, shift):
    v = np.sort(np.array([x >> shift for x in values], np.uint64))
    s = elias_fano.Sequence(b"pad" + elias_fano.encode(v) + b"tail", 3)
    assert s.get(np.arange(len(v))).tolist() == v.tolist()
    asked = sorted({0, 5, 2**64 - 1, *v.tolist(), *(int(x) + 1 for x in v if x < 2**64 - 1)})
    at, hit = s.search(np.array(asked, np.uint64))
    assert at.tolist() == np.searchsorted(v, np.array(asked, np.uint64)).tolist()
    assert hit.tolist() == [x in v.tolist() for x in asked]
    for begin, end in ((0, len(v) // 2), (len(v) // 3, len(v)), (len(v) // 2, len(v) // 2)):
        at, hit = s.search(np.array(asked, np.uint64), begin, end)
        assert at.tolist() == (begin + np.searchsorted(v[begin:end], np.array(asked, np.uint64))).tolist()
        assert hit.tolist() == [x in v[begin:end].tolist() for x in asked]
    assert all((s.find(np.array(asked, np.uint64)) >= 0) == [x in v.tolist() for x in asked])


def test_elias_fano_is_compact():
    rng = np.random.default_rng(4)
    for n, top in ((100_000, 2**40), (100_000, 2**63), (50_000, 60_000)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        raw = elias_fano.encode(v)
        assert 8 * len(raw) / n <= 2 + max(np.log2(top / n), 0) + 2.1  # high and low bits, and the directory
        s = elias_fano.Sequence(raw)
        some = rng.integers(0, n, 5000)
        assert (s.get(some) == v[some]).all()
        at, hit = s.search(v[some])
        assert hit.all() and (at == np.searchsorted(v, v[some])).all()


def test_trie(tmp_path):
    rng = np.random.default_rng(2)
    contexts = np.unique(rng.integers(20, 2**63, 50, dtype=np.uint64))
    word_pool = rng.integers(20, 2**63, 30, dtype=np.uint64)
    pairs = sorted({(int(c), int(w)) for c, w in zip(rng.integers(0, len(contexts) - 1, 800), rng.integers(0, 29, 800), strict=True)})
    context, word, p = np.array([c for c, _ in pairs]), word_pool[[w for _, w in pairs]], rng.uniform(1e-6, 1, len(pairs))
    lm.Trie.write(str(tmp_path / "t"), contexts, context, word, p)
    t, held = lm.Trie(str(tmp_path / "t")), {(int(contexts[c]), int(w)): x for c, w, x in zip(context, word, p, strict=True)}
    every = np.array([*contexts.tolist(), 7], np.uint64)
    for few in (True, False):  # one at a time, and all at once
        asked = [(i, w) for i in range(len(every)) for w in [*word_pool.tolist(), 9]]
        at, words = np.array([i for i, _ in asked]), np.array([w for _, w in asked], np.uint64)
        codes = np.array([t.codes_of(every, at[k : k + 1], words[k : k + 1])[0] for k in range(len(asked))]) if few else t.codes_of(every, at, words)
        for (i, w), code, got in zip(asked, codes.tolist(), lm.restore(codes).tolist(), strict=True):
            want = held.get((int(every[i]), w))
            assert (code == 0) == (want is None) and (want is None or abs(np.log10(got / want)) <= 0.5 / 64 + 1e-9)
    t.close()


@pytest.mark.parametrize(("most", "shards"), [(256, 64), (256, 272), (256, 830), (256, 70_000), (5, 65), (4096, 4097)])
def test_a_combined_request_holds_about_a_block(monkeypatch, most, shards):
    """As many blocks are combined as there are lanes; 272 shards used to give lanes of 256 and of 16 shards, and 256 blocks each."""
    monkeypatch.setattr(lm, "FAN", most)
    fan, widths = lm.lanes(shards)
    assert fan <= most and widths[-1] == 1 and all(a == fan * b for a, b in zip(widths, widths[1:], strict=False))
    assert fan * widths[0] >= shards
    assert len(widths) == 1 or fan * widths[0] / shards <= 2


def test_requests_combine_and_answers_come_back():
    """Asks dealt to lanes, combined, dealt again: every count and code reaches its asker."""
    rng, shards = np.random.default_rng(3), 37
    hot = np.sort(rng.integers(20, 2**63, 3, dtype=np.uint64))
    pool = np.concatenate((hot, rng.integers(20, 2**63, 40, dtype=np.uint64), np.array([1, 2], np.uint64)))
    asks = []
    for _ in range(4):
        token = rng.integers(0, len(pool) - 2, 200)
        asks.append(lm.Bigrams(pool, token, np.array([50, 0, 150]), np.array([True, True, False])))
    value = lambda a: (a.words[a.context] ^ tb.mix(a.pair_word)) % np.uint64(50_000)
    lanes = {}
    for i, a in enumerate(asks):
        for lane, raw in a.deal(shards, 10, hot).requests(hot):
            lanes.setdefault(lane, []).append((i, raw))
    answers = {i: [] for i in range(len(asks))}
    total = {}
    for lane, rows in lanes.items():
        both = lm.Combined([lm.read_request(raw, hot) for _, raw in rows])
        dealt = both.deal(shards, 1, hot)
        inside = []
        for shard, raw in dealt.requests(hot):
            assert shard // 10 == lane
            last = lm.Combined([lm.read_request(raw, hot)])
            for c, w, n in zip(last.words[last.context].tolist(), last.pair_word.tolist(), last.pair_n.tolist(), strict=True):
                assert (c, w) not in total
                total[c, w] = n
            inside.append((shard, last.answers(last.n, value(last))[0]))
        n, codes = dealt.gather([x for x, _ in inside], [x for _, x in inside])
        for (i, _), raw in zip(rows, both.answers(n, codes), strict=True):
            answers[i].append((lane, raw))
    want_n, want_pairs = np.zeros(len(pool), np.int64), Counter()
    for a in asks:
        want_n += a.n
        for c, w, n in zip(a.words[a.context].tolist(), a.pair_word.tolist(), a.pair_n.tolist(), strict=True):
            want_pairs[c, w] += n
    assert total == want_pairs
    for i, a in enumerate(asks):
        n, codes = a.deal(shards, 10, hot).gather([x for x, _ in answers[i]], [x for _, x in answers[i]])
        assert n.tolist() == np.where(a.home, want_n, 0).tolist() and codes.tolist() == value(a).tolist()


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path(), 2, limit=50)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAbeEKté É.,'<|>endoftext \ń"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_tokens(encoder, texts):
    for b in tb.blocks(pa.array(texts, pa.string())):
        ids, offsets = encoder.encode(b)
        for d in range(len(b)):
            want = encoder.tokenizer.encode(texts[b.first + d], add_special_tokens=False).ids
            assert ids[offsets[d] : offsets[d + 1]].tolist() == [*want, 2]


@pytest.mark.parametrize("word", ["<|endoftext|>", "a<|startoftext|>b.", "J̌.", "K̇,", "İ.", "don't.", "Straße,", "×.", "a..", "...", "x" * 3000 + "."])
def test_odd_tokens(encoder, word):
    b = next(tb.blocks(pa.array([f"{word} and {word}"])))
    ids, _ = encoder.encode(b)
    assert ids[:-1].tolist() == encoder.tokenizer.encode(f"{word} and {word}", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([planes.BYTE, planes.BIT]), st.sampled_from([8, 64, 1 << 16]))
def test_plane_files(values, kind, block):
    ids = np.array(values, np.uint32)
    n = np.array([len(ids)], np.int64)
    raw = planes.write_file(ids, np.array([-5]), np.array([True]), n, kind, block)
    r = planes.Reader(raw)
    assert r.read().tolist() == values and r.doc_ids.tolist() == [-5] and r.n_tokens.tolist() == [len(values)]
    for k in range(-(-len(values) // block)):
        assert r.read_block(k).tolist() == values[k * block : (k + 1) * block]
    with pytest.raises(ValueError):
        planes.Reader(b"nothing like it" + raw[20:])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 100_000))
def test_piece_lengths(n):
    p = packing.piece_lengths(n)
    assert sum(p) == n and p == sorted(p, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in p)
    assert len([x for x in p if x < 2048]) == len({x for x in p if x < 2048})


def test_pairwise_ranking():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (300, 5)), rng.normal(-1, 1, (60, 5))
    m = bradley_terry.fit(good, bad)
    assert (bradley_terry.strength(m, good).mean() - bradley_terry.strength(m, bad).mean()) > 2
    assert bradley_terry.fit(good, bad[:0])["w"] is None
    bad, good = np.array([5, 1, 0, 0, 0]), np.array([0, 0, 0, 0, 9])
    low, high = np.array([-9.0, 1.0, np.nan, np.nan, 4.0]), np.array([0.5, 2.0, np.nan, np.nan, 1e9])
    assert bradley_terry.cut_from_counts(bad, good, low, high) == 3.0
    assert bradley_terry.cut_from_counts(good * 0, good, low, high) <= 4.0 and bradley_terry.cut_from_counts(bad, bad * 0, low, high) > 2.0


def test_convolution_gradient_learns_bigrams():
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(40)]
    texts, y = [], []
    for k in range(240):
        words = [w for w in rng.choice(pool, 30) if w not in ("w1", "w2")]
        if k % 2:
            at = rng.integers(0, len(words))
            words[at:at] = ["w1", "w2"]
        else:
            words += ["w2", "w1"] if k % 4 else []
        texts.append(" ".join(words))
        y.append(k % 2)
    model = toxicity.fit(pa.array(texts), np.array(y), epochs=40)
    right = (toxicity.scores(model, pa.array(texts)) >= 0.5) == np.array(y, bool)
    assert right.mean() > 0.95  # order matters: single words do not tell
    assert toxicity.fit(pa.array(["a"]), np.array([1])) is None
    assert toxicity.scores(model, pa.array([None, ""]))[0] < 0.5
