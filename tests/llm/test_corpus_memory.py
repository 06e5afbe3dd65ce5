"""Memory and lookups of the corpus operators' Python tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from chatterlens.llm import induced, suffix_dedup, toxicity


def _texts(n, size, seed=0):
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"aaabcdeeeefghiiklmnooprsttuv     ", dtype=np.uint8)
    return [letters[rng.integers(0, len(letters), size)].tobytes() for _ in range(n)]


def _peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sorting_takes_little_memory_a_byte():
    pieces = _texts(1500, 400)
    pieces[7] = pieces[3][:250] + pieces[7][:50]
    total = sum(map(len, pieces))
    suffix_dedup.repeated(pieces[:2], [1, 1], 200)
    peak = _peak(lambda: suffix_dedup.repeated(pieces, [1] * len(pieces), 200))
    assert peak < 50 * total


def test_cutting_holds_few_texts_at_a_time():
    texts = [t.decode() for t in _texts(1000, 2000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(1000), pa.int64()), pa.array(range(1000), pa.int64()), pa.array(texts)], ["k1", "k2", "text"])
    cut = suffix_dedup._cut(200, 64)
    found = []
    list(cut(iter([batch.slice(0, 1)])))
    peak = _peak(lambda: found.extend(x.num_rows for x in cut(iter([batch]))))
    assert sum(found) > 1000
    assert peak < 60_000_000


def test_windows_that_repeat_across_a_piece_end_do_not_count():
    piece = _texts(1, 420, seed=3)[0]
    pieces = [piece, piece[100:320], b"x" * 150]
    first, second, short = suffix_dedup.repeated(pieces, [1, 1, 1], 200)
    assert first.tolist() == list(range(100, 121)) and second.tolist() == list(range(21)) and not len(short)


def test_common_prefixes_in_parts_are_the_same(monkeypatch):
    text = np.frombuffer(b"".join(_texts(2, 300)) * 3, dtype=np.uint8)
    x, y = np.random.default_rng(1).integers(0, len(text), size=(2, 1000))
    y[::3] = (x[::3] + 600) % len(text)
    whole = induced.common_prefix(text, x, y, 200)
    monkeypatch.setattr(induced, "PAIRS", 7)
    assert induced.common_prefix(text, x, y, 200).tolist() == whole.tolist()


@pytest.mark.parametrize("features", [
    np.zeros(0, dtype=np.uint64), np.array([5], dtype=np.uint64), np.array([2**64 - 1], dtype=np.uint64),
    np.arange(100, 400, dtype=np.uint64), np.uint64(2**64 - 300) + np.arange(300, dtype=np.uint64),
    np.unique(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)),
])
def test_places_of_hashes(features):
    other = np.random.default_rng(3).integers(0, 2**64, 2000, dtype=np.uint64)
    found = np.concatenate([features[::-1], other, features + np.uint64(1), features, np.array([0, 2**64 - 1], dtype=np.uint64)])
    place, hit = toxicity.places(features, found)
    assert hit.tolist() == np.isin(found, features).tolist()
    assert (features[place[hit]] == found[hit]).all()


def test_spread_hashes_need_no_halving(monkeypatch):
    features = np.unique(np.random.default_rng(4).integers(0, 2**64, 50_000, dtype=np.uint64))
    sought, halve = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args, **more: (sought.append(np.size(v)), halve(a, v, *args, **more))[1])
    texts = [t.replace(b" ", b"q ") for t in _texts(20, 3000)]
    toxicity.vectors(texts, features)
    words = sum(len(t.split()) for t in texts)
    # Owners of words and bounds of texts are looked up; the words' hashes are not.
    assert sum(sought) < 1.2 * words
