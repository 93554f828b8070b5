"""What a task holds beside its input, and that working in small stretches changes nothing."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tidegrid.llm import bpe, collocations, ngram_join, suffix_dedup, token_files


def peak(f):
    """Its result, and the MB that were held at once while it ran."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_near_duplicate_blocks_hold_no_copies_of_their_matrices():
    rng = np.random.default_rng(1)
    half = [np.sort(rng.choice(20_000, 60, replace=False)).astype(np.uint64) for _ in range(1000)]
    sets = [*half, *(x if k % 3 else x[:-1] for k, x in enumerate(half))]
    links, held = peak(lambda: ngram_join._forest(sets, 1000, 80))
    assert {(i, i + 1000) for i in range(1000)} <= set(links)
    assert held < 30  # 48 for two copies of a matrix of all sets alone


def test_edges_are_spelt_a_slice_at_a_time():
    rng = np.random.default_rng(2)
    n = 300_000
    keys = rng.integers(1, 1 << 62, (5, n)).astype(np.uint64)
    numbers = rng.integers(0, 1_000_000, (5, n))
    numbers[4, :7] = -1
    both = [collocations._Numbers.spell(k, m) for k, m in zip(keys, numbers, strict=True)]
    times = rng.integers(1, 300, n)
    packed, held = peak(lambda: collocations._packed([w for w, _ in both], [s for _, s in both], np.full(n, 4), times))
    assert held < 40
    for i in [*range(20), *rng.integers(0, n, 200).tolist(), n - 1]:
        tail = bytes([times[i]]) if times[i] < 255 else int(times[i]).to_bytes(4, "little") + b"\xff"
        assert packed[i].as_py() == b"\4" + b"".join(w[i, : s[i]].tobytes() for w, s in both) + tail


def test_files_are_spelt_out_a_stretch_at_a_time():
    rng = np.random.default_rng(3)
    sizes = np.full(2000, 1000)
    ids = np.repeat(rng.integers(1, 40_000, 20_000), 100).astype("<u4")
    file = token_files.file_of(ids, sizes, np.arange(2000), np.ones(2000, bool), 50_000, token_files.FileParams())
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([file], pa.binary())], ["before", "file"])

    def read():
        return [(b.num_rows, b.column("id")[0].as_py(), b.column("start")[0].as_py(), b.column("ids")[0].as_py()) for b in token_files._decode(iter([batch]))]

    found, held = peak(read)
    assert sum(n for n, *_ in found) == 2000 and len(found) > 4
    assert all(raw == ids[1000 * i : 1000 * (i + 1)].tobytes() and start == 1000 * i + 5 for _, i, start, raw in found)
    assert held < 25


@pytest.mark.parametrize("added_tokens", [True, False])
def test_parts_of_texts_are_encoded_like_texts(added_tokens):
    rng = np.random.default_rng(4)
    letters = ["a", "B", "é", "日", " ", " ", "  ", "　", " ", " ", "\t", "\n", "\x85", "\x1c", "!", "'s", "<|endoftext|>", "<|", "​", "9", "word ", "😀", "x" * 300]
    texts = [None, "", " ", "  ", " a", "a ", *("".join(rng.choice(letters, int(rng.integers(1, 30)))) for _ in range(2000))]
    with open(public_tokenizers.path("byte_bpe_50k.json")) as definition:
        words = token_files._Words(definition.read(), 256, added_tokens)
    for a in range(0, len(texts), 300):
        some = texts[a : a + 300]
        ids, sizes = words.encode(pa.array(some, pa.string()))
        want = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_words_of_a_task_are_held_as_arrays():
    ranks = {bytes([i]): i for i in range(256)} | {b" w": 256}
    texts = [[f" w{i}" for i in range(100 * k, 100 * k + 100)] for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "_words"])
    shared, vocabulary = SimpleNamespace(value=(ranks, {" w7": np.array([256, 55], "<u4").tobytes()})), SimpleNamespace(value=list(ranks))

    def read():
        return sum(b.num_rows for b in bpe._join(shared, vocabulary, 1 << 18, ("doc_id",))(iter([batch])) if b.column("decoded").to_pylist())

    found, held = peak(read)
    assert found == 3000 and held < 30
    first = next(bpe._join(shared, vocabulary, 4, ("doc_id",))(iter([batch])))
    assert first.column("decoded")[0].as_py() == "".join(texts[0]).encode()
    assert np.frombuffer(first.column("ids")[0].as_py(), "<u4").tolist() == [i for w in texts[0] for i in (256, *w[2:].encode())]


def test_sampling_works_on_short_stretches():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 62, 1_000_000).astype(np.uint64)
    least, held = peak(lambda: suffix_dedup._sliding_min(values, 77))
    assert held < 12
    assert (least == np.lib.stride_tricks.sliding_window_view(values, 77).min(1)).all()
    raw = rng.integers(97, 100, 100_000).astype(np.uint8)
    whole = suffix_dedup._grams(raw, 24)
    for i in [*rng.integers(0, len(whole), 50).tolist(), len(whole) - 1]:
        assert whole[i] == suffix_dedup._grams(raw[i : i + 24].copy(), 24)[0]
