"""Memory of Python workers, which Spark hands from one operator to the next and keeps beside the stages that follow."""
import subprocess
import sys
import weakref
from pathlib import Path

import pytest

from gridpulse.llm import encoding, fertility
from gridpulse.llm.encoding import BYTE_BPE, PIECE_BPE, WORD_BPE, TextEncoder, encoder

TEXTS = ["", None, " ", "a b  c\n\nd", "Straße und Fluss\tüber 42 Brücken", "x" * 300, "日本 語 \x01 mark", "one two three one two three"] + [f"word{k} stands by word{k * 7}" for k in range(60)]


def test_a_worker_keeps_one_vocabulary():
    first = weakref.ref(encoder(PIECE_BPE))
    assert first() is encoder(PIECE_BPE)  # kept between tasks
    encoder(BYTE_BPE)
    assert first() is None  # without waiting for Python's garbage collection
    assert list(encoding._ENCODERS) == [(BYTE_BPE, None)]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_new_parts_are_learnt_a_bounded_number_at_once(monkeypatch, name):
    want = list(TextEncoder(name).encode_many(TEXTS))
    monkeypatch.setattr(encoding, "LEARN_PARTS", 7)
    coder, most = TextEncoder(name), []
    learn = "_learn_bytes" if name == BYTE_BPE else "_learn_words"
    spied = getattr(coder, learn)
    monkeypatch.setattr(coder, learn, lambda parts: (most.append(len(parts)), spied(parts)))
    assert list(coder.encode_many(TEXTS)) == want
    assert max(most) == 7 and len(most) > 5


def test_words_in_slices_and_a_small_memo(monkeypatch):
    cut = [encoding.words_of(t or "") for t in TEXTS]
    want = list(TextEncoder(PIECE_BPE).encode_words(cut))
    monkeypatch.setattr(encoding, "LEARN_PARTS", 7)
    coder = TextEncoder(PIECE_BPE, memo_parts=20)
    assert [x for w in cut for x in coder.encode_words([w])] == want


@pytest.mark.parametrize("sizes, cuts", [([], []), ([5], [1]), ([0, 0, None], [3]), ([4, 4, 4, 4, 4], [2, 2, 1]), ([3, 100, 3, 3, 9], [1, 3, 1]), ([100, 100], [1, 1])])
def test_slices(sizes, cuts):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array([None if n is None else "x" * n for n in sizes], pa.string())], ["i", "t"])
    got = list(encoding.slices(batch, 1, 10))
    assert [b.num_rows for b in got] == cuts
    assert pa.Table.from_batches(got, batch.schema).to_pylist() == batch.to_pylist()


def test_quality_is_the_same_in_slices(spark, docs_of, monkeypatch):
    rows = [*enumerate(TEXTS), (3, "again and again " * 30), (3, "again and again " * 30), (None, "no id " * 12)]
    want = sorted(map(repr, fertility.quality(docs_of(rows), with_row=True).collect()))

    def small(batch, column):
        return encoding.slices(batch, column, 50)
    monkeypatch.setattr(fertility, "slices", small)
    assert sorted(map(repr, fertility.quality(docs_of(rows), with_row=True).collect())) == want and len(want) == len(rows)


GROWTH = """
import resource, sys
from gridpulse.llm.encoding import PIECE_BPE, encoder
coder = encoder(PIECE_BPE)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
words = lambda k: [[f"w{i}q{i * 31 % 977}" for i in range(k * 40_000, (k + 1) * 40_000)]]
list(coder.encode_words(words(0)))
before = peak()
for k in range(1, 26):
    list(coder.encode_words(words(k)))
print(peak() - before)
"""


def test_memory_of_a_worker_over_ever_new_words():
    out = subprocess.run([sys.executable, "-c", GROWTH], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(out.stdout) < 90  # MB
