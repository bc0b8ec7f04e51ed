"""Texts longer than a slice are worked in pieces: same results, and bounded memory."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from runstore.llm import packing, quality, textnum, toxicity

from .test_near_duplicates import shingles

ROOT = Path(__file__).parents[2]


def long_text(n, seed=1, words=3000):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghijklmnoprstuvwéñ") for _ in range(r.randrange(1, 11))) for _ in range(words)]
    out, size = [], 0
    while size < n:
        w = r.choice(known) + r.choice((" ",) * 12 + (". ", "\n", "  ", "\t"))
        out.append(w)
        size += len(w)
    return "".join(out)


def test_shingles_of_a_long_text():
    text = long_text(2_500_000) + " " + "x" * 2_300_000 + " end of it all now"
    own, again = textnum.shingle_sets(pa.array([text, "y"]))
    want = shingles(text)
    assert len(own) == len(want) and len(again) == 1
    tail = next(textnum.shingle_sets(pa.array(["x" * 2_300_000 + " end of it all"])))
    assert len(tail) == 1 and tail[0] in own  # a word of any length has one hash, wherever it stands


def test_statistics_of_a_long_text(monkeypatch):
    text = long_text(2_500_000)
    got = quality.statistics(pa.array([text]))[0]
    monkeypatch.setattr(quality, "SLICE_BYTES", 1 << 30)
    assert np.allclose(got, quality.statistics(pa.array([text]))[0], rtol=1e-3, atol=1e-4)


def test_words_of_a_long_text(monkeypatch):
    texts = pa.array([long_text(2_500_000), "short one here"])
    features = np.unique(np.concatenate([h for _, _, _, h in toxicity.distinct_words(texts)]))
    vocabulary = features[::7]
    row, col = toxicity.known_words(texts, vocabulary)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1 << 30)
    assert (features == np.unique(np.concatenate([h for _, _, _, h in toxicity.distinct_words(texts)]))).all()
    want = toxicity.known_words(texts, vocabulary)
    assert set(zip(row.tolist(), col.tolist())) == set(zip(*(x.tolist() for x in want))) and len(row) == len(want[0])


def test_stretches_give_the_same_ids(monkeypatch):
    encode = packing._encoder(None, None)
    r = random.Random(3)
    bits = ["word", " ", "  ", "\n", "\t ", "12", "é", "'s", "!?", " x", " ", "\x1c", "　", "日本", "<|endoftext|>", " 've"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randrange(60)))
        whole = encode(text)
        for size in (3, 10):
            monkeypatch.setattr(packing, "STRETCH", size)
            parts = list(packing._stretches(text))
            assert "".join(parts) == text and sum((list(encode(p)) for p in parts), []) == list(whole)


CODE = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from runstore.llm import near_duplicates, personal_data, quality, repeated_passages, secrets, textnum, toxicity
block = "the quick brown fox jumps over a lazy dog, mail x@y.example.com {{}} and goes on without any end in sight.\\n"
text = "".join(block.format(i) for i in range({n} // 104))
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.large_string())], ["doc_id", "text"])
del text
op = {op!r}
if op == "op2":
    toxicity.known_words(batch.column(1), np.arange(1, 2000, dtype=np.uint64) << np.uint64(50))
elif op == "op3":
    secrets.tagger().spans(batch.column(1)), secrets.base_spans(batch.column(1)[0].as_py())
elif op == "op5":
    list(near_duplicates._sketch([batch]))
elif op == "op6":
    list(repeated_passages._scan([batch]))
elif op == "op7":
    quality.statistics(batch.column(1))
elif op == "op10":
    personal_data.tagger().spans(batch.column(1)), personal_data.base_spans(batch.column(1)[0].as_py())
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("op", ["op2", "op3", "op5", "op6", "op7", "op10"])
def test_memory_for_a_text_of_64_mb(op):
    run = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), n=64 << 20, op=op)], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout) < 1200
