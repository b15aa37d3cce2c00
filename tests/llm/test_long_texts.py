"""One very long text takes memory in proportion to itself, not to the many numbers that are made of it."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
HEAD = """
import resource, sys
import numpy as np, pyarrow as pa
rng = np.random.default_rng(0)
words = np.array([f"word{i}" for i in range(5000)])
text = " ".join(words[rng.integers(0, 5000, 3_800_000)].tolist())
texts = pa.array([text])
size = len(text)
del text
import sedimenta.llm.texthash as texthash
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
CASES = {
    "classifier": "from sedimenta.llm import quality; assert len(quality.text_features(texts)[0]) > 4000",
    "passages": "from sedimenta.llm import suffix_dedup as s; assert sum(len(p.at) for _, p, _ in s._parses(pa.RecordBatch.from_arrays([texts], names=['text']), 50)) > 50_000",
    "near": "from sedimenta.llm import near_dedup as n; h, f = texthash.all_shingle_sets(texts, 3); assert n.minhash(h, f).shape == (1, n.HASHES)",
    "benchmark": "from sedimenta.llm import decontaminate as d; i = d.ItemIndex([(1, ' '.join(words[:40]))], 3); assert not i.find(texts)",
    "licences": "from sedimenta.llm import license_scan as l; m = l.Matcher({'x': ['word1 word2 word3 word4 word5 word6']}, 3, 0.7, 6); assert not list(m.find(texts[0].as_py()))",
    "tokens": "from sedimenta.llm import bpe; t = bpe.compile_vocabulary(bpe.load_ranks(bpe.VOCABULARY)) | bpe.compile_lexicon([]) | {'ids': np.zeros(0, np.int32), 'ids_first': np.zeros(1, np.int64)}; assert bpe.Encoder(t).exact(texts)[2].all()",
}


@pytest.mark.parametrize("name", CASES)
def test_memory(name):
    """32 MB of text: at most twelve bytes for each, and 160 MB for tables and one piece."""
    tail = "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / 1e6, size / 1e6)"
    out = subprocess.run([sys.executable, "-c", HEAD + CASES[name] + "\n" + tail], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    more, size = map(float, out.stdout.split())
    assert size > 30 and more < 160 + 12 * size, (more, size)
