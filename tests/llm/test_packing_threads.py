"""A packing worker keeps to its task's core: the tokenizer starts no threads of its own."""

import os
import subprocess
import sys

import pytest

from spanstrata.llm.common import TOKENIZERS

CODE = """
import os
from array import array
from tokenizers import Tokenizer
from spanstrata.llm.packing import ChunkEncoder

path = {path!r}
text = " ".join(f"no{{i}}! +{{i}}-x (a{{i}})" for i in range(500)) + " plain words. Éou ciónes,"
encoder = ChunkEncoder(path)
before = len(os.listdir("/proc/self/task"))
ids = encoder.encode(text.encode())
print(len(os.listdir("/proc/self/task")) - before)
print(ids == array("I", Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids).tobytes())
"""


@pytest.mark.skipif(not os.path.isdir("/proc/self/task"), reason="threads are counted in /proc")
def test_no_threads_beside_the_task():
    env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    code = CODE.format(path=f"{TOKENIZERS}/word_bpe_49k.json")
    out = subprocess.run([sys.executable, "-B", "-c", code], env=env, capture_output=True, text=True, check=True).stdout.split()
    assert out == ["0", "True"]
