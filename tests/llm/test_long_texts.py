"""One very long text through each operator's worker function, in a process of its own: peak memory is bounded."""

import subprocess
import sys

import pytest

SIZE, LIMIT_MB = 20_000_000, 1000

CODE = """
import random, resource, sys
import numpy as np
import pyarrow as pa
rng = random.Random(1)
words = ["w%x" % rng.randrange(1 << 30) for _ in range(5000)] + ["mail a%d@b.org" % i for i in range(50)] + ["Top.", "##", "x" * 40]
text = " ".join(rng.choices(words, k={size} // 9))
name = sys.argv[1]
ids, t = pa.array([1], pa.int64()), pa.array([text.encode()], pa.binary())
batch = pa.record_batch({{"doc_id": ids, "_id": ids, "_k": pa.array([b"k"], pa.binary()), "_t": t}})
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if name == "quality":
    from lodestone.llm.quality import STATS, _statistics
    out = list(_statistics(iter([batch]), 3, [0], ["doc_id", *STATS]))
    assert out[0].column(1)[0].as_py() > 1e6
elif name == "near":
    from lodestone.llm.near_dedup import DEPTH, TREES, _sketcher
    out = list(_sketcher(5, TREES * DEPTH, TREES, DEPTH)(iter([batch])))
    assert out[0].column(2)[0].as_py() > 1e6
elif name == "language":
    from lodestone.llm.language import SLOTS, Filter, grams, stretches, _count
    from lodestone.llm.textnum import flat
    out = list(_count(iter([pa.record_batch({{"lang": pa.array(["en"]), "_t": t}})])))
    model = Filter(["en"], [1.0], np.zeros((1, SLOTS), np.uint64))
    data, off = flat(t)
    assert sum(model.counts(*grams(data[lo:hi], part), j - i)[0, -1] for i, j, lo, hi, part in stretches(off)) > 1e6
elif name == "pii":
    from lodestone.llm.pii import _scan
    out = list(_scan(iter([pa.record_batch({{"doc_id": ids, "_k": batch.column("_k"), "_t": pa.array([text])}})])))
    assert len(out[0].column("base")[0].as_py()) > 1000
elif name == "decontaminate":
    from lodestone.llm.decontaminate import Automaton, words_of
    auto = Automaton([("1", words_of(" ".join(words[:30]).encode()))])
    assert auto.scan(words_of(text.encode()))[0] == []
elif name == "html":
    from lodestone.llm.html_text import main_text
    assert len(main_text("<article><p>" + text.replace(" Top. ", "<p>") + "</article>")) > 1e6
elif name == "substring":
    from lodestone.llm.substring_dedup import _anchor_rows
    keyed = pa.record_batch({{"_k": ids, "_t": t}})
    assert sum(b.num_rows for b in _anchor_rows(200, 64)(iter([keyed]))) > 1e5
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize("name", ["quality", "near", "language", "pii", "decontaminate", "html", "substring"])
def test_memory_of_a_long_text(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(size=SIZE), name], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-800:]
    print(name, done.stdout.strip(), "MB")
    assert int(done.stdout) < LIMIT_MB
