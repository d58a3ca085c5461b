import re
from pathlib import Path

import pyarrow as pa
import pytest

from helixframe.llm import line_dedup, near_copies, packing
from helixframe.llm.common import tidy

USED = Path("/proc/self/smaps_rollup")


def used_mb():
    return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", USED.read_text()))) / 1024


def scattered(batches, kept):
    """A task that frees 100 MB but for a piece here and there, which outlives it."""
    for b in batches:
        pieces = [bytes(1000) for _ in range(100_000)]
        kept += pieces[::100]
        del pieces
        yield b


@pytest.mark.skipif(not USED.exists(), reason="memory is read from /proc")
def test_a_worker_gives_freed_memory_back_after_its_task():
    batch, kept = pa.record_batch([pa.array([1])], names=["x"]), []
    before = used_mb()
    assert [b.num_rows for b in tidy(scattered)(iter([batch, batch]), kept)] == [1, 1]
    assert len(kept) == 2000 and used_mb() - before < 40


def test_tasks_of_the_pipeline_give_it_back():
    tasks = [line_dedup._keys, line_dedup._candidates, line_dedup._verified, line_dedup._linked, near_copies._signed, near_copies._sets, near_copies._verified, near_copies._compared, packing._tokenize, packing._pack]
    assert all(hasattr(t, "__wrapped__") for t in tasks)
