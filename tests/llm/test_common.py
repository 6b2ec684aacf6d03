"""Shared pieces."""

import pyarrow as pa

from ebbflow.llm.common import row_chunks


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_tasks_give_back_what_earlier_ones_have_freed():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5))], names=["n"])
    blocks = [bytes(2000) for _ in range(100_000)]
    top = blocks.pop()  # above the others, so that the allocator keeps what is freed below
    blocks.clear()
    before = _resident()
    assert [b.num_rows for b in row_chunks(iter([batch]), 2)] == [2, 2, 1]
    assert before - _resident() > 100_000_000 and len(top) == 2000
