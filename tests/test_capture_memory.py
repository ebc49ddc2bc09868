"""A reader of captures holds pages of a file, not its groups of rows."""

import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from bazaarium.sources import adapters


def test_a_group_of_rows_is_not_held_whole(tmp_path):
    n, folder = 30_000, tmp_path / "kind=k" / "source=s"
    folder.mkdir(parents=True)
    rng = random.Random(1)
    day = 86_400_000_000
    table = pa.table({"url": [str(i) for i in range(n)], "captured_at": pa.array([1_700_000_000_000_000 + i % 2 * day for i in range(n)], pa.timestamp("us", "UTC")), "payload": [f"{rng.getrandbits(60):020d}" * 50 for _ in range(n)]})
    pq.write_table(table, folder / "a.parquet", row_group_size=n)
    del table
    reader = adapters.CaptureReader({"path": str(tmp_path), "since": "2023-11-15T00:00:00"})
    before, most, found = pa.total_allocated_bytes(), 0, 0
    for part in reader.partitions():
        for batch in reader.read(part):
            found += batch.num_rows
            assert batch.column("captured_at")[0].as_py().replace(tzinfo=None) >= datetime(2023, 11, 15)
            most = max(most, pa.total_allocated_bytes() - before)
    assert found == n // 2 and most < 12 << 20
