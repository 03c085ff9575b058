"""Many small images: windows of them share tasks, and each is read."""

import numpy as np

from canopyspark.sources import tiff


def test_windows_share_tasks(tmp_path, monkeypatch):
    data = np.arange(5 * 64, dtype="<f4").reshape(5, 8, 8)
    for k in range(30):
        (tmp_path / f"a{k:02}.tif").write_bytes(tiff.write(tiff.Image(data + k, data.shape), "none"))
    reader = tiff.TiffReader({"path": f"file://{tmp_path}", "window_bytes": str(2 * 8 * 5 * 8)})
    assert len(reader.partitions()) == 1
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 120
    whole = {}
    for r in rows:
        whole.setdefault(r[0], []).append(np.frombuffer(r[-1]).reshape(r[3], r[1], r[2]))
    for k, path in enumerate(sorted(whole)):
        assert (np.concatenate(whole[path], axis=1) == data + k).all()
    monkeypatch.setattr(tiff, "TASK_PIXELS", 100)  # as if they were large: the driver finds the windows
    parts = reader.partitions()
    assert len(parts) == 120 and [r[:4] for p in parts for r in reader.read(p)] == [r[:4] for r in rows]
