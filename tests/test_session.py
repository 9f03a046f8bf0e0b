"""Where steps are written."""

from types import SimpleNamespace

import pytest

from fieldlark.session import checkpoint_dir


def test_a_cluster_needs_a_shared_folder(spark):
    held = SimpleNamespace(isDefined=lambda: False)
    far = SimpleNamespace(master="spark://elsewhere:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=far))
    assert checkpoint_dir(spark)
