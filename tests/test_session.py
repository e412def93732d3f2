"""A temporary folder only stands in for the shared one in local sessions."""

from types import SimpleNamespace

import pytest

from fieldlens import session


def test_other_masters_need_a_shared_folder():
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(master=master, applicationId="none"))
        with pytest.raises(ValueError):
            session._fallback_dir(fake)
