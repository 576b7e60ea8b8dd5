"""Whole licence texts that are known by digest only."""

import os

import pytest

from gridlake.llm import licenses

TEXTS = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(TEXTS), reason="no licence texts on this machine")
def test_whole_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(k, open(f"{TEXTS}/{k}").read()) for k in files if os.path.exists(f"{TEXTS}/{k}")]
    got = {r.name: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert got == {k: files[k] for k, _ in rows}
