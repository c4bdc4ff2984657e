"""Constructs that do not scale, or do not survive a lost executor, stay out of the package."""

from __future__ import annotations

import pathlib
import re

import pytest
from conftest import ROOT

SOURCES = sorted(pathlib.Path(ROOT, "nitrapanel").rglob("*.py"))
BANNED = {
    "cross join": r"\.crossJoin\(",
    "unpartitioned window": r"Window\.(orderBy|partitionBy\(\))",
    "local checkpoint": r"localCheckpoint",
    "row UDF": r"@F\.udf|F\.udf\(",
    "to driver": r"\.toPandas\(|toLocalIterator",
    "rdd": r"\.rdd\b",
}


@pytest.mark.parametrize("what", BANNED)
def test_banned_constructs(what):
    hits = [p.name for p in SOURCES if re.search(BANNED[what], p.read_text())]
    assert hits == []
