"""The test tables for the corpus operators."""

from __future__ import annotations

import os

import pytest


@pytest.fixture(scope="session")
def sf() -> str:
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("needs the test tables")
    return path


@pytest.fixture(scope="session")
def large() -> str:
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("needs the test tables")
    return path
