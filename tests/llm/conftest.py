"""Shared pieces of the tests of the subpackage."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="session")
def small() -> str:
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    return SMALL
