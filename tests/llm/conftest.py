from __future__ import annotations

import random

import pytest


@pytest.fixture
def rng():
    return random.Random(11)
