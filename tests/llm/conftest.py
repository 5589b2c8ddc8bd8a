import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """A maker of invented words and texts with a seed."""

    def make(seed: int, n: int, stems: str = "bcdfglmnprst") -> list[str]:
        rng = random.Random(seed)
        return ["".join(rng.choice(stems) + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n)]

    return make
