import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import HOSTILE  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "re", "su", "lo", "ne", "vi") for b in ("ran", "bel", "dor", "mik", "tas") for c in ("o", "en", "ar", "is", "um")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def text(rng, lines=4, n=12):
    return "\n".join(sentence(rng, n) + "." for _ in range(lines))


@pytest.fixture(scope="session")
def hostile(spark):
    """HOSTILE and one very long text, with columns whose names the operators use themselves."""
    rng = random.Random(5)
    rows = [*HOSTILE, (11, sentence(rng, 60_000)), (12, text(rng)), (13, text(rng))]
    data = [(i, t, None if i == 4 else "en", f"s{k % 3}" if k % 4 else None, 7, "x", 1, "z", 3, 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, row string, shard int, kept double")


@pytest.fixture(scope="session")
def empty(hostile):
    return hostile.where("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
