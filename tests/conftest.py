import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import compare  # noqa: E402

from tremorline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def db():
    return compare.database(compare.SF)


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Limits so low that every test series is split into blocks, slots and parts."""
    from tremorline import blocks
    from tremorline.operators import preprocess, spectrum

    for module in (blocks, preprocess):
        monkeypatch.setattr(module, "BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "SPLIT_ROWS", 20)
    monkeypatch.setattr(blocks, "PARTS_PER_SPLIT", 2)
    monkeypatch.setattr(spectrum, "ARRAY_ROWS", 32)
