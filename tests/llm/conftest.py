import pytest

from covspark.llm import substrings


@pytest.fixture(autouse=True)
def few_jobs(monkeypatch):
    """A round's segments are settled at once, as fixtures are small; tests of turns set them again."""
    monkeypatch.setattr(substrings, "TURNS", 1)
