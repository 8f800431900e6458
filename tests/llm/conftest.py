import pytest

from lattica.llm import common, linededup


@pytest.fixture(autouse=True)
def short_plans(request, monkeypatch):
    """Line dedup is exact under any order of its words: a small table of ranks makes short plans. Small shuffles need no early end."""
    if "production" not in request.keywords:
        monkeypatch.setattr(linededup, "BUCKET_BITS", 8)
        monkeypatch.setattr(common, "release", lambda spark: None)
