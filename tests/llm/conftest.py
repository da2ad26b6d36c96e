import pytest

pytest.importorskip("targetry.llm.queries")
