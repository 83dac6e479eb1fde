import pytest

pytest.importorskip("sluiceway.llm")
