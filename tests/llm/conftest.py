import pytest

pytest.importorskip("flowloom.llm")
