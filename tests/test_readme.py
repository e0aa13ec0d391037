import re
from pathlib import Path


def test_no_placeholders():
    assert not re.search(r"\b[A-Z]+_TABLE\b", (Path(__file__).parent.parent / "README.md").read_text())
