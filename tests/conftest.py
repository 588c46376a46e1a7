import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from frameweave import get_session  # noqa: E402

# Started at import, as column expressions at module level need a session.
SESSION = get_session("tests", "local[8]", spark__ui__showConsoleProgress="false")
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
