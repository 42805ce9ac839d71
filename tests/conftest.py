import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from locusframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("locusframe-tests", cores=8, partitions=4)


@pytest.fixture
def text_file(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_text(content)
        return str(path)

    return write
