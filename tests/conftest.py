import textwrap

import pytest

from loomgraph.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture
def write_tree(tmp_path):
    """Write {relative path: text} below a new folder and return the folder."""

    def write(files, name="repo"):
        root = tmp_path / name
        for path, text in files.items():
            target = root / path
            target.parent.mkdir(parents=True, exist_ok=True)
            if isinstance(text, bytes):
                target.write_bytes(text)
            else:
                target.write_text(textwrap.dedent(text))
        return root

    return write


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
