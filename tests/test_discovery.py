"""Reading source trees and choosing the files to index."""

import pytest

from loomgraph.operators.discovery import detect_frameworks, discover, ignore_regex
from loomgraph.sources.repo_files import read_repositories
from tests.conftest import as_set


@pytest.fixture
def tree(write_tree):
    return write_tree(
        {
            "pkg/__init__.py": "x = 1\n",
            ".hidden/tool.py": "y = 1\n",
            "node_modules/x.js": "a()\n",
            "src/a.min.js": "b()\n",
            "src/big.py": "#" * 501 * 1024,
            "src/line.js": "x" * 1001,
            "src/long.ts": ("y" * 800 + "\n") * 3,
            "src/app.tsx": "const a = 1;\n",
            "src/UPPER.PY": "z = 1\n",
            "src/notes.md": "text\n",
            "src/next-env.d.ts": "declare const x: number;\n",
            "web/public/p.js": "p();\n",
            "web/package.json": '{"dependencies": {"react": "1"}}',
            "manage.py": "import django\n",
            "core/migrations/m.py": "m = 1\n",
            "gen/keep.py": "k = 1\n",
            "gen/drop.py": "d = 1\n",
            "deep/gen/free.py": "f = 1\n",
            ".gitignore": "/gen/*.py\n!gen/keep.py\n# comment\n\n*.tmp.py\n",
            "src/a.tmp.py": "t = 1\n",
        }
    )


def test_only_wanted_files_remain(spark, tree):
    found = discover(read_repositories(spark, [str(tree)]))
    assert as_set(found, "relative_path", "language") == {
        ("pkg/__init__.py", "python"),
        (".hidden/tool.py", "python"),
        ("src/app.tsx", "tsx"),
        ("src/UPPER.PY", "python"),
        ("manage.py", "python"),
        ("gen/keep.py", "python"),
        ("deep/gen/free.py", "python"),
    }


def test_frameworks(spark, tree):
    row = detect_frameworks(read_repositories(spark, [str(tree)])).first()
    assert row.frameworks == ["django", "node", "react"]


def test_language_filter_includes_tsx(spark, tree):
    found = discover(read_repositories(spark, [str(tree)]), ["typescript"])
    assert as_set(found, "relative_path") == {("src/app.tsx",)}


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("*.log", "a/b.log", True),
        ("*.log", "a/b.log.py", False),
        ("docs/", "docs/a.py", True),
        ("docs/", "x/docs/a.py", True),
        ("docs/", "docs", False),
        ("/docs", "x/docs/a.py", False),
        ("/docs", "docs/a.py", True),
        ("a/b", "a/b/c.py", True),
        ("a/b", "x/a/b", False),
        ("a/*/c", "a/b/c", True),
        ("a/*/c", "a/b/d/c", False),
        ("a/**/c", "a/b/d/c", True),
        ("a/**/c", "a/c", True),
        ("**/c.py", "c.py", True),
        ("a/**", "a/b/c", True),
        ("a/**", "a", False),
        ("f?.py", "f1.py", True),
        ("f[0-3].py", "f2.py", True),
        ("f[!0-3].py", "f2.py", False),
        ("\\#x", "#x", True),
        ("a.c", "abc", False),
    ],
)
def test_ignore_patterns(spark, pattern, path, hit):
    import re

    regex, negated = ignore_regex(pattern)
    assert not negated and bool(re.search(regex, path)) is hit


def test_ignore_lines_without_a_rule():
    assert ignore_regex("") is ignore_regex("# c") is ignore_regex("/") is None
    assert ignore_regex("!keep")[1] is True
