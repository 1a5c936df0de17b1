"""The entry points, and the folder that jobs share."""

import importlib
import importlib.util

import pytest

from tidepanel.session import shared_dir


def test_the_entry_works_without_the_corpus_part(monkeypatch):
    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("tidepanel.llm", "corpus_pipeline") else find(name, *a))
    bare = importlib.reload(entry)
    assert not [n for n in bare.queries() if n.startswith("op") or n == "pipeline"]
    assert set(bare.oracle_sql()) <= set(bare.queries()) and len(bare.queries()) > 200
    monkeypatch.undo()
    importlib.reload(entry)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Session())
