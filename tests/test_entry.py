"""The driver's entry with and without the training-data operators."""

import builtins
import sys

import pytest

import __spark_entry__


def test_entry_without_a_library_of_the_operators(monkeypatch):
    """Queries of the library stay when the operators cannot be imported."""
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.split(".")[0] == "public_tokenizers" or name.startswith("clinfeat.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [x for x in sys.modules if x.startswith("clinfeat.llm") or x in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("clinfeat.llm", "clinfeat.llm.catalogue"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.warns(UserWarning, match="left out"):
        found = __spark_entry__.queries()
    assert "build_dataset" in found and not any(x.startswith("op") and x[2:3].isdigit() for x in found) and "pipeline" not in found
    with pytest.warns(UserWarning, match="left out"):
        assert "pipeline" not in __spark_entry__.oracle_sql()
