import builtins
import sys

import pytest

import __spark_entry__
from quarrygraph import registry, session


def without(monkeypatch, package):
    """Makes a package, and all modules of the optional folder, look as if never imported and absent."""
    real = builtins.__import__

    def guarded(name, *args, **kwargs):
        if name.split(".")[0] == package:
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("quarrygraph.llm") or m in ("corpus_pipeline", package) or m.startswith(package + ".")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", guarded)


def test_queries_of_the_core_survive_a_missing_package(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "_optional", lambda name: None)
    assert __spark_entry__.queries() == registry.queries() and __spark_entry__.oracle_sql() == registry.oracle_sql()


@pytest.mark.parametrize("package", ["numpy", "regex"])
def test_only_import_errors_are_passed_over(monkeypatch, package):
    without(monkeypatch, package)
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Unset:
        @staticmethod
        def get(name, default=None):
            return default

    class Session:
        conf = Unset()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert session.shared_dir(spark) == session.shared_dir(spark)
