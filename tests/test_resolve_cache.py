"""Names resolved to definitions, and kept results of searches."""

from __future__ import annotations

from tarn import api
from tarn.api import Project
from tarn.operators import resolve
from tarn.sources import code

FILES = {
    "app/__init__.py": "from .core import run\nfrom . import util\n\n\ndef start():\n    run()\n    return util.twice(2)\n",
    "app/core.py": "from .util import twice as double\nfrom .deep.inner import Engine\nfrom ..outside import helper\nimport app.util\n\n\ndef run():\n    e = Engine()\n    double(1)\n    app.util.twice(3)\n    helper()\n    unknown()\n    return Engine.make()\n",
    "app/util.py": "def twice(x):\n    return x * len([x])\n\n\ndef same():\n    return 1\n",
    "app/deep/inner.py": "from ..util import same\n\n\nclass Engine:\n    def make(self):\n        self.tune()\n        self.missing()\n        return same()\n\n    def tune(self):\n        def same():\n            return 2\n        return same()\n",
    "other.py": "def same():\n    pass\n\n\ndef lonely():\n    obj.tune()\n    same()\n    sole()\n",
    "extra/part.py": "def sole():\n    return broken(\n",
    "extra/whole.py": "def sole():\n    return 1\n",
}


def test_calls_meet_their_definitions(spark):
    files = spark.createDataFrame([(p, "python", t) for p, t in FILES.items()] + [(None, "python", "f()"), ("x.go", "go", "func x() { y() }")], "file_path string, language string, text string")
    edges = resolve.call_edges(code.concepts(files), code.references(files))
    got = {(r.caller_file, r.caller, r.name, r.callee_file, r.callee, r.scope) for r in edges.collect()}
    assert got == {
        ("app/__init__.py", "start", "run", "app/core.py", "run", "import"), ("app/__init__.py", "start", "util.twice", "app/util.py", "twice", "import"),
        ("app/core.py", "run", "Engine", "app/deep/inner.py", "Engine", "import"), ("app/core.py", "run", "double", "app/util.py", "twice", "import"),
        ("app/core.py", "run", "app.util.twice", "app/util.py", "twice", "import"), ("app/core.py", "run", "Engine.make", "app/deep/inner.py", "make", "import"),
        ("app/deep/inner.py", "make", "self.tune", "app/deep/inner.py", "tune", "class"), ("app/deep/inner.py", "make", "same", "app/util.py", "same", "import"),
        ("app/deep/inner.py", "tune", "same", "app/util.py", "same", "import"), ("other.py", "lonely", "obj.tune", "app/deep/inner.py", "tune", "only"),
        ("other.py", "lonely", "same", "other.py", "same", "file"), ("other.py", "lonely", "sole", "extra/whole.py", "sole", "only"),
    }
    assert {r.caller for r in resolve.callers_of(edges, "twice").collect()} == {"start", "run"}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert resolve.call_edges(code.concepts(files.limit(0)), code.references(files.limit(0))).count() == 0


def test_results_are_kept_until_a_table_changes(spark, tmp_path, monkeypatch):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.py").write_text("def alpha():\n    return 1\n")
    project = Project(spark, str(tmp_path / "index"))
    project.index(str(source))
    calls, plain = [], Project.search
    monkeypatch.setattr(Project, "search", lambda self, *a, **o: calls.append(a) or plain(self, *a, **o))
    monkeypatch.setattr(api, "CACHED", 2)
    one = project.search_cached("alpha", 3, mode="lexical").collect()
    assert one and project.search_cached("alpha", 3, mode="lexical").collect() == one and len(calls) == 1
    project.search_cached("beta", 3, mode="lexical")
    project.search_cached("alpha", 3, mode="lexical")  # used again, so beta is the oldest
    project.search_cached("gamma", 3, mode="lexical")
    assert len(project._found) == 2 and len(calls) == 3
    project.search_cached("alpha", 3, mode="lexical")
    assert len(calls) == 3
    project.search_cached("alpha", 2, mode="lexical")
    assert len(calls) == 4
    (source / "b.py").write_text("def alpha():\n    return 22\n")
    project.index(str(source))
    assert project.search_cached("alpha", 2, mode="lexical").count() == 2 and len(calls) == 5
