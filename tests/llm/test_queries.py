"""Every query has a name of its operator; the library stands without them."""

import re
import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    own = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op"))
    assert own == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert {"op1_warc", "op8_mix_sources", "op11_embedding_duplicates", "op13_fill_in_middle"} <= set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_them():
    code = "import dealflow.reports, dealflow.sources, dealflow.session, sys; print([m for m in sys.modules if 'dealflow.llm' in m])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=entry.__file__.rsplit("/", 1)[0])
    assert out.stdout.strip() == "[]"
