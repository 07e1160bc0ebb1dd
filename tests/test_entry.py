import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_without_the_corpus_operators():
    code = (
        "import sys; sys.modules['hushframe.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'entity_counts' in names and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "assert set(e.oracle_sql()) <= set(names)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    own = [p for p in (ROOT / "hushframe").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "hushframe.llm" in p.read_text()]


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"entity_type", "severity", "n"}
