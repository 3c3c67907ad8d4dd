import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(hidden: str) -> str:
    code = f"import sys; sys.modules.update({{m: None for m in {hidden.split()!r}}}); import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_entry_works_without_the_optional_parts():
    import __spark_entry__ as entry

    core = len(entry.catalog.QUERIES)
    assert run("bitgrove.llm corpus_pipeline").startswith(f"{core} []")
    assert "pipeline" not in run("corpus_pipeline")


def test_faults_inside_the_optional_parts_are_not_hidden():
    import __spark_entry__ as entry

    if entry._llm() is None:
        return
    code = "import sys; sys.modules['pyarrow'] = None; import __spark_entry__ as e; e._llm()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode != 0
