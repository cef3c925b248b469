import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_console(tmp_path):
    """Prompt, statements, an error that does not end it, a script, timings, and exit."""
    (tmp_path / "s.sql").write_text('insert into pets (2, "Bo"); insert into pets (2, "Again")')
    lines = [
        "create table pets (id=int, name=char8);",
        'insert into pets (1, "Al");',
        "select * from nosuch;",
        "",
        "what is this",
        f'run "file://{tmp_path}/s.sql";',
        "select * from pets where id >= 1;",
        "exit",
        "show;",
    ]
    done = subprocess.run(
        [sys.executable, "-m", "corvane", f"file://{tmp_path}/wh"],
        input="\n".join(lines) + "\n", capture_output=True, text=True, timeout=240, cwd=tmp_path,
        env=os.environ | {"PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path)},
    )
    out = done.stdout
    assert done.returncode == 0, done.stderr[-2000:]
    assert out.count("db> ") == 8 and out.count(" us\n") == 6
    assert "Created table pets" in out and "table nosuch does not exist" in out and "PARSER ERROR" in out
    assert "Insertion Error key: 2 is already in the index tree" in out
    assert "| 2       | Bo        |" in out and "Returned 2 records." in out and "[indexed]" not in out
