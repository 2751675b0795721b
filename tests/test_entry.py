"""The entry module imports in a fresh process without a session, also from PySpark's zip files."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

HERE = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e, pyspark; q, o = e.queries(), e.oracle_sql(); print(pyspark.__file__, len(q), all(isinstance(x, str) for x in o.values()), set(o) <= set(q))"


def test_import_without_a_session():
    library = next(p for p in Path(pyspark.__file__).parents if (p / "jars").is_dir())
    zips = [str(p) for p in (library / "python" / "lib").glob("*.zip")]
    assert len(zips) >= 2
    for lead in ([], zips):
        env = os.environ | {"PYTHONPATH": os.pathsep.join([*lead, str(HERE)])}
        env.pop("SPARK_HOME", None)
        said = subprocess.run([sys.executable, "-c", SAY], cwd=HERE, env=env, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr[-2000:]
        place, count, strings, known = said.stdout.split()[-4:]
        assert int(count) > 80 and strings == known == "True"
        assert (".zip" in place) == bool(lead)
