"""How queries are registered, where scratch data goes, and what the log says."""

import io
import json
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from chronofold import log, session

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["chronofold.llm", "xxhash", "zstandard"])
def test_the_rest_is_there_without_optional_parts(missing):
    code = f"import sys; sys.modules['{missing}'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 60 and 'state_fold_history' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_scratch_data_of_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, applicationId="a")))
    for master in ("local", "local[4]", "local[*]"):
        assert Path(session.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, applicationId="a")))).is_dir()
    given = SimpleNamespace(get=lambda key, default=None: "hdfs://x/y/")
    assert session.shared_dir(SimpleNamespace(conf=given, sparkContext=SimpleNamespace(master="yarn", applicationId="a"))) == "hdfs://x/y"


def test_log_lines():
    out = io.StringIO()
    logger = log.configure("INFO", "json", out)
    logger.info("built %d", 3)
    logger.debug("not told")
    assert [json.loads(line)["message"] for line in out.getvalue().splitlines()] == ["built 3"]
    out = io.StringIO()
    log.configure("WARNING", "console", out).warning("careful")
    assert "WARNING careful" in out.getvalue()
    with pytest.raises(ValueError):
        log.configure("LOUD")
    logger.handlers, logger.propagate = [], True
