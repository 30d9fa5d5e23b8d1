import os
import subprocess
import sys

import pytest

from tidemark import session


class Conf(dict):
    def set(self, key, value):
        raise RuntimeError("CANNOT_MODIFY_CONFIG")


class Session:
    """A session without the setting, as far as `shared_dir` looks at one."""

    def __init__(self, master, application):
        self.conf = Conf()
        self.sparkContext = type("Context", (), {"master": master, "applicationId": application})()


def test_a_local_session_without_the_setting_has_one_folder():
    first = session.shared_dir(Session("local[2]", "a"))
    assert first == session.shared_dir(Session("local[2]", "a")) != session.shared_dir(Session("local[2]", "b")) and os.path.isdir(first)
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("spark://somewhere", "c"))


def test_staging_with_an_empty_configuration(tmp_path):
    code = ("from tidemark.session import local_session, stage\n"
            "spark = local_session(2)\n"
            "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
            "print(stage(spark.range(7), 'x').count() + stage(spark.range(3), 'y').count())")
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_CONF")} | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip() == "10", out.stderr[-2000:]
