"""Executors need no copy of the package: what the operators define loads where it can't be imported."""

import importlib
import os
import pkgutil
import subprocess
import sys

from pyspark import cloudpickle

import skyloom.llm

CODE = """
import importlib.util, sys
from pyspark import cloudpickle
assert importlib.util.find_spec("skyloom") is None
print(len(cloudpickle.loads(sys.stdin.buffer.read())))
"""


def test_functions_load_without_the_package(tmp_path):
    found = []
    for info in pkgutil.iter_modules(skyloom.llm.__path__):
        if info.name != "queries":  # runs on the driver
            module = importlib.import_module(f"skyloom.llm.{info.name}")
            found += [x for x in vars(module).values() if callable(x) and getattr(x, "__module__", "") == module.__name__]
    here = os.path.dirname(os.path.dirname(skyloom.__file__))
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != here)}
    done = subprocess.run([sys.executable, "-c", CODE], input=cloudpickle.dumps(found), capture_output=True, cwd=tmp_path, env=env, timeout=120)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
    assert int(done.stdout) == len(found) > 50
