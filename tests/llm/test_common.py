"""Helpers shared by the corpus operators."""

import subprocess
import sys

#: A task whose last piece of memory lives on; above it nothing is free, below it all is.
TASK = """
import os, re
from pathlib import Path
from sessionlens.llm import common

def used():
    return int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

pinned = []

def run(batches):
    held = [bytes(1000) for _ in range(200_000)]
    pinned.append(bytes(1000))
    yield len(held)

before = used()
assert list(common.giving_back(run)([])) == [200_000]
print(used() - before)
"""


def test_a_worker_gives_back_what_its_task_freed():
    out = subprocess.run([sys.executable, "-c", TASK], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 3)[0])
    assert float(out.stdout) < 100  # of about 200 MB
