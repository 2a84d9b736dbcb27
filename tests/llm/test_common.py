import subprocess
import sys

#: Blocks of which one stays beside each hundred that go keep a heap from shrinking by itself.
SCRIPT = """
import re
from flowloom.llm.common import lean

def megabytes():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

kept = []

@lean
def work(batches):
    for n in batches:
        held = [bytes(4000) for _ in range(n)]
        kept.append(bytes(4000))
        yield megabytes()

print(megabytes(), *work(iter([100_000])), megabytes())
"""


def test_memory_goes_back_after_a_task():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, check=True)
    before, most, after = map(float, done.stdout.split())
    assert most > before + 350
    assert after < before + 100
