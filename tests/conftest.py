import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowloom.registry import SOURCE_COLUMNS  # noqa: E402
from flowloom.session import local_session  # noqa: E402

# label -> rows, per file
FILES = {
    "Friday.csv": {"BENIGN": 160, "DDoS": 120},
    "Tuesday.csv": {
        "BENIGN": 160,
        "FTP-Patator": 60,
        "SSH-Patator": 60,
        "Web Attack \x96 Brute Force": 100,
        "Bot": 100,
        "Infiltration": 5,
    },
    "Wednesday.csv": {"BENIGN": 160, "DoS Hulk": 90, "DoS slowloris": 40, "PortScan": 120},
}


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


def csv_lines(parts, seed):
    """Flows whose columns follow a level of their class, with the faults real files have."""
    rng = np.random.default_rng(seed)
    rows = []
    for label, count in parts.items():
        level = np.random.default_rng(len(label) * 131 + ord(label[0])).uniform(1, 9, len(SOURCE_COLUMNS))
        for values in np.rint(np.exp(rng.normal(level, 0.3, (count, len(SOURCE_COLUMNS))))):
            rows.append([str(int(v)) for v in values] + [label])
    duration = SOURCE_COLUMNS.index("Flow Duration")
    rows[0][duration], rows[1][duration] = "0", "-5"
    rows += [rows[2], rows[3]]
    names = ["Destination Port", *SOURCE_COLUMNS, "Label", "Flow Bytes/s"]
    yield ",".join(f" {n}" for n in names)
    for row in rows:
        yield ",".join(["80", *row, "Infinity"])


@pytest.fixture(scope="session")
def flow_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("flows")
    for i, (name, parts) in enumerate(FILES.items()):
        (folder / name).write_text("\n".join(csv_lines(parts, i)) + "\n", encoding="latin-1")
    return str(folder)
