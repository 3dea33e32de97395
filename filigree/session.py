"""Sessions and the shared folder for checkpoints."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    root, raw = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    digest = hashlib.sha256(raw.getvalue()).hexdigest()[:12]
    known = (spark.sparkContext.applicationId, digest)
    if known not in _SHIPPED:
        path = Path(tempfile.mkdtemp(prefix="filigree-")) / f"filigree-{digest}.zip"
        path.write_bytes(raw.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(known)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own on a single machine only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="filigree-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on one machine, as tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("filigree")
    own = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = builder.config(map=own | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
