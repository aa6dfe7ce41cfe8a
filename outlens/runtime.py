"""Session settings, checkpoints and code shipping."""

from __future__ import annotations

import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    The folder is ``spark.checkpoint.dir``; only a local session that names none gets a
    temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            where = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(where)
    out = df.checkpoint(eager=True)
    _free_shuffles(context)
    return out


#: Seconds between two collections.
_PAUSE = 2.0
_last = 0.0


def _free_shuffles(context) -> None:
    """Let Spark delete the shuffle files behind checkpoints: it does so once the driver's garbage is collected, which may be hours away."""
    global _last
    if time.monotonic() - _last >= _PAUSE:
        context._jvm.System.gc()
        _last = time.monotonic()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_outlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="code-")) / "outlens_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(out))
    context._outlens_shipped = True


def quoted(name: str) -> str:
    """A column name with dots or blanks, safe for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"
