"""Sessions and the settings that results depend on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC fixes hours and dates; the rest lets Spark re-plan joins, split skewed partitions and merge small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "pitlake", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    return prepared(b.config(map=SETTINGS | conf).getOrCreate())


def prepared(spark: SparkSession) -> SparkSession:
    """Fix the time zone of a session that someone else made."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a temporary folder in a local session without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pitlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pitlake-{name}-{uuid.uuid4().hex}"


def package(folder: str | Path, into: str | Path) -> str:
    """Zip a package's Python files so that the archive on a path makes `import <folder's name>` work."""
    root, archive = Path(folder).resolve(), Path(into) / f"{Path(folder).resolve().name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    return str(archive)


def ship(spark: SparkSession, *folders: str | Path) -> None:
    """Give driver and executors this package and others, such as a folder of features; each once for a context."""
    sc = spark.sparkContext
    done = sc.__dict__.setdefault("_pitlake_packages", set())
    for folder in (Path(__file__).parent, *folders):
        if (root := str(Path(folder).resolve())) not in done:
            sc.addPyFile(package(root, tempfile.mkdtemp(prefix="pitlake-code-")))
            done.add(root)
