"""Session helpers: local test sessions, parallelism and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "seriesmill", memory: str = "8g"):
    """A single-JVM session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.unix.domain.socket.enabled", "true")  # spares short Python tasks the delays of TCP
        .getOrCreate()
    )


def parallelism(spark: SparkSession) -> int:
    """How many range blocks one pass should at least be cut into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_OWN_FOLDER: dict[str, str] = {}  # by application, of local sessions that name no shared folder


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only in a local session that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="seriesmill-own-")
    return _OWN_FOLDER[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back, so that later passes do not recompute it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
