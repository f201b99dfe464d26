"""A session with the settings that the library's results rely on."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lantern", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the folder that spark.checkpoint.dir names and goes on from there: they are computed once, and a
    lost executor costs no recomputation. Where it names none, as in tests, and there is but one machine, a temporary
    folder is set; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lantern-"))
    return df.checkpoint(eager=True)
