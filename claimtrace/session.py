"""Session defaults. Sizes of shuffles follow the data by adaptive execution; nothing here depends on one machine."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "claimtrace", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the folder of ``spark.checkpoint.dir``, so that a lost executor costs no
    recomputation. Where it is unset a local session, as of tests, gets a temporary folder; on a cluster it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="claimtrace-"))
    return df.checkpoint(eager=True)
