"""Session defaults for local work; a cluster passes its own session instead."""

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "quern", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One parquet table of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


#: Arrow batches are held by both the executor and its Python worker; whole texts make them large.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once an application; workers need no installed copy.

    Also lowers Spark's bound on the bytes of an Arrow batch to ``BATCH_BYTES``, if it is higher.
    """
    import os
    import tempfile
    import zipfile

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        place = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
        with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(place)
        _SHIPPED.add(context.applicationId)
    return spark


def shipping(query):
    """``query`` with :func:`ship` before it."""
    import functools

    @functools.wraps(query)
    def run(spark, *args):
        return query(ship(spark), *args)

    return run
