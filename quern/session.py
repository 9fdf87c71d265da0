"""Session helpers: lineage cuts and lookups that withstand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Hot keys are spread over so many salts.
SALTS = 32
#: A lookup of numbers with up to so many rows is broadcast.
SMALL = 500_000


def local_session(app: str = "quern", cores: str = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The folder is the one in spark.checkpoint.dir; without it a cluster is an error, and a session on one machine gets a folder of its own. The files outlive lost executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df by way of files in the checkpoint folder: unlike cut's, its plan keeps no properties that would multiply in a loop."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        cut(df.sparkSession.range(1))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", count: str = "n_rows") -> DataFrame:
    """Join rows with a lookup that has one row for each key, whatever the skew of rows.

    lookup must hold in column `count` how many of rows have its key. Keys with more than 1/HOT_SHARE of the rows are hot;
    there can be no more than HOT_SHARE of them, so the list of hot keys that is broadcast has that bound. Rows of hot keys get
    one of SALTS salts by a hash of their columns (the same in every attempt of a task), and the lookup's hot rows are repeated for each salt; all other rows keep salt 0.
    Rows with a null key find nothing. The lookup is written once to the checkpoint folder, as it is read three times.
    """
    lookup = cut(lookup)
    total = lookup.agg(F.sum(count).alias("total"))
    hot = (
        lookup.select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.col(count).alias("__n"))
        .join(F.broadcast(total))
        .where(F.col("__n") * HOT_SHARE > F.greatest(F.col("total"), F.lit(HOT_SHARE * SALTS)))
        .drop("total", "__n")
    )

    def marked(df: DataFrame) -> DataFrame:
        on = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
        return df.join(F.broadcast(hot), on, "left").withColumn("__is_hot", F.col(f"__hot_{keys[0]}").isNotNull()).drop(*[f"__hot_{k}" for k in keys])

    hashed = [f"`{f.name}`" for f in rows.schema.fields if not f.dataType.simpleString().startswith(("map", "struct", "variant"))]
    salt = F.pmod(F.xxhash64(*hashed, F.lit("salt")), F.lit(SALTS))
    spread = marked(rows).withColumn("__salt", F.when(F.col("__is_hot"), salt).otherwise(0).cast("int")).drop("__is_hot")
    repeated = (
        marked(lookup.drop(count))
        .withColumn("__salt", F.explode(F.when(F.col("__is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("__is_hot")
    )
    return spread.join(repeated, [*keys, "__salt"], how).drop("__salt")


def small_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], count: str = "n_rows") -> DataFrame:
    """The same as salted_lookup for a lookup that is mostly small: with up to SMALL rows, counted first, it is broadcast."""
    lookup = cut(lookup)
    if lookup.count() <= SMALL:
        return rows.join(F.broadcast(lookup.drop(count)), keys)
    return salted_lookup(rows, lookup, keys, count=count)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has so few partitions that most would idle (a small table in one file); else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


#: White space as Python's str.strip has it.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def spark_python_white() -> str:
    """The same as a character class body for Java and RE2 patterns."""
    return r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
