"""Helpers that the operators of this subpackage share."""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts define words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a sieve, so many whatever the input: 4 MB at most are broadcast. BITMAP are those of one of Spark's bitmaps.
SIEVE_BITS, BITMAP = 1 << 25, 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder. A single-machine session without one gets
    a temporary folder; a cluster without one is an error, since its machines share no local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if given:
            sc.setCheckpointDir(given)
        elif sc.master == "local" or sc.master.startswith("local["):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here, and a lost executor costs no
    recomputation. Operators write slim tables so (keys, counts, fingerprints); the pipeline writes each stage's documents."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. A column that a lambda names may be inlined into it by the optimizer and
    then computed for each element; a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def fresh_names(df: DataFrame, *bases: str) -> dict[str, str]:
    """A column name for each base that df does not have."""
    return {b: fresh_name(df, b) for b in bases}


def same_columns(df: DataFrame) -> list[Column]:
    """df's own columns, by quoted names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def sifted(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose key may be among `keys` (one column of longs), and rows whose key is not, null keys among
    them. A hash of each key sets a bit; the more keys, the more rows of others may be. So a join of the first part
    settles the whole, and the second part need not be shuffled."""
    n = fresh_names(df, "_at", "_bits", "_slice")
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(SIEVE_BITS))
    marks = keys.select(place(F.col(keys.columns[0])).alias("at")).select(F.floor(F.col("at") / BITMAP).alias("slice"), F.col("at").bitwiseAND(F.lit(BITMAP - 1)).alias("bit"))
    bits = marks.repartition("slice").groupBy(F.col("slice").alias(n["_slice"])).agg(F.bitmap_construct_agg("bit").alias(n["_bits"]))
    bits = materialize(bits, "sieve")
    at = F.col(n["_at"])
    tried = df.withColumn(n["_at"], F.when(key.isNotNull(), place(key))).join(F.broadcast(bits), F.floor(at / BITMAP) == F.col(n["_slice"]), "left")
    within = at.bitwiseAND(F.lit(BITMAP - 1))
    byte = F.conv(F.hex(F.substring(F.col(n["_bits"]), F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(F.call_function("getbit", byte, (within % 8).cast("int")) == 1, F.lit(False))
    return tried.filter(set_).select(*same_columns(df)), tried.filter(~set_).select(*same_columns(df))
