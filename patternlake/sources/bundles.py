"""Bundles of patterns that workspaces exchange: JSON lines, as many files as there are partitions, and a file of metadata; encrypted on request."""

from __future__ import annotations

import hashlib
import json
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import sanitize as S

VERSION = "1.0"


def derived_key(passphrase: str, salt: bytes) -> bytes:
    """256 bits by scrypt, on the driver."""
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def sealed(line: Column, key: bytes) -> Column:
    """AES-GCM of a line with a random nonce, in hexadecimal digits."""
    return F.hex(F.aes_encrypt(line.cast("binary"), F.unhex(F.lit(key.hex())), F.lit("GCM")))


def opened(line: Column, key: bytes) -> Column:
    """What sealed() sealed; another key or another text is an error."""
    return F.aes_decrypt(F.unhex(line), F.unhex(F.lit(key.hex())), F.lit("GCM")).cast("string")


def exportable(patterns: DataFrame, text: str = "context", key: str | None = None) -> DataFrame:
    """Patterns with their text sanitised, and with it their hash, if they have one. It may be empty."""
    clean = patterns.withColumn(text, S.sanitize(patterns[text]))
    return clean.withColumn(key, F.md5(F.col(text).cast("binary"))) if key else clean


def export_bundle(patterns: DataFrame, path: str, text: str = "context", workspace: str = "", passphrase: str | None = None, now: str | None = None) -> StructType:
    """Write patterns to path/patterns with their text sanitised, and path/metadata; returns the schema to import them with. An empty set is an error."""
    n = patterns.count()
    if not n:
        raise ValueError("no patterns to export")
    clean = exportable(patterns, text)
    line, salt = F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}), secrets.token_bytes(16)
    if passphrase is not None:
        line = sealed(line, derived_key(passphrase, salt))
    clean.select(line.alias("value")).write.option("compression", "gzip").text(f"{path}/patterns")
    told = {"version": VERSION, "exported_at": now, "source_workspace": hashlib.sha256(workspace.encode()).hexdigest()[:16], "pattern_count": n, "encrypted": passphrase is not None, "salt": salt.hex()}
    patterns.sparkSession.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return clean.schema


def metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def import_bundle(spark: SparkSession, path: str, schema: StructType, passphrase: str | None = None) -> DataFrame:
    """What export_bundle wrote. A line that isn't JSON is an error, and so is a wrong or missing passphrase of an encrypted bundle."""
    told = metadata(spark, path)
    if told["version"] != VERSION:
        raise ValueError(f"unknown version {told['version']}")
    lines = spark.read.text(f"{path}/patterns")
    if told["encrypted"]:
        if passphrase is None:
            raise ValueError("the bundle is encrypted")
        lines = lines.select(opened(F.col("value"), derived_key(passphrase, bytes.fromhex(told["salt"]))).alias("value"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def merge_bundle(spark: SparkSession, path: str, schema: StructType, table: DataFrame, strategy: str = "add", passphrase: str | None = None, failures: str = "failure") -> DataFrame:
    """A counter table (key, label, success, failure) with a bundle's rows merged in by a strategy of merge_best()."""
    from ..operators.patterns import merge_best

    return merge_best(table, import_bundle(spark, path, schema, passphrase), strategy, failures=failures)
