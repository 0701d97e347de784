"""Helpers shared by the operators: tables, texts, scratch tables and small Python pieces."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SEPARATORS = "[ \\t\\n\\x0B\\f\\r]+"
#: Setting of Spark 4.1 under which a query's shuffle files are removed when it ends.
DROP_SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A plan's text holds every constant in it and is made anew at each of its stages; the driver keeps this much of it.
PLAN_TEXT = {"spark.sql.maxPlanStringLength": "16384"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folders that owners have made and not yet emptied.
_MADE: dict[str, list[str]] = {}
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Scratch folders made inside belong to ``owner``; those it made before are emptied first.

    For steps that each write their result before the next begins: what an
    earlier step kept is of no use any more.
    """
    release(spark, owner)
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def release(spark: SparkSession, owner: str) -> None:
    """Empty the folders of ``owner``: a table without rows takes the place of what they hold."""
    for path in _MADE.pop(owner, []):
        empty(spark, path)


def empty(spark: SparkSession, path: str) -> None:
    spark.range(0).write.mode("overwrite").parquet(path)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor sees.

    Only a local session may leave the setting out; it gets a folder in /tmp.
    """
    path = _fresh_folder(spark, purpose)
    if _OWNER.get():
        _MADE.setdefault(_OWNER.get(), []).append(path)
    return path


def _fresh_folder(spark: SparkSession, purpose: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = f"/tmp/spark-{uuid.uuid4().hex[:12]}"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, settings: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Write once to the shared folder and read back, which ends the lineage.

    For results that several later jobs read.  A lost executor costs a re-read.
    The shuffle files of the write are of no use afterwards and go with it.
    ``settings`` of the session hold for the write alone.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, purpose)
    own = {DROP_SHUFFLE_FILES: "true", **PLAN_TEXT, **(settings or {})}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        df.write.options(**options).parquet(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Empty the folder of a table from ``stored`` that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        empty(table.sparkSession, path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` treat exactly these ASCII characters.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def id_crc(doc_id: Iterable[int | None]) -> list[int]:
    """crc32 of each id written as text; a null id counts as the empty text."""
    return [zlib.crc32(b"" if i is None else b"%d" % i) for i in doc_id]


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name
