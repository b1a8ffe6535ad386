"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the contracts: runs of characters other than the six ASCII white-space characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in runs whose `column` takes about `most` bytes; a longer value comes alone, whole."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def shuffles(spark: SparkSession) -> int:
    """Partitions that a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-case words of all texts on end and their number for each text; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if pa.types.is_large_list(lists.type):
        lists = lists.cast(pa.list_(pa.string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full).dictionary_encode(), before[offsets[1:] - offsets[0]] - before[offsets[:-1] - offsets[0]]


def free_name(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


# The table of the reflected checksum polynomial, by its rule, and the checksum of a text with it, for SQL twins.
CRC32_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS crc_of FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """Expression: unsigned crc32 of a text's UTF-8 bytes, where the table crc_table is joined."""
    digits = f"hex(encode({text}))"
    each = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"
