"""Problem 3: one record for all that differ only in formatting, with the number of copies.

The text column is dictionary-encoded batch by batch, each distinct text is canonicalised once into field values, every
field value becomes an integer identifier by a dictionary of the values met (the identifier follows from the value, so that the
dictionaries of all workers agree), and a record becomes its sorted tuple of identifiers, held as a 128-bit key.
Only (identifier of the row, key) is shuffled, never a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.keyed import join_keyed
from corvina.llm.textkit import record_key


def record_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2): the key of each row's record. Blank texts (null, or without letter or digit) and null ids give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(1).dictionary_encode()
            keys = [record_key(v) for v in code.dictionary.to_pylist()]
            ids, k1, k2 = [], [], []
            for i, at in zip(b.column(0).to_pylist(), code.indices.to_pylist()):
                if at is not None and (k := keys[at]) is not None:
                    ids.append(i), k1.append(k[0]), k2.append(k[1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, k1, k2)], names=["id", "k1", "k2"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "id bigint, k1 bigint, k2 bigint")


def classes(keys: DataFrame, *by: str) -> DataFrame:
    """(by, k1, k2, keep_id, copies) of each class; counted before the shuffle as well, so that hot classes do no harm."""
    return keys.groupBy(*by, "k1", "k2").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def copies(keys: DataFrame, *by: str) -> DataFrame:
    """(by, keep_id, row_id) for each row that is the same as an earlier one; keys should be a table, it is read twice."""
    more = classes(keys, *by).filter("copies > 1")
    got = join_keyed(keys, more, [*by, "k1", "k2"], "copies")
    return got.filter("keep_id < id").select(*by, "keep_id", F.col("id").alias("row_id"))
