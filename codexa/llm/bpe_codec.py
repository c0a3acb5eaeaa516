"""BPE encoding and decoding of whole documents (operator 2).

Every worker keeps one encoder; a batch's texts are encoded together by the merge rounds of
``codexa.llm.bpe``. No shuffle: one scan, one row out for each row in.

Defined results: null and empty text give no ids (count 0, digests of the empty string); repeated
rows give repeated rows; an empty table gives an empty result; only ``doc_id`` and ``text`` are
read, so other columns of any name do no harm; a null id passes through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codexa.llm.bpe import bpe
from codexa.llm.text import slices, texts


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids array<int>, decoded string)`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for part in slices(batches, text):
            ids, at = coder.encode(*texts(part[text]))
            decoded = [coder.decode(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part[key].cast(pa.int64()), lists, pa.array(decoded)], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: the encoder's results in short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for part in slices(batches, text):
            ids, at = coder.encode(*texts(part[text]))
            ids_sha, decoded_sha = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[a:b]
                ids_sha.append(hashlib.sha256(" ".join(coder.digits[own].tolist()).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(coder.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part[key].cast(pa.int64()), pa.array(np.diff(at)), pa.array(ids_sha), pa.array(decoded_sha)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
