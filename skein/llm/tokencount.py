"""Token counts of whole texts, encoded in batches that are balanced by bytes.

Texts are cut into pieces at boundaries that no pre-token and no special token crosses: in
front of white space that follows something else.  The byte-level pre-tokenizer's pattern takes
white space only at the front of a token, so encoding the pieces and adding their lengths gives
exactly what encoding the whole text gives.  Only lengths leave the function.

Defined results: a null text counts as empty and has no tokens; repeated rows are counted one
by one; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches

#: Texts longer than this many characters are cut, and batches hold about this many bytes.
PIECE_CHARS = 64_000
BATCH_BYTES = 1_000_000

#: White space in Python's and the tokenizer's sense differ in a few controls; only these cut.
_BOUNDARY = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0])(?=[ \n])")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` at safe boundaries into pieces of ``size`` characters or a little more."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_tokens_in(texts: list[str], path: str, sizes: list[int]) -> list[int]:
    """Tokens of each text; ``sizes`` are their bytes."""
    tokenizer, counts = _tokenizer(path), [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        for i, encoded in zip(owner, tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            counts[i] += len(encoded)
        batch.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text):
            batch.append(piece)
            owner.append(i)
            held += sizes[i] if len(piece) == len(text) else len(piece.encode("utf-8", "surrogatepass"))
            if held >= BATCH_BYTES:
                flush()
                held = 0
    if batch:
        flush()
    return counts


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row of ``docs``: its id, UTF-8 bytes, tokens, and whether these are more than ``limit``.

    ``tokenizer`` is the path of a tokenizer file that every executor can open.
    """
    import os

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        for batch in batches:
            counts = count_tokens_in(batch.column("text").to_pylist(), tokenizer, batch.column("n_bytes").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        run, f"id {id_type}, n_bytes long, n_tokens long"
    )
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
