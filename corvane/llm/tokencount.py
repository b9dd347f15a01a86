"""Token counts of whole texts by a SentencePiece model.

An Arrow function encodes batches of about equal bytes and returns lengths only. Long texts are split
where no token can span the cut, so the sum over the parts is the count of the whole.

Defined results: null text counts as empty and has no bytes and no tokens; bad UTF-8 is read with
replacement marks; texts are never truncated; rows are independent, so repeated rows get equal
counts; other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import by_size, strings

#: Bytes encoded in one call, about, and the characters beyond which a text is split.
CALL_BYTES, PART_CHARS = 400_000, 4_000
#: The model's mark for a space.
MARK = "▁"


def splits_at_spaces(model) -> bool:
    """Whether a single space after another character is a safe cut: no piece goes on past one, and each text gets a mark in front."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return all(MARK not in p.lstrip(MARK) for p in pieces) and model.encode("a a", out_type=str) == [f"{MARK}a"] * 2


def safe_parts(text: str, most: int) -> list[str]:
    """`text` cut at single spaces, each of which the mark in front of the next part stands for."""
    parts, start = [], 0
    while len(text) - start > most:
        cut = text.find(" ", start + most)
        while cut > 0 and (text[cut - 1] in (" ", MARK) or text[cut + 1 : cut + 2] in (" ", MARK, "")):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        parts.append(text[start:cut])
        start = cut + 1
    return [*parts, text[start:]]


@lru_cache(2)
def loaded(path: str):
    """A worker's model, and whether texts may be cut at spaces: loaded and checked once a worker, not once a task."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, splits_at_spaces(model)


def counter(path: str, part: int = PART_CHARS):
    """An Arrow function: text to its number of tokens."""

    @F.arrow_udf("long")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, cuts = loaded(path)
        for column in columns:
            parts, owner = [], []
            for i, text in enumerate(strings(column)):
                own = safe_parts(text, part) if cuts and len(text) > part else [text]
                parts += own
                owner += [i] * len(own)
            total = np.zeros(len(column), np.int64)
            for a, b in by_size([len(p.encode("utf-8", "replace")) for p in parts], CALL_BYTES):
                found = model.encode(parts[a:b], out_type=int, num_threads=1)
                np.add.at(total, owner[a:b], [len(x) for x in found])
            yield pa.array(total)

    return count


def count_tokens(df: DataFrame, model: str, limit: int, text: str = "text") -> DataFrame:
    """`df` with n_bytes, n_tokens and over_limit (n_tokens > limit); columns of those names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": counter(model)(whole)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
