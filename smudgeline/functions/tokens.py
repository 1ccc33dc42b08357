"""Prompts, token ids and their padding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the prompt a ranking pair is asked with.
RANK_PROMPT = "match product:\ninput: {noisy}\ncandidate: {candidate}"

# Padding, end of text, and how far bytes are moved up.
PAD, EOS, OFFSET = 0, 1, 3
Tokenizer = Callable[[Column], Column]


def rank_prompt(noisy: Column, candidate: Column, template: str = RANK_PROMPT) -> Column:
    """Fill ``{noisy}`` and ``{candidate}`` into a template."""
    pieces: list[Column] = []
    for i, chunk in enumerate(template.split("{noisy}")):
        if i:
            pieces.append(noisy)
        for j, text in enumerate(chunk.split("{candidate}")):
            if j:
                pieces.append(candidate)
            pieces.append(F.lit(text))
    return F.concat(*pieces)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_ids(texts: pa.Array) -> pa.Array:
    """All texts of a batch at once: their bytes lie end to end in the Arrow buffer."""
    texts = texts.cast(pa.large_string())
    known = texts.fill_null("")
    ends = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
    data = known.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.array([], np.uint8)
    # one more place per text, for its end token
    offsets = (ends - ends[0] + np.arange(len(ends))).astype(np.int32)
    ids = np.full(offsets[-1], EOS, np.int32)
    inside = np.ones(len(ids), bool)
    inside[offsets[1:] - 1] = False
    ids[inside] = codes.astype(np.int32) + OFFSET
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=texts.is_null())


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes moved up by three, then the end token: a closed vocabulary of 259 ids."""
    return _byte_ids(text)


def word_tokens(text: Column, size: int = 32_000) -> Column:
    """Hashed words, then the end token; stays in the JVM and needs no vocabulary table."""
    ids = F.transform(
        F.filter(F.split(text, r"\s+"), lambda w: w != ""),
        lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % size).cast("int")
        + OFFSET,
    )
    return F.concat(ids, F.array(F.lit(EOS)))


def pad(ids: Column, width: int) -> Column:
    """Cut or fill to ``width``, keeping the end token when cutting."""
    n = F.size(ids)
    kept = F.when(
        n > width, F.concat(F.slice(ids, 1, width - 1), F.array(F.lit(EOS)))
    ).otherwise(ids)
    return F.concat(kept, F.array_repeat(F.lit(PAD), F.greatest(F.lit(width) - n, F.lit(0))))


def mask(ids: Column, width: int) -> Column:
    """Ones over the tokens, zeros over the padding."""
    n = F.least(F.size(ids), F.lit(width))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(width) - n))
