"""Token counts of a sentencepiece BPE model by a whole-token shortcut.

Offline (once per worker, from the vocabulary alone) two facts are proved:

1. No piece holds the space mark after another character, so no merge crosses the start of
   a run of spaces; a text's count is the sum over its pre-tokens (space run plus word).
2. Which vocabulary strings, encoded alone, come back as one token. Those pre-tokens count 1.

Only other pre-tokens are merged by the library, once for each distinct one in a batch.
If the first fact does not hold for a model, or its normaliser settings change more of a text than
putting the mark for spaces and in front, whole texts are encoded.

Null and empty texts have no tokens. Texts are never cut; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"
#: A pre-token after the first: a run of spaces (or of the mark itself) and what follows it.
PRE_TOKEN = re.compile(f"(?<![ {MARK}])(?=[ {MARK}])")
MEMO = 200_000


@lru_cache(maxsize=2)
def model(path: str):
    """(processor, lengths of the proven single tokens, whether the split is proven)."""
    import sentencepiece
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    apart = not any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:], strict=False))
    proto = ModelProto.FromString(sp.serialized_model_proto())
    norm = proto.normalizer_spec
    # Text stays as it is, but for a mark in front and one for each space.
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
    # A pre-token is given without its first mark: the library puts one in front of each text.
    alone = [p[1:].replace(MARK, " ") for p in pieces if p[0] == MARK]
    single = frozenset(x for x, ids in zip(alone, sp.encode(alone), strict=True) if len(ids) == 1 and x)
    if MARK in pieces:
        single |= {""}  # a last space alone is the mark itself
    return sp, single, apart and plain


def count_batch(texts: list[str], path: str, memo: dict[str, int]) -> list[int]:
    sp, single, proven = model(path)
    if not proven:
        return [len(sp.encode(t)) for t in texts]
    cut = [split(t) for t in texts]
    rest = list({p for c in cut for p in c} - single - memo.keys())
    fresh = dict(zip(rest, map(len, sp.encode(rest)), strict=True)) if rest else {}
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        need = {p for c in cut for p in c} - single - fresh.keys()
        need = list(need)
        fresh |= dict(zip(need, map(len, sp.encode(need)), strict=True)) if need else {}
    memo |= fresh
    out = []
    for c in cut:
        hits = Counter(c)
        out.append(sum(n * (1 if p in single else memo[p]) for p, n in hits.items()))
    return out


def split(text: str) -> list[str]:
    """Pre-tokens without the mark in front of each; the first word has an unwritten one."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    parts = PRE_TOKEN.split(text.replace(MARK, " "))
    if parts[0] == "":
        # The text starts with spaces: the added mark and they are one run.
        return [" " * (len(parts[1]) - len(parts[1].lstrip(" "))) + parts[1].lstrip(" "), *(p[1:] for p in parts[2:])] if len(parts) > 1 else []
    return [parts[0], *(p[1:] for p in parts[1:])]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; a row for each row, no shuffle."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, int] = {}
        for texts in batches:
            yield pd.Series(count_batch(texts.tolist(), model_path, memo), dtype="int64")

    df = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    df = df.select(F.col("_id").alias(id_col), F.octet_length("_t").cast("long").alias("n_bytes"), counted("_t").alias("n_tokens"))
    return df.withColumn("over_limit", F.col("n_tokens") > limit)
