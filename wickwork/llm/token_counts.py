"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is split at safe boundaries, places where the pre-tokenizer always starts a new piece, so the pieces'
counts add up to the count of the whole text. Pieces that repeat are encoded once per worker; the others go to the
tokenizer in batches that are balanced by bytes. Texts never leave the map stage and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: A space before a visible character: byte-level pre-tokenizers always start a piece at that space.
SAFE_BOUNDARY = re.compile(r" (?=\S)")
#: Bytes of text that one call of the tokenizer gets.
BATCH_BYTES = 1 << 20
#: Characters of pieces whose counts a worker remembers, each with PIECE more; the memory is emptied beyond that.
#: Longer pieces than LONG characters are not remembered.
REMEMBERED, PIECE, LONG = 72_000_000, 110, 256

_state: dict[str, tuple] = {}


def split_safely(text: str) -> list[str]:
    """Pieces of ``text`` between safe boundaries; every piece but the first stands for itself with a space before it."""
    return SAFE_BOUNDARY.split(text)


def byte_batches(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """``pieces`` in runs of at most ``limit`` bytes each; a longer piece is a run of its own."""
    run, size = [], 0
    for p in pieces:
        n = len(p) if p.isascii() else len(p.encode())
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(p)
        size += n
    if run:
        yield run


def _tokenizer(path: str):
    if path not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _state[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None, False)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            _state[path] = (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], model, True)
    return _state[path]


_counts: dict[str, dict[str, int]] = {}
_size: dict[str, int] = {}


def lengths(texts: list[str], path: str, piecewise: bool) -> list[int]:
    """Token counts of ``texts``."""
    encode = _tokenizer(path)[0]
    if not piecewise:
        return [n for run in byte_batches(texts) for n in encode(run)]
    known = _counts.setdefault(path, {})
    split = []
    for text in texts:
        if text:
            first, *rest = split_safely(text)
            split.append([first, *[" " + p for p in rest]])
        else:
            split.append([])
    if _size.get(path, 0) > REMEMBERED:
        known.clear()
        _size[path] = 0
    new = list({p for pieces in split for p in pieces if p not in known})
    for run in byte_batches(new):
        known.update(zip(run, encode(run), strict=True))
    out = [sum(map(known.__getitem__, pieces)) for pieces in split]
    for p in new:
        if len(p) > LONG:
            del known[p]
        else:
            _size[path] = _size.get(path, 0) + len(p) + PIECE
    return out


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, piecewise: bool | None = None) -> DataFrame:
    """Per row of ``df``: its id, bytes, tokens and whether it has more than ``limit`` tokens.

    ``piecewise`` splits texts at spaces, right for tokenizers with a byte-level pre-tokenizer (the default for
    ``.json`` files that declare one); others get whole texts. Null texts count as empty (0 tokens); repeated rows and
    null ids pass through, one row each; an empty table gives an empty result; other columns, whatever their
    names, are not read.
    """
    if piecewise is None:
        piecewise = tokenizer_path.endswith(".json") and _is_byte_level(tokenizer_path)
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(df, text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = lengths(batch.column("text").to_pylist(), tokenizer_path, piecewise)
            size = pa.compute.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _is_byte_level(path: str) -> bool:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
