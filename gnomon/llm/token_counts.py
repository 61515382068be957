"""Token counts: batch encoding in Arrow functions that return lengths only.

Each task takes its Arrow batches, cuts the texts at safe boundaries, pools the
pieces of all texts of a batch, and hands the library batches of about equal bytes.  For this kind of vocabulary (white
space is dropped and no token crosses it) every ASCII white-space run is a safe
boundary: the tokens of a text are the tokens of its pieces, in order.  Only
the lengths leave the encoder; a bounded memory of lengths spares it pieces
that it has counted already.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings inside a text are read as the library's default reads them; no tokens
are added, cut off or padded; an empty table gives an empty table; repeated
rows give repeated rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Bytes of pieces that the encoder gets at once.
BATCH_BYTES = 1 << 18
#: Bytes of texts whose pieces wait for one another at most.
HELD_BYTES = 8 << 20
#: Bytes of one text that are cut into pieces at once.
SLICE_BYTES = 1 << 20
#: Pieces whose lengths a worker remembers, and the longest of them in bytes.
MEMO_PIECES = 400_000
MEMO_PIECE_BYTES = 48


def default_vocabulary() -> str:
    """Path of the vocabulary that the registered query counts with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def safe_slices(raw: bytes, size: int) -> Iterator[bytes]:
    """``raw`` in slices of about ``size`` bytes, cut at ASCII white space only."""
    at = 0
    while len(raw) - at > size:
        cut = next((i for i in range(at + size, len(raw)) if raw[i] in b" \t\n\r\x0b\x0c"), len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


class LengthCounter:
    """Counts the tokens of texts with one tokenizer file."""

    def __init__(self, vocabulary: str, batch_bytes: int = BATCH_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(vocabulary)
        self._encoder.no_truncation()
        self._encoder.no_padding()
        self._batch_bytes = batch_bytes
        self._memo: dict[bytes, int] = {}

    def _encode(self, pieces: list[bytes]) -> None:
        """Put the lengths of ``pieces`` into the memory, batch by batch of equal bytes."""
        batch, size = [], 0
        for last, piece in enumerate(pieces, 1 - len(pieces)):
            batch.append(piece)
            size += len(piece)
            if size >= self._batch_bytes or last == 0:
                codes = self._encoder.encode_batch_fast([p.decode() for p in batch], add_special_tokens=False)
                self._memo.update(zip(batch, map(len, codes), strict=True))
                batch, size = [], 0

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each UTF-8 text.

        Pieces that are not remembered wait until there are ``batch_bytes`` of
        them, whatever texts they come from; the texts that have them wait too.
        """
        out = [0] * len(texts)
        waiting: list[tuple[int, list[bytes]]] = []
        new: set[bytes] = set()
        size = held = 0

        def settle() -> None:
            nonlocal new, size, held
            if new:
                self._encode(list(new))
            for i, pieces in waiting:
                out[i] += sum(map(self._memo.__getitem__, pieces))
            if len(self._memo) > MEMO_PIECES:
                self._memo.clear()
            else:
                for piece in new:
                    if len(piece) > MEMO_PIECE_BYTES:
                        del self._memo[piece]
            waiting.clear()
            new, size, held = set(), 0, 0

        for i, raw in enumerate(texts):
            for part in safe_slices(raw, SLICE_BYTES):
                pieces = part.split()
                fresh = set(pieces).difference(self._memo, new)
                new |= fresh
                size += sum(map(len, fresh))
                held += len(part)
                waiting.append((i, pieces))
                if size >= self._batch_bytes or held >= HELD_BYTES:
                    settle()
        settle()
        return out


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row of ``docs``."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LengthCounter(vocabulary)
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary())]
            out = pa.array(counter.count(texts), pa.int64()), pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out[1], out[0]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens"]
    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(lengths, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    counted = count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
