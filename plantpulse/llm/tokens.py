"""Token ids of texts with a public tokenizer file, and their cut into pieces."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

# How byte-level vocabularies split texts, and the bytes they write as themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_LOADED: dict[str, "Encoder"] = {}


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a tokenizers file. Plain byte-level BPE files are run by tiktoken, which gives the same ids about six
    times faster; any other file, and any text it refuses, by the tokenizers library."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(file)
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.slow.get_vocab_size()
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
                 and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex")
                 and not spec.get("normalizer") and not spec.get("post_processor"))
        if not plain:
            return None
        import tiktoken

        shifted = [b for b in range(256) if b not in _PLAIN]
        byte_of = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(shifted)}
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        # merges must rank as their results are numbered, or the two libraries would differ
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, file: str) -> "Encoder":
        """One instance for each worker process."""
        if file not in _LOADED:
            _LOADED[file] = cls(file)
        return _LOADED[file]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except ValueError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(total: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than `width`."""
    if total <= width:
        return [(0, total)]
    first = total % width or width
    return [(0, first)] + [(s, width) for s in range(first, total, width)]


def document_ids(text: str | None, encoder: Encoder, end_id: int) -> np.ndarray:
    return np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", file: str | None = None, width: int = 1024,
           end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids (little-endian 32-bit) if asked.

    A null text is an empty one, whose only id is `end_id`.
    """
    file = file or default_file()
    fields = [StructField("doc_id", docs.schema[doc_id].dataType), StructField("piece", IntegerType()),
              StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    if with_ids:
        fields.append(StructField("ids", BinaryType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(file)
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                row, number, starts, lengths, crc, bodies = [], [], [], [], [], []
                for r, text_value in enumerate(part.column("text")):
                    ids = document_ids(text_value.as_py(), encoder, end_id)
                    for k, (start, length) in enumerate(cut(len(ids), width)):
                        body = ids[start:start + length].tobytes()
                        row.append(r)
                        number.append(k)
                        starts.append(start)
                        lengths.append(length)
                        crc.append(zlib.crc32(body))
                        if with_ids:
                            bodies.append(body)
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                           pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    columns + ([pa.array(bodies, pa.binary())] if with_ids else []), [f.name for f in fields])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, StructType(fields))
