"""Token counts with a whole-token shortcut for a SentencePiece BPE vocabulary.

Offline proof, made from the model file alone: its normaliser maps no characters, keeps all
spaces, marks them and puts one before the text, and no piece holds the space mark after
another character.  So no merge crosses from a word into the spaces before the next one, and
a text's tokens are those of its pre-tokens (spaces and the run up to the next space).  Each piece that begins with the space mark is encoded once; those that come
back as themselves count as one token without any merging.  Other pre-tokens are merged
by the library, once for each distinct one while a bounded memory of counts holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_PRE_TOKEN = re.compile(" +[^ ]*")
#: pre-tokens remembered in a worker; at about 150 bytes each
REMEMBERED = 400_000


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _message(data: bytes) -> dict[int, list]:
    """Field number -> values of a protocol buffer message: numbers, or bytes of strings and messages."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value: int | bytes = number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            value = data[at : at + n]
            at += n
        out.setdefault(key >> 3, []).append(value)
    return out


def plain_normaliser(path: str) -> bool:
    """True if the model file's settings leave every character as it is, and mark each space and the text's begin.

    Fixed values are field numbers of the public model format: 2 trainer (24: space as suffix),
    3 normaliser (2: map of characters, 3: mark before the text, 4: drop extra spaces, 5: mark spaces, 6: rules).
    """
    model = _message(_model(path).serialized_model_proto())
    trainer, normaliser = _message(model.get(2, [b""])[-1]), _message(model.get(3, [b""])[-1])
    flag = lambda message, field, default: bool(message.get(field, [default])[-1])
    unmapped = not any(x for field in (2, 6) for x in normaliser.get(field, []))
    return unmapped and flag(normaliser, 3, True) and not flag(normaliser, 4, True) and flag(normaliser, 5, True) and not flag(trainer, 24, False)


def splits_at_spaces(path: str) -> bool:
    """True if the model file proves that pre-tokens can be counted one by one."""
    model = _model(path)
    apart = all(MARK not in model.id_to_piece(i).lstrip(MARK) for i in range(model.vocab_size()))
    return plain_normaliser(path) and apart and model.encode("", out_type=str) == []


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> dict[str, int]:
    """Pre-tokens (with leading space) that the vocabulary holds and that encode alone as one token."""
    model = _model(path)
    pieces = [p for i in range(model.vocab_size()) if len(p := model.id_to_piece(i)) > 1 and p[0] == MARK]
    texts = [p[1:].replace(MARK, " ") for p in pieces]
    return {" " + t: 1 for p, t, got in zip(pieces, texts, model.encode(texts, out_type=str, num_threads=1), strict=True) if got == [p]}


class PreTokenCounts(dict):
    """Counts by pre-token; what is missing is merged by the library and kept, within bounds."""

    def __init__(self, path: str):
        self.model, self.proven = _model(path), whole_tokens(path)
        super().__init__(self.proven)
        self[" "] = 1

    def __missing__(self, pre_token: str) -> int:
        n = len(self.model.encode(pre_token[1:], num_threads=1))
        if len(pre_token) < 256:
            self[pre_token] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; null and empty texts have none."""
        if not text:
            return 0
        return sum(map(self.__getitem__, _PRE_TOKEN.findall(" " + text.replace(MARK, " "))))

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self |= self.proven
            self[" "] = 1


def token_counts(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of ``documents``, in no order.

    Counts equal those of the SentencePiece library without begin or end tokens; strings
    that look like special tokens are ordinary text, as the library has them.  A null text
    is an empty text: 0 bytes, 0 tokens.  A null doc_id stays null; repeated rows are
    counted each; an empty table gives an empty table; no other column is read.  Texts of
    any length are counted whole.
    """
    proven = splits_at_spaces(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PreTokenCounts(model_path)
        for batch in batches:
            n = []
            for text in batch["text"]:
                text = text.as_py() or ""
                n.append(counts.count(text) if proven else len(counts.model.encode(text, num_threads=1)))
            counts.trim()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
