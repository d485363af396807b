"""SentencePiece encoding and decoding by a prefix table.

A merge model gives every prefix of a word exactly one possible last token: the token that ends there and can
stand after the last token of the prefix before it. An Aho-Corasick automaton lists the tokens that end at each
position, a pair-compatibility test (do the merges of the two joined pieces give back these two pieces?) picks the
one, and the ids are recovered backwards from the end of the word. Spark deals out the documents; the encoder is
a small helper inside tasks.

Defined results: null text = empty text = the end id alone; unknown characters become their UTF-8 byte pieces;
rows with equal ids or texts are handled one by one; extra columns are dropped from the result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, kept, small_batches, table

BAR = "▁"
_CHUNKS = re.compile(f"{BAR}*[^{BAR}\n]+|{BAR}+|\n")


class PrefixTableEncoder:
    """Encoder and decoder of one merge-type SentencePiece model with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.score: dict[str, float] = {}
        self.piece_id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.id_bytes: list[bytes] = []
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.id_bytes.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                self.score[p.piece], self.piece_id[p.piece] = p.score, i
                self.id_bytes.append(p.piece.replace(BAR, " ").encode())
                automaton.add_word(p.piece, (len(p.piece), i))
            else:
                self.id_bytes.append(b"")
        self.piece_of = [p.piece for p in model.pieces]
        self.id_code = [i.to_bytes(4, "little") for i in range(len(model.pieces))]
        automaton.make_automaton()
        self.automaton = automaton
        self.end_id = model.trainer_spec.eos_id
        self.pairs: dict[int, bool] = {}
        self.after_bar = Memo(lambda w: self.encode_chunk(BAR + w), cap=800_000)
        self.bare = Memo(self.encode_chunk, cap=50_000)

    def merge(self, text: str) -> list[str]:
        """The merges as such: the best-scored adjacent pair first, the leftmost of equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart, each in one piece. left -1: a start or an unknown character."""
        one, two = self.piece_of[left] if left >= 0 else "", self.piece_of[right]
        known = self.merge(one + two) == ([one, two] if one else [two])
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[left << 16 | right] = known
        return known

    def encode_chunk(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of a chunk."""
        if BAR * 2 in chunk:  # runs of spaces share one score, so that the place decides: use the merges as such
            return b"".join(self.id_code[self.piece_id[p]] if p in self.piece_id else self.unknown(p) for p in self.merge(chunk))
        n = len(chunk)
        last = [-1] * (n + 1)  # the unique last token of each prefix; -1 after an unknown character
        pairs = self.pairs
        for end, (size, token) in self.automaton.iter(chunk):
            if last[end + 1] < 0:
                left = last[end + 1 - size]
                ok = pairs.get(left << 16 | token)
                if ok or ok is None and self.compatible(left, token):
                    last[end + 1] = token
        out: list[bytes] = []
        while n:
            token = last[n]
            if token < 0:
                out.append(self.unknown(chunk[n - 1]))
                n -= 1
            else:
                out.append(self.id_code[token])
                n -= len(self.piece_of[token])
        return b"".join(out[::-1])

    def unknown(self, char: str) -> bytes:
        return b"".join(self.id_code[self.byte_id[b]] for b in char.encode("utf-8", "replace"))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text and the end id. Tokens never cross from a character into a following space, nor a line end."""
        out: list[bytes] = []
        if text:
            if BAR in text:
                return self._slow(text)
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if "" in words and line:
                    return self._slow(text)
                if k:
                    out.append(self.bare["\n"])
                    if line:
                        out.append(self.bare[words[0]])
                    words = words[1:]
                elif not line:
                    words = [""]
                out.extend(map(self.after_bar.__getitem__, words))
        out.append(np.array([self.end_id], "<i4").tobytes())
        return np.frombuffer(b"".join(out), "<i4")

    def _slow(self, text: str) -> np.ndarray:
        parts = [self.bare[c] for c in _CHUNKS.findall(BAR + text.replace(" ", BAR))]
        return np.frombuffer(b"".join(parts) + np.array([self.end_id], "<i4").tobytes(), "<i4")

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.id_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encoder(model_file: str) -> PrefixTableEncoder:
    return kept(f"pieces {model_file}", lambda: PrefixTableEncoder(model_file))


def encode_decode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, `ids` (end id last) and `decoded`, the text those ids stand for."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model_file)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = [codec.encode(t) for t in texts[lo : lo + 256]]
                ends = np.cumsum([0, *map(len, part)], dtype="i8")
                ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part)))
                decoded = pa.array([codec.decode(p.tolist()) for p in part], pa.string())
                yield pa.RecordBatch.from_arrays([keys.slice(lo, len(part)), ids.cast(pa.list_(pa.int32())), decoded], ["k", "ids", "decoded"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", key)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
