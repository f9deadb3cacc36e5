"""Byte-level BPE encoding and decoding (operator 7).

The rank file of a byte-level vocabulary is serialised as a sentencepiece BPE
model: every token becomes one piece, its bytes mapped to printable code
points, with the score ``-rank``; normalisation is the identity and no
whitespace is added or escaped.  sentencepiece merges the adjacent pair whose
union has the highest score, leftmost first, which is the lowest-rank rule of
byte-level BPE, so a piece's id is the token's rank.  Texts are cut into
pre-tokens by the vocabulary's pattern and each pre-token is encoded by itself;
decoding maps ids to bytes and joins them.

Null texts count as empty (no tokens).  Special tokens are never produced:
their strings are ordinary text.  Input columns named like added ones give way to
them; repeated rows get equal results; an empty table gives none.  Any length of text and of pre-token is
encoded whole; the pre-token cache only saves time and is bounded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docmill.llm.common import map_arrow, room_for, spare_name, table, with_fields

#: Unicode's White_Space, which \\s means in the pattern's own regex dialect.
WHITE_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
CACHED_TOKENS, CACHED_LENGTH = 150_000, 48


def byte_alphabet() -> list[str]:
    """One printable code point per byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    chars = dict(zip(own, map(chr, own))) | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank; the file has a base64 token and its rank on every line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} aren't 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    """A protocol-buffer field: a varint, or length and bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes last."""
    alphabet = byte_alphabet()
    normal, unknown, bpe = 1, 2, 2

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    pieces = [piece("".join(alphabet[b] for b in t), -float(rank), normal) for rank, t in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with one vocabulary; made once in each Python worker."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens, self.unknown = tokens, len(tokens)
        self.findall = regex.compile(pattern.replace(r"[^\s", rf"[^{WHITE_SPACE}").replace(r"(?!\S)", rf"(?![^{WHITE_SPACE}])").replace(r"\s", f"[{WHITE_SPACE}]")).findall
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.cache: dict[str, bytes] = {}

    def _encode(self, pre: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers; one that is itself a token stays whole."""
        raw = pre.encode("utf-8")
        out = self.whole.get(raw)
        if out is None:
            ids = self.sp.encode(raw.decode("latin-1").translate(self.alphabet), out_type=int)
            if self.unknown in ids:
                raise ValueError(f"no token for a byte of {pre[:40]!r}")
            out = np.array(ids, "<u4").tobytes()
        if len(pre) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED_TOKENS:
                self.cache.clear()
            self.cache[pre] = out
        return out

    def encode(self, text: str) -> bytes:
        get, encode, out = self.cache.get, self._encode, []
        for pre in self.findall(text):
            out.append(get(pre) or encode(pre))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def _codec(key: str, shipped) -> Codec:
    if key not in _codecs:
        model, tokens, pattern = shipped.value
        _codecs[key] = Codec(model, tokens, pattern)
    return _codecs[key]


def encode(spark: SparkSession, docs: DataFrame, *, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True, decoded: str | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) plus ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, if asked for, ``ids`` (array of int) and the decoded text
    under the name ``decoded``.

    One pass without a shuffle; the vocabulary (a fixed file of about a megabyte) is
    read on the driver and broadcast.
    """
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + (f", `{decoded}` string" if decoded else "")
    keep = room_for([c for c in docs.columns if c != text] if keep is None else keep, added)
    tokens = read_ranks(vocabulary)
    model = serialise_model(tokens)
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    shipped = spark.sparkContext.broadcast((model, tokens, pattern))
    ids_type = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shipped)
        for batch in batches:
            n, ids_sha, decoded_sha, all_ids, texts = [], [], [], [], []
            for value in batch.column(len(keep)):
                ids = codec.encode(value.as_py() or "")
                back = codec.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                if decoded:
                    texts.append(back.decode("utf-8"))
            out = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            out += [pa.array(all_ids, ids_type)] * with_ids + [pa.array(texts, pa.string())] * bool(decoded)
            yield pa.RecordBatch.from_arrays(out, names=names)
        _codecs.clear()  # the worker lives on, and what it holds counts against its executor

    schema = with_fields(docs.select(*keep).schema, added)
    names = schema.names
    # A batch holds whole texts, so few rows a batch bound a worker's memory.
    return map_arrow(docs.select(*keep, docs[text].alias(spare_name(keep))), run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, with_ids=False)
