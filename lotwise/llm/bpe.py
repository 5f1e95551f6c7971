"""Byte-level BPE through a sentencepiece model made from a rank file.

The vocabulary becomes a BPE model without training: each token's bytes are
mapped to printable characters, its score is its negative rank, and the
normaliser is the identity. Merging the best-scored pair first is then the same
as merging the lowest rank first. Texts are cut into pre-tokens, each pre-token
is encoded by itself, and ids are decoded by the inverse of the byte map.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.common import pieces

#: Distinct parts of texts a worker remembers before it starts anew, and the longest.
REMEMBERED = 300_000
LONGEST = 64
#: Bytes of text that are cut and looked up at a time.
PIECE = 4 << 20


def byte_names() -> list[str]:
    """A printable character for each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in names)
    names |= {b: chr(256 + n) for n, b in enumerate(rest)}
    return [names[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: bytes are length-prefixed, integers are varints of 64 bits."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value % (1 << 64))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: <unk>, then the tokens by rank.

    Fields as in the public sentencepiece_model.proto: pieces 1 (text 1, score 2,
    type 3), trainer 2 (model type 3: BPE is 2, unk/bos/eos/pad ids 40-43),
    normaliser 3 (name 1, dummy prefix 3, extra spaces 4, escaping 5).
    """
    import struct

    names = byte_names()
    pieces = [_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(names[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    trainer = _field(3, 2) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


#: Letters and digits of Unicode after version 16, which the library
#: of the rank files does not know. They are cut like U+0378, which is unassigned.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f "
    "12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 "
)
_NEWER = re.compile(
    "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]"
)
#: A space that no word follows: there a text is not cut.
_LOOSE = re.compile(r" (?=\s|$)")


class Codec:
    r"""Encoder and decoder of one vocabulary.

    The pattern's ``\s`` is read as the Unicode property White_Space, as the
    library of the rank files reads it.
    """

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        pattern = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank_at = [-1, *sorted(ranks.values())]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.names = {b: name for b, name in enumerate(byte_names())}
        self.known: dict[str, tuple[int, ...]] = {}

    def _cut(self, part: str) -> list[str]:
        if part.isascii() or not _NEWER.search(part):
            return self.split(part)
        ends = list(accumulate(map(len, self.split(_NEWER.sub("\u0378", part)))))
        return [part[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, parts: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each part: of its pre-tokens in turn, whole if they are tokens, else by merges."""
        cut = [self._cut(part) for part in parts]
        raw = {token: token.encode() for tokens in cut for token in tokens}
        ids = {t: (self.ranks[b],) for t, b in raw.items() if b in self.ranks}
        apart = [t for t in raw if t not in ids]
        merged = self.model.encode([raw[t].decode("latin-1").translate(self.names) for t in apart], out_type=int, num_threads=1)
        at = self.rank_at
        ids.update((t, tuple([at[i] for i in found])) for t, found in zip(apart, merged, strict=True))
        return {
            part: ids[tokens[0]] if len(tokens) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, tokens)))
            for part, tokens in zip(parts, cut, strict=True)
        }

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Each text's ids.

        A space before a word always starts a pre-token, and none of the others
        reaches over it, so texts are cut there and equal parts are looked up.
        """
        cut = [self._parts(text) for text in texts]
        known = self.known
        fresh = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(dict.fromkeys(chain.from_iterable(cut)))
        known.update(self._learn(fresh))
        for parts in cut:
            yield list(chain.from_iterable(map(known.__getitem__, parts)))
        for part in fresh:
            if len(part) > LONGEST:
                del known[part]

    def encode(self, text: str) -> list[int]:
        return list(self.encode_batch([text]))[0]

    def _parts(self, text: str) -> list[str]:
        parts = text.split(" ")
        if _LOOSE.search(text):
            parts = self._joined(parts)
        return [parts[0], *[" " + part for part in parts[1:]]]

    @staticmethod
    def _joined(parts: list[str]) -> list[str]:
        """The parts, each with those after it that start with no word."""
        out: list[list[str]] = [[parts[0]]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                out.append([part])
            else:
                out[-1].append(part)
        return [" ".join(p) for p in out]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[int, str], Codec] = {}


def codec_of(broadcast, pattern: str) -> Codec:
    """One codec per worker process and broadcast vocabulary."""
    key = (broadcast.id if hasattr(broadcast, "id") else id(broadcast), pattern)
    if key not in _CODECS:
        model, ranks = broadcast.value
        _CODECS.clear()
        _CODECS[key] = Codec(model, ranks, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` without the text but with ``n_tokens`` and ``token_ids`` (array of int).

    With ``digests`` there are, in place of the ids, the SHA-256 of the decimal
    ids joined by commas and that of the bytes they decode to. Null and empty
    texts have no ids. Each row is encoded by itself, so ties and repeated rows
    do not matter; an input column of a new name is replaced. The vocabulary,
    about one MB whatever the table, is broadcast.
    """
    import hashlib

    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((model_of(ranks), ranks))
    added = (
        [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
        if digests
        else [("n_tokens", pa.int64(), "long"), ("token_ids", pa.list_(pa.int32()), "array<int>")]
    )
    others = [c for c in docs.columns if c != text and c not in {n for n, *_ in added}]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in others), *(f"{n} {t}" for n, _, t in added)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        names = {rank: str(rank) for rank in codec.bytes_of}
        for batch in pieces(batches, PIECE):
            counts, first, second = [], [], []
            for ids in codec.encode_batch([value or "" for value in batch.column(text).to_pylist()]):
                counts.append(len(ids))
                if digests:
                    first.append(sha(",".join(map(names.__getitem__, ids)).encode()))
                    second.append(sha(codec.decode(ids)))
                else:
                    first.append(pa.array(ids, pa.int32()))
            made = [pa.array(counts, pa.int64())]
            if digests:
                made += [pa.array(first, pa.string()), pa.array(second, pa.string())]
            else:
                flat = pa.concat_arrays(first) if first else pa.array([], pa.int32())
                ends = [0]
                for n in counts:
                    ends.append(ends[-1] + n)
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), *made], names=[*others, *(n for n, *_ in added)]
            )

    return docs.select(text, *[f"`{c}`" for c in others]).mapInArrow(work, schema)
