"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing (MacKay and Peto 1995):

    p(w) = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m)

where h' is h without its first word, m is ``MASS``, and a context never seen
leaves p(w | h') as it is. Written as an automaton, each context seen in training
is a state. A state has an arc for each word seen after it, with the weight
log10 p(w | h), and one failure arc to the state of h' with the weight
log10(m / (c(h) + m)). The state without words has arcs for all words and one
for words that are unknown. A text is read from left to right from the start
state: where a state has no arc for the next token its failure arc is taken, and
its weight added, until one has; that arc leads to the longest context that is a state.

Neither text nor automaton is held in one place. Texts are dealt into blocks,
and a block asks for the counts of just those n-grams that it has: they are the
arcs its texts can take. The requests carry the block's own training counts, so
the answer is their sum over all blocks that ask, and no n-gram travels twice. A
request is a run of sorted 63-bit hashes in one row for each block and bucket of
the hash; an answer is the counts in the same order. Words are told apart by
128 bits, so counts of words are exact; of 10^9 different n-grams about one shares its
hash, and so its count, with some other in ten. Requests and answers follow the input, a word that all texts
have is one number for each block, and a bucket holds an even share of hashes.

A null text is empty and has its end only; a null id counts as empty text, so it
is in training. Repeated rows count each time. Only the two named columns are read, so
the names of others do not matter. No documents give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import mix64

#: Fixed values of the contract: texts with this remainder of their id's checksum are held out.
FOLDS, HELD_OUT = 7, 2
#: Words of an n-gram at most, and the weight of the shorter context in counts.
ORDER, MASS = 2, 200.0
#: Bytes of text in a block, and of text whose n-grams are in one bucket.
BLOCK = 8 << 20

#: Hashes of the end of a text and of the state before its first word: no word has a space in it.
_END, _START = xxhash.xxh3_128_intdigest(b"end of text"), xxhash.xxh3_128_intdigest(b"start of text")
_LOW = (1 << 64) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


class Block:
    """The tokens of a block's texts and the hashes of their n-grams.

    ``ids`` numbers the tokens by word, the end being the last; ``first`` is where each
    text begins.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        real = pc.not_equal(words, "")
        coded = words.filter(real).dictionary_encode()
        of = of[real.to_numpy(zero_copy_only=False)]
        known = [xxhash.xxh3_128_intdigest(w) for w in coded.dictionary.to_pylist()] + [_END, _START]
        self.end, self.start = len(known) - 2, len(known) - 1
        self.high = np.array([k >> 64 for k in known], np.uint64)
        self.low = np.array([k & _LOW for k in known], np.uint64)
        sizes = np.bincount(of, minlength=len(texts)) + 1
        self.last = np.cumsum(sizes) - 1
        self.first = self.last - sizes + 1
        self.sizes = sizes
        self.ids = np.full(int(sizes.sum()), self.end, np.int64)
        inside = np.ones(len(self.ids), bool)
        inside[self.last] = False
        self.ids[inside] = coded.indices.to_numpy()
        self.place = np.arange(len(self.ids)) - np.repeat(self.first, sizes)
        self.by_hash = np.argsort(self.high[: self.start], kind="stable")

    def grams(self, order: int):
        """For n from 2: n, the hash of the n words that end at each token, and where there are as many.

        The start counts as a word.
        """
        tokens = self.high[self.ids]
        before = np.empty_like(self.ids)
        before[1:], before[self.first] = self.ids[:-1], self.start
        context = self.high[before]
        for n in range(2, order + 1):
            key = mix64(context * _STEP + tokens)
            yield n, key & ~_ONE, self.place >= n - 2
            context = np.concatenate([key[:1], key[:-1]])


def _narrow(counts: np.ndarray) -> bytes:
    most = int(counts.max(initial=0))
    return counts.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)).tobytes()


def _counts(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // size}").astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte: the upper bytes are zeros, which Spark compresses away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


REQUEST = "bucket int, block int, n int, size int, keys binary, checks binary, counts binary"


def _request(buckets: int, order: int):
    def ask(docs: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py()
        text = Block(docs["text"].combine_chunks())
        train = np.repeat(~docs["held_out"].to_numpy(zero_copy_only=False), text.sizes)
        seen = np.bincount(text.ids[train], minlength=text.start)[text.by_hash]
        rows = []

        def add(n: int, keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray) -> None:
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                check = b"" if checks is None else checks[a:b].tobytes()
                rows.append((int(bucket[a]), block, n, b - a, _pack(keys[a:b]), check, _narrow(counts[a:b])))

        add(1, text.high[text.by_hash], text.low[text.by_hash], seen)
        for n, keys, there in text.grams(order):
            flagged = np.sort(keys[there] | train[there])
            if not len(flagged):
                continue
            plain = flagged & ~_ONE
            starts = np.concatenate([[0], np.flatnonzero(plain[1:] != plain[:-1]) + 1])
            add(n, plain[starts], None, np.add.reduceat((flagged & _ONE).astype(np.int64), starts))
        names = [c.split()[0] for c in REQUEST.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ask


def _same(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of all keys of some requests: a number for each key, equal for equal keys, and the counts."""
    keys = np.concatenate([_unpack(r["keys"]) for r in rows])
    counts = np.concatenate([_counts(r["counts"], r["size"]) for r in rows])
    if not rows[0]["checks"]:
        return np.unique(keys, return_inverse=True)[1], counts
    checks = np.concatenate([np.frombuffer(r["checks"], np.uint64) for r in rows])
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    number = np.empty(len(keys), np.int64)
    number[order] = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (c[1:] != c[:-1]))])
    return number, counts


ANSWER = "block int, n int, bucket int, size int, counts binary"


def _answer(requests: pa.Table) -> pa.Table:
    """The sum of all requests' counts, for each request in the order of its keys."""
    asked, out = requests.to_pylist(), []
    for n in sorted({r["n"] for r in asked}):
        rows = [r for r in asked if r["n"] == n]
        number, counts = _same(rows)
        totals = np.bincount(number, weights=counts).astype(np.int64)[number]
        parts = np.split(totals, np.cumsum([r["size"] for r in rows])[:-1])
        out += [(r["block"], n, r["bucket"], r["size"], _narrow(part)) for r, part in zip(rows, parts)]
    kinds = [pa.int32()] * 4 + [pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "n", "bucket", "size", "counts"])


def _known(requests: pa.Table) -> pa.Table:
    """Training tokens and distinct training words of a bucket."""
    rows = [r for r in requests.to_pylist() if r["n"] == 1]
    tokens = words = 0
    if rows:
        number, counts = _same(rows)
        tokens, words = int(counts.sum()), int((np.bincount(number, weights=counts) > 0).sum())
    return pa.table([pa.array([tokens], pa.int64()), pa.array([words], pa.int64())], ["tokens", "words"])


RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _traverse(order: int, mass: float):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        text = Block(docs["text"].combine_chunks())
        given = answers.sort_by([("n", "ascending"), ("bucket", "ascending")]).to_pylist()
        tokens, words = given[0]["tokens"], given[0]["words"]

        def counts(n: int, size: int) -> np.ndarray:
            found = [_counts(r["counts"], r["size"]) for r in given if r["n"] == n]
            joined = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(joined) != size:
                raise ValueError("a block's texts have changed between its questions and their answers")
            return joined

        by_word = np.empty(text.start, np.int64)
        by_word[text.by_hash] = counts(1, text.start)
        seen = by_word[text.ids]
        # Arcs of the state without words; an unknown word's is that of a count of 0.
        chance = (seen + 1) / (tokens + words + 1)
        weight = base = np.log10(chance)
        context = np.empty_like(seen)
        context[1:], context[text.first] = seen[:-1], by_word[text.end]
        for n, keys, there in text.grams(order):
            unique, inverse = np.unique(keys[there], return_inverse=True)
            found = np.zeros(len(seen), np.int64)
            found[there] = counts(n, len(unique))[inverse]
            arc = (found + mass * chance) / (context + mass)
            fail = np.log10(mass / (context + mass))
            weight = np.where(there, np.where(found > 0, np.log10(arc), fail + weight), weight)
            chance = np.where(there, arc, chance)
            context = np.concatenate([found[:1], found[:-1]])
        columns = [
            docs["id"].combine_chunks(),
            docs["held_out"].combine_chunks(),
            pa.array(text.sizes, pa.int64()),
            pa.array(np.add.reduceat((seen > 0).astype(np.int64), text.first)),
            pa.array(np.full(len(text.first), tokens, np.int64)),
            pa.array(np.add.reduceat(base, text.first)),
            pa.array(np.add.reduceat(weight, text.first)),
        ]
        return pa.table(columns, ["id", *[c.split()[0] for c in RESULT.split(", ")]])

    return score


def score(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    mass: float = MASS,
    block: int = BLOCK,
) -> DataFrame:
    """Id, fold, tokens, known tokens and log10 probabilities of every text.

    ``base_score`` is that of single words, ``score`` the automaton's. Two passes
    over the texts, which are dealt to blocks once: one asks, one reads the answers.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(FOLDS))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    dealt = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold == HELD_OUT).alias("held_out"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"),
    ).repartition(blocks, "block")
    requests = dealt.groupBy("block").applyInArrow(_request(blocks, order), REQUEST)
    asked = requests.groupBy("bucket")
    known = asked.applyInArrow(_known, "tokens long, words long")
    totals = known.agg(F.struct(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")))
    answers = asked.applyInArrow(_answer, ANSWER).withColumn("totals", totals.scalar())
    answers = answers.select("block", "n", "bucket", "size", "counts", "totals.tokens", "totals.words")
    kind = docs.schema[key].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _traverse(order, mass), f"id {kind}, {RESULT}"
    )
    return scored.withColumnRenamed("id", key)
