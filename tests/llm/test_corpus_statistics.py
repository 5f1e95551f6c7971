"""Scoring, spelling variants and whitening against plain Python on small tables with the awkward cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotwise.llm import backoff, spelling, whitening

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = np.random.default_rng(11)
WORDS = [f"{s}{e}" for s in ("garden", "window", "Straße", "naïveté", "kettle") for e in ("", "s", "e", "x", "sx")]
SCHEMA = "doc_id long, text string, block int, word string, id long"


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS, n))


TEXTS = [
    prose(40), prose(300), None, "", " \x0b\x0c\n\t\r ", "one", "ONE one", prose(20_000), "a b\x85c   d",
    "x" * 70_000, "gardEn GARDEN\ngardens  gardenz\x1cgardenz", *[prose(30) for _ in range(12)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "clash", 2) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, TEXTS[1], 1, "clash", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(docs) -> list[tuple]:
    return [(r.doc_id, r.text) for r in docs.collect()]


def plain_model(rows, order: int, mass: float):
    """Texts as words, their folds, the counts, and p(word | context)."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts, starts = Counter(), 0
    for words, out in zip(texts, held):
        if not out:
            starts += 1
            seen = ["<s>", *words]
            counts.update(tuple(seen[k - n + 1 : k + 1]) for n in range(1, order + 1) for k in range(max(1, n - 1), len(seen)))
    singles = {g: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(singles.values()), len(singles)

    def chance(context: tuple, word) -> float:
        if not context:
            return (counts[(word,)] + 1) / (n + v + 1)
        whole = starts if context == ("<s>",) else counts[context]
        return (counts[(*context, word)] + mass * chance(context[1:], word)) / (whole + mass)

    return texts, held, counts, n, chance


def plain_scores(rows, order: int, mass: float):
    """What the scorer should say of each row."""
    texts, held, counts, n, chance = plain_model(rows, order, mass)
    found = []
    for (i, _), words, out in zip(rows, texts, held):
        seen = ["<s>", *words]
        base = sum(math.log10(chance((), w)) for w in words)
        full = sum(math.log10(chance(tuple(seen[max(0, k - order + 1) : k]), seen[k])) for k in range(1, len(seen)))
        found.append((i, out, len(words), sum(counts[(w,)] > 0 for w in words), n, base, full))
    return found


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (2, 20_000), (2, 1 << 20), (3, 20_000)])
def test_scores_equal_the_plain_model(docs, order, block):
    got = [tuple(r) for r in backoff.score(docs, order=order, mass=3.5, block=block).collect()]
    expected = plain_scores(rows_of(docs), order, 3.5)
    assert len(got) == len(expected) == docs.count()
    for a, b in zip(ordered(got), ordered(expected)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_model_is_a_distribution():
    """After any context the chances of all words and of one unknown word for the rest add up to 1."""
    rows = [(i, " ".join(rng.choice(["u", "v", "w"], 9))) for i in range(30)]
    _, _, counts, _, chance = plain_model(rows, 3, 2.0)
    words = [g[0] for g in counts if len(g) == 1] + ["unknown"]
    for context in ((), ("<s>",), ("u",), ("never",), ("<s>", "v"), ("v", "w"), ("never", "w")):
        assert sum(chance(context, w) for w in words) == pytest.approx(1.0)


def test_context_helps_on_held_out_text(spark):
    """Text with an order of words: held-out texts are likelier with the context than without."""
    verses = [["red", "fox", "runs"], ["blue", "whale", "sings"], ["old", "owl", "sleeps"]]
    texts = [(i, " ".join(w for k in rng.integers(0, 3, 20) for w in verses[k])) for i in range(200)]
    got = backoff.score(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 10
    assert all(r.score > r.base_score for r in got)


def test_scores_on_empty_tables(spark, docs):
    assert backoff.score(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(None, None)], "doc_id long, text string")
    row = backoff.score(none).first()
    assert (row.doc_id, row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (None, False, 1, 1, 1)
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = backoff.score(spark.createDataFrame([(out, "only held out")], "doc_id long, text string")).first()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0)


def test_scores_do_not_depend_on_partitions(docs):
    a = backoff.score(docs, block=20_000).select("doc_id", F.round("score", 6).alias("s"))
    b = backoff.score(docs.repartition(7), block=300_000).select("doc_id", F.round("score", 6).alias("s"))
    assert ordered(map(tuple, a.collect())) == ordered(map(tuple, b.collect()))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True))
def test_packed_keys_come_back(keys):
    made = np.sort(np.array(keys, np.uint64))
    assert backoff._unpack(backoff._pack(made)).tolist() == made.tolist()


def test_words_that_share_half_a_hash_are_told_apart():
    """Equal upper halves with other lower halves are other words, whatever order requests bring them in."""
    def request(low, count):
        return {"keys": backoff._pack(np.array([5, 9], np.uint64)), "checks": np.array(low, np.uint64).tobytes(),
                "counts": backoff._narrow(np.array(count)), "size": 2}

    number, counts = backoff._same([request([1, 1], [3, 4]), request([2, 1], [10, 20]), request([1, 7], [100, 300])])
    totals = np.bincount(number, weights=counts)[number]
    assert totals.tolist() == [103, 24, 10, 24, 103, 300]


# ---- spelling variants


def plain_words(rows, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    found = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        found.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return found


def spelled(spark):
    """Texts with variants of frequent words, chains of forms, ties, anagrams, accents and very long words."""
    long = "q" * 3000
    made = {
        "lantern": 1800, "lanterm": 280, "lamterm": 46, "lamterms": 7, "lantrn": 6, "lanternn": 9, "lanetrn": 8,
        "harbour": 60, "harbor": 60, "harboor": 12, "éclairs": 40, "eclairs": 8, "éclair": 8, "short": 500, "fewtimes": 4,
        long: 30, long + "r": 6, long[:-1] + "r": 5, "silent": 20, "listen": 20, "enlist": 100, "ÀÉÎÕÜ÷×": 25, "ÀÉÎÕÜ÷": 5,
    }
    made |= {f"v{a}{b}riant": 5 + (a == "a") * 30 for a in "abcdefgh" for b in "abcdefgh"}
    runs = [w for w, n in made.items() for _ in range(n)]
    rng.shuffle(runs)
    texts = [" ".join(runs[i : i + 90]) for i in range(0, len(runs), 90)]
    rows = [(i, t, 1, "clash", 2) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], 1, "clash", 2), (900, None, 1, None, 2), (901, "", 1, None, 2), (902, "Lantern LANTERN ÉCLAIRS 3lantern4", 1, None, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_variants_equal_brute_force(spark, monkeypatch):
    docs = spelled(spark)
    expected = plain_variants(rows_of(docs))
    assert sum(e[1] is not None for e in expected) > 20 and any(e[2] not in (e[0], e[1]) for e in expected)
    assert {tuple(r) for r in spelling.variants(docs).collect()} == expected
    # Chunks and groups as small as large tables make them.
    monkeypatch.setattr(spelling, "CHUNK", 3)
    monkeypatch.setattr(spelling, "GROUP", 50)
    assert {tuple(r) for r in spelling.variants(docs).collect()} == expected


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, 1, "w", 2), (2, "five5 words", 1, "w", 2)], SCHEMA)).collect() == []


alphabet = st.text("abcàé", min_size=6, max_size=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(alphabet, min_size=2, max_size=40, unique=True))
def test_products_of_letter_counts_find_all_pairs(words):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    found = set()
    for n, left in by_length.items():
        found |= {frozenset((left[i], left[j])) for i, j in zip(*spelling.near_pairs(left, None))}
        right = by_length.get(n + 1)
        if right:
            found |= {frozenset((left[i], right[j])) for i, j in zip(*spelling.near_pairs(left, right))}
    assert found == {frozenset((a, b)) for a in words for b in words if a != b and one_edit(a, b)}


def test_neighbours_are_the_blocks_of_one_edit(spark):
    """Any edit of a word leads to its block or to one of the neighbours, from one side or the other."""
    words = ["lantern", "lanterna", "lantera", "lanera", "éclairs", "eclairs", "ÿclairs", "clairs"]
    blocks = {r.word: tuple(r[b] for b in spelling.BLOCK) for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", *spelling._block()).collect()}
    steps = set(spelling._neighbours())
    for a in words:
        for b in words:
            if a != b and one_edit(a, b):
                step = tuple(y - x for x, y in zip(blocks[a], blocks[b]))
                assert step in steps or tuple(-s for s in step) in steps


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, index long, x string, place int"


def vector_rows(n: int, dim: int):
    mixing = rng.normal(size=(dim, dim)) * 0.2
    return [(i, [float(np.float32(v)) for v in rng.normal(size=dim) @ mixing + 3], 1, "clash", 2) for i in range(n)]


def plain_whitening(rows):
    kept = [(r[0], r[1]) for r in rows]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviations = [int(((n * v - s) ** 2).sum()) for v in x]
    c = np.array(n * x - s, dtype=float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, deviations, c, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("n,dim,height", [(200, 5, 1024), (333, 40, 50)])
def test_whitening_equals_plain_numpy(spark, n, dim, height):
    rows = vector_rows(n, dim)
    rows += [rows[0], rows[0], (None, rows[1][1], 1, "clash", 2)]
    dropped = [
        (-1, None, 1, None, 2), (-2, [], 1, None, 2), (-3, [None] * dim, 1, None, 2), (-4, [1.0, *[None] * (dim - 1)], 1, None, 2),
        (-5, [math.nan] * dim, 1, None, 2), (-6, [1.0] * (dim - 1) + [math.inf], 1, None, 2), (-7, [1.0] * (dim - 1) + [-math.inf], 1, None, 2),
        (-8, [1.0] * (dim - 1), 1, None, 2), (-9, [1.0] * (dim + 1), 1, None, 2),
    ]
    got = whitening.whiten(spark.createDataFrame([*dropped, *rows], VECTORS).repartition(5), height=height).collect()
    count, deviations, centred, values, directions = plain_whitening(rows)
    k = min(32, dim)
    assert len(got) == len(rows) * k and {r.n for r in got} == {count}
    z = centred @ (directions[:, :k] / np.sqrt(values[:k]))
    by_id = {r[0]: (d, w) for r, d, w in zip(rows, deviations, z)}
    signs = {}
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id)):
        d, w = by_id[r.vec_id]
        sign = signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
        assert r.deviation == d
        assert r.whitened * sign == pytest.approx(w[r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "x", 2)], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "x", 2)] * 3, VECTORS)).collect() == []
    # One of two dimensions varies: one component.
    rows = [(i, [float(i), 7.0], 1, "x", 2) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id, r.component, r.explained) for r in got) == [(i, 1, 1.0) for i in range(4)]


def test_whitening_of_huge_entries(spark):
    """Entries beyond the bound count as the bound; a deviation beyond a long is null, not an error."""
    rows = [(1, [1e30, 0.0], 1, "x", 2), (2, [-1e30, 1.0], 1, "x", 2), (3, [0.5, 2.0], 1, "x", 2)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 40960}


def test_splits_change_no_scatter(spark):
    values = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "index long, values array<double>")
    for height in (7, 64, 1024):
        matrix = whitening.block_matrix(rows, 300, 4, height)
        assert np.allclose(whitening.scatter(matrix), values.T @ values)


def test_texts_are_cut_like_the_pattern():
    texts = ["a\x0bb\x0cc\rd\te\nf g", "  lead", "trail \n", "", "x\x1cy z ", "ÄÉ İ A"]
    block = backoff.Block(pa.array(texts))
    assert block.sizes.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for t in texts]
