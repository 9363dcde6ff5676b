"""Source divergence, spelling variants and the chosen-path join against plain Python, on rows with nulls, repeats, ties, long texts and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_operators import SCHEMA, lower, rows, words

from tessella.llm import chosen_path, divergence, nodes, spelling
from tessella.llm.common import Sieve, WorkFolder

WIDE = SCHEMA + ", g long, node long, v long, term string, form string, size long, leaf long, label long"


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, "t", "f", 4, 5, 6) for r in many()], WIDE).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], WIDE)


def many():
    """The usual hostile rows, and texts that share frequent words, variants of them, and near copies of several kinds."""
    rng, out = random.Random(11), rows()
    names = ["colour", "color", "colours", "grüße", "Grüße", "aaaaa", "aaaaaa", "naïve", "naive", "abcdefghij", "bcdefghij", "ábcdefghij"]
    base = [f"w{i}" for i in range(300)]
    for i in range(80):
        text = " ".join(rng.choices(names, k=rng.randint(0, 60))) + rng.choice(["", " Ⱥbc", " étage", "\x00x", " x×y÷z", "?"])
        out.append((1000 + i, text, ["en", "", None][i % 3], ["s1", None, "é", "z"][i % 4], 7, i, "k", 1, 2, "t"))
    for i in range(40):
        copy = list(base)
        for _ in range(i // 5):
            copy[rng.randrange(len(copy))] = rng.choice(["x", "y", "z"])
        out.append((2000 + i, " ".join(copy), "xx", "alone", 7, i, "k", 1, 2, "t"))
    out += [(None, " ".join(base), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    out.append((2003, "quite another text of the same id", "en", "s1", 7, 1, "k", 1, 2, "t"))
    return out


def plain_divergence(table, least=10):
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for r in table:
        lang, source = r[2] or "", r[3] or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in found.items() if g == lang}
        total = {t: sum(c[t] for c in groups.values()) for t in kept}

        def shares(counts):
            size = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // size for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            marks = [(-f(p[s][t], q[t]), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, some in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(marks, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(some, 1)]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("block", [1024, 2])
def test_source_divergence(wide, none, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)  # more sources than a block
    monkeypatch.setattr(divergence, "HELD", 5)
    got = sorted(tuple(r) for r in divergence.source_divergence(wide).select(COLUMNS).collect())
    assert got == plain_divergence(many())
    assert divergence.source_divergence(none).count() == 0


def test_shares_and_runs_are_exact():
    rng = random.Random(1)
    n = [0, 1, 5, 10**6, 8 * 10**15 - 2] + [rng.randrange(10**15) for _ in range(50)]
    size = 9 * 10**15
    assert divergence.shares(np.array(n), size).tolist() == [1 + 10**9 * (x + 2) // size for x in n]
    length = np.array([rng.randint(1, 9) for _ in range(40)])
    x, y = (np.sort(np.array([rng.randint(0, 5) for _ in range(40)])) for _ in range(2))
    before = np.concatenate([[0], np.cumsum(length)])
    a, b = divergence.RunColumn(x, 300), divergence.RunColumn(y, 200)
    p, q = divergence.shares(x, 300), divergence.shares(y, 200)
    assert len(a.start) <= 6 and divergence.run_divergence(a, b, before) == int(((p - q) ** 2 // (p + q) * length).sum())


def plain_variants(table):
    counts = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(o, key=lambda v: (-n[v], v)) for w, o in others.items() if o}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(others[w]), n.get(form.get(w))))
    return sorted(out, key=str)


WORDS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_variants(spark, wide, none):
    got = sorted((tuple(r) for r in spelling.spelling_variants(wide).select(WORDS).collect()), key=str)
    assert got == plain_variants([(r[0], r[1]) for r in many()]) and any(r[1] for r in got)
    assert spelling.spelling_variants(none).count() == 0


@pytest.mark.parametrize("limit", [spelling.LIMIT, 2])
def test_near_words_of_every_window(spark, limit):
    """All words of few letters, with runs, where an edit has several places; large partitions are divided down to one place."""
    rng = random.Random(4)
    table = {"".join(rng.choices("abÿ", k=rng.randint(5, 8))) for _ in range(150)} | {"a" * i for i in range(5, 75)} | {"a" * 80 + "b", "a" * 81}
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(table))], "word string, n long")
    got = [(r.word, r.other) for r in spelling.near_words(df, WorkFolder(spark, "t"), limit).collect()]
    gaps = defaultdict(set)
    for w in table:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1 :]].add(w)
    want = {(a, b) for some in gaps.values() for a in some for b in some if a != b}
    for (_, rest), some in gaps.items():
        if rest in table:
            want |= {p for w in some for p in ((w, rest), (rest, w))}
    assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    made = spelling.Acceptor(sorted([b"tap", b"taps", b"top", b"tops"]))
    assert len(made.arcs) == 5  # t, a or o, p, s: the two middles are one state
    assert sorted(made.common(made.start, made.start, 4)) == [b"taps", b"tops"]


def sets_of(table, k):
    out = []
    for doc, text in table:
        found = words(lower(text))
        out.append((doc, frozenset(tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))) if found else frozenset()))
    return out


def plain_components(table, k, percent):
    """Each row's component is that of its own text."""
    rows_ = sets_of(table, k)
    least = {}
    sets = {s for d, s in rows_ if d is not None and s}
    links = {s: [t for t in sets if 100 * len(s & t) >= percent * len(s | t)] for s in sets}
    first = {s: min(d for d, t in rows_ if t == s and d is not None) for s in sets}
    for s in sorted(sets, key=first.get):
        todo, root = [s], first[s]
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = root
                todo += links[x]
    out = [(d, len(s), None if d is None else least.get(s, d)) for d, s in rows_]
    return sorted(((d, n, c, None if d is None else d == c) for d, n, c in out), key=str)


@pytest.mark.parametrize("small,k,percent", [(chosen_path.SMALL, 5, 85), (4, 5, 85), (3, 3, 60)])
def test_chosen_path_join(wide, none, monkeypatch, small, k, percent):
    monkeypatch.setattr(chosen_path, "SMALL", small)  # nodes branch, and what stays large is compared tile by tile
    monkeypatch.setattr(chosen_path, "DEPTH", 3)
    got = sorted((tuple(r) for r in chosen_path.near_duplicates(wide, k, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == plain_components([(r[0], r[1]) for r in many()], k, percent)
    assert chosen_path.near_duplicates(none).count() == 0


def test_trees_reach_their_recall():
    """Pairs of just the least similarity share a root's node in one tree at least; unlike ones hardly ever do."""
    rng = np.random.default_rng(3)
    hit = {0.86: 0, 0.2: 0}
    for similar in hit:
        for _ in range(200):
            both, own = int(1000 * similar), (1000 - int(1000 * similar)) // 2
            x = rng.integers(0, 1 << 63, both + 2 * own).astype(np.uint64)
            a, b = chosen_path.minwise([x[: both + own], np.concatenate([x[:both], x[both + own :]])], 0, chosen_path.TREES)
            hit[similar] += int((a == b).sum())
    assert 0.82 < hit[0.86] / (200 * chosen_path.TREES) < 0.9 and hit[0.2] / (200 * chosen_path.TREES) < 0.25


def test_forest_joins_what_the_pairs_join():
    rng = np.random.default_rng(5)
    for _ in range(50):
        near = np.triu(rng.random((12, 12)) < 0.1, 1)
        near |= near.T
        edges = nodes.forest(near)
        assert all(near[i, j] for i, j in edges)
        reach, part = np.linalg.matrix_power(near.astype(int) + np.eye(12, dtype=int), 12) > 0, np.eye(12, dtype=int)
        for i, j in edges:
            part[i, j] = part[j, i] = 1
        assert ((np.linalg.matrix_power(part, 12) > 0) == reach).all() and len(edges) == 12 - len({tuple(r) for r in reach.tolist()})


def test_close_pairs_keep_every_similar_pair():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        sets += [np.unique(base[: rng.integers(330, 401)]) for _ in range(3)]
    near = nodes.close_pairs(np.array([len(s) for s in sets]), np.array([nodes.bit_sketch(s).view(np.uint64) for s in sets]), 85)
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            both = len(np.intersect1d(s, t))
            assert near[i, j] or 100 * both < 85 * (len(s) + len(t) - both)


def test_marks_keep_similar_pairs_and_tell_large_sets_apart():
    rng = np.random.default_rng(8)
    base, sets = rng.integers(0, 1 << 63, 9000).astype(np.uint64), []
    for similar in (0.86, 0.99, 0.3, 0.0):
        kept = int(9000 * 2 * similar / (1 + similar))
        sets.append(np.unique(np.concatenate([base[:kept], rng.integers(0, 1 << 63, 9000 - kept).astype(np.uint64)])))
    marks = [m.tobytes() for m in chosen_path.mix(chosen_path.minwise([np.unique(base), *sets], 16, 64)).astype(np.uint8)]
    near = nodes.agreeing(~np.eye(5, dtype=bool), marks, 85)
    assert near[0].tolist() == [False, True, True, False, False] and (near == near.T).all()
    assert nodes.least_agreeing(64, 85) == 31 and nodes.agreeing(~np.eye(5, dtype=bool), [None] * 5, 85).sum() == 20


def test_sieve(spark):
    ids = list(range(0, 20_000, 7)) + [-1, (1 << 63) - 1]
    made = Sieve(spark.createDataFrame([(i,) for i in [*ids, None]], "id long"))
    assert made(np.array(ids)).all() and made(np.arange(1, 20_000, 7)).mean() < 0.01
    assert not Sieve(spark.createDataFrame([], "id long"))(np.arange(100)).any()
