"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and itself."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, whole_groups

#: Code points and occurrences of a word, at least.
LEAST_LENGTH, LEAST_N = 5, 3
#: One in so many (document, run) pairs loses a code point.
MODULUS = 97
#: Distinct runs that a task counts before it sends them on.
HELD = 500_000
#: Words of an initial state's partition; larger ones are divided by where the edit is.
LIMIT = 4096

#: Code points below 256 as bytes: runs with A-Z as a-z, all others as spaces.
_RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: A set of lengths as bits; the last one stands for its own and all greater lengths.
_LAST = 63


def runs(text: str) -> list[bytes]:
    """The runs of a text, a byte a code point, A-Z as a-z. Code points from 256 on end a run, as the question mark does."""
    return text.encode("latin-1", "replace").translate(_RUN_BYTES).split()


def altered(start: int, run: bytes) -> bytes:
    """The run, or what is left when the hash of document and run takes a code point. ``start``: crc32 of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % MODULUS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches):
    """(word, n) of what each task has read, in parts."""
    import pyarrow as pa

    held: Counter = Counter()

    def out():
        words = [w for w in held if len(w) >= LEAST_LENGTH and held[w] > 0]
        texts = pa.array([w.decode("latin-1") for w in words], pa.string())
        return pa.RecordBatch.from_arrays([texts, pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = runs(text)
            start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
            held.update(found)
            gone = {run: word for run in set(found) if (word := altered(start, run)) is not run}
            for run, n in Counter(r for r in found if r in gone).items() if gone else ():
                held[run] -= n
                held[gone[run]] += n
        if len(held) > HELD:
            yield out()
            held.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of LEAST_LENGTH code points and LEAST_N occurrences."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_N)


class Acceptor:
    """The minimal acyclic acceptor of some words, given sorted and distinct.

    ``arcs[s]`` are a state's transitions (byte, state), ``final[s]`` whether it accepts, ``lengths[s]`` the lengths
    of what it accepts, as bits. Equal states are merged as soon as no later word can pass through them.
    """

    def __init__(self, words: list[bytes]) -> None:
        self.arcs: list[tuple[tuple[int, int], ...]] = []
        self.final: list[bool] = []
        self.lengths: list[int] = []
        known: dict = {}
        path: list[list] = [[False, []]]  # states that are still open: final, arcs; the last arc leads to the next one

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                path[-1][1][-1][1] = self._state(known, final, tuple(map(tuple, arcs)))

        before = b""
        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            close(same)
            for byte in word[same:]:
                path[-1][1].append([byte, -1])
                path.append([False, []])
            path[-1][0] = True
            before = word
        close(0)
        self.start = self._state(known, path[0][0], tuple(map(tuple, path[0][1])))

    def _state(self, known: dict, final: bool, arcs: tuple) -> int:
        found = known.get((final, arcs))
        if found is None:
            found = known[final, arcs] = len(self.arcs)
            bits = int(final)
            for _, to in arcs:
                after = self.lengths[to]
                bits |= (after << 1) & ((2 << _LAST) - 1) | after & (1 << _LAST)
            self.arcs.append(arcs)
            self.final.append(final)
            self.lengths.append(bits)
        return found

    def common(self, p: int, q: int, length: int) -> Iterator[bytes]:
        """What both states accept of this length: the part of the composition after the edit."""
        todo = [(p, q, b"")]
        while todo:
            p, q, read = todo.pop()
            left = length - len(read)
            if not self.lengths[p] & self.lengths[q] & (1 << min(left, _LAST)):
                continue
            if not left:
                yield read  # the lengths say that both accept
                continue
            other = dict(self.arcs[q])
            todo += [(to, other[byte], read + bytes((byte,))) for byte, to in self.arcs[p] if byte in other]


def one_edit_pairs(words: list[bytes], length: int, last: bool) -> Iterator[tuple[bytes, bytes]]:
    """Pairs (x, y) of sorted, distinct words that the acceptor, a one-edit transducer and the acceptor again accept.

    x has ``length`` code points; y as many (one replaced) or one more (inserted). Of equal code points the last
    counts as the inserted one. Unless ``last``, one inserted at the very end is left out: it may be a later one's repeat.
    """
    made = Acceptor(words)
    todo = [(made.start, b"")]  # both sides have read the same so far
    while todo:
        state, read = todo.pop()
        arcs, left = made.arcs[state], length - len(read)
        for i, (a, p) in enumerate(arcs):
            if left > 0:
                for b, q in arcs[i + 1 :]:
                    for s in made.common(p, q, left - 1):
                        yield read + bytes((a,)) + s, read + bytes((b,)) + s
            if left or last:
                for s in made.common(state, p, left):
                    if not s or s[0] != a:
                        yield read + s, read + bytes((a,)) + s
            if left > 0:
                todo.append((p, read + bytes((a,))))


def _compose(batches):
    """(word, other, n of other), both ways, for every partition (key, m, lo, hi, word, n) of words that share their first lo and last m - hi code points."""
    import pyarrow as pa

    for some in whole_groups(batches):
        keys, m, lo, hi, words, n = (c.to_pylist() for c in some.columns)
        left, right, count, at = [], [], [], 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if end - at > 1:
                tail, first = m[at] - hi[at], lo[at]
                whole = {(b := w.encode("latin-1"))[first : len(b) - tail]: i for i, w in enumerate(words[at:end], at)}
                for x, y in one_edit_pairs(sorted(whole), hi[at] - first, not tail):
                    i, j = whole[x], whole[y]
                    left += (words[i], words[j])
                    right += (words[j], words[i])
                    count += (n[j], n[i])
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(count, pa.int64())], names=["word", "other", "n"])


def _keyed(windows: DataFrame) -> DataFrame:
    """Windows (word, n, m, lo, hi) with the initial state's key: all that the words of a pair share for certain."""
    key = F.concat_ws(" ", "m", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("right(word, m - hi)"))
    return windows.select(key.alias("key"), "m", "lo", "hi", "word", "n")


def near_words(words: DataFrame, work: WorkFolder, limit: int = LIMIT) -> DataFrame:
    """(word, other, n of other) of all pairs of ``words`` (word, n) that are one inserted, deleted or replaced code point apart, both ways.

    With m the shorter word's length, an edit before place m / 2 leaves the words' ends alike, and one from there on their beginnings:
    such a window of places and what is outside of it names the initial state that both words reach. Partitions of more than
    ``limit`` words are divided by halving their window, down to one place, where the alphabet bounds them.
    """
    halves = "filter(array(struct(m, 0 as lo, m div 2 as hi), struct(m, m div 2 as lo, m as hi)), x -> x.lo < x.hi)"
    lengths = F.expr(f"filter(array(length(word), length(word) - 1), x -> x >= {LEAST_LENGTH})")
    todo = words.select("word", "n", F.explode(lengths).alias("m")).select("word", "n", F.explode(F.expr(halves)).alias("w")).select("word", "n", "w.*")
    out, level = None, 0
    while True:
        keyed = _keyed(todo)
        large = keyed.groupBy("key", "lo", "hi").agg(F.count("*").alias("size")).filter(f"size > {limit} AND hi - lo > 1").select("key")
        large = work.cut(large, f"large{level}")
        some = not large.isEmpty()
        small = keyed.join(large, "key", "left_anti").select(keyed.columns) if some else keyed
        parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = small.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compose, "word string, other string, n long")
        found = work.cut(found, f"pairs{level}")
        out = found if out is None else out.union(found)
        if not some:
            return out
        split = "array(struct(m, lo, (lo + hi) div 2 as hi), struct(m, (lo + hi) div 2 as lo, hi))"
        todo = work.cut(keyed.join(large, "key", "left_semi").select("word", "n", F.explode(F.expr(split)).alias("w")).select("word", "n", "w.*"), f"windows{level}")
        level += 1


def last_forms(forms: DataFrame, work: WorkFolder) -> DataFrame:
    """(word, root) of ``forms`` (word, form): each word's last form. A step doubles the way gone; forms grow in n, so there are no rings."""
    found, turn = work.cut(forms.select("word", F.col("form").alias("root")), "root0"), 0
    while True:
        turn += 1
        on = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = work.cut(found.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"root{turn}")
        done = moved.filter("moved").isEmpty()
        work.drop(f"root{turn - 1}")
        found = moved.select("word", "root")
        if done:
            return found


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text).

    A word's form is its near word of largest n, if that is twice its own or more; ties go to the smaller in code-point order. A null text has no
    words, a null doc_id counts as an empty one in the hash; repeated rows count each time; an empty table gives no rows.
    Words are compared as they are written: a letter with a combining mark is no run.
    """
    work = WorkFolder(docs.sparkSession, "spelling")
    words = work.cut(vocabulary(docs), "words")
    near = near_words(words, work)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("form")))
    by_word = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    placed = words.join(by_word, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.form", (-F.col("best.less")).alias("form_n"))
    true_form = F.col("form_n") >= 2 * F.col("n")
    placed = placed.select("word", "n", "n_near", *[F.when(true_form, F.col(c)).alias(c) for c in ("form", "form_n")])
    placed = work.cut(placed, "forms")
    roots = last_forms(placed.filter("form IS NOT NULL").select("word", "form"), work)
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
