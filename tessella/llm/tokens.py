"""Token ids by public tokenizers, and their ORC files with indexes on document ids."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder, slices, text_of
from tessella.llm.words import Table, hash_runs

#: Pieces whose ids a process keeps.
KEPT_PIECES = 1_000_000
#: Bytes of text that are encoded together.
SLICE = 2 << 20


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _marks(places: bytes) -> np.ndarray:
    """For each byte, whether it is one of these."""
    found = np.zeros(256, dtype=bool)
    found[list(places)] = True
    return found


_LETTER, _STOP = _marks(bytes([*range(65, 91), *range(97, 123)])), _marks(b".,")
_WHITE = _marks(b" \t\n\x0b\x0c\r")
#: Bytes that begin white space, or may do so beyond ASCII.
_MAYBE_WHITE = _WHITE | _marks(b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")


def word_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lower-casing vocabularies that drop white space, so that no token spans it: words, A-Z lower-cased where no accent may follow.

    A stop or comma right after a letter a-z begins a token of its own, so is cut off with what follows.
    Returns all bytes, where each piece begins and ends, and at which piece each text begins, one more for the end.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8).copy()
    data[:-1] += ((data[:-1] >= 65) & (data[:-1] <= 90) & (data[1:] < 128)).astype(np.uint8) * np.uint8(32)
    inside = ~_WHITE[data]
    before = np.concatenate([[False], inside[:-1]])
    after_letter = np.concatenate([[False], _LETTER[data[:-1]]])
    start = np.flatnonzero(inside & (~before | (after_letter & _STOP[data])))
    end = np.flatnonzero(np.concatenate([inside[:-1] & (~inside[1:] | (_LETTER[data[:-1]] & _STOP[data[1:]])), [False]])) + 1
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return data, start, end, np.searchsorted(start, begins)


def byte_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For byte-level vocabularies whose tokens hold a space in front alone; returns as ``word_pieces``.

    Such a tokenizer always starts a new piece at a space before a character that isn't white space, at a stop
    or comma after a letter, at a line feed after one of these, and at a letter after such a line feed; the texts are cut there.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    letter, stop, feed = _LETTER[data], _STOP[data], data == 10
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[:-2] = (data[:-1] == 32) & ~_MAYBE_WHITE[data[1:]]
    cut[1:-1] |= (letter[:-1] & (stop | feed)[1:]) | (stop[:-1] & feed[1:])
    cut[2:-1] |= (letter | stop)[:-2] & feed[1:-1] & letter[2:]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    cut[begins] = True
    cut[begins[1:] - 1] = True  # the line feeds between the texts
    start = np.flatnonzero(cut)
    own = np.ones(len(start) - 1, dtype=bool)
    own[np.searchsorted(start, begins[1:] - 1)] = False
    end = start[1:][own]
    start = start[:-1][own]
    return data, start, end, np.searchsorted(start, begins)


class Encoder:
    """Texts to the ids the vocabulary's own library gives them (without special tokens around them).

    Texts are cut by ``cut`` into pieces that no token spans; a piece's ids are looked up by a 64-bit hash, and only those of
    pieces not known yet come from the library; those that match ``plain`` go to it in one text, ``between`` them: of
    each, exactly the one token whose name ``bound`` matches is its first or last. Of more than ``kept`` pieces those used most stay. A text with
    the string of an added token (in any case, A-Z), which the library may take for that token, goes to it as a whole.
    """

    def __init__(self, path: str, cut: Callable, plain: bytes, between: str, bound: str, first: bool, kept: int = KEPT_PIECES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made, self.cut, self.kept = Tokenizer.from_file(path), cut, kept
        self.plain, self.between, self.first = re.compile(plain), between, first
        self.bound = np.zeros(self.made.get_vocab_size(), dtype=bool)
        self.bound[[i for name, i in self.made.get_vocab().items() if re.search(bound, name)]] = True
        self.added = [t.content.encode().lower() for t in self.made.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.known, self.ids = Table(), np.zeros(0, dtype="<u4")
        self.size, self.uses = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray, uses: np.ndarray) -> None:
        self.known.add(hashes)
        self.ids, self.size, self.uses = np.concatenate([self.ids, ids]), np.concatenate([self.size, size]), np.concatenate([self.uses, uses])
        self.start = np.cumsum(self.size) - self.size
        self.hash = np.concatenate([self.hash, hashes]) if len(self.uses) > len(hashes) else hashes

    def _forget(self) -> None:
        """Keeps the more used pieces, at most half of ``kept``."""
        least = np.sort(self.uses)[-self.kept // 2]
        stay = np.flatnonzero(self.uses > least)
        old = self.hash[stay], runs_at(self.ids, self.start[stay], self.size[stay]), self.size[stay], self.uses[stay] // 2
        self._empty()
        self._remember(*old)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after the other, and how many each has."""
        plain = np.array([self.plain.fullmatch(p) is not None for p in pieces])
        size = np.zeros(len(pieces), dtype=np.int64)
        parts = []
        for which in (plain, ~plain):
            some = [p.decode("utf-8", "replace") for p, w in zip(pieces, which.tolist(), strict=True) if w]
            if not some:
                parts.append(np.zeros(0, dtype="<u4"))
            elif which is plain:
                ids = np.array(self.made.encode_batch_fast([self.between.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
                bounds = np.flatnonzero(self.bound[ids])
                size[which] = np.diff(bounds, append=len(ids)) if self.first else np.diff(bounds, prepend=-1)
                parts.append(ids)
            else:
                found = self.made.encode(some, is_pretokenized=True, add_special_tokens=False)
                size[which] = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(some))
                parts.append(np.array(found.ids, dtype="<u4"))
        start = np.zeros(len(pieces), dtype=np.int64)
        start[plain] = np.cumsum(size[plain]) - size[plain]
        start[~plain] = len(parts[0]) + np.cumsum(size[~plain]) - size[~plain]
        return runs_at(np.concatenate(parts), start, size), size

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        odd = lambda text: any(map(text.lower().__contains__, self.added))
        odd_ones = [i for i, t in enumerate(texts) if odd(t)] if odd(b"\n".join(texts)) else []
        whole = {i: self.made.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids for i in odd_ones}
        data, start, end, first = self.cut([b"" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        n = end - start
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[start] += 1
        inside[end] -= 1
        hashes = hash_runs(data[np.cumsum(inside[:-1], dtype=np.int8) > 0], n)
        if self.known.n > self.kept or len(self.ids) > 8 * self.kept:
            self._forget()
        at = self.known.find(hashes)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            fresh, where, which = np.unique(hashes[lacking], return_index=True, return_inverse=True)
            where, blob = lacking[where], data.tobytes()
            at[lacking] = self.known.n + which
            for i in range(0, len(fresh), 20_000):
                some = where[i : i + 20_000]
                ids, size = self._learn([blob[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
                self._remember(fresh[i : i + 20_000], ids, size, np.zeros(len(some), dtype=np.int64))
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids, n_ids = runs_at(self.ids, self.start[at], size), np.diff(ends[first])
        for i in sorted(whole, reverse=True):
            ids, n_ids[i] = np.insert(ids, ends[first[i]], np.array(whole[i], dtype="<u4")), len(whole[i])
        return ids, n_ids


def runs_at(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` values from each ``start`` on, one after the other."""
    return values[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)]


#: A plain word is of letters of basic Latin and of Latin-1, one token at least, the last marked as the end of a word.
@functools.cache
def word_encoder(path: str) -> Encoder:
    return Encoder(path, word_pieces, rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+", " ", "</w>$", first=False)


#: A plain piece has its one space in front, and no token but its first begins with that space's letter.
@functools.cache
def byte_encoder(path: str) -> Encoder:
    return Encoder(path, byte_pieces, rb" [^\x00-\x20\x7f\xc2\xe1-\xe3]+", "", "^\u0120", first=True)


def ended(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with ``end_id`` after them."""
    return np.insert(ids, np.cumsum(n), end_id), n + 1


def encode_documents(docs: DataFrame, path: str, end_id: int, encoder=word_encoder) -> DataFrame:
    """``docs`` (any columns, the last one text) with tokens (array of int) in place of text, ``end_id`` last."""
    keys = docs.columns[:-1]
    docs = docs.withColumn("text", text_of().cast("binary"))

    def run(batches):
        import pyarrow as pa

        encode = encoder(path)
        for batch in batches:
            for first, texts in slices((x.as_py() for x in batch.column(len(keys))), SLICE):
                ids, n = ended(*encode(texts), end_id)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in range(len(keys))), tokens], [*keys, "tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), "tokens array<int>"])
    return docs.mapInArrow(run, schema)


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int, stripe_mb: int = 16, stride: int = 1000) -> None:
    """ORC files of ``docs`` (doc_id, text) in ascending doc_id order, nulls first, ties by a hash of the text.

    Rows: doc_id, place (file number in the upper bits, row in the lower 33) and
    tokens, which ORC run-length encodes. Stripes of about ``stripe_mb`` MB can
    be read apart; each has a row index every ``stride`` rows and Bloom filters on doc_id.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = encode_documents(dealt.select("doc_id", F.monotonically_increasing_id().alias("place"), "text"), vocabulary_path, end_id)
    options = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_mb << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    tokens.write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, place, tokens; with ``doc_ids`` the stripes and row groups whose indexes rule them out aren't read."""
    found = spark.read.schema("doc_id long, place long, tokens array<int>").orc(path)
    return found if doc_ids is None else found.filter(F.col("doc_id").isin(doc_ids))


def token_checks(tokens: DataFrame) -> DataFrame:
    """``tokens`` (columns, the last one tokens) with n_tokens and ids_crc32 in place of tokens."""
    keys = tokens.columns[:-1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(len(keys))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], [*keys, "n_tokens", "ids_crc32"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields[:-1]), "n_tokens long, ids_crc32 long"])
    return tokens.mapInArrow(run, schema)


def file_starts(checked: DataFrame, place: Column) -> DataFrame:
    """``checked`` with start: the ids before each row in ``place`` order, from running sums in each file on top of the files' totals."""
    rows = checked.withColumn("_file", F.shiftright(place, 33))
    totals = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_file").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(totals, "_file").withColumn("start", F.col("_base") + F.col("_in")).drop("_file", "_base", "_in")


def token_file_digest(docs: DataFrame, vocabulary_path: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as token files, reads them back: doc_id, start, n_tokens, ids_crc32, one row a document.

    A null text is empty, its one token the end id; a null doc_id comes first; an empty table gives no rows.
    """
    work = WorkFolder(docs.sparkSession, "tokens")
    write_token_files(docs, f"{work.path}/orc", vocabulary_path, end_id)
    checked = work.cut(token_checks(read_token_files(docs.sparkSession, f"{work.path}/orc")), "checked")
    return file_starts(checked, F.col("place")).select("doc_id", "start", "n_tokens", "ids_crc32")
