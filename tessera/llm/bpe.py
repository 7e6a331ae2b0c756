"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, materialize, parts, quoted, sized, table

#: The packed word table goes to the workers up to so many bytes, its most spread words first; the others are joined.
PACKED_BYTES = 128 << 20
FLUSH_BYTES, MEMO_WORDS, BATCH_ROWS = 24 << 20, 100_000, 1000
_loaded: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """One tokenizer for each Python worker, without threads, truncation and padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _small_batches(spark: SparkSession) -> None:
    """Rows of whole texts and their ids are large: ten thousand of them, the default, would be a batch of 100 MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


_TABLE = "words binary, h binary, check binary, n binary, ids binary, spread binary, n_words long, n_ids long"


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word's hash to find it by, and 32 more to check that it is the word."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
    return h[:, 0].astype(np.uint64), (h[:, 1] >> np.uint64(32)).astype(np.uint32)


def word_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The distinct words (runs of characters other than ASCII white space) of all texts, each encoded once.

    A row holds those of one bucket of hashes, packed: the words joined by spaces, their hashes (64 and 32 bits), how many ids each
    has (uint32), the ids (uint32), and in how many parts of the corpus each was found (uint32). Null texts have none. White space never reaches an id under a vocabulary whose
    pre-tokenizer drops it, so the ids of a text are those of its words, one after the other; special tokens inside a
    word are found as the library finds them.
    """
    buckets = 4 * parts(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held = 0

        def out():
            words = list(seen)
            where = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(where, kind="stable")
            values, starts = np.unique(where[order], return_index=True)
            blobs = [b" ".join([words[i] for i in part]) for part in np.split(order, starts[1:])] if words else []
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(blobs, pa.binary())], ["bucket", "words"])

        for batch in batches:
            for t in _column(batch, "t"):
                before = len(seen)
                seen.update((t or b"").split())
                held += 80 * (len(seen) - before)
                if held > FLUSH_BYTES:
                    yield from out()
                    seen, held = set(), 0
        yield from out()

    def encode(bucket: pa.Table) -> pa.Table:
        t, seen = tokenizer(path), Counter()
        for blob in bucket.column("words").to_pylist():
            seen.update(blob.split(b" "))
        words, n, ids = sorted(seen), [], []
        for i in range(0, len(words), 2000):
            for e in t.encode_batch_fast([w.decode() for w in words[i : i + 2000]], add_special_tokens=False):
                n.append(len(e.ids))
                ids += e.ids
        h, check = _hashes(words)
        spread = np.fromiter(map(seen.__getitem__, words), np.uint32, len(words))
        blobs = [b" ".join(words), h.tobytes(), check.tobytes(), np.array(n, np.uint32).tobytes(), np.array(ids, np.uint32).tobytes(), spread.tobytes()]
        return pa.table({**{c: pa.array([x], pa.binary()) for c, x in zip(("words", "h", "check", "n", "ids", "spread"), blobs, strict=True)}, "n_words": pa.array([len(words)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})

    found = docs.select(F.col(quoted(text)).alias("t")).mapInArrow(split, "bucket long, words binary")
    return found.groupBy("bucket").applyInArrow(encode, _TABLE)


def _rare(words: DataFrame, spread: int) -> DataFrame:
    """(word binary, ids array<int>) of the words of a table that fewer than `spread` parts have, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, n, ids, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(n, np.uint32))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, np.uint32).astype(np.int32)))
                rare = pa.array(np.frombuffer(found, np.uint32) < spread)
                yield pa.RecordBatch.from_arrays([pa.array(blob.split(b" "), pa.binary()).filter(rare), lists.filter(rare)], ["word", "ids"])

    return words.select("words", "n", "ids", "spread").mapInArrow(run, "word binary, ids array<int>")


def _common(words: DataFrame, spread: int) -> DataFrame:
    """(h, check, n, ids) of the words of a table that at least `spread` parts have, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                h, check, n, ids, found = (np.frombuffer(b.column(i)[k].as_py(), t) for i, t in enumerate((np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)))
                common = found >= spread
                out = (h[common], check[common], n[common], ids[np.repeat(common, n)])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], ["h", "check", "n", "ids"])

    return words.select("h", "check", "n", "ids", "spread").mapInArrow(run, "h binary, check binary, n binary, ids binary")


def _spread(words: DataFrame, most: int) -> tuple[int, int, int]:
    """(spread, words, ids): the least spread from which on the words of a table pack into `most` bytes, and how many
    words and ids those are. A row for each spread comes here, of which there are no more than parts of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, found in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                values, group = np.unique(np.frombuffer(found, np.uint32), return_inverse=True)
                sums = (values, np.bincount(group), np.bincount(group, np.frombuffer(n, np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in sums], ["spread", "n_words", "n_ids"])

    rows = words.select("n", "spread").mapInArrow(run, "spread long, n_words long, n_ids long").groupBy("spread").agg(F.sum("n_words"), F.sum("n_ids")).collect()
    least, n_words, n_ids = max((r[0] for r in rows), default=0) + 1, 0, 0
    for spread, more, more_ids in sorted(rows, reverse=True):
        if WORD_BYTES * (n_words + more) + 2 * (n_ids + more_ids) > most:
            break
        least, n_words, n_ids = spread, n_words + more, n_ids + more_ids
    return least, n_words, n_ids


#: What a word takes in the packed table, beside its ids.
WORD_BYTES = 20


class _Packed:
    """The word table as arrays: hashes in order; the ids of word i are n[i] ids from start[i] on. Word -1 has none."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray):
        self.hashes, self.checks, self.start, self.n, self.ids = hashes, checks, np.append(start, start.dtype.type(0)), np.append(n, n.dtype.type(0)), ids

    def places(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; -1 for those that aren't there."""
        h, check = _hashes(words)
        if not len(self.hashes):
            return np.full(len(h), -1)
        at, last = np.searchsorted(self.hashes, h), len(self.hashes) - 1
        out = np.full(len(h), -1)
        for step in (0, 1):  # two words of one hash stand side by side
            i = np.minimum(at + step, last)
            out = np.where((out < 0) & (self.hashes[i] == h) & (self.checks[i] == check), i, out)
        return out


def _pack(words: DataFrame, n_words: int, n_ids: int) -> _Packed:
    """The table in the driver, bucket by bucket into arrays of known size."""
    hashes, checks, n, ids = np.empty(n_words, np.uint64), np.empty(n_words, np.uint32), np.empty(n_words, np.uint32), np.empty(n_ids, np.uint16)
    i = j = 0
    for r in words.select("h", "check", "n", "ids").toLocalIterator():
        h, m, x = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.uint32), np.frombuffer(r["ids"], np.uint32)
        if ids.dtype == np.uint16 and x.max(initial=0) >= 1 << 16:
            ids = ids.astype(np.uint32)
        hashes[i : i + len(h)], checks[i : i + len(h)], n[i : i + len(h)], ids[j : j + len(x)] = h, np.frombuffer(r["check"], np.uint32), m, x
        i, j = i + len(h), j + len(x)
    start = (np.cumsum(n, dtype=np.uint64) - n).astype(np.uint32)
    order = np.argsort(hashes).astype(np.uint32)
    return _Packed(hashes[order], checks[order], start[order], (n.astype(np.uint16) if n.max(initial=0) < 1 << 16 else n)[order], ids)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without null lists."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _ragged(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[start[i]:start[i] + n[i]] for each i, one after the other."""
    total = int(n.sum())
    if not total:
        return values[:0]
    at = np.repeat(start - (np.cumsum(n) - n), n)
    return values[at + np.arange(total)]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", packed_bytes: int = PACKED_BYTES) -> DataFrame:
    """docs with the column `ids`: what the library's encode(text, add_special_tokens=False) gives for the whole text.

    Null and empty texts have no ids; repeated rows stay repeated; other columns pass through untouched (a column named
    like `ids` is replaced). The word table is written to the shared folder and measured: up to `packed_bytes` every
    worker holds it as flat arrays and looks words up by 64-bit hash; of a larger one it holds the words that most parts
    of the corpus have, and the others are joined: each once for a text that has it, by a shuffle, never by position.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    _small_batches(spark)
    words = materialize(word_table(docs, path, text))
    n_words, n_ids = words.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    docs = docs.drop(ids)
    fields = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    own = None
    if WORD_BYTES * n_words + 2 * n_ids <= packed_bytes:
        shared = spark.sparkContext.broadcast(_pack(words, n_words, n_ids))
    else:
        spread, n_words, n_ids = _spread(words, packed_bytes)
        shared = spark.sparkContext.broadcast(_pack(_common(words, spread), n_words, n_ids))
        key, own = free_names(docs, "key", "own")
        # 128 bits of SHA-256 tell texts apart.
        sha = F.unhex(F.substring(F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")), 256), 1, 32))
        at = _unknown(docs.select(sha.alias("key"), F.col(quoted(text)).alias("text")), shared)
        got = at.join(_rare(words, spread), "word").groupBy("key").agg(F.collect_set(F.struct("word", "ids")).alias(own))
        got = materialize(got.withColumnRenamed("key", key))
        docs = docs.withColumn(key, sha).join(sized(got), key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, memo = shared.value, {}
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts = [(t or b"").split() for t in _column(batch, text)]
                flat = [w for words in texts for w in words]
                new = list(set(flat).difference(memo))
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    new = list(set(flat))
                memo.update(zip(new, p.places(new).tolist(), strict=True))
                per = np.fromiter(map(len, texts), np.int64, len(texts))
                rows = np.fromiter(map(memo.__getitem__, flat), np.int64, len(flat))
                n = p.n[rows].astype(np.int64)
                values = _ragged(p.ids, p.start[rows].astype(np.int64), n).astype(np.int32)
                if own:
                    joined = {x["word"]: x["ids"] for pairs in batch.column(batch.schema.get_field_index(own)).to_pylist() for x in pairs or ()}
                    n, values = _filled(rows, n, values, [joined[flat[i]] for i in np.flatnonzero(rows < 0).tolist()])
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per)])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                kept = [c for c in batch.schema.names if c != own]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), lists], [*kept, ids])

    return docs.mapInArrow(run, fields)


def _unknown(texts: DataFrame, shared) -> DataFrame:
    """(key, word): the distinct words of each text (key, text) that the packed table does not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, memo = shared.value, {}
        for b in batches:
            keys, found = [], []
            for key, t in zip(_column(b, "key"), _column(b, "text"), strict=True):
                mine = set((t or b"").split())
                new = list(mine.difference(memo))
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    new = list(mine)
                memo.update(zip(new, p.places(new).tolist(), strict=True))
                mine = [w for w in mine if memo[w] < 0]
                keys += [key] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "word"])

    return texts.mapInArrow(run, "key binary, word binary")


def _filled(rows: np.ndarray, n: np.ndarray, values: np.ndarray, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """n and values with the lists in the places where rows are -1."""
    n, gap = n.copy(), rows < 0
    n[gap] = np.fromiter(map(len, lists), np.int64, len(lists))
    gap = np.repeat(gap, n)
    out = np.empty(len(gap), np.int32)
    out[~gap] = values
    out[gap] = np.fromiter((i for x in lists for i in x), np.int32, int(gap.sum()))
    return n, out


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the column `text`: what the library's decode(ids, skip_special_tokens=False) gives; null ids: empty.

    Each id meets its piece by its place in the table of pieces, one row of the plan whose size the vocabulary bounds. A
    vocabulary without a decoder has its pieces joined by spaces, as the library does; with one, the library's own
    decoder runs on the ids. A column named like `text` is replaced, others pass through.
    """
    path = path or vocabulary_path()
    t = tokenizer(path)
    docs = docs.drop(text)
    if t.decoder is None:
        pieces = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
        cut = next(c for c in map(chr, range(1, 32)) if not any(c in p for p in pieces))
        table_of = F.split(F.lit(cut.join(pieces)), cut)  # folded to one array when the plan is made
        said = F.array_join(F.transform(F.col(quoted(ids)), lambda i: F.get(table_of, i)), " ")
        return docs.withColumn(text, F.coalesce(said, F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                values, at = _flat(batch.column(batch.schema.get_field_index(ids)).fill_null([]))
                said = [t.decode(values[i:j].tolist(), skip_special_tokens=False) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], [*batch.schema.names, text])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())]))


def ids_digest(docs: DataFrame, ids: str = "ids", out: str = "ids_sha256") -> DataFrame:
    """docs without `ids`, with the hex SHA-256 of the decimal ids joined by one space, and n_tokens."""
    have = F.coalesce(F.col(quoted(ids)), F.array().cast("array<int>"))
    done = docs.withColumns({"n_tokens": F.size(have).cast("long"), out: F.sha2(F.array_join(have.cast("array<string>"), " "), 256)})
    return done.drop(ids)


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs).select("doc_id", "ids"))
    done = ids_digest(done.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256")))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
