"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut by the tokenizer's pattern; every match (a word) is encoded by itself. The words of a
batch that are not known yet go to an in-memory DuckDB as rows (word, position, token), a token per
byte at first. A recursive query joins each token and its right neighbour to the merge table and
contracts, in every word, the leftmost pair of minimum rank, until no word has a pair left. The merge
table has every pair of tokens whose bytes together are a token, with that token's id as its rank, so
the result is that of the rank file's own encoder. Decoding joins the ids to the vocabulary and
aggregates the bytes in order; for a document's ids, a worker looks each id up in the vocabulary once.

A round of SQL merges one pair of each word, so words of over SQL_WORD bytes would need as many rounds
as bytes over as many rows; they take the same contraction, leftmost minimum first, from a heap. What a
worker remembers (in bytes), gathers and sends to DuckDB is bounded; long texts are encoded in pieces, at
word ends.

Defined results: a null or empty text has no tokens; repeated rows are encoded alike; an empty table
gives an empty table; other columns are ignored or, by `with_tokens`, kept, whatever their names, but
columns called n_tokens and tokens get an underscore.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import islice, pairwise
from sys import getsizeof

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrille.llm.common import BATCH_ROWS, arrow_schema, bound_batches, make_batch, table

SQL_WORD = 256
#: Words in a DuckDB query and in a piece of a long text, and bytes of them; words in the cache, and bytes of memory that it takes.
QUERY_WORDS, PIECE_WORDS, QUERY_BYTES = 40_000, 200_000, 4_000_000
CACHE_WORDS, CACHE_BYTES = 1_000_000, 64_000_000
#: Bytes of a word's entry in the dictionary: 24 and an index of 4, in tables that are half empty on average.
ENTRY_BYTES = 2 * (24 + 4)
#: Characters of text that are gathered before DuckDB is asked about their new words.
GATHER_CHARS = 2_000_000
DUCKDB_MEMORY = "200MB"

#: k is word << 32 | position. A word without a mergeable pair gets step -1 and takes no part in the next round.
_ENCODE = """
INSERT INTO encoded
WITH RECURSIVE steps(i, k, t) AS (
  SELECT 0, k, t FROM bytes_of_words
  UNION ALL (
    WITH near AS (
      SELECT i, k, t, lead(t) OVER place AS right_t, lead(k) OVER place AS right_k, lag(k) OVER place AS left_k
      FROM steps WHERE i >= 0 WINDOW place AS (ORDER BY k)),
    best AS (
      SELECT near.k >> 32 AS w, min((m.n::BIGINT << 32) | (near.k & 4294967295)) AS best
      FROM near JOIN merges m ON m.ab = ((near.t::BIGINT << 32) | near.right_t)
      WHERE near.right_k >> 32 = near.k >> 32 GROUP BY near.k >> 32)
    SELECT CASE WHEN best IS NULL THEN -1 ELSE i + 1 END, k, CASE WHEN k & 4294967295 = best & 4294967295 THEN (best >> 32)::INTEGER ELSE t END
    FROM near LEFT JOIN best ON near.k >> 32 = best.w
    WHERE best IS NULL OR left_k IS NULL OR left_k >> 32 <> k >> 32 OR left_k & 4294967295 <> best & 4294967295))
SELECT (k >> 32)::INTEGER, (k & 4294967295)::INTEGER, t FROM steps WHERE i < 0
"""
_TOKENS = "SELECT w, t FROM encoded ORDER BY w, p"
_DECODE = "SELECT w, string_agg(hex, '' ORDER BY p) AS hex FROM encoded JOIN vocabulary ON t = id GROUP BY w"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encodes and decodes words with a rank file; keeps a DuckDB connection, so it stays in its process."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        pairs: dict[str, list] = {"ab": [], "n": []}
        for token, n in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs["ab"].append((a << 32) | b)
                    pairs["n"].append(n)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "preserve_insertion_order": False})
        self._load("merges", pa.table({"ab": pa.array(pairs["ab"], pa.int64()), "n": pa.array(pairs["n"], pa.int32())}))
        self._load("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("loaded", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM loaded")
        self.db.unregister("loaded")

    def _encode(self, words: list[bytes]) -> None:
        """Fills the table `encoded` with the tokens of each word, by its number; the words must not be empty."""
        self.db.execute("CREATE OR REPLACE TABLE encoded (w INTEGER, p INTEGER, t INTEGER)")
        short, ready = [], []
        for w, word in enumerate(words):
            if word in self.ranks:
                ready.append((w, 0, self.ranks[word]))
            elif len(word) > SQL_WORD:
                ready += [(w, p, t) for p, t in enumerate(self.merge_long(word))]
            else:
                short.append(w)
        if ready:
            self._insert(*zip(*ready, strict=True))
        if short:
            some = [words[w] for w in short]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            k = (np.repeat(np.array(short, np.int64), lengths) << 32) + np.arange(len(starts)) - starts
            tokens = self.byte_ids[np.frombuffer(b"".join(some), np.uint8)]
            self._load("bytes_of_words", pa.table({"k": k, "t": tokens}))
            self.db.execute(_ENCODE)

    def _insert(self, w, p, t) -> None:
        self.db.register("loaded", pa.table({"w": pa.array(w, pa.int32()), "p": pa.array(p, pa.int32()), "t": pa.array(t, pa.int32())}))
        self.db.execute("INSERT INTO encoded FROM loaded")
        self.db.unregister("loaded")

    def tokens(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as packed 32-bit integers."""
        self._encode(words)
        found = self.db.sql(_TOKENS).to_arrow_table()
        ends = np.cumsum(4 * np.bincount(found.column(0).to_numpy(), minlength=len(words))).tolist()
        packed = found.column(1).to_numpy().astype(np.int32, copy=False).tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[bytes]) -> list[str]:
        """The decimal ids of each word, joined by spaces."""
        return [" ".join(map(str, unpacked(x).tolist())) for x in self.tokens(words)]

    def decode(self, sequences: list[str]) -> list[bytes]:
        """The bytes of each sequence of decimal ids joined by spaces."""
        self.db.execute("CREATE OR REPLACE TABLE encoded (w INTEGER, p INTEGER, t INTEGER)")
        rows = [(w, p, int(t)) for w, ids in enumerate(sequences) for p, t in enumerate(ids.split())]
        if rows:
            self._insert(*zip(*rows, strict=True))
        found = self.db.sql(_DECODE).to_arrow_table()
        out = [b""] * len(sequences)
        for w, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            out[w] = bytes.fromhex(x)
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """The same contraction for a word of any length, by a heap of (rank, position)."""
        n = len(word)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(at: int) -> int | None:
            return self.ranks.get(word[at : ends[ends[at]]]) if ends[at] < n else None

        heap = [(r, at, at + 2) for at in range(n - 1) if (r := rank(at)) is not None]
        heapq.heapify(heap)
        while heap:
            r, at, end = heapq.heappop(heap)
            if not alive[at] or ends[at] >= n or ends[ends[at]] != end or self.ranks.get(word[at:end]) != r:
                continue
            gone = ends[at]
            alive[gone], ends[at] = False, end
            if end < n:
                before[end] = at
            for near in (before[at], at):
                if near >= 0 and (r := rank(near)) is not None:
                    heapq.heappush(heap, (r, near, ends[ends[near]]))
        found, at = [], 0
        while at < n:
            found.append(self.ranks[word[at : ends[at]]])
            at = ends[at]
        return found


class CachedBpe:
    """A Bpe that remembers the ids of up to CACHE_WORDS words in CACHE_BYTES of memory, and the bytes of each id that came up.

    When it is full, the half that it met first stays: frequent words are met early. What the words of one
    call of `learn` take comes on top, as the caller needs them all, and so do the ids' bytes (a vocabulary at most).
    """

    def __init__(self, path: str) -> None:
        self.bpe, self.size = Bpe(path), 0
        #: A word's ids, packed; an id's bytes.
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[int, bytes] = {}
        #: By id: its decimals and a space; its bytes, null if it did not come up.
        self.decimals = pa.array([b"%d " % i for i in range(max(self.bpe.ranks.values()) + 1)], pa.large_binary())
        self.vocabulary = pa.nulls(len(self.decimals), pa.large_binary())

    def learn(self, words: set[str]) -> None:
        """Afterwards `ids` has each of the words, and `decoded` each of their ids."""
        new = words - self.ids.keys()
        if len(self.ids) + len(new) > CACHE_WORDS or self.size > CACHE_BYTES:
            self._forget()
            new = words - self.ids.keys()
        for some in _bounded(new):
            tokens = self.bpe.tokens([w.encode() for w in some])
            self.ids.update(zip(some, tokens, strict=True))
            self.size += sum(map(getsizeof, some)) + sum(map(getsizeof, tokens)) + ENTRY_BYTES * len(some)
            if unknown := list(set(unpacked(b"".join(tokens)).tolist()) - self.decoded.keys()):
                self.decoded.update(zip(unknown, self.bpe.decode(list(map(str, unknown))), strict=True))
                self.vocabulary = pa.array(map(self.decoded.get, range(len(self.decimals))), pa.large_binary())

    def _forget(self) -> None:
        kept, size = 0, 0
        for word, ids in self.ids.items():
            size += getsizeof(word) + getsizeof(ids) + ENTRY_BYTES
            if kept >= CACHE_WORDS // 2 or size > CACHE_BYTES // 2:
                break
            kept, self.size = kept + 1, size
        self.ids = dict(islice(self.ids.items(), kept))
        self.size = self.size if kept else 0

    def _lists(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The ids of texts of learnt words, one after the other; where each text starts and ends; the bytes decoded from each one's ids."""
        parts = [b"".join(map(self.ids.__getitem__, words)) for words in texts]
        ids = unpacked(b"".join(parts))
        places = np.cumsum([0, *map(len, parts)]) // 4
        return ids, places, _joined(self.vocabulary, ids, places)

    def tokens(self, texts: list[list[str]]) -> list[tuple[np.ndarray, bytes]]:
        """For each text of learnt words: its ids in order, and the bytes decoded from these ids."""
        ids, places, decoded = self._lists(texts)
        return list(zip([ids[a:b] for a, b in pairwise(places)], decoded, strict=True))

    def encode_all(self, texts: list[list[str]]) -> list[tuple[str, bytes]]:
        """The same, the ids as decimals joined by spaces."""
        ids, places, decoded = self._lists(texts)
        return [(x[:-1].decode(), d) for x, d in zip(_joined(self.decimals, ids, places), decoded, strict=True)]

    def encode(self, words: list[str]) -> tuple[str, bytes]:
        return self.encode_all([words])[0]


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.int32)


def _joined(values: pa.Array, ids: np.ndarray, places: np.ndarray) -> list[bytes]:
    """The values of the ids between each two places, in order, end to end."""
    if not len(ids):
        return [b""] * (len(places) - 1)
    _, offsets, data = values.take(pa.array(ids)).buffers()
    ends, whole = np.frombuffer(offsets, np.int64)[places].tolist(), memoryview(data)
    return [bytes(whole[a:b]) for a, b in pairwise(ends)]


def _bounded(words: set[str]) -> Iterator[list[str]]:
    """The words in lists of QUERY_WORDS, and of QUERY_BYTES and a word, at most."""
    some, size = [], 0
    for word in words:
        some.append(word)
        size += len(word)
        if len(some) >= QUERY_WORDS or size >= QUERY_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


_ENCODERS: dict[str, CachedBpe] = {}


def encoder(path: str) -> CachedBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedBpe(path)
    return _ENCODERS[path]


def pieces(text: str, pattern) -> Iterator[list[str]]:
    """The words of a text, all at once or, if it is long, in pieces of PIECE_WORDS."""
    if len(text) < GATHER_CHARS:
        yield pattern.findall(text)
        return
    matches = pattern.finditer(text)
    while piece := [m[0] for m in islice(matches, PIECE_WORDS)]:
        yield piece


def encoded(texts: Iterator[tuple[tuple, str]], path: str, pattern: str, form: Callable = CachedBpe.encode_all) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """For each (key, text): the key and an iterator of (ids, decoded bytes), a pair for each piece, as form gives it.

    Short texts are gathered, so that DuckDB gets many words at a time.
    """
    bpe, cut = encoder(path), regex.compile(pattern)

    def flush(held):
        bpe.learn(set().union(*[words for _, words in held]))
        for (key, _), part in zip(held, form(bpe, [words for _, words in held]), strict=True):
            yield key, iter([part])

    def long(text):
        for piece in pieces(text, cut):
            bpe.learn(set(piece))
            yield from form(bpe, [piece])

    held: list = []
    size = 0
    for key, text in texts:
        if len(text) >= GATHER_CHARS:
            yield from flush(held)
            held, size = [], 0
            yield key, long(text)
            continue
        held.append((key, cut.findall(text)))
        size += len(text)
        if size >= GATHER_CHARS:
            yield from flush(held)
            held, size = [], 0
    yield from flush(held)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """((the other columns), text) of each row; the text is the first column."""
    for batch in batches:
        others = [c.to_pylist() for c in batch.columns[1:]]
        for k, text in enumerate(batch.column(0)):
            yield tuple(c[k] for c in others), text.as_py() or ""


def _mapped(rows: DataFrame, schema: str | StructType, path: str, pattern: str, finish, form: Callable = CachedBpe.encode_all) -> DataFrame:
    """Rows (text, ...) through `encoded`; finish(key, pieces) gives the row that comes out."""
    arrow = arrow_schema(schema)
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for key, parts in encoded(_texts(batches), path, pattern, form):
            row, size = finish(key, parts)
            out.append(row)
            held += size
            if len(out) >= BATCH_ROWS or held >= GATHER_CHARS:
                yield make_batch(out, arrow)
                out, held = [], 0
        if out:
            yield make_batch(out, arrow)

    return rows.mapInArrow(run, schema)


def with_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs, the text first, with n_tokens (long) and tokens (array of int); the text column must be named text."""
    renamed = {c: f"{c}_" if c in ("n_tokens", "tokens") else c for c in docs.columns if c != "text"}

    def finish(key, parts):
        ids, decoded = zip((np.empty(0, np.int32), b""), *parts, strict=True)
        tokens = np.concatenate(ids)
        return (b"".join(decoded).decode(), *key, len(tokens), tokens), 4 * len(tokens)

    # The other columns as one, so that no name in it can clash.
    rows = docs.select("text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(renamed)]).alias("row"))
    schema = StructType([rows.schema["text"], rows.schema["row"], *StructType.fromDDL("n_tokens long, tokens array<int>")])
    found = _mapped(rows, schema, path, pattern, finish, CachedBpe.tokens)
    return found.select("text", *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(renamed.values())], "n_tokens", "tokens")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them."""

    def finish(key, parts):
        n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids, decoded in parts:
            if ids:
                if n:
                    ids_sha.update(b" ")
                n += ids.count(" ") + 1
                ids_sha.update(ids.encode())
                bytes_sha.update(decoded)
        return (*key, n, ids_sha.hexdigest(), bytes_sha.hexdigest()), 1

    kind = dict(docs.dtypes)["doc_id"]
    return _mapped(docs.select("text", "doc_id"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, finish)


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
