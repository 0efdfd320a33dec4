"""Language-model scoring by a weighted backoff automaton over every n-gram of the corpus.

The model is trained on the documents whose crc32(doc_id as text) mod 10 is not 0. Words are
between white space after lower-casing A-Z, and an end closes each text.

Unigrams: P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) over every word of every training document (the
base score is their sum of logarithms). Longer n-grams, up to trigrams, are smoothed by Dirichlet
priors: P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m), h' being the context without its first word
and m the prior of the order. As an automaton: a state for each context, an arc for each n-gram that
was seen, with log P(w | h), and from each state a failure arc to that of h', with log m / (c(h) + m);
the root takes every word. A text is one left-to-right walk that carries its state and adds up the
weights of the arcs that it takes.

All n-grams count, of all words and from one occurrence on, and nothing of the model is broadcast or
gathered. Texts are tokenised once into buckets of some BUCKET_TOKENS. A bucket sends each shard of
the key space the n-grams that it needs (all it has, once each) with its own training counts; the
shard adds up the buckets' counts and answers with the totals; the bucket builds the automaton of
just its n-grams and walks its texts. An n-gram comes to its shard once from each bucket at most,
so none makes a shard hot. Buckets, shards and their messages are of bounded size; their number
grows with the corpus. Messages are sorted keys as compressed differences.

Words are known by 63-bit hashes, longer n-grams by hashes that have KEY_SLACK bits more than it takes
to number those of the corpus, so at any size about one of these in 2^20 shares its count with another.

Defined results: a null or empty text has one token, its end; a null id counts as the empty text and
is held out; repeated rows are scored (and counted) one by one; an empty training part gives N = 0
and P = 0.1 / 0.1 for any word; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import arrow_schema, bound_batches, make_batch, table

ADD = 0.1
#: Weight of the next shorter context, as so many occurrences of the context, for bigrams and trigrams (of nine pairs that with the highest held-out score on the table of 25 MB).
PRIORS = (60.0, 3.0)
#: Tokens after which a bucket is closed, and n-grams of all buckets in a shard (on average).
BUCKET_TOKENS, SHARD_KEYS = 3 << 19, 1 << 22
#: Bytes after which a long text is cut at the next white space. It keeps its context over the cut.
PIECE_BYTES = 8 << 20
WORD_BITS, KEY_SLACK = 63, 20
#: Different words that a worker counts before it hands their counts on.
COUNTED = 400_000
END = b""  # no word is empty
SEED = 42
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def pieces(text: str | None, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, and the end after the last; long texts in pieces."""
    data = (text or "").encode().lower()
    at = 0
    while len(data) - at > size:
        blank = _BLANK.search(data, at + size)
        if not blank:
            break
        yield data[at : blank.start()].split()
        at = blank.start()
    words = data[at:].split()
    words.append(END)
    yield words


def words_of(text: str | None) -> list[bytes]:
    """The words and the end."""
    return [w for piece in pieces(text) for w in piece]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


# Keys and messages


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _joined(context: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    return _mixed(context * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(order))


def key_bits(tokens: int) -> int:
    return min(63, KEY_SLACK + (2 * tokens + 1).bit_length())


def word_keys(words: list[bytes]) -> np.ndarray:
    return word_hashes(words) >> np.uint64(64 - WORD_BITS)


class Grams:
    """The n-grams at each position of a bucket's segments (pieces of texts), from the words' keys there.

    keys[k]: the keys of the n-grams of order k + 1 that end at the positions at[k].
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, bits: int) -> None:
        cut = np.uint64(64 - bits)
        place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        two = _joined(words[:-1], words[1:], 2)
        three = _joined(two[:-1], words[2:], 3)
        self.at = [np.arange(len(words)), *(np.flatnonzero(place >= k) for k in (1, 2))]
        self.keys = [words, two[self.at[1] - 1] >> cut, three[self.at[2] - 2] >> cut]


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, without the empty ones."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, : data[0]] = planes.T
    return numbers.view("<u8").ravel().astype(np.uint64)


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def shard_edges(shards: int, bits: int) -> np.ndarray:
    """Where the shards of a key space begin, but for the first."""
    return np.array([(k << bits) // shards for k in range(1, shards)], np.uint64)


def counted(keys: list[np.ndarray], idle: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how many occurrences of each are not idle."""
    flagged = np.sort(np.concatenate([x << np.uint64(1) | y for x, y in zip(keys, idle, strict=True)]))
    keys = flagged >> np.uint64(1)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    counts = np.add.reduceat((flagged & np.uint64(1)) ^ np.uint64(1), first) if len(first) else first.astype(np.uint64)
    return keys[first], counts


def corpus_size(training: DataFrame) -> tuple[int, int]:
    """N and V: the tokens of the column text, and the different ones. Two numbers are gathered.

    Words are sent by shard of their keys, of which there are as many as partitions.
    """
    schema = "shard int, n long, a binary"
    arrow = arrow_schema(schema)
    texts = training.select("text")
    edges = shard_edges(texts.rdd.getNumPartitions(), WORD_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys, order = np.unique(word_keys(list(counts)), return_index=True)
            times = np.fromiter(counts.values(), np.int64, len(counts))[order]
            counts.clear()
            at = np.searchsorted(keys, edges)
            parts = [(k, int(n.sum()), pack_sorted(x)) for k, (x, n) in enumerate(zip(np.split(keys, at), np.split(times, at), strict=True)) if len(x)]
            return make_batch(parts, arrow)

        for batch in batches:
            for text in batch.column(0):
                for piece in pieces(text.as_py()):
                    counts.update(piece)
                    if len(counts) > COUNTED:
                        yield flush()
        if counts:
            yield flush()

    def count(rows: pa.Table) -> pa.Table:
        kinds = len(np.unique(np.concatenate([unpack_sorted(x.as_py()) for x in rows["a"]])))
        return pa.table({"n": [sum(rows["n"].to_pylist())], "kinds": [kinds]})

    bound_batches(training.sparkSession)
    sizes = texts.mapInArrow(run, schema).groupBy("shard").applyInArrow(count, "n long, kinds long")
    return tuple(sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "kinds")]).first())


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Bucket:
    """Texts of one task, in segments: pieces that begin with up to two words of context (`skip`)."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # row, id, held out, length, skip
        self.tokens = 0

    def add(self, row: int, key, out: bool, context: list[bytes], piece: list[bytes]) -> None:
        words = context + piece
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.docs.append((row, key, out, len(words), len(context)))
        self.tokens += len(words)

    def messages(self, bucket: int, bits: int, shards: tuple[int, int], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Its words and its longer n-grams, a row for each of their `shards`, and the texts as word numbers, for itself."""
        ids = np.concatenate(self.ids)
        rows, names, out, lengths, skip = zip(*self.docs, strict=True)
        lengths, skip = np.array(lengths), np.array(skip)
        # Frequent words get small numbers, which pack well. Those that come once follow in order, so a mark in place of the number does.
        times = np.bincount(ids)
        order = np.argsort(-times, kind="stable")
        often = int(np.count_nonzero(times > 1))
        known = word_keys(list(self.numbers))[order]
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        ids = number[ids]
        grams = Grams(known[ids], lengths, bits)
        # Idle occurrences don't count: those held out, and those of a context, which were counted before.
        idle = np.repeat(np.array(out, np.uint64), lengths)
        for k in range(2):
            idle[(np.cumsum(lengths) - lengths + k)[skip > k]] = 1
        idle = [idle[at] for at in grams.at]
        parts = []
        for (keys, n), (some, space) in zip((counted(grams.keys[:1], idle[:1]), counted(grams.keys[1:], idle[1:])), zip(shards, (WORD_BITS, bits), strict=True), strict=True):
            edges = np.searchsorted(keys, shard_edges(some, space))
            parts += zip(np.split(keys, edges), np.split(n, edges), strict=True)
        of = pa.struct(list(arrow.field("docs").type.value_type))
        doc_arrays = [pa.array(x, f.type) for x, f in zip((rows, names, out, lengths, skip), of, strict=True)]
        docs = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.StructArray.from_arrays(doc_arrays, fields=list(of)))
        own = -1 - int(_mixed(np.array([bucket], np.uint64))[0] % np.uint64(len(parts)))
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([own], pa.int32()), pa.array([pack(known)]), pa.array([pack(np.append(np.minimum(ids, often), often))]), docs.cast(arrow.field("docs").type)], schema=arrow)
        for shard, (keys, n) in enumerate(parts):
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([shard], pa.int32()), pa.array([pack_sorted(keys)]), pa.array([pack(n)]), pa.nulls(1, arrow.field("docs").type)], schema=arrow)


def add_up(rows: pa.Table) -> pa.Table:
    """The rows of one shard: each bucket's counts are replaced by the corpus's. A bucket's own rows (shards below 0) pass."""
    if rows["shard"][0].as_py() < 0:
        return rows
    keys = [unpack_sorted(x.as_py()) for x in rows["a"]]
    counts = np.concatenate([unpack(x.as_py()) for x in rows["b"]])
    ends = np.cumsum([len(x) for x in keys])[:-1]
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.diff(keys, prepend=~keys[:1]) != 0
    del keys
    totals = np.add.reduceat(counts[order], np.flatnonzero(new))
    counts[order] = totals[np.cumsum(new) - 1]
    answers = [pack(x) for x in np.split(counts, ends)]
    return pa.table([rows["bucket"], rows["shard"], pa.array(answers, pa.binary()), pa.nulls(len(answers), pa.binary()), rows["docs"]], schema=rows.schema)


class Automaton:
    """The backoff automaton of a bucket's n-grams, which are its states and arcs by their places among the sorted keys.

    arc: the weight of the n-gram's arc from its context. seen: whether there is such an arc. back, fail:
    the weight of the failure arc of the n-gram as a state, and the state that it leads to (-1: the root).
    """

    def __init__(self, grams: Grams, places: list[np.ndarray], counts: np.ndarray, base: float, priors: tuple[float, float]) -> None:
        n = len(counts)
        self.seen = counts > 0
        self.arc, self.back = np.zeros(n), np.zeros(n)
        self.fail = np.full(n, -1, np.int32)
        p = np.zeros(n)
        for k in range(3):
            order = k + 1
            first = np.empty(n, np.int32)
            first[places[k]] = np.arange(len(places[k]))  # any position of each n-gram
            mine = np.zeros(n, bool)
            mine[places[k]] = True
            mine = np.flatnonzero(mine)
            where = first[mine]
            if order == 1:
                p[mine] = (counts[mine] + ADD) / base
            else:
                # Among the n-grams an order lower: the one that ends here, and the one that ends a word before.
                here = np.searchsorted(grams.at[k - 1], grams.at[k][where])
                shorter, context = places[k - 1][here], places[k - 1][here - 1]
                prior = priors[order - 2]
                p[mine] = (counts[mine] + prior * p[shorter]) / (counts[context] + prior)
                self.fail[mine] = shorter
            self.arc[mine] = np.log10(p[mine])
            if order < 3:
                prior = priors[order - 1]
                self.back[mine] = np.log10(prior / (counts[mine] + prior))

    def walk(self, grams: Grams, places: list[np.ndarray]) -> np.ndarray:
        """The weight of each position's step: of its arc, and of the failure arcs before it.

        Two words of context fix a state, so those of all positions are known at once; the walk goes
        through the failure arcs in step, at most two.
        """
        n = len(grams.at[0])
        state, wanted = np.full(n, -1, np.int32), np.empty(n, np.int32)
        steps = np.zeros(n)
        wanted[:] = places[0]
        for k in (1, 2):  # the longest context that there is, and the n-gram that it makes with the word
            at = grams.at[k]
            before = np.searchsorted(grams.at[k - 1], at) - 1
            state[at], wanted[at] = places[k - 1][before], places[k]
        left = np.flatnonzero((state >= 0) & ~self.seen[wanted])
        while len(left):
            steps[left] += self.back[state[left]]
            state[left], wanted[left] = self.fail[state[left]], self.fail[wanted[left]]
            left = left[(state[left] >= 0) & ~self.seen[wanted[left]]]
        return steps + self.arc[wanted]


def walk_bucket(rows: pa.Table, bits: int, base: float, priors: tuple[float, float], arrow: pa.Schema) -> pa.Table:
    """From a bucket's rows: row, id, held out, tokens, known ones, and the scores, of each segment."""
    shards = np.array(rows["shard"])
    own = int(np.argmin(shards))
    docs = rows["docs"][own].values
    lengths, skip = np.array(docs.field("length")), np.array(docs.field("skip"))
    known, ids = unpack(rows["a"][own].as_py()), unpack(rows["b"][own].as_py()).astype(np.int32)
    ids, often = ids[:-1], ids[-1]
    ids[ids == often] = np.arange(often, len(known))
    counts = np.concatenate([unpack(rows["a"][int(k)].as_py()) for k in np.argsort(shards) if k != own]).astype(np.float64)
    grams = Grams(known[ids], lengths, bits)
    words, first = np.unique(grams.keys[0], return_inverse=True)
    longer, others = np.unique(np.concatenate(grams.keys[1:]), return_inverse=True)
    if len(words) + len(longer) != len(counts):
        raise ValueError(f"{len(counts)} counts for {len(words)} words and {len(longer)} n-grams")
    places = [first.astype(np.int32), *np.split((others + len(words)).astype(np.int32), [len(grams.keys[1])])]
    del words, longer, first, others
    grams.keys.clear()
    automaton = Automaton(grams, places, counts, base, priors)
    n = len(lengths)
    segment = np.repeat(np.arange(n), lengths)
    own_words = np.ones(len(ids), bool)
    for k in range(2):
        own_words[(np.cumsum(lengths) - lengths + k)[skip > k]] = False

    def sums(values: np.ndarray) -> np.ndarray:
        return np.bincount(segment, values * own_words, n)

    scores = sums(automaton.seen[places[0]]).astype(np.int64), sums(automaton.arc[places[0]]), sums(automaton.walk(grams, places))
    columns = [docs.field("row"), docs.field("id"), docs.field("out"), pa.array(lengths - skip), *map(pa.array, scores)]
    return pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def score(docs: DataFrame, total: int, kinds: int, priors: tuple[float, float] = PRIORS, bucket_tokens: int = BUCKET_TOKENS, shard_keys: int = SHARD_KEYS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; total, kinds: N and V of the training part of docs."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"bucket long, shard int, a binary, b binary, docs array<struct<row: long, id: {kind}, out: boolean, length: long, skip: int>>"
    arrow = arrow_schema(schema)
    bits, shards = key_bits(total), (total // shard_keys + 1, 2 * total // shard_keys + 1)
    base = total + ADD * (kinds + 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        bucket, number, row = Bucket(), task, task
        for batch in batches:
            for text, key, out in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                context: list[bytes] = []
                for piece in pieces(text.as_py(), piece_bytes):
                    if bucket.tokens >= bucket_tokens:
                        yield from bucket.messages(number, bits, shards, arrow)
                        bucket, number = Bucket(), number + 1
                    bucket.add(row, key, out, context, piece)
                    context = (context + piece)[-2:]
                row += 1
        if bucket.docs:
            yield from bucket.messages(number, bits, shards, arrow)

    bound_batches(docs.sparkSession)
    walked = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    walked_arrow = arrow_schema(walked)
    sent = docs.select("text", "doc_id", held_out().alias("out")).mapInArrow(gather, schema)
    answered = sent.groupBy("shard").applyInArrow(add_up, schema)
    segments = answered.groupBy("bucket").applyInArrow(lambda rows: walk_bucket(rows, bits, base, priors, walked_arrow), walked)
    firsts = [F.first(c).alias(c) for c in ("doc_id", "held_out")]
    sums = {c: F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")}
    return segments.groupBy("row").agg(*firsts, *sums.values()).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, *corpus_size(docs.where(~held_out())))
