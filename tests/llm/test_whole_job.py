"""Inputs on which an operator once did less than its whole job."""

import math
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quadrille.llm import bpe, chat, license_scan, lm, media, quality

# Language model


def lm_scores(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total, kinds = lm.corpus_size(docs.where(~lm.held_out()))
    return {x["doc_id"]: x for x in lm.score(docs, total, kinds, (6.0, 3.0), **sizes).collect()}


def trained_ids(spark, n):
    return [x[0] for x in spark.range(10 * n).select(F.col("id").alias("doc_id")).where(~lm.held_out()).limit(n).collect()]


@pytest.mark.parametrize("texts", [[None, "", " "] * 20, ["one short document"], ["a b c"] * 2])
def test_lm_of_few_ngrams(spark, texts):
    got = lm_scores(spark, list(zip(trained_ids(spark, len(texts)), texts, strict=True)))
    assert len(got) == len(texts)
    assert all(math.isfinite(x["score"]) and x["n_known"] == x["n_tokens"] for x in got.values())


@pytest.mark.parametrize("copies", [1, 2])
def test_lm_keeps_every_rare_ngram(spark, copies):
    """210,000 bigrams and as many trigrams that occur once or twice, all counted."""
    n = 210_000
    got = lm_scores(spark, [(k, " ".join(f"w{k}" for k in range(n))) for k in trained_ids(spark, copies)], shard_keys=100_000)
    total = copies * (n + 1)
    one = (copies + 0.1) / (total + 0.1 * (n + 2))
    two = (copies + 6 * one) / (copies + 6)
    three = (copies + 3 * two) / (copies + 3)
    for x in got.values():
        assert x["n_known"] == x["n_tokens"] == n + 1
        assert x["score"] == pytest.approx(math.log10(one) + math.log10(two) + (n - 1) * math.log10(three), rel=1e-6)


def test_lm_tells_documents_that_occur_twice(spark):
    """A model of the whole corpus scores the words of a text that it saw twice above those of one that it saw once."""
    r = random.Random(6)
    texts = [" ".join(f"w{r.randint(0, 500)}" for _ in range(60)) for _ in range(300)]
    ids = trained_ids(spark, 320)
    got = lm_scores(spark, list(zip(ids, texts + texts[:20], strict=True)))
    mean = [got[k]["score"] / got[k]["n_tokens"] for k in ids[:300]]
    assert min(mean[:20]) > max(mean[20:])


# Licence scans


PLAIN = [(k, "licensed license gnu general public apache mit cc software warranty plain words") for k in range(100, 140)]


def labels_of(spark, texts):
    rows = [*enumerate(texts), *PLAIN]
    got = {x["doc_id"]: set(x["labels"].split(",")) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[k] - {""} for k, _ in PLAIN)
    return [got[k] for k in range(len(texts))]


def test_all_licences_of_one_text_are_found(spark):
    """Words of the longest templates don't push out those of the others."""
    long = [license_scan.MIT, license_scan.BSD, license_scan.ISC, license_scan.UNLICENSE, license_scan.ZLIB]
    short = ["licensed under the gnu general public license version 3", "released under the mit license", "licensed under cc by 4 0", "licensed under the apache license version 2 0"]
    (got,) = labels_of(spark, [" . ".join([*long, *short])])
    assert got >= {"mit", "bsd", "isc", "gpl", "gpl-3.0", "cc-by", "cc-by-4.0", "apache-2.0", "unlicense", "zlib"}


WHOLE = {"mit": license_scan.MIT, "bsd": license_scan.BSD, "isc": license_scan.ISC, "apache-2.0": license_scan.APACHE, "gpl-3.0": license_scan.GPL.format(3), "unlicense": license_scan.UNLICENSE, "zlib": license_scan.ZLIB}


def test_licences_with_words_put_in_and_left_out(spark):
    """Words inserted or missing between the key phrases, several at a time; without a key phrase nothing is found."""
    r, texts, expected = random.Random(11), [], []
    for label, text in WHOLE.items():
        phrases = [set(range(k, k + len(p.split()))) for l, t, ps in license_scan.TEMPLATES if l == label and len(t) > 200 for p in ps for k in range(len(license_scan.template_words(text))) if license_scan.template_words(text)[k : k + len(p.split())] == p.split()]
        free = sorted(set(range(8, len(license_scan.template_words(text)) - 3)) - set().union(*phrases))
        for inserted, missing in ((1, 0), (0, 1), (1, 1), (4, 3)):
            words = license_scan.template_words(text)
            for k in r.sample(free, missing):
                words[k] = ""
            for k in sorted(r.sample(free, inserted), reverse=True):
                if not any({k - 1, k} <= p for p in phrases):
                    words.insert(k, "really")
            texts.append("x " * r.randint(0, 30) + " ".join(w for w in words if w))
            expected.append(label)
    texts.append(" ".join(w for w in license_scan.MIT.split() if w not in ("hereby", "substantial")))
    got = labels_of(spark, texts)
    assert all(label in found for label, found in zip(expected, got, strict=False))
    assert "mit" not in got[-1]


# Media


def test_fingerprint_covers_the_last_samples():
    r = np.random.default_rng(1)
    for size in (256, 320, 384, 448, 5 * 64 + 128 * 9):
        payload = r.integers(0, 256, size).astype(np.uint8)
        other = payload.copy()
        other[-64:] = r.integers(0, 256, 64)
        assert not np.array_equal(media.band_peaks(payload.tobytes())[1], media.band_peaks(other.tobytes())[1])


# Quality rules


def test_a_rule_with_a_rare_gain_of_its_own_is_proposed():
    places = np.array([[0, 1], [1, 0], [1, 1]])
    assert quality.proposed(places, np.array([0, 0, 500]), np.array([991, 1, 0]), [1, 1], 0.05) == [(0, -1), (0, 0)]


def test_copies_count_once(spark):
    """A good text that many documents share doesn't certify anything."""
    stats = spark.createDataFrame([(k, "en", 7 if k < 1000 else k, *(60 if f in ("n_words", "word_chars") else 0 if k < 1000 or f == "n_repeat_words" else 200 for f in quality.FIELDS)) for k in range(1100)], f"doc_id long, lang string, text_hash long, {quality.STATS_DDL}")
    labels = spark.createDataFrame([(k, int(k < 1000)) for k in range(1100)], "doc_id long, quality int")
    assert not any(quality.calibrate(stats, labels).values())
    assert any(quality.calibrate(stats.withColumn("text_hash", F.col("doc_id")), labels).values())


# Chat


def test_whole_examples_have_all_turns_before(spark):
    turns = [(c, k, "assistant" if k % 3 == 2 else "user", f"turn {k} " * 40) for c in (1, 2) for k in range(20)] + [(3, 0, "user", "only this")]
    examples = chat.prefix_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 700)
    assert examples.where("parent is not null").count()
    rows = chat.whole_examples(examples).collect()
    replies = {}
    for x in rows:
        mine = [(role, text) for c, _, role, text in turns if c == x["conv_id"]]
        said = chat.parse_turns(x["text"])
        assert said == mine[: len(said)]
        if x["loss_start"] is not None:
            assert chat.unescape(x["text"][x["loss_start"] : x["loss_end"]]) == said[-1][1]
            replies.setdefault(x["conv_id"], []).append(len(said))
    assert replies == {c: [k + 1 for k in range(20) if k % 3 == 2] for c in (1, 2)}


# Byte pairs


def test_bpe_cache_is_bounded_in_memory(monkeypatch):
    """The bound holds for the objects that the cache keeps, not just for what their strings say; what goes is encoded anew."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1_000_000)
    cache, step = bpe.CachedBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), 500
    rounds = [[f" w{k}x" for k in range(n, n + step)] for n in range(0, 8_000, step)]
    first = None
    for words in [*rounds, rounds[0], rounds[8]]:
        cache.learn(set(words))
        ids, decoded = cache.encode(words)
        assert decoded.decode() == "".join(words)
        if words == rounds[8]:
            first = first or ids
            assert ids == first
        held = sum(map(sys.getsizeof, [*cache.ids, *cache.ids.values(), *cache.decoded.values(), cache.ids, cache.decoded]))
        assert held <= bpe.CACHE_BYTES + 400 * step


def test_bpe_cache_has_room_for_what_it_encodes(monkeypatch):
    """A word takes little more than itself and its ids, so that few words are dropped and encoded anew."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1_000_000)
    cache, asked = bpe.CachedBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), []
    encode = bpe.Bpe._encode
    monkeypatch.setattr(bpe.Bpe, "_encode", lambda self, words: (asked.extend(words), encode(self, words))[1])
    rounds = [[f" w{k}x" for k in range(n, n + 500)] for n in range(0, 5_000, 500)]
    for words in [*rounds, *rounds]:
        cache.learn(set(words))
        assert cache.encode(words)[1] == "".join(words).encode()
    assert len(asked) == 5_000


def test_bpe_of_a_long_text_without_words(spark):
    docs = spark.createDataFrame([(1, " " * bpe.GATHER_CHARS), (2, "a"), (3, None)], "doc_id long, text string")
    got = {x["doc_id"]: (x["text"], x["n_tokens"], len(x["tokens"])) for x in bpe.with_tokens(docs.select("text", "doc_id"), public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\S+").collect()}
    assert got == {1: ("", 0, 0), 2: ("a", 1, 1), 3: ("", 0, 0)}


def test_bpe_of_empty_partitions(spark):
    docs = spark.createDataFrame([("a b", 1)], "text string, doc_id long").repartition(4)
    assert [tuple(x)[:3] for x in bpe.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()] == [("a b", 1, 2)]
    assert bpe.CachedBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")).tokens([]) == []
