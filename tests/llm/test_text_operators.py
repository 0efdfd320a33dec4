"""Quality rules, licence scans, LM scoring, media and BPE against brute force."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quadrille.llm import bpe, license_scan, lm, media, quality

ODD = [None, "", " \t\n", "one", "one two three", "a b c d a b c", "x y \x1cz", "Ünï cödé 日本語 \U0001f389", "w " * 5000, "q" * 5000, "a\x00b", "$$$ ### |"]
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark, texts, extra=True):
    rows = [(k if k != 3 else None, t, "en", "src", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long" if extra else "doc_id long, text string, lang string, source string, n_chars long")


# Quality rules


def slow_stats(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    lines, seen, dup, n_lines = text.split("\n"), [], 0, 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0d]", line):
            n_lines += 1
            dup += line in seen
            seen.append(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n_lines, len(re.findall("[A-Z]", text))


def test_text_stats_are_those_of_brute_force():
    r = random.Random(1)
    texts = [*ODD, *["".join(r.choice("ab \n|A") for _ in range(r.randint(0, 300))) for _ in range(200)]]
    for text in texts:
        assert quality.text_stats(text) == slow_stats(text)


def test_binomial_tail():
    for n, p in ((10, 0.3), (50, 0.02)):
        for k in (0, 1, 3, n):
            assert quality.binomial_at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certification_stops_at_the_first_failure():
    places, steps = np.array([[0], [1], [2]]), [(0,), (1,), (2,)]
    certified = lambda *rejected, n=1000: quality.certified(steps, np.vstack([places, [[3]]]), np.array([*rejected, n - sum(rejected)]), 0.01, 0.01)
    assert certified(0, 0, 0) == (2,)
    assert certified(0, 0, 30) == (1,)
    assert certified(0, 30, 0) == (0,)  # what follows a failure isn't tested
    assert certified(30, 0, 0) is None
    assert certified(0, 0, 0, n=20) is None  # too few labels certify nothing
    assert quality.certified(steps, np.zeros((0, 1), int), np.zeros(0, int), 0.01, 0.01) is None


def test_ninety_good_documents_certify():
    assert quality.binomial_at_most(0, 90, quality.RISK) <= quality.ERROR / len(quality.STRATA) < quality.binomial_at_most(0, 89, quality.RISK)


def test_false_rejection_is_limited():
    """Over many random holdouts, rules whose true false rejection together is above the risk are rarely certified."""
    r, wrong = random.Random(2), 0
    for _ in range(400):
        kinds = Counter((int(r.random() < 0.985), int(r.random() < 0.985)) for _ in range(600))  # either rule rejects 1.5 %, both 3 %
        places, good = np.array(list(kinds)), np.array(list(kinds.values()))
        wrong += quality.certified([(0, -1), (0, 0)], places, good, 0.02, 0.05) == (0, 0)
    assert wrong <= 20


def slow_cutoffs(rows, risk, error):
    """The certified cutoffs from documents (stratum, tunes, values, good) one by one."""
    grids, found = [grid for _, _, grid in quality.RULES], {}
    for s in quality.STRATA:
        tune, hold = ([(v, good) for t, part, v, good in rows if (t, part) == (s, side)] for side in (True, False))
        cuts, chosen = [-1] * len(grids), None
        hit = lambda v, c: any(k >= 0 and x > g[k] for x, g, k in zip(v, grids, c, strict=True))
        while True:
            best = None
            for rule, grid in enumerate(grids):
                for k in range(cuts[rule] + 1, len(grid)):
                    new = [good for v, good in tune if v[rule] > grid[k] and not hit(v, cuts)]
                    gain, lose = new.count(0), new.count(1)
                    if gain and gain >= quality.MIN_ODDS * lose:
                        if best is None or gain / (lose + 1) > best[0]:
                            best = gain / (lose + 1), rule, k
                        break
            if best is None:
                break
            cuts[best[1]] = best[2]
            if sum(good and hit(v, cuts) for v, good in tune) > risk * sum(good for _, good in tune):
                break
            n, k = sum(good for _, good in hold), sum(good and hit(v, cuts) for v, good in hold)
            if quality.binomial_at_most(k, n, risk) > error / len(quality.STRATA):
                break
            chosen = list(cuts)
        found[s] = {name: grid[c] for (name, _, grid), c in zip(quality.RULES, chosen or [], strict=False) if c >= 0}
    return found


def test_verdicts_are_those_of_brute_force(spark):
    """Cutoffs and kept over documents of several languages, with copies, defects of all kinds and good documents that have them too."""
    r, rows, labels = random.Random(4), [], []
    for k in range(3000):
        kind, lang = r.randrange(6), r.choice(["en", "en", "de", "fr", "xx", None])
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        defect = r.random() if r.random() < 0.5 else 0
        if kind == 1:
            words = [w + ("#" if r.random() < 2 * defect else "") for w in words]
        if kind == 2:
            words = [w.upper() if r.random() < defect else w for w in words]
        if kind == 3:
            words = ["\n" + " ".join(words[:6]) if r.random() < defect / 2 else w for w in words]
        text = " ".join(words)
        if kind == 5 and rows:
            text, lang = r.choice(rows)[1:3]
        rows.append((k, text, lang, "s", 0))
        if r.random() < 0.9:
            labels.append((k, int(r.random() < 0.995 if defect < 0.2 else r.random() < 0.02)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stats = quality.checkpointed(quality.stats_table(docs))
    cutoffs = quality.calibrate(stats, spark.createDataFrame(labels, "doc_id long, quality int"))

    good, texts = dict(labels), {}
    for x in stats.collect():
        if x["doc_id"] in good and x["n_words"] >= 50 and 2 * x["n_repeat_words"] <= x["n_words"]:
            values = (x["n_symbols"] / x["n_words"], x["n_dup_lines"] / x["n_lines"], x["n_repeat_words"] / x["n_words"], x["n_capitals"] / x["word_chars"])
            s = x["lang"] if x["lang"] in quality.STRATA else "other"
            texts.setdefault((x["text_hash"], s, values), []).append(good[x["doc_id"]])
    expected = slow_cutoffs([(s, h % quality.TUNE_ONE_IN == 0, v, min(g)) for (h, s, v), g in texts.items()], quality.RISK, quality.ERROR)
    assert cutoffs == expected
    assert all(expected[s] for s in ("en", "de", "fr", "other"))
    for x in stats.withColumn("rules", quality.failed_rules(cutoffs, F.col("lang"))).collect():
        s = x["lang"] if x["lang"] in quality.STRATA else "other"
        values = dict(zip(("symbols", "dup_lines", "repeats", "capitals"), (x["n_symbols"] / max(x["n_words"], 1), x["n_dup_lines"] / max(x["n_lines"], 1), x["n_repeat_words"] / max(x["n_words"], 1), x["n_capitals"] / max(x["word_chars"], 1)), strict=True))
        assert set(x["rules"]) == {name for name, c in expected[s].items() if values[name] > c}
    # Good documents that the holdout shows as rejected keep to the risk.
    for s in quality.STRATA:
        hold = [v for (h, t, v), g in texts.items() if t == s and h % quality.TUNE_ONE_IN and min(g)]
        limits = [expected[s].get(name, math.inf) for name, _, _ in quality.RULES]
        assert sum(any(x > c for x, c in zip(v, limits, strict=True)) for v in hold) <= quality.RISK * len(hold)


def test_keep_good(spark):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(4000):
        bad = k % 8 == 0
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) + ("###" if bad else "") for _ in range(60)]
        rows.append((k, " ".join(words), "en", "s", 0, "kept as it is"))
        labels.append((k, int(not bad)))
    rows += [(9001, "too short", "en", "s", 0, ""), (9002, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    found = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert found.columns == docs.columns
    assert {x["doc_id"] for x in found.collect()} == {k for k in range(4000) if k % 8}
    # Without labels only the base rule decides; empty tables stay empty.
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == 4000
    assert quality.keep_good(docs.limit(0), none).count() == 0


# Licence scans


def test_licence_scan(spark):
    texts = [
        *ODD,
        "Released under the MIT License.",
        "x CC-BY, cc by; CC BY-NC 4.0: Licensed under CC BY-NC 4.0",
        "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
        "general public license",
        "license mit",  # the words, but not the phrase
        "all rights reserved",  # the separator is a letter here, so no phrase
        "Key cc é by",
        "license " * 3000,
    ]
    got = {x["row"]: x for x in license_scan.scan(documents(spark, texts).selectExpr("row as doc_id", "text", "source as labels")).withColumnRenamed("doc_id", "row").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, text in enumerate(texts):
        words = re.findall(license_scan.WORDS, (text or "").translate(lower))
        at = [(i, label) for label, phrase in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        row = got[k]
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (len(words), len(at), ",".join(sorted({x for _, x in at})))
        assert (row["first_word"], row["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= row["score"] <= 1
    n = len(ODD)
    assert [got[n + k]["labels"] for k in range(8)] == ["mit", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0,reserved", "gpl", "", "", "", ""]
    assert license_scan.scan(documents(spark, texts).limit(0)).count() == 0


# Language model


def brute_lm(rows):
    counts = Counter()
    for key, text in rows:
        if zlib.crc32(b"" if key is None else str(key).encode()) % 10:
            counts.update(lm.words_of(text))
    n, v = sum(counts.values()), len(counts)
    return counts, n, v, lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))


class PlainModel:
    """The smoothing by its definition, from plain dictionaries."""

    def __init__(self, rows, priors):
        self.counts, _, _, self.log_p = brute_lm(rows)
        self.grams, self.priors = Counter(), priors
        for key, text in rows:
            if zlib.crc32(b"" if key is None else str(key).encode()) % 10:
                words = lm.words_of(text)
                self.grams.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))

    def p(self, gram):
        if len(gram) == 1:
            return 10 ** self.log_p(gram[0])
        prior = self.priors[len(gram) - 2]
        return (self.grams[gram] + prior * self.p(gram[1:])) / (self.grams[gram[:-1]] + prior)

    def score(self, text):
        words = lm.words_of(text)
        return sum(math.log10(self.p(tuple(words[max(0, i - 2) : i + 1]))) for i in range(len(words)))


def lm_rows(n=150):
    r = random.Random(5)
    texts = [*ODD, *[" ".join(r.choice(["A", "b", "c d", "the cat", "sat on", f"rare{r.randint(0, 400)}"]) for _ in range(r.randint(0, 60))) for _ in range(n)], *ODD]
    return [(k if k != 3 else None, t) for k, t in enumerate(texts)]


def by_id(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0]))


@pytest.mark.parametrize("sizes", [{}, {"bucket_tokens": 50, "shard_keys": 90, "piece_bytes": 40}, {"bucket_tokens": 1, "piece_bytes": 1}])
def test_lm_scores(spark, sizes):
    """n-grams seen once and twice, buckets, shards and pieces of any size: all as plain dictionaries have it."""
    rows = lm_rows() if len(sizes) != 2 else [(k, t if t is None or len(t) < 500 else t[:90]) for k, t in lm_rows(20)]
    docs = spark.createDataFrame([(*row, "clash", 0) for row in rows], "doc_id long, text string, score string, shard int")
    total, kinds = lm.corpus_size(docs.where(~lm.held_out()))
    got = by_id([tuple(x) for x in lm.score(docs, total, kinds, (6.0, 3.0), **sizes).collect()])
    c, n, v, log_p = brute_lm(rows)
    assert (total, kinds) == (n, v)
    model = PlainModel(rows, (6.0, 3.0))
    assert {1, 2} <= set(model.grams.values())
    for x, (key, text) in zip(got, by_id(rows), strict=True):
        words = lm.words_of(text)
        assert x[:5] == (key, zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0, len(words), sum(c[w] > 0 for w in words), n)
        assert x[5] == pytest.approx(sum(map(log_p, words)), abs=1e-6)
        assert x[6] == pytest.approx(model.score(text), abs=1e-6)
    held = [x for x in got if x[1]]
    if not sizes:
        assert sum(x[6] for x in held) > sum(x[5] for x in held)


def test_lm_probabilities_add_up_to_one():
    rows = [(1, "a b a c"), (2, "b a"), (3, "a b")]
    model = PlainModel(rows, (2.0, 1.0))
    for context in ((b"a",), (b"b",), (b"a", b"b"), (b"b", b"a"), (b"x", b"y")):
        known = sum(model.p((*context, w)) for w in model.counts)
        unseen = model.p((*context, b"?"))  # the one word that stands for all unseen ones
        assert known + unseen == pytest.approx(1.0)


def test_lm_of_nothing(spark):
    docs = documents(spark, ["a b"]).limit(0)
    assert lm.corpus_size(docs) == (0, 0)
    assert lm.score(docs, 0, 0).count() == 0
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    docs = spark.createDataFrame(list(zip(held, ["a b", None], strict=True)), "doc_id long, text string")
    assert [tuple(x) for x in lm.score(docs, 0, 0).orderBy("n_tokens").collect()] == [(held[1], True, 1, 0, 0, 0.0, 0.0), (held[0], True, 3, 0, 0, 0.0, 0.0)]


def test_lm_messages():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        for top in (1, 300, 1 << 62):
            x = r.integers(0, top, n).astype(np.uint64)
            assert (lm.unpack(lm.pack(x)) == x).all()
            x.sort()
            assert (lm.unpack_sorted(lm.pack_sorted(x)) == x).all()


# Media


def test_media_round_trip(spark):
    texts = [*ODD, "é" * 32, "x" * 64, "x" * 65, "tone " * 20_000]
    rows = documents(spark, texts).selectExpr("row as doc_id", "text")
    stored = {x["doc_id"]: x for x in media.store_media(rows, "doc_id", "text").collect()}
    prints = {x["doc_id"]: x["fingerprint"] for x in media.media_fingerprints(media.store_media(rows, "doc_id", "text")).collect()}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        payload = media.read_wav(bytes(stored[k]["media"]))
        assert stored[k]["n_bytes"] == len(data)
        assert payload[: len(data)] == data and not any(payload[len(data) :])
        assert len(payload) % 64 == 0 and 0 < len(payload) < len(data) + 64 + (not data)
        with wave.open(io.BytesIO(bytes(stored[k]["media"]))) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
        assert prints[k] == media.fingerprint(payload).tolist() == sorted(prints[k])


def test_fingerprint_finds_tones():
    t = np.arange(8000) / media.RATE
    tone = lambda f: np.sin(2 * np.pi * f * t)
    beat = (np.sin(2 * np.pi * 4 * t) > 0) * (tone(1000) + tone(3000))
    payload = media.pad(bytes((128 + 50 * beat).astype(np.uint8)))
    pairs = media.fingerprint(payload)
    bins = {int(p) >> 16 & 255 for p in pairs} | {int(p) >> 8 & 255 for p in pairs}
    assert {round(1000 * media.FRAME / media.RATE), round(3000 * media.FRAME / media.RATE)} <= bins


# BPE


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_is_the_library_s(spark, reference):
    r = random.Random(7)
    texts = [*ODD, *["".join(r.choice("abcdeéß  \n1,.'日") for _ in range(r.randint(0, 400))) for _ in range(60)], "<|endoftext|>", "it's we'll", "\r\n \t x", "aaaa" * 30, "ab" * 400]
    docs = documents(spark, texts).selectExpr("row as doc_id", "text", "source as tokens", "lang")
    got = {x["doc_id"]: x for x in bpe.token_digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    full = bpe.with_tokens(docs, PATH, public_tokenizers.PATTERN)
    assert full.columns == ["text", "doc_id", "tokens_", "lang", "n_tokens", "tokens"]
    tokens = {x["doc_id"]: x for x in full.collect()}
    for k, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert tokens[k]["tokens"] == ids and tokens[k]["text"] == (text or "") and tokens[k]["tokens_"] == "src"
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.token_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_words_and_long_texts(reference, monkeypatch):
    monkeypatch.setattr(bpe, "GATHER_CHARS", 50)
    monkeypatch.setattr(bpe, "PIECE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 300)
    monkeypatch.setattr(bpe, "QUERY_BYTES", 20)
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("thers ing") for _ in range(r.randint(1, 90))) for _ in range(r.randint(0, 20))) for _ in range(30)]
    for (key,), parts in bpe.encoded((((k,), t) for k, t in enumerate(texts)), PATH, public_tokenizers.PATTERN):
        parts = list(parts)
        assert " ".join(i for i, _ in parts if i) == " ".join(map(str, reference.encode_ordinary(texts[key])))
        assert b"".join(d for _, d in parts) == texts[key].encode()


def test_both_ways_of_merging_agree(reference):
    own, r = bpe.Bpe(PATH), random.Random(9)
    words = [bytes(r.choice(b"etaoinshr \xc3\xa9") for _ in range(r.randint(1, 60))) for _ in range(300)] + [bytes(r.choice(b"etaoinshr") for _ in range(n)) for n in (255, bpe.SQL_WORD)]
    ids = own.encode_words(words)
    assert ids == [" ".join(map(str, own.merge_long(w))) for w in words] == [" ".join(map(str, reference._encode_single_piece(w))) for w in words]
    assert own.decode(ids) == words
