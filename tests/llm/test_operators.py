"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import license_scan, mixing, pieces, quality_classifier, quality_rules, repeats, simhash, url_filter, vector_search, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, d long, _size long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage = prose(rng, 80)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(25)]
    texts += [texts[3], texts[3], texts[4] + " tail", f"{prose(rng, 30)} {passage} {prose(rng, 30)}", f"{passage}\n{prose(rng, 9)}", f"{passage} {passage}"]
    texts += [None, "", " \n\t ", "x" * 3000, "ab" * 900, prose(rng, 3000), "one\none\n\none two", "é" * 450, "\x00\x1d a b ▁ c  d"]
    out = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, "clash", 7, 9) for i, t in enumerate(texts)]
    return out + [out[5], (None, texts[3], "fr", "s1", None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_cover(texts, length, keep_first):
    seen, cover = {}, []
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    first = set()
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if seen[w] > 1 and (not keep_first or w in first):
                hit[i : i + length] = b"\1" * length
            first.add(w)
        cover.append(hit)
    return cover


@pytest.mark.parametrize("length,bucket", [(400, 1 << 20), (60, 1 << 20), (60, 300)])
def test_repeats(docs, rows, length, bucket, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    texts = [(r[1] or "").encode() for r in rows]
    found = repeats.remove_repeats(docs, length, keep_first=False).collect()
    wanted = sorted((str(r[0]), t, bytes(b for b, h in zip(t, c) if not h), len(re.findall(b"\1+", bytes(c)))) for r, t, c in zip(rows, texts, brute_cover(texts, length, False)))
    assert sorted((str(x.doc_id), (x.text or "").encode(), bytes(x._rest), len(x._spans)) for x in found) == wanted
    assert all(x._text == "clash" and x._size == 9 for x in found if x.doc_id is not None)


@pytest.mark.parametrize("bucket", [1 << 20, 300])
def test_repeats_keep_first(spark, rows, bucket, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    ordered = sorted({r[0]: r for r in rows if r[0] is not None}.values())
    found = repeats.remove_repeats(spark.createDataFrame(ordered, SCHEMA), 60).orderBy("doc_id").collect()
    texts = [(r[1] or "").encode() for r in ordered]
    for x, t, c in zip(found, texts, brute_cover(texts, 60, True)):
        assert bytes(x._rest) == bytes(b for b, h in zip(t, c) if not h), x.doc_id


@pytest.mark.parametrize("bucket", [1 << 20, 300])
def test_repeats_keep_first_of_repeated_rows(spark, bucket, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rng = random.Random(12)
    passage = prose(rng, 60)
    one, two, three = (f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(3))
    rows = [(None, one), (None, one), (None, one), (3, two), (3, two), (4, three), (4, one)]
    distinct = [(None, one), (3, two), *sorted([(4, three), (4, one)], key=lambda r: int.from_bytes(hashlib.sha256(r[1].encode()).digest()[:8]) & (2**63 - 1))]
    texts = [t.encode() for _, t in distinct]
    rest = {r: bytes(b for b, h in zip(t, c) if not h) for r, t, c in zip(distinct, texts, brute_cover(texts, 60, True))}
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 60).collect()
    assert len(found) == len(rows) and rest[None, one] == one.encode()
    for x in found:
        assert bytes(x._rest) == rest[x.doc_id, x.text], x.doc_id


def colliding(rng):
    """Two texts of 64 ASCII characters, alike but for bytes 0 to 8 and 32 to 40, with one xxhash64 (whatever follows, by Spark's seed): a lane's second word makes up for its first."""
    p1, p2, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    step = lambda acc, w: ((((acc + w * p2) & full) << 31 | ((acc + w * p2) & full) >> 33) & full) * p1 & full
    while True:
        one = bytes(rng.randrange(97, 123) for _ in range(64))
        other = bytes(rng.randrange(97, 123) for _ in range(8))
        start = (42 + p1 + p2) & full
        a, b = step(start, int.from_bytes(one[:8], "little")), step(start, int.from_bytes(other, "little"))
        second = (int.from_bytes(one[32:40], "little") + (a - b) * pow(p2, -1, 1 << 64)) & full
        raw = second.to_bytes(8, "little")
        if all(32 < c < 127 for c in raw):
            return one.decode(), (other + one[8:32] + raw + one[40:]).decode()


@pytest.mark.parametrize("halves", [False, True])
def test_texts_whose_hashes_collide(spark, halves, monkeypatch):
    one, two = colliding(random.Random(7))
    assert one != two and spark.sql("SELECT xxhash64(:a) = xxhash64(:b)", {"a": one, "b": two}).first()[0]
    if halves:  # all texts agree in the first half of their digests
        own = repeats._halves
        monkeypatch.setattr(repeats, "_halves", lambda text: [F.lit(5).cast("long"), own(text)[1]])
    tail = prose(random.Random(8), 130)
    rows = [(None, one + tail), (None, two + tail), (-(2**63), one + tail), (None, one + tail)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 400, keep_first=False).collect()
    wanted = [bytes(b for b, h in zip(t.encode(), c) if not h) for (_, t), c in zip(rows, brute_cover([t.encode() for _, t in rows], 400, False))]
    assert sorted((str(x.doc_id), x.text, bytes(x._rest)) for x in found) == sorted((str(i), t, w) for (i, t), w in zip(rows, wanted))
    found = {(x.doc_id, x.text): bytes(x._rest) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()}
    assert sorted(len(found[None, t + tail]) for t in (one, two)) == [40, 64 + len(tail.encode())] and found[-(2**63), one + tail] == b""


def test_texts_whose_polynomial_sums_collide(spark):
    """Two texts of which no 400 bytes agree, made so that sums of powers modulo 2^64 do: nothing may go."""
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    rng = random.Random(2)
    ends = ["".join(rng.choice("qwrtzp") for _ in range(330)) for _ in range(2)]
    texts = [ends[0] + "".join("lg"[x ^ k] for x in word) + ends[1] for k in (0, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = [bytes(b for b, h in zip(t.encode(), c) if not h) for t, c in zip(texts, brute_cover([t.encode() for t in texts], 400, False))]
    for keep_first in (False, True):
        found = repeats.remove_repeats(df, 400, keep_first).orderBy("doc_id").collect()
        if not keep_first:
            assert [bytes(x._rest) for x in found] == wanted
    short = [ends[0] + "".join("lg"[x ^ k] for x in word[:256]) + ends[1] for k in (0, 1)]
    found = repeats.remove_repeats(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"), 400, False).collect()
    assert all(len(x._spans) == 0 for x in found)


def test_repeats_of_many_equal_rows(spark):
    text = prose(random.Random(3), 120)
    df = spark.createDataFrame([(None, text)] * 400 + [(1, text + " x")], "doc_id long, text string").repartition(4)
    found = repeats.remove_repeats(df, 400, keep_first=False).collect()
    assert len(found) == 401 and {len(x._rest) for x in found} == {0, 2}
    found = repeats.remove_repeats(df, 400).collect()
    assert {(x.doc_id, len(x._rest)) for x in found} == {(None, len(text.encode())), (1, 2)}


def test_passages_by_brute_force(spark):
    """Which texts hold a passage of 51 words that another place holds too."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(30)]
    for n in (49, 50, 51, 52, 70):
        passage = [word() for _ in range(n)]
        texts += [" ".join([*(word() for _ in range(9)), *passage, *(word() for _ in range(9))]), "\n".join([*passage, word()])]
    texts += [None, "", " ", "a " * 200, texts[0], prose(rng, 20_000)]
    seen = {}
    for t in texts:
        ws = (t or "").split()
        for i in range(len(ws) - 50):
            seen.setdefault(tuple(ws[i : i + 51]), []).append(1)
    wanted = [any(len(seen[tuple((t or "").split()[i : i + 51])]) > 1 for i in range(len((t or "").split()) - 50)) for t in texts]
    found = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), keep_first=False, report=51).orderBy("doc_id").collect()
    assert [len(x._passages) > 0 for x in found] == wanted


def brute_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in group}
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in found) == sorted((str(r[0]), f"{f:016x}", str(least[g])) for r, f, g in zip(rows, fps, group))


@pytest.mark.parametrize("block,agree", [(1024, None), (8, 3), (1024, 5)])
def test_simhash_links(spark, block, agree):
    rng = random.Random(1)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(s, s) for s in signed], "node long, fp long"), block=block, agree=agree).collect()}

    def parts(pairs):
        group = {s: s for s in signed}
        for a, b in pairs:
            a, b = group[a], group[b]
            group = {k: b if g == a else g for k, g in group.items()}
        out = {}
        for k, g in group.items():
            out.setdefault(g, set()).add(k)
        return sorted(map(sorted, out.values()))

    assert parts(found) == parts([(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (fps[i] ^ fps[j]).bit_count() <= 3])


def test_pieces(docs, rows):
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    found = pieces.encode(docs, keep=["doc_id", "text", "d"]).collect()
    assert len(found) == len(rows)
    for x in found:
        assert x._ids == own.encode(x.text or "")
        assert x._exact and x._decoded_sha256 == hashlib.sha256((x.text or "").replace("▁", " ").encode()).hexdigest()


def test_pieces_random():
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    codec, rng = pieces.codec(open(pieces.MODEL, "rb").read(), "bpe"), random.Random(9)
    texts = ["".join(rng.choice("aabcdeinorst  hTHE\n\téß漢😀0123.,▁") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == own.encode(text)
        assert codec.decode(ids) == text.replace("▁", " ")


def test_unigram_pieces():
    scores = {"a": (0, -2.0), "b": (1, -2.5), "ab": (2, -3.0), "ba": (3, -3.1), "aba": (4, -6.0), "abab": (5, -5.5)}
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(i % 9 + 1)) for i in range(60)})

    def best(word):
        if not word:
            return 0.0
        return max([best(word[k:]) + scores[word[:k]][1] for k in range(1, len(word) + 1) if word[:k] in scores] + [best(word[1:]) - 16.0 if word[0] == "c" else -math.inf])

    of_id = {i: (p, s) for p, (i, s) in scores.items()} | {99: ("c", -16.0)}
    flat, sizes = pieces.Pieces(scores, "unigram", None, 99).encode_sorted(words)
    ends = [0, *sizes.cumsum().tolist()]
    for word, a, b in zip(words, ends, ends[1:]):
        ids = flat[a:b].tolist()
        assert "".join(of_id[i][0] for i in ids) == word
        assert sum(of_id[i][1] for i in ids) == pytest.approx(best(word))


def test_mixing(docs, rows):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = {}
    for r, n in zip(rows, sizes):
        total[r[3]] = total.get(r[3], 0) + n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * total[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 2.0 * total[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    found = mixing.mix(docs, keep=["doc_id", "_text"]).collect()
    assert sorted((str(x.doc_id), x._size) for x in found) == sorted((str(r[0]), n) for r, n in zip(rows, sizes))
    for s in order:
        own = [x for x in found if x._source == s]
        assert all(x._target == pytest.approx(target[s]) and x._total == total[s] and 0 <= x._times <= 2 for x in own)
        assert abs(sum(x._size * x._times for x in own) - target[s]) <= max(x._size for x in own) / 2 + 1
        assert {x._times for x in own if x._size} <= {int(target[s] // total[s]), int(target[s] // total[s]) + 1}
    again = mixing.mix(docs.repartition(2), keep=["doc_id"]).collect()
    assert sorted((str(x.doc_id), x._times) for x in again) == sorted((str(x.doc_id), x._times) for x in found)


def test_quality_rules(docs, rows):
    wanted = []
    for r in rows:
        t = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted.append((str(r[0]), len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)))
    found = quality_rules.quality_rules(docs).collect()
    assert sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in found) == sorted(wanted)
    assert not any(x.kept for x in found if x.base_failed)


def test_quality_distances(docs, rows):
    """Both distances and the verdict against histograms made in Python."""
    found = quality_rules.quality_rules(docs).collect()
    classes = ["[A-Z]", "[a-z]", "[0-9]", "[#*$%&|<>]", r"""[.,;:!?'"()\-]""", r"[^\x00-\x7F]"]
    own = {}
    for i, r in enumerate(rows):
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")]
        own[i] = ([len(re.findall(c, r[1] or "")) for c in classes], [words.count(w) for w in quality_rules.COMMON_WORDS.get(r[2], [])], len(words))
    failed = {(str(x.doc_id), x.n_words): x.base_failed for x in found}
    total = {}
    for i, r in enumerate(rows):
        if not failed[str(r[0]), own[i][2]]:
            c, w, n = total.get(r[2], ([0] * 6, [0] * len(own[i][1]), 0))
            total[r[2]] = ([a + b for a, b in zip(c, own[i][0])], [a + b for a, b in zip(w, own[i][1])], n + own[i][2])

    def distance(p, q):
        part = lambda x, m: x * math.log2(x / m) if x else 0.0
        return math.sqrt(max(0.0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2))

    wanted = []
    for i, r in enumerate(rows):
        c, w, n = own[i]
        ref = total.get(r[2])
        by_class = distance([x / sum(c) for x in c], [x / sum(ref[0]) for x in ref[0]]) if n >= 50 and sum(c) and ref else None
        by_word = distance([*(x / n for x in w), 1 - sum(w) / n], [*(x / ref[2] for x in ref[1]), 1 - sum(ref[1]) / ref[2]]) if n >= 100 and r[2] and ref and r[2] in quality_rules.COMMON_WORDS else None
        kept = not failed[str(r[0]), n] and (by_class or 0) <= quality_rules.MAX_CLASS_DISTANCE and (by_word or 0) <= quality_rules.MAX_WORD_DISTANCE
        wanted.append((str(r[0]), n, kept, by_class, by_word))
    assert len(found) == len(wanted)
    key = lambda x: (x[0], x[1])
    for a, b in zip(sorted(((str(x.doc_id), x.n_words, x.kept, x.class_distance, x.word_distance) for x in found), key=key), sorted(wanted, key=key)):
        assert a[:3] == b[:3] and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-6) for x, y in zip(a[3:], b[3:])), (a, b)
    assert any(x[3] for x in wanted)


def test_license_scan(spark):
    texts = ["MIT License and the Apache\nLicense, cc by cc BY", None, "", "submit licensed", "released under the mit license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "gnu general public", "x " * 5000 + "mit license", "a mit license mit license b"]
    found = {x.doc_id: x for x in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = {(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}
        x = found[i]
        assert (x.n_words, x.n_base, x.base_labels) == (len(words), len(at), ",".join(sorted({label for _, label in at})))
        assert (x.first_word, x.last_word) == ((min(k for k, _ in at), max(k for k, _ in at)) if at else (None, None))
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert found[5].labels == "bsd" and found[6].labels == ""


def test_license_notices_may_be_wrapped():
    templates = license_scan.TEMPLATES
    join = license_scan.Templates(templates, {}, license_scan.THRESHOLD)
    for k, (_, notice) in enumerate(templates):
        ws = notice.split()
        for width in (1, 3, 6, 9):
            wrapped = "\n".join(" * " + " ".join(ws[i : i + width]) for i in range(0, len(ws), width))
            for before in (0, 7, 40, 333):
                assert join.scan("x\n" * before + wrapped + "\n\ny" * 50).get(k) == 1.0
        # Words too far from each other are no notice.
        assert k not in join.scan((" x" * 60 + "\n").join(ws))


def test_license_join_is_exact():
    rng = random.Random(2)
    templates = [(f"t{i}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))) for i in range(8)]
    join = license_scan.Templates(templates, {w.encode(): rng.randint(0, 9) for w in "abcdefgh"}, 0.8)
    for _ in range(400):
        block = [rng.choice("abcdefghxyz").encode() for _ in range(rng.randint(1, 4))]
        best: dict = {}
        join.found(block, best)
        wanted = {}
        for k, (_, t) in enumerate(templates):
            own = set(t.encode().split())
            share = len(own & set(block)) / len(own)
            if share >= 0.8 - 1e-9:
                wanted[k] = share
        assert best == pytest.approx(wanted)


def test_license_windows_are_exact():
    """Against all stretches of a text: of a template's length (the least that must be found) and of twice that (the most that may be)."""
    rng = random.Random(14)
    for _ in range(300):
        templates = [(f"t{i}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))) for i in range(5)]
        join = license_scan.Templates(templates, {w.encode(): rng.randint(0, 9) for w in "abcdefgh"}, 0.8)
        text = "".join(rng.choice("abcdefghxyz") + rng.choice("   \n") for _ in range(rng.randint(0, 60)))
        found = join.scan(text)
        ws = text.split()
        for k, (_, t) in enumerate(templates):
            own, n = set(t.split()), len(t.split())
            share = lambda size: max((len(own & set(ws[i : i + size])) / len(own) for i in range(max(1, len(ws) - size + 1))), default=0.0)  # noqa: B023, E731
            if share(n) >= 0.8 - 1e-9:
                assert found[k] >= share(n) - 1e-9
            assert found.get(k, 0.0) <= share(2 * n) + 1e-9


def test_license_notices_without_a_phrase(spark):
    """Whole notices, wrapped and with a comment's marks, of which no phrase stands in the text."""
    filler = " ".join(f"w{i}" for i in range(400))
    texts, wanted = [], []
    for label, notice in license_scan.TEMPLATES:
        ws = re.findall(r"[\w'-]+", notice)
        if len(ws) > 40 and label in ("mit", "isc", "bsd", "zlib", "unlicense", "mpl", "lgpl", "agpl"):
            texts.append(filler + "\n" + "\n".join(" # " + " ".join(ws[i : i + 11]) for i in range(0, len(ws), 11)) + "\n" + filler)
            wanted.append(label)
    found = sorted(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert len(wanted) >= 7 and all(x.n_base == 0 and x.score > 0.95 and label in x.labels.split(",") for x, label in zip(found, wanted))


def test_warc(spark):
    rows = [(1, "http://a/é x", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (4, "v", ""), (5, "w", "z" * 300_000), (6, "w", "q"), (6, "w", "q"), (None, "n", "q")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, payload string, _n int")
    root = warc.fresh_path(spark, "test")
    manifest = warc.write_archives(pages, root, shards=3, roll_bytes=200)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    found = warc.read_archives(spark, root).collect()
    assert len(found) == len(rows)
    for x in found:
        html = next(h or "" for i, _, h in rows if i == x.page_id)
        same = [i for i, _, h in rows if (h or "") == html and i is not None]
        assert x.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() and x.payload_bytes == len(html.encode())
        assert (x.record_type, x.refers_to) == (("response", None) if x.page_id == max(same) else ("revisit", max(same)))
        assert x.payload is None or bytes(x.payload) == html.encode()
    assert warc.archive(pages.limit(0)).count() == 0


def test_vector_search(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(1500)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2002, None), (2003, [0.0] * 16), (2004, [math.nan] * 16), (2005, [None] * 16), (2006, [1.0]), (2007, []), (None, [1.0] * 16)]
    found = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    good = [(i, [float(v) for v in x]) for i, x in spark.createDataFrame(rows, "vec_id long, embedding array<float>").collect() if i is not None and (i < 1500 or i in (2000, 2001))]
    hits = 0
    for q, x in [g for g in good if g[0] % 100 == 0]:
        wanted = sorted((math.dist(x, y), i) for i, y in good if i != q)[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        hits += len({i for _, i in wanted} & {r[1] for r in own})
        for _, i, s in own:
            assert s == pytest.approx(math.dist(x, dict(good)[i]), rel=1e-12)
    assert hits >= 0.95 * 10 * 16
    few = spark.createDataFrame(rows[:3] + rows[1500:1501], "vec_id long, embedding array<float>")
    assert vector_search.nearest(few).count() == 6
    assert vector_search.nearest(few.limit(0)).count() == 0


def test_vector_search_with_many_copies(spark, monkeypatch):
    """Several blocks of both sides, a vector that a third of the rows hold, a row that repeats, a vec_id with two vectors, clashing columns."""
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", (128, 512))
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 8)
    rng = random.Random(15)
    one = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, one if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(12)], 7, "w") for i in range(1800)]
    rows += [rows[5]] * 15 + [(100, [x + 0.01 for x in rows[100][1]], 7, "w")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int, w string").repartition(3)
    found = vector_search.nearest(df).collect()
    hits = wanted = 0
    for q, x, *_ in [r for r in rows if r[0] % 100 == 0]:
        best = sorted((math.dist(x, y), i) for i, y, *_ in rows if i != q)[:10]
        own = sorted((r.rank, r.score, r.vec_id) for r in found if r.query_id == q)
        if q == 100:
            assert [r[0] for r in own] == sorted([*range(1, 11)] * 2)
            continue
        assert [r[0] for r in own] == list(range(1, 11))
        left = [(round(d, 9), i) for d, i in best]
        hits += sum((round(s, 9), i) in left for _, s, i in own)
        wanted += 10
        if q % 3 == 0:  # the copies with the smallest ids, exactly
            assert [i for _, _, i in own] == [i for i in range(0, 40, 3) if i != q][:10]
    assert hits >= 0.95 * wanted


@pytest.mark.parametrize("kind", ["shifted", "log-normal norms", "heaps", "huge"])
def test_vector_search_recall(spark, kind):
    """At least nine of ten of the true neighbours, wherever the vectors lie and however long they are."""
    rng = np.random.default_rng(19)
    x = rng.normal(size=(8000, 32 if kind != "shifted" else 16))
    if kind == "shifted":
        x += 10
    elif kind == "log-normal norms":
        x *= np.exp(rng.normal(size=(len(x), 1)))
    elif kind == "heaps":
        x = rng.normal(size=(50, 32))[rng.integers(0, 50, len(x))] * 3 + x
    else:
        x *= 1e25
    found = vector_search.nearest(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")).toPandas()
    hits = 0
    for q in range(0, len(x), 100):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.argsort(far, kind="stable")[:10].tolist()) & set(found.loc[found["query_id"] == q, "vec_id"].tolist()))
    assert hits >= 0.9 * 10 * 80, hits


@pytest.mark.parametrize("kind", ["tight heaps", "uneven components", "far ones", "heavy tails", "far from zero", "too long to square", "few kinds"])
def test_vector_search_is_exact(spark, kind, monkeypatch):
    """The very lists of brute force, in several blocks, where codes of four bits tell little of nearness."""
    monkeypatch.setattr(vector_search, "CANDIDATE_BLOCK", (512, 1024))
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(23)
    x = rng.normal(size=(4000, 10))
    if kind == "tight heaps":
        x = rng.normal(size=(4, 10))[rng.integers(0, 4, len(x))] + x * 1e-4
    elif kind == "uneven components":
        x[:, 0] *= 1e4
    elif kind == "far ones":
        x[::97] *= 1e7
    elif kind == "heavy tails":
        x = rng.standard_cauchy(size=x.shape)
    elif kind == "far from zero":
        x += 1e9
    elif kind == "too long to square":
        x[::50] *= 1e200
        x[1::50] *= 1e40
        x[[3, 4], 0] = 1.7e308, -1.7e308
    else:
        x = rng.integers(0, 3, size=x.shape).astype(float)
    found = vector_search.nearest(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")).toPandas()
    used = np.flatnonzero((x != 0).any(axis=1))
    for q in [q for q in range(0, len(x), 100) if q in used]:
        with np.errstate(over="ignore"):
            far = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        order = [i for i in np.lexsort((np.arange(len(x)), far)) if i != q and i in used][:10]
        own = found[found["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == order and own["score"].tolist() == far[order].tolist(), q


def test_vector_search_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    import numpy as np

    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = vector_search.nearest(spark.createDataFrame(rows)).collect()
    hits = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        d[k] = np.inf
        hits += len({*ids[np.lexsort((ids, d))[:10]].tolist()} & {r.vec_id for r in found if r.query_id == ids[k]})
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?q", "http://a.example.com/en/8", "http://x.org/es/#f", "https://example.net/de/8", "https://example.net/de/7", "http://notexample.net?x=/de/", "ftp://a.de/fr"]
    urls += [f"http://site{i}.com/en/{i}" for i in range(60)] + [f"http://host{i}.net/de/{i}" for i in range(60)]
    found = {x.page_id: x for x in url_filter.url_filter(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("example.com", "/en/7x", "example.com/en/7"), ("a.example.com", "/en/8", "com/en/"), ("x.org", "/es/", "org/es/"),
        ("example.net", "/de/8", "example.net/de/8"), ("example.net", "/de/7", "net/de/"), ("notexample.net", "", None), ("a.de", "/fr", None)]
    assert [found[i].verdict for i in range(3, 8)] == ["allow", "block", "block", "block", "allow"] and {x.verdict for x in found.values()} == {"allow", "block"}
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_scores_by_counting(spark):
    """The model, its joins and its threshold against dictionaries."""
    rng = random.Random(21)
    urls = [f"http://{rng.choice(['shop', 'news', 'aa'])}{rng.randint(0, 9)}.{rng.choice(['com', 'net', 'org', 'de'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(0, 99)}é" for _ in range(400)]
    urls += [urls[0]] * 5 + ["HTTP://Q.com/en/", None, "", "x" * 3000]
    rows = [(None if i == 3 else i, u, 1.0, 2) for i, u in enumerate(urls)]
    found = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, score double, run long").repartition(3)).collect()
    assert len(found) == len(rows)
    lower = [(u or "").lower() for u in urls]
    hashes = dict(spark.createDataFrame([(x,) for x in set(lower)], "u string").selectExpr("u", "pmod(xxhash64(u), 5)").collect())
    ruled = {x.page_id: x.rule for x in found}
    verdict = {r: v for v, r in url_filter.RULES}
    counts = {}
    for i, u in enumerate(lower):
        own = ruled[None if i == 3 else i]
        if own and hashes[u]:
            raw = b"\0" * 4 + u.encode()
            for at in range(4, len(raw)):
                for o in range(5):
                    for key in ((verdict[own], o, raw[at - o : at]), (verdict[own], o, raw[at - o : at], raw[at])):
                        counts[key] = counts.get(key, 0) + 1

    def score(u):
        raw, total = b"\0" * 4 + u.encode(), 0.0
        for at in range(4, len(raw)):
            for sign, label in ((1, "allow"), (-1, "block")):
                p = 1 / 256
                for o in range(5):
                    context = (label, o, raw[at - o : at])
                    p = (counts.get((*context, raw[at]), 0) + 4.0 * p) / (counts.get(context, 0) + 4.0)
                total += sign * math.log(p)
        return total / max(1, len(raw) - 4)

    for x in found:
        u = (rows[3][1] if x.page_id is None else urls[x.page_id]) or ""
        assert x.score == pytest.approx(score(u.lower()), abs=1e-8)
        if x.rule:
            assert x.verdict == verdict[x.rule]
    free = [x for x in found if not x.rule]
    assert max([x.score for x in free if x.verdict == "block"], default=-9) < min([x.score for x in free if x.verdict == "allow"], default=9)


def test_quality_classifier(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60) + "." if i % 2 else " ".join("#$%" + str(rng.randint(0, 99)) for _ in range(40)), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, None), (901, "", None), (None, "x", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(900, None, 0), (901, 5, 1)], "doc_id long, quality int, toxic int")
    found = quality_classifier.quality_scores(docs, labels).collect()
    assert len(found) == 303 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found)
    for x in found:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    held = [x for x in found if x.held_out and x.doc_id < 900]
    assert sum(x.predicted == x.doc_id % 2 for x in held) >= 0.95 * len(held)
    assert quality_classifier.quality_scores(docs, labels.limit(0)).filter("score = 1").count() == 303


def test_hinge_loss_by_projected_gradient():
    """Dual coordinate descent against another solver of the same problem, dense and small."""
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    values = [rng.normal(size=len(r)) for r in rows]
    y, cost = np.where(rng.random(60) < 0.5, 1.0, -1.0), rng.uniform(0.2, 3.0, 60)
    x = np.zeros((60, 31))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, -1] = v, 1.0
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a = np.zeros(60)
    for _ in range(60_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, cost)
    w = quality_classifier.dual_coordinate_descent(rows, values, y, cost, epochs=3000)
    own = np.concatenate([w[:30], w[-1:]])
    loss = lambda w: w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w))
    assert loss(own) <= loss((a * y) @ x) * (1 + 1e-4)
    assert np.allclose(own, (a * y) @ x, atol=1e-2)


def test_empty_tables(none, docs):
    assert repeats.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert pieces.encode(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert license_scan.license_scan(none).count() == 0
    assert quality_classifier.quality_scores(none, none.select("doc_id", F.lit(1).alias("quality"))).count() == 0


def test_all_operators_take_odd_rows(docs, rows):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality_classifier.quality_scores(docs, labels, keep=["doc_id", "_text"]).count() == len(rows)
    assert license_scan.license_scan(docs).count() == len(rows)


def test_very_long_texts(spark):
    """One text of 150,000 words and 3 million characters in all, cut by no operator."""
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 12))) for _ in range(150_000)]
    text = " ".join(words) + " mit license " + "y" * 2_000_000
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "short " + " ".join(words[-80:]), "en", "s")], "doc_id long, text string, lang string, source string")
    own = {x.doc_id: x for x in license_scan.license_scan(docs).collect()}
    assert (own[1].n_words, own[1].first_word, own[1].labels) == (150_003, 150_000, "mit")
    assert {x.doc_id: x.fingerprint for x in simhash.near_duplicates(docs).collect()}[1] == f"{brute_fingerprint(text):016x}"
    found = {x.doc_id: x for x in quality_rules.quality_rules(docs).collect()}
    assert found[1].n_words == 150_003 and found[1].word_chars == sum(map(len, text.split()))
    cover = brute_cover_of_run(text, words[-80:])
    spans = {x.doc_id: [(s["from"], s["to"]) for s in x._spans] for x in repeats.remove_repeats(docs, 400, keep_first=False).select("doc_id", "_spans").collect()}
    assert spans[1][0] == cover and spans[1][-1][1] - spans[1][-1][0] >= 1_999_000
    assert sum(x._size for x in mixing.mix(docs).collect()) == 150_003 + 81
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.quality_scores(docs, labels).count() == 2


def brute_cover_of_run(text, words):
    """Where the run of words stands in the text, with the space before it that the other text has too."""
    run = " " + " ".join(words)
    return text.index(run), text.index(run) + len(run)
