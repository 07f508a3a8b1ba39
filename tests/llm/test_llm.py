"""The training-data operators against brute force, round trips and hand-made edge cases."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import chat, decontam, html, jaccard, mixing, quality, sharding, substring, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))


def edge_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \n\t ", "en", None, 3),
        (4, LONG, "en", "b", len(LONG)),
        (5, "one two three", "en", "b", 13),
        (5, "one two three", "en", "b", 13),
        (5, "another text under the same id, with some words more than that", "en", "b", 60),
        (None, "one two three", "en", "c", 13),
        (None, None, None, None, None),
        (9, LONG, "de", "a", 1),
    ]
    extra = ["size", "copies", "shard", "slot", "target", "source_size", "text_crc32"]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in extra})


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 token counts ----


def test_token_counts_match_the_tokenizer(spark):
    df = edge_docs(spark).select("doc_id", "text")
    with open(tokens.RANKS, "rb") as f:
        encode = tokens.encoder(f.read()).encode_ordinary
    want = collections.Counter((r["doc_id"], len(encode(r["text"] or ""))) for r in df.collect())
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(df).collect())
    assert got == want
    assert tokens.count_tokens(empty_docs(spark)).count() == 0


def test_token_counts_of_string_ids(spark):
    df = spark.createDataFrame([("a", "one two"), (None, ""), ("b", None)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    assert got["a"] > 0 and got[None] == got["b"] == 0


@pytest.mark.parametrize("block", [2, 6, 10, 64, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    files = {}
    for name, ends in (("a.bin", True), ("b.bin", False), ("c.bin", True), ("empty.bin", True)):
        lens = [] if name.startswith("empty") else [rng.choice([0, 0, 1, 3, 40]) for _ in range(25)]
        ids = [x for n in lens for x in [*[7] * n, 9]]
        files[name] = (lens, ids if ends else [*ids, 7, 7])
        (tmp_path / name).write_bytes(np.array(files[name][1], "<u2").tobytes())
    path = f"file://{tmp_path}"
    named = spark.createDataFrame([(n,) for n in files], "file string")
    got = tokens.scan_token_files(tokens.list_blocks(spark, path, named, block), path, eod=9).collect()
    for name, (lens, ids) in files.items():
        rows = sorted((r["ordinal"], r["n_tokens"], r["terminated"], r["start"]) for r in got if r["file"] == name)
        want = [(i, n, True) for i, n in enumerate(lens)] + ([(len(lens), 2, False)] if name == "b.bin" else [])
        assert [r[:3] for r in rows] == want
        assert all(9 not in ids[r[3] : r[3] + r[1]] for r in rows)


# ---- 2 substring dedup ----


def brute_repeats(rows, size=substring.PASSAGE):
    """doc -> word places that lie in a repeat of an earlier window and beyond that window."""
    first, gone = {}, collections.defaultdict(set)
    for doc, text in sorted(rows):
        words = tuple((text or "").lower().split())
        for i in range(len(words) - size + 1):
            d, j = first.setdefault(words[i : i + size], (doc, i))
            if (d, j) != (doc, i):
                gone[doc] |= set(range(max(i, j + size) if d == doc else i, i + size))
    return {d: p for d, p in gone.items() if p}


def check_passages(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring.repeated_passages(df)
    got = collections.defaultdict(set)
    for r in spans.where("not stays").collect():
        got[r["doc_id"]] |= set(range(r["start"], r["stop"]))
    want = brute_repeats(rows)
    assert dict(got) == want
    places = collections.defaultdict(list)
    for doc, text in rows:
        words = (text or "").lower().split()
        for i in range(len(words) - substring.PASSAGE + 1):
            places[tuple(words[i : i + substring.PASSAGE])].append((doc, i))
    again = collections.defaultdict(set)
    for found in places.values():
        for doc, i in found if len(found) > 1 else []:
            again[doc] |= set(range(i, i + substring.PASSAGE))
    clean = {r["doc_id"]: r for r in substring.remove_passages(df, spans).collect()}
    assert len(clean) == len(rows)
    for doc, text in rows:
        r = clean[doc]
        left = [w for i, w in enumerate((text or "").split()) if i not in want.get(doc, ())]
        assert (r["text"] or "").split() == left
        assert (r["text"] is None) == (text is None)
        assert sum(len(text[x["start"] : x["stop"]].split()) for x in r["_cut"]["removed"]) == len(want.get(doc, ())) == r["_cut"]["n_removed"]
        assert (r["_cut"]["n_repeated"], r["_cut"]["n_words"]) == (len(again.get(doc, ())), len((text or "").split()))
    return want


def test_passages_inside_longer_lines(spark):
    w = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    p, rng = w("Pass", 51), random.Random(2)
    rows = [(1, f"{w('a', 70)} {p} {w('b', 9)}"), (2, f"{w('c', 33)} {p.upper()} {w('d', 80)}"), (3, f"{w('e', 5)} {w('Pass', 50)} {w('f', 60)}"), (4, None), (5, ""), (6, p), (7, "la " * 200), (8, " ".join([w("o", 53)] * 4)), (9, " ".join([w("p", 20)] * 9))]
    rows += [(10 + k, " ".join(rng.choice("xyz") for _ in range(90)) + " " + w("a", 70)[rng.randrange(20) :]) for k in range(4)]
    base = [f"t{rng.randrange(9)}" for _ in range(400)]
    for k in range(12):  # edited copies, windows of all kinds
        a, b = sorted(rng.sample(range(400), 2))
        rows.append((20 + k, " ".join([*base[a:b], f"q{k}", *base[rng.randrange(400) :]])))
    want = check_passages(spark, rows)
    assert want[2] == set(range(33, 84)) and 3 not in want and want[6] == set(range(51)) and len(want[7]) == 149


def test_passages_of_short_lines(spark):
    verse = [f"v{i} of nine" for i in range(20)]
    rows = [(1, "one head\n" + "\n".join(verse)), (2, "\n\n".join(verse) + "\nan end of its own"), (3, "\n".join(verse[:16]) + "\nx"), (4, "\n".join(verse[3:]).replace(" ", "\n"))]
    want = check_passages(spark, rows)
    assert want == {2: set(range(60)), 4: set(range(51))}


def test_passages_edges(spark):
    df = edge_docs(spark)
    spans = substring.repeated_passages(df)
    assert {r["doc_id"] for r in spans.where("not stays").collect()} == {9}  # the long text of document 4
    clean = substring.remove_passages(df.withColumn("_cut", F.lit("clash")), spans)
    assert clean.count() == 10 and [r["text"].strip() for r in clean.where("doc_id = 9").collect()] == [""]
    assert substring.repeated_passages(empty_docs(spark)).count() == 0


def test_texts_under_one_id_are_told_apart(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(5, f"first {p}"), (5, f"a whole other text that must stay here, {p} and this too"), (5, "none of it"), (5, f"first {p}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [r["text"] for r in substring.remove_passages(df, substring.repeated_passages(df)).collect()]
    whole = [t for t in texts if "p30" in t]  # one text keeps it: as often as that row is repeated
    assert len(texts) == 4 and len(set(whole)) == 1 and "none of it" in texts
    assert any(t.startswith("a whole other text that must stay here,") and t.endswith(" and this too") for t in texts)


def test_planted_passages_are_caught_and_clean_texts_stay(spark):
    rng, rows, planted = random.Random(11), [], set()
    text = lambda n: " ".join(f"u{rng.randrange(10**9)}" + rng.choice(["", ",", "\n"]) for _ in range(n))
    for k in range(60):
        passage = text(rng.choice([51, 60, 120]))
        for _ in range(rng.choice([2, 3, 9])):
            planted.add(len(rows))
            rows.append((len(rows), f"{text(rng.randrange(80))} {passage} {text(rng.randrange(80))}"))
        rows.append((len(rows), f"{text(30)} {' '.join(passage.split()[:50])} {text(40)}"))
        rows.append((len(rows), text(150)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_passages(df, substring.repeated_passages(df)).select("doc_id", "_cut.n_repeated", "text").collect()
    assert {r["doc_id"] for r in got if r["n_repeated"]} == planted
    assert all(r["text"] == rows[r["doc_id"]][1] for r in got if r["doc_id"] not in planted)


# ---- 3 mixing ----


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 900, None: 70}, {"a": 0, "b": 10}, {"a": 0}, {"é": 5, "z": 5, "Z": 5, "a": 1000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_comes_near_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 50, 400])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    per = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 450 and r["most"] <= 2 for r in per)
    again = mixing.mix(df.repartition(7)).select("doc_id", "copies").orderBy("doc_id").collect()
    assert again == mixed.select("doc_id", "copies").orderBy("doc_id").collect()
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_the_chance_of_a_copy_is_the_fraction(spark):
    """The cut stays within the bound that plan_mix states; over seeds long and short documents are as likely."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * (400 if i % 20 == 0 else rng.randint(1, 30))), "ab"[i % 2]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    long, short, n = 0, 0, 6
    for seed in range(n):
        base = df.select("source", mixing.n_words(F.col("text")).alias("size"), mixing._slice(F.col("doc_id"), f"s{seed}").alias("slice"))
        for p in mixing.plan_mix(base).collect():
            own = collections.Counter()
            for r in base.where(F.col("source") == p["source"]).collect():
                own[r["slice"]] += r["size"]
            total, upto, stray = sum(own.values()), 0, 0.0
            for k in range(mixing.SLICES):
                upto += own[k]
                stray = max(stray, abs(upto / total - (k + 1) / mixing.SLICES))
            assert abs(p["cut"] / mixing.SLICES - p["fraction"]) <= stray + max(own.values()) / total
        for r in mixing.mix(df, f"s{seed}").where("source = 'a'").collect():
            extra = r["copies"] - int(r["target"] / r["source_size"])
            long, short = long + extra * (r["size"] == 400), short + extra * (r["size"] < 400)
    part = r["target"] / r["source_size"] % 1
    assert abs(long / (75 * n) - part) < 0.1 and abs(short / (675 * n) - part) < 0.05


def test_mix_with_columns_of_any_name(spark):
    names = ["cut", "_slice", "_source", "slice", "source_size", "copies", "fraction", "_copy", "size"]
    df = edge_docs(spark).drop("size", "copies", "source_size").withColumns({c: F.lit("own") for c in names})
    out = mixing.mix(df)
    assert out.count() == 10 and all(r["cut"] == r["_slice"] == r["_source"] == r["_copy"] == "own" for r in mixing.emit(out).collect())


def test_mix_edges(spark):
    out = mixing.mix(edge_docs(spark)).collect()
    assert len(out) == 10 and all(r["copies"] <= 2 for r in out)
    assert len({r["copies"] for r in out if r["doc_id"] == 5}) == 1
    assert mixing.mix(empty_docs(spark)).count() == 0


# ---- 4 quality ----


def brute_quality(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {p for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    shares = []
    chars = sum(map(len, words))
    for n in range(5, 11):
        seen, covered = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                covered |= set(range(i, i + n))
            seen.add(g)
        shares.append(sum(len(words[p]) for p in covered) / chars if chars else 0.0)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words), shares


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "#x", "\n", " ", "c\x0bd"]), max_size=120))
def test_quality_is_brute_force(parts):
    text = " ".join(parts)
    m, b = quality.measure(text), brute_quality(text)
    assert m[:6] == b[:6] and m[7] == pytest.approx(b[6])


def test_quality_edges(spark):
    rows = edge_docs(spark).select("doc_id", quality.quality(F.col("text")).alias("q")).collect()
    assert len(rows) == 10 and [r["q"]["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert not any(r["q"]["kept"] for r in rows if r["doc_id"] == 5)
    assert {r["q"]["n_words"] for r in rows if r["doc_id"] == 4} == {60_000}
    assert quality.keep_good(empty_docs(spark)).count() == 0


# ---- 5 Jaccard join ----


def brute_sets(texts):
    out = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(texts):
    sets, parent = brute_sets(texts), {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def near_texts(seed, n_base, copies, lengths):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for b in range(n_base):
        base = [word() for _ in range(rng.choice(lengths))] + (passage if b % 3 == 0 else [])
        for _ in range(rng.choice(copies)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 18))):
                op, at = rng.random(), rng.randrange(len(t))
                if op < 0.5:
                    t[at] = word()
                elif op < 0.75 and len(t) > 1:
                    del t[at]
                else:
                    t.insert(at, word())
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed, n_base, copies, lengths", [(1, 60, [1, 2, 5], [1, 3, 6, 12, 30]), (2, 12, [1, 40], [60, 90, 130]), (3, 25, [1, 3], [250, 333, 700])])
def test_components_are_brute_force(spark, seed, n_base, copies, lengths):
    texts = near_texts(seed, n_base, copies, lengths)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("singles", [0, 0b1111111])
def test_no_link_is_lost_by_the_filter_or_the_index(singles):
    """Linked sets have as many posts in common as each needs; the one-deletion index finds each linked pair by any H + 1 units."""
    rng = random.Random(9)
    for _ in range(150):
        n = rng.choice([1, 2, 5, 17, 63, 64, 200, 255, 256, 700])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, n // 5 + 1)):
            if rng.random() < 0.5 and len(b) > 1:
                b.remove(rng.choice(sorted(b)))
            else:
                b.add(rng.getrandbits(64))
        if not jaccard.linked(len(a), len(b), len(a & b)):
            continue
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        shared = set(dict(jaccard.bands(len(a)))) & set(dict(jaccard.bands(len(b))))
        found = False
        for band in shared:
            hx, hy = dict(jaccard.bands(len(a)))[band], dict(jaccard.bands(len(b)))[band]
            p, q = (jaccard.posts(s, band, h, singles) for s, h in ((x, hx), (y, hy)))
            common = len(np.intersect1d(p, q))
            assert common >= max(jaccard.needed(len(a), band), jaccard.needed(len(b), band))
            seg, less, value = jaccard.index_rows(x, band, singles)
            _, _, other = jaccard.index_rows(y, band, singles)
            units = [(s, v) for s, le, v in zip(seg, less, value, strict=True) if not le]
            hood = collections.defaultdict(set)
            for s, le, v in zip(seg, less, value, strict=True):
                if le:
                    hood[s].add(v)
            spend, looked = hx + 1, set()
            for s, v in sorted(units, key=lambda u: rng.random()):
                if spend > 0:
                    looked.add(v)
                    spend -= 1
                    if spend > 0 and hood[s]:
                        looked |= hood[s]
                        spend -= 1
            assert spend == 0 and looked & set(other.tolist())
            found = True
        assert found


def test_bands_have_room():
    for n in itertools.chain(range(1, 3000), (10**4, 10**5)):
        a = np.sort(quality.mixed(np.arange(n)))
        assert jaccard.too_few(a) == 0


@pytest.mark.parametrize("band", [1, 3, 4])
def test_what_a_set_needs_is_the_least_over_its_partners(band):
    first, end = 4**band, 4 ** (band + 1)
    for s in {-(-3 * first // 4), first - 1, first, first + 1, (first + end) // 2, end - 1}:
        least = []
        for t in range(1, end):
            if max(s, t) >= first and 4 * t >= 3 * s and 4 * s >= 3 * t:
                count = [jaccard.post_count(dict(jaccard.bands(x))[band]) for x in (s, t)]
                least.append(min(count) - 25 * (s + t) // 175)
        assert jaccard.needed(s, band) == min(least) >= 1


def test_common_posts_go_another_way_to_the_same_links(spark, monkeypatch):
    texts = near_texts(5, 30, [1, 4], [20, 60, 90])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == brute_components(texts)


def test_parities_tell_unlike_sets_and_no_linked_ones():
    rng = np.random.default_rng(5)
    told = 0
    for _ in range(3000):
        n, m = int(rng.integers(1, 900)), int(rng.integers(1, 900))
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        common = int(rng.integers(0, min(n, m) + 1)) if rng.random() < 0.5 else min(n, m)
        a, b = pool[:n], pool[max(0, n - common) : max(0, n - common) + m]
        both = len(np.intersect1d(a, b))
        may = jaccard.may_be_linked(len(a), jaccard.parities(a), len(b), jaccard.parities(b))
        assert may or not jaccard.linked(len(a), len(b), both)
        # Of sizes that may link; a similarity under one third.
        if len(a) + len(b) > 200 and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and both * 3 < len(a) + len(b) - both:
            told += not may
            assert not may
    assert told > 50


def test_posts_are_counted_in_rounds_that_leave_no_shuffle(spark, monkeypatch):
    import time

    from orrery.sources import shared

    manager = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    texts = {i: " ".join(f"w{(i // 2) * 1000 + k}" for k in range(60)) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scanned = jaccard._scanned(jaccard._texts(df, "doc_id", "text"), 0, frozenset())
    known, swept = lambda: manager.shuffleStatuses().size(), []
    sweep = shared.drop_shuffles

    def counted(rows):
        before = known()
        sweep(rows)
        for _ in range(50):
            if known() < before:
                break
            time.sleep(0.1)
        swept.append(before - known())

    monkeypatch.setattr(jaccard, "drop_shuffles", counted)
    jaccard._posted(scanned)
    assert len(swept) == jaccard.ROUNDS and sum(swept) > 0  # a file may go a round later


def test_what_was_read_and_shuffled_goes_round_by_round(spark, monkeypatch):
    import os

    texts = {i: " ".join(f"w{(i // 2) * 1000 + k}" for k in range(60)) + f" x{i}" for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scanned = jaccard._scanned(jaccard._texts(df, "doc_id", "text"), 0, frozenset())
    folder, left = scanned.written_to.removeprefix("file:").replace("//", "/"), []
    parts = lambda: {x for x in os.listdir(folder) if x.startswith("round=")}
    assert parts() == {f"round={k}" for k in range(-1, jaccard.ROUNDS)}  # documents and rounds
    monkeypatch.setattr(jaccard, "drop_shuffles", lambda rows: left.append(len(parts())))
    kept = jaccard._posted(scanned)
    assert left == list(range(jaccard.ROUNDS, 0, -1)) and not os.path.exists(folder)
    assert sum(k.count() for k in kept) > 0


def test_shuffle_files_go_with_the_table_written(spark):
    import glob
    import os
    import time

    from orrery.sources import shared

    files = lambda: set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))
    local = os.path.dirname(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getAbsolutePath())
    before, key = files(), shared.FILES_GO
    was = spark.conf.get(key)
    out = shared.materialise(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "s"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 5000 and spark.conf.get(key) == was


def test_whole_sets_are_compared_in_rounds(spark, monkeypatch):
    texts = near_texts(11, 60, [1, 2, 3], [12, 30])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "SETS_SENT", 0.5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == brute_components(texts)


def test_sets_that_share_a_number_are_told_apart(spark, monkeypatch):
    texts = near_texts(6, 40, [1, 2], [12, 30])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = jaccard.digest
    monkeypatch.setattr(jaccard, "digest", lambda a: (whole(a)[0] % 16, whole(a)[1]))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()} == brute_components(texts)


def test_one_text_very_often(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    df = df.unionByName(spark.createDataFrame([(-1, text + " and one more"), (-2, "something else")], "doc_id long, text string"))
    posts = jaccard._scanned(jaccard._texts(df, "doc_id", "text"), 0, frozenset()).where("tag >= 0")
    assert posts.count() < 1000  # once from each task
    assert {tuple(r) for r in jaccard.near_duplicates(df).groupBy("component_id").count().collect()} == {(-1, 100_001), (-2, 1)}
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [-2, -1]
    same = df.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert jaccard.keep_one(same).count() == 2


def test_jaccard_edges(spark):
    rows = jaccard.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == 10
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert by[9] == by[4] and {c for _, c in by[4]} == {4}
    assert by[None] == {(1, 5), (0, None)}
    kept = jaccard.keep_one(edge_docs(spark)).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, None: 1}
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0 and jaccard.keep_one(empty_docs(spark)).count() == 0


# ---- 6 HTML ----


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b  c\n d", "a\nb c d"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
        ("<table><tr><th>k<th>value<tr><td>long<td>1</table>", "k     value\nlong  1"),
        ("<table><tr><td>aa<td colspan=2>wide one<td>z<tr><td>b<td>c<td>dd<td>y</table>", "aa  wide one  z\nb   c  dd     y"),
        (f"<table><tr><td>{'word ' * 20}<td>x<tr><td>a<td>y</table>", f"{' '.join(['word'] * 12)}  x\n{' '.join(['word'] * 8)}\na{' ' * 58}  y"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<title>t</title><script>var a='<p>'</script><p style='display:none'>no<p hidden>no<p>yes", "yes"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<b>bo<i>ld</b>&amp;&eacute;</i>", "bold&é"),
        ("<blockquote>q</blockquote>", "  q"),
        ("<details><summary>s</summary>hidden</details>", "s"),
        ("<!-- x --><![CDATA[ y ]]>z", "z"),
        ("", ""),
        ("<p>", ""),
    ],
)
def test_render(page, text):
    assert html.render(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "w1", " w2 ", "<b>", "</b>", "<", "<!", "<![x", "&#0;", "<td colspan=9e9>", "\x00", "<pre>", "</div>"]), max_size=40))
def test_render_never_fails_and_loses_no_word(parts):
    text = html.render("".join(parts))
    if not any(p.startswith(("<!", "&", "\x00")) or p == "<" for p in parts):
        assert collections.Counter("".join(text.split())) == collections.Counter("".join(p for p in parts if p[0] != "<").replace(" ", "")) or "-" in text


def test_html_edges(spark):
    assert html.render(None) is None
    assert html.render("<div>" * 20_000 + "deep").endswith("deep")
    rows = spark.createDataFrame([(1, None), (2, ""), (2, "<p>x"), (None, "<p>" + "long " * 50_000)], "page_id long, html string")
    got = rows.select("page_id", html.extract(F.col("html")).alias("text")).collect()
    assert [r["text"] for r in got][:3] == [None, "", "x"] and len(got[3]["text"]) == 249_999


def model_page(rng, depth=0):
    """(html, tokens): a random page and what it shows, as words, ("nl",) and ("blank",) between blocks, and whole lines."""
    html, shown = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "inline", "hidden", "br", "div", "p", "list", "table", "quote"] if depth < 3 else ["text", "inline", "hidden", "br"])
        word = f"w{rng.randrange(1000)}"
        if kind == "text":
            html.append(f" {word}\n  {word}x ")
            shown += [word, f"{word}x"]
        elif kind == "inline":
            html.append(f" <b>{word}</b> ")
            shown.append(word)
        elif kind == "hidden":
            html.append(rng.choice([f"<script>{word}</script>", f"<span hidden>{word}</span>", f"<!-- {word} -->", f"<i style='display: none'>{word}<b>{word}</b></i>"]))
        elif kind == "br":
            html.append(f" {word}<br>{word} ")
            shown += [word, ("nl",), word]
        elif kind in ("div", "p"):
            inner, own = model_page(rng, 3 if kind == "p" else depth + 1)
            edge = ("blank",) if kind == "p" else ("nl",)
            html.append(f"<{kind}>{inner}</{kind}>")
            shown += [edge, *own, edge]
        elif kind == "quote":
            inner, own = model_page(rng, depth + 1)
            html.append(f"<blockquote>{inner}</blockquote>")
            shown += [("blank",), ("lines", [f"  {x}" if x else "" for x in model_lines(own)]), ("blank",)]
        elif kind == "list":
            tag, items, lines = rng.choice(["ul", "ol"]), [], []
            for i in range(rng.randint(1, 3)):
                inner, own = model_page(rng, 3)
                mark = "- " if tag == "ul" else f"{i + 1}. "
                items.append(f"<li>{inner}" + rng.choice(["", "</li>"]))
                lines += [(mark if j == 0 else " " * len(mark)) + x for j, x in enumerate(model_lines(own))]
            html.append(f"<{tag}>{''.join(items)}</{tag}>")
            shown += [("blank",), ("lines", lines), ("blank",)]
        else:
            n, grid = rng.randint(1, 3), []
            for _ in range(rng.randint(1, 3)):
                grid.append([f"c{rng.randrange(10 ** rng.randint(1, 6))}" for _ in range(n)])
            wide = [max(len(row[k]) for row in grid) for k in range(n)]
            html.append("<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in grid) + "</table>")
            shown += [("blank",), ("lines", ["  ".join(x.ljust(w) for x, w in zip(row, wide, strict=True)).rstrip() for row in grid]), ("blank",)]
    return "".join(html), shown


def model_lines(shown):
    """Words of a line with blanks between; a blank line where one is due between two lines."""
    lines, now, due = [], [], False

    def put(more):
        nonlocal due
        for x in more:
            if due and lines:
                lines.append("")
            due = False
            lines.append(x)

    for t in [*shown, ("nl",)]:
        if isinstance(t, str):
            now.append(t)
            continue
        if now:
            put([" ".join(now)])
            now = []
        if t[0] == "lines" and t[1]:
            put(t[1][:1])
            lines += t[1][1:]
        due = due or t[0] == "blank"
    return lines


@pytest.mark.parametrize("seed", range(300))
def test_layout_is_brute_force(seed):
    page, shown = model_page(random.Random(seed))
    assert html.render(page) == "\n".join(model_lines(shown)), page


@pytest.mark.parametrize("n", [149, 151, 3000])
def test_html_below_many_unclosed_elements(n):
    body = "x<script>var s=1</script><style>p{}</style><div hidden>secret <font>in</font> more</div><template><b>no</b></template> y</b>z"
    want = html.render(f"<b>{body}")
    assert "var s" not in want and "more" not in want
    assert html.render("<b><font>" + "<span>" * n + body) == want
    for tag in ("blockquote", "ul><li", "ol><li", "table><tr><td", "dl><dd", "div"):
        assert [w for w in html.render("".join(f"<{tag}>q{i}" for i in range(n))).split() if w[0] == "q"] == [f"q{i}" for i in range(n)]
    assert html.render("<blockquote>" * n + "<ol><li>a<li>b").split() == ["1.", "a", "2.", "b"]


# ---- 7 sharding ----


def test_shards_are_even_and_whole(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(4000)] + [(10_000 + i, "the same text " * 20) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(df, 10).collect()
    assert len(out) == len(rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        assert r["size"] == len(r["text"]) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(size.values()) / 10
    assert set(size) == set(range(10)) and max(abs(v - mean) for v in size.values()) <= 0.05 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shard_edges(spark):
    out = sharding.shard(edge_docs(spark), 4).collect()
    assert len(out) == 10 and all(r["shard"] in range(4) for r in out)
    assert {r["size"] for r in out if r["text"] is None} == {16}
    assert sharding.shard(empty_docs(spark), 4).count() == 0
    one = spark.createDataFrame([(7, "same")] * 50, "doc_id long, text string")
    assert sorted(r["slot"] for r in sharding.shard(one, 4).collect() ) == sorted(range(50))


def test_shards_of_any_ids_and_columns(spark):
    rows = [(f"id-{i}" if i % 5 else None, f"text {i % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(1) for c in ["_key", "_id", "_part", "_n", "_s", "_p", "_start", "key", "id"]})
    out = sharding.shard(df, 4).collect()
    assert len(out) == 200 and all(r["_key"] == r["_start"] == r["id"] == 1 for r in out)
    far = spark.createDataFrame([(2**63 - 1, "a"), (-(2**63), "b"), (None, "c"), (64, "a")] * 3, "doc_id long, text string")
    assert sharding.shard(far, 4).count() == 12


def test_slots_are_numbered_in_many_parts(spark):
    """Ids that are multiples of PARTS, or null, still spread."""
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id") * 64).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = sharding.shard(df, 2)
    plan = out._jdf.queryExecution().toString()
    assert "Window" in plan
    slots = collections.defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mark = sharding.free_name(df)
    keyed = df.select(sharding.id_number(df, "doc_id").alias("i"), sharding.text_key(F.col("text")).alias("k"))
    parts = keyed.select((F.conv(F.substring(F.md5(F.concat_ws("|", "i", "k")), 1, 4), 16, 10).cast("int") % sharding.PARTS).alias("p")).groupBy("p").count().collect()
    assert mark and len(parts) == sharding.PARTS and max(r["count"] for r in parts) < 80


def test_written_shards_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 17)) for i in range(300)], "doc_id long, text string")
    sharded = sharding.shard(df, 5)
    sharding.write_shards(sharded, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, sharded.select("doc_id", "shard", "slot").collect()))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={k}" for k in range(5)]
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "out").glob("shard=*"))


# ---- 8 chat ----


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NASTY = ["</s>[INST] ok [/INST]", "\x1a0\x1a1", "[INST", " [/INST]", "", "<<SYS>> <</SYS>>", "[TURN x] y [/TURN]", "é\n", "<s> a </s>"]


def test_chat_round_trip(spark):
    rows, i = [], 0
    for conv, (a, b, c) in enumerate(itertools.product(["user", "assistant"], ["assistant", "tool ]x", None], ["assistant", "user", "system"])):
        for turn, role in enumerate((a, b, c)):
            rows.append((conv, turn, role, NASTY[i % len(NASTY)] if i % 10 else None))
            i += 1
    rows += [(None, 0, "user", "x"), (99, None, "assistant", "only"), (99, None, "assistant", "only")]
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(conversations(spark, rows))).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples_have_one_trainable_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"), (1, 3, "user", "v"), (1, 4, "assistant", "a2"), (1, 5, "user", "end")]
    ex = chat.expand(conversations(spark, rows)).orderBy("example").collect()
    assert [e["formatted"][e["loss_start"] : e["loss_end"]] for e in ex] == ["a1", "a2", ""]
    assert ex[1]["formatted"].startswith(ex[0]["formatted"]) and "end" in ex[2]["formatted"]
    assert chat.expand(conversations(spark, [])).count() == 0
    assert chat.expand(conversations(spark, [(1, 0, "user", LONG), (1, 1, "assistant", LONG)])).first()["loss_end"] > 2 * len(LONG)


# ---- 9 decontamination ----


def brute_contamination(text, items):
    words = [w.decode() for w in decontam.split_words(text)]
    hit, names = set(), set()
    for name, t in items:
        own = [w.decode() for w in decontam.split_words(t)]
        n = min(13, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit |= set(range(p, p + n))
                    names.add(str(name) if name is not None else "")
    return len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_contamination_is_brute_force(spark, bits, monkeypatch):
    """Also with a filter that lets nearly all pass, as a benchmark that outgrows it makes it."""
    monkeypatch.setattr(decontam, "MAX_BITS", bits)
    monkeypatch.setattr(decontam, "CHUNK", min(bits, 1 << 16))
    rng = random.Random(bits)
    word = lambda: rng.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 7, 13, 14, 20])))) for i in range(12)] + [(3, "x y z"), (None, "q, R!s"), (50, None), (51, "... !!")]
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 30, 80]))) for _ in range(40)]
    texts += [f"{rng.choice(items[:12])[1].upper()}, and {t}" for t in texts[:20]] + [None, "", "Q R S", "X-Y-Z"]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontam.contamination(df, bench).collect():
        d = r["_decon"]
        assert (d["n_words"], d["n_hit"], d["items"], d["contaminated"]) == brute_contamination(r["text"], items)


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.contamination(edge_docs(spark), bench).where("_decon.contaminated").count() == 3
    assert decontam.contamination(edge_docs(spark), bench.limit(0)).where("_decon.n_hit > 0").count() == 0
    assert decontam.keep_clean(empty_docs(spark), bench).count() == 0
    assert decontam.contamination(edge_docs(spark).withColumn("_decon", F.lit("clash")).withColumn("key", F.lit(1)), bench).where("_decon.contaminated").count() == 3


def test_benchmark_of_many_items_is_broadcast_as_a_filter_alone(spark):
    """The filter's size is bounded; it passes all that it should."""
    h = quality.mixed(np.arange(40_000))
    df = spark.createDataFrame([(int(v),) for v in h.view(np.int64)], "shingle long")
    packed = decontam._filter(df)
    assert 8 * len(packed) == 1 << 20 and decontam._may_hold(packed, h).all()
    assert decontam._may_hold(packed, quality.mixed(np.arange(50_000, 90_000))).mean() < 0.02


def test_a_very_common_text_and_window(spark):
    p = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(f"{p} and more")).otherwise(F.concat(F.lit(f"no {p} "), F.col("id"))).alias("text"))
    bench = spark.createDataFrame([(i, p) for i in range(50)], "item_id long, text string")
    got = decontam.contamination(docs, bench).select("_decon.n_hit", F.size("_decon.items").alias("n")).distinct().collect()
    assert [tuple(r) for r in got] == [(30, 50)]


# ---- 10 toxicity ----


def brute_segments(scores):
    """Maximal-scoring segments by their definition: the best one, then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or (total, -(j - i)) > (best[2], -(best[1] - best[0] - 1))):
                best = (i, j + 1, total)
    if best is None:
        return []
    left, right = brute_segments(scores[: best[0]]), brute_segments(scores[best[1] :])
    return left + [best] + [(a + best[1], b + best[1], s) for a, b, s in right]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-7, 7), max_size=30))
def test_segments_sum_like_the_definition(scores):
    got = toxicity.segments(np.array(scores, float))
    assert sorted(s for *_, s in got) == sorted(s for *_, s in brute_segments(scores))
    assert all(sum(scores[a:b]) == s for a, b, s in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def toxic_tables(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "mu", "te", "lan"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        t, bad = [word() for _ in range(rng.randint(5, 150))], i % 6 == 0
        for _ in range(rng.randint(1, 5) if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["idiot", "scumbag", "vermin"]) + rng.choice(["", "o", "en"]))
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark, 1200)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "_tox.score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    wrong = [r for r in rows if (r["score"] >= toxicity.THRESHOLD) != (r["doc_id"] % 6 == 0)]
    assert len(rows) > 300 and len(wrong) <= 0.02 * len(rows)


def test_calibration_is_brute_force(spark):
    docs, labels = toxic_tables(spark, 300)
    rows = toxicity.training_rows(docs, labels).cache()
    parts = [(rows.where(F.col("part") == k), toxicity.Model(toxicity.learn_tokens(rows.where(F.col("part") != k)))) for k in (0, 1)]
    model = toxicity.calibrate(toxicity.Model(), parts)
    told, scores, words = [], [toxicity.MIN_ODDS], 1.0
    for part, own in parts:
        for r in part.collect():
            found, n = toxicity.scan(own, own.word_scores(), r["text"])
            told.append((r["toxic"], found, n))
            if not r["toxic"]:
                scores, words = scores + [s for *_, s in found], words + n
    assert model.rate == pytest.approx(len(scores) / sum(scores)) and model.scale == pytest.approx(len(scores) / words)
    x = np.array([[1.0, *model.features(found, n)] for _, found, n in told])
    y = np.array([t for t, *_ in told], float)
    w = np.array(model.weights)
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 0.1 * w  # nought at the best weights, for those above nought
    assert all(abs(g) < 1e-4 for g, v in zip(slope, w, strict=True) if v != 0) and (w[1:] >= 0).all()
    rows.unpersist()


def test_toxicity_tells_every_significant_passage(spark):
    docs, labels = toxic_tables(spark, 600)
    model = toxicity.train(docs, labels)
    clean = "bako rimu telan " * 40
    text = f"{clean}idiot scumbag vermin idiot {clean}vermin scumbag idiot scumbag vermin {clean}"
    rows = spark.createDataFrame([(1, text), (2, clean), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["_tox"] for r in toxicity.score(rows, model).collect()}
    assert [(p["start"], p["end"]) for p in got[1]["passages"]] == [(120, 124), (244, 249)]
    assert got[1]["n_segments"] == 2 and (got[1]["best_start"], got[1]["best_end"]) == (244, 249)
    assert got[2]["passages"] == got[3]["passages"] == [] and got[2]["n_segments"] == 0
    weak = toxicity.Model({t: 0.1 for t in toxicity.tokens(b"weak")} | {t: 30.0 for t in toxicity.tokens(b"strong")})
    weak.rate, weak.scale = 1.0, 0.01
    one = spark.createDataFrame([(1, "a weak b c strong d")], "doc_id long, text string")
    tox = toxicity.score(one, weak).head()["_tox"]
    assert tox["n_segments"] == 1 and [(p["start"], p["end"]) for p in tox["passages"]] == [(4, 5)]  # "weak" is no passage


def test_toxicity_edges(spark):
    docs, labels = toxic_tables(spark, 300)
    model = toxicity.train(docs, labels)
    out = toxicity.score(edge_docs(spark), model).collect()
    assert len(out) == 10 and all(0 <= r["_tox"]["score"] <= 1 for r in out)
    assert len({r["_tox"]["score"] for r in out if not (r["text"] or "").strip()}) == 1
    blank = toxicity.train(docs, labels.limit(0))
    assert len({r["_tox"]["score"] for r in toxicity.score(docs.limit(20), blank).collect()}) == 1
    assert toxicity.score(empty_docs(spark), model).count() == 0


# ---- pipeline ----


def test_stages_keep_columns_of_any_name(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = edge_docs(spark).withColumns({c: F.lit("own") for c in ["_quality", "_decon", "key", "node", "label", "_id", "_key", "words"]})
    for out in (quality.keep_good(df), jaccard.keep_one(df), decontam.keep_clean(df.drop("_decon"), bench)):
        assert all(r["key"] == r["words"] == "own" for r in out.collect())


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    first = P.STAGES[0][1](spark, docs, sf)
    assert first.schema.names == docs.schema.names and 0 < first.count() < docs.count()
    assert P.STAGES[0][1](spark, empty_docs(spark), sf).count() == 0
    null_row = spark.createDataFrame([(None, None, None, None, None)], docs.schema)
    for _, stage in P.STAGES:
        assert stage(spark, null_row, sf).count() <= 1


def test_queries_match_their_twins(spark):
    import os

    import duckdb

    from orrery.llm.queries import ORACLES, QUERIES

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        want = c.sql(sql)
        at = [want.columns.index(x) for x in cols]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key), name


