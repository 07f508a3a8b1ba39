"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of WINDOW words (a shorter item is one window), and windows
and documents into shingles. A window is contained in a document only if all its
shingles are, so the necessary prefix is one shingle: the rarest, by the places in
the corpus that hold it. One scan of the documents keeps the runs of words whose
shingles may be of the benchmark; a Bloom filter of at most MAX_BITS bits decides
that, whatever the benchmark's size. All that follows are joins of tables: shingles are counted
with partial sums, each window is filed under its rarest, runs meet windows by that
shingle alone, the shingle's place and the run's length bound where the window may lie,
and all words are compared there.

Documents stay where they are: only runs are shuffled, each text's once a task, under the
text's MD5. A benchmark that outgrows the filter makes more runs, not a larger
broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orrery.llm.common import free_name, materialise, release, table
from orrery.llm.quality import mixed

WINDOW, SHINGLE = 13, 5
#: Bits of the filter: so many for each shingle, in all MAX_BITS at most (16 MB), in chunks of CHUNK.
BITS_EACH, MAX_BITS, CHUNK = 16, 1 << 27, 1 << 16
#: Hits (documents and their items) that are broadcast at most; beyond it the join is left to the optimiser.
BROADCAST_ROWS = 1_000_000
#: A document is contaminated if at least 1 / MIN_PART of its words are hit.
MIN_PART = 20
#: Texts whose runs a task remembers to have told.
REMEMBERED = 100_000

#: Bytes that separate words: ASCII but for digits and letters; A-Z turn to a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in a text whose letters are not yet in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    """Words of the contract, lower case; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values."""
    if len(values) < n:
        return values[:0]
    h, power = values[: len(values) - n + 1].copy(), _MULT
    with np.errstate(over="ignore"):
        for k in range(1, n):
            h += power * values[k : len(values) - n + 1 + k]
            power = power * _MULT
    return h


class Words(dict):
    """64-bit hash of each word."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; by n, so that lengths are told apart."""
    return mixed(hashes(values, n) + np.uint64(n))


def _windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, words (of a window, with blanks between), size, n (words in a shingle), shingles: one row for each window of each item."""

    def cut(batches):
        hashed = Words()
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = split_words(text)
                size = min(WINDOW, len(words))
                n = min(SHINGLE, size)
                for i in range(len(words) - size + 1 if size else 0):
                    part = words[i : i + size]
                    out.append((item, b" ".join(part), size, n, shingle_hashes(hashed.numbers(part), n).view(np.int64).tolist()))
            yield pd.DataFrame(out, columns=["item", "words", "size", "n", "shingles"])

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return materialise(items.mapInPandas(cut, "item string, words binary, size int, n int, shingles array<long>").distinct())


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _filter(shingles: DataFrame) -> np.ndarray:
    """A Bloom filter of the column shingle, as bytes; chunks of it are made where their shingles are."""
    need = BITS_EACH * max(1, shingles.count())
    bits = min(MAX_BITS, max(CHUNK, 1 << (need - 1).bit_length()))
    chunk = CHUNK

    def place(batches):
        for batch in batches:
            at = np.concatenate(_places(batch["shingle"].to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pd.DataFrame({"chunk": at // chunk, "bit": at % chunk})

    def build(part: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(chunk, np.uint8)
        flags[part["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "packed": [np.packbits(flags, bitorder="little").tobytes()]})

    placed = shingles.mapInPandas(place, "chunk long, bit int").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in placed.groupBy("chunk").applyInPandas(build, "chunk long, packed binary").toLocalIterator():
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["packed"], np.uint8)
    return out


def _may_hold(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in _places(h, 8 * len(packed)):
        found &= (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _runs(docs: DataFrame, text_col: str, lengths: list[int], packed: np.ndarray) -> DataFrame:
    """key (MD5 of the text), n, start, words, shingles: the longest runs of words all of whose shingles of n words pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # MAX_BITS / 8 bytes at most

    def scan(batches):
        hashed, done, bits = Words(), set(), shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if key in done:
                    continue
                words, told = split_words(text), len(out)
                values = hashed.numbers(words)
                for n in lengths:
                    if len(words) < n:
                        continue
                    h = shingle_hashes(values, n)
                    edge = np.diff(np.concatenate(([0], _may_hold(bits, h).astype(np.int8), [0])))
                    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                        out.append((key, n, a, b" ".join(words[a : b + n - 1]), h[a:b].view(np.int64).tolist()))
                if len(out) > told:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(key)
            yield pd.DataFrame(out, columns=["key", "n", "start", "words", "shingles"])

    texts = docs.where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    return materialise(texts.mapInPandas(scan, "key string, n int, start int, words binary, shingles array<long>"))


def _verified(batches):
    """For each run the places and windows that its words hold."""
    for batch in batches:
        out = []
        for key, start, text, found in batch[["key", "start", "words", "found"]].itertuples(index=False):
            words, spans, held = text.split(b" "), [], set()
            for c in found:
                if b" ".join(words[c["at"] : c["at"] + c["size"]]) == c["window"]:
                    spans.append((start + c["at"], start + c["at"] + c["size"]))
                    held.add(bytes(c["window"]))
            flat: list[int] = []
            for a, b in sorted(spans):
                if flat and a <= flat[-1]:
                    flat[-1] = max(flat[-1], b)
                else:
                    flat += [a, b]
            if flat:
                out.append((key, flat, sorted(held)))
        yield pd.DataFrame(out, columns=["key", "spans", "held"])


def _union_size(flat: list[int]) -> int:
    total, end = 0, -1
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        total, end = total + max(0, b - max(a, end)), max(end, b)
    return total


def hits(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """key (MD5 of a text), n_hit, spans (starts and ends of words in turn, may overlap), items: the texts that hold windows."""
    windows = _windows(benchmark, item_col, item_text_col)
    own = materialise(windows.select("words", "size", "n", "shingles").distinct())
    prefixes = own.select("words", "size", "n", F.posexplode("shingles").alias("offset", "shingle"))
    lengths = sorted(r["n"] for r in own.select("n").distinct().collect())  # SHINGLE at most
    runs = _runs(docs, text_col, lengths, _filter(prefixes.select("shingle").distinct()))
    places = runs.select("key", "n", "start", F.size("shingles").alias("length"), F.posexplode("shingles").alias("at", "shingle"))
    # A text that several tasks hold counts as often; that sways the order, which is free, and no result.
    rarity = places.groupBy("n", "shingle").agg(F.count("*").alias("df"))
    ranked = prefixes.join(rarity, ["n", "shingle"], "left").groupBy("words", "size", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "shingle")).alias("p"), F.min(F.coalesce("df", F.lit(0))).alias("least"))
    filed = materialise(ranked.where("least > 0").select(F.col("words").alias("window"), "size", "n", F.col("p.offset").alias("offset"), F.col("p.shingle").alias("shingle")))
    near = places.join(filed, ["n", "shingle"]).withColumn("at", F.col("at") - F.col("offset"))
    near = near.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("length") + F.col("n") - 1))
    run = ["key", "n", "start"]
    candidates = materialise(near.groupBy(*run).agg(F.collect_set(F.struct("at", "size", "window")).alias("found")))
    once = runs.join(candidates.select(*run), run, "left_semi").groupBy(*run).agg(F.min("words").alias("words"))
    sure = materialise(once.join(candidates, run).mapInPandas(_verified, "key string, spans array<int>, held array<binary>"))
    named = sure.select("key", F.explode("held").alias("words")).distinct().join(windows.select("words", "item"), "words")
    items = named.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    spans = sure.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = materialise(spans.withColumn("n_hit", pandas_udf(lambda s: s.map(_union_size), "long")("spans")).join(items, "key").select("key", "n_hit", "spans", "items"))
    release(windows, own, runs, filed, candidates, sure)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """docs with _decon: n_words, n_hit, items (array of string), contaminated.

    Null, empty and wordless texts have no words and are never contaminated. Items
    without words match nothing; a null item_id counts as the empty id; items with one
    id count once. Documents are judged by their texts, so repeated rows and null or
    repeated doc_ids need no rule. Texts are read whole, at any length. An empty benchmark
    hits nothing, an empty table gives no rows. A column of docs named _decon is replaced;
    others may have any name.
    """
    found = hits(docs, benchmark, text_col).drop("spans")
    size = found.agg(F.count("*") + F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    mark = free_name(docs)
    found = found.select(F.col("key").alias(mark), F.struct("n_hit", "items").alias(mark + "hit"))
    own = docs.drop("_decon")
    rows = own.join(F.broadcast(found) if size <= BROADCAST_ROWS else found, F.md5(F.col(text_col)) == F.col(mark), "left")
    n_words = pandas_udf(lambda texts: texts.map(lambda t: len(split_words(t))), "long")(F.col(text_col))
    n_hit = F.coalesce(F.col(mark + "hit.n_hit"), F.lit(0).cast("long"))
    # Counted by itself, for the few rows that are hit: those who only ask for this need no UDF.
    dirty = F.when(n_hit > 0, MIN_PART * n_hit >= F.regexp_count(F.col(text_col), F.lit(WORD))).otherwise(False)
    items = F.coalesce(F.col(mark + "hit.items"), F.array().cast("array<string>"))
    out = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), dirty.alias("contaminated"))
    return rows.select(*[F.col(f"`{c}`") for c in own.columns], out.alias("_decon"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """The rows of docs that are not contaminated, with their columns; texts without words stay, as do all rows where the benchmark is empty."""
    return contamination(docs, benchmark, text_col).where(~F.col("_decon.contaminated")).drop("_decon")


def op9_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("_decon.items")
    return found.select(
        "doc_id",
        "_decon.n_words",
        "_decon.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "_decon.contaminated",
    )


def decontam_sql(docs: str = "documents") -> str:
    """WITH parts that end in dc_rows: the rows of docs with the contract's columns."""
    words = lambda t: rf"coalesce(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return rf"""
dc_item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words("text")} AS ws FROM benchmark),
dc_win AS (SELECT item, n, list_slice(ws, i, i + n - 1) AS g FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(len(ws), {WINDOW}) AS n FROM dc_item WHERE len(ws) > 0))),
dc_doc AS (SELECT *, row_number() OVER () AS rid, {words("text")} AS ws FROM {docs}),
dc_gram AS (SELECT rid, n, i, list_slice(ws, i, i + n - 1) AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dc_doc, (SELECT DISTINCT n FROM dc_win))),
dc_hit AS (SELECT rid, n, i, item FROM dc_gram JOIN dc_win USING (n, g)),
dc_pos AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, i + unnest(range(0, n)) AS p FROM dc_hit) GROUP BY rid),
dc_items AS (SELECT rid, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM dc_hit GROUP BY rid),
dc_rows AS (SELECT * EXCLUDE (rid, ws, n_hit, n_items, items), len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {MIN_PART} * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM dc_doc LEFT JOIN dc_pos USING (rid) LEFT JOIN dc_items USING (rid))"""


OP9_SQL = f"WITH {decontam_sql()} SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM dc_rows"
