"""Substring dedup: passages of over 50 words, wherever in their lines they start and end.

The units are cut by content, not by line ends: a passage that starts inside a line
or is made of short lines has units of its own. Every window of PASSAGE words names
the least hash of its GRAM-word shingles (winnowing), so equal windows name equal
shingles, and neighbours that name the same one make a segment, which is the unit.
Segments are normalised and hashed where their document lies; only digests, ids and
offsets are shuffled. Digests are grouped globally with partial aggregation, so that
a passage of a third of all documents is one row from each task. The repeated
digests are written out; segments then join them, which lets the optimiser
broadcast them where they are measured to be small and split a hot digest where not.
Only where a shingle has segments of differing content are the windows of one segment
of each content compared too. No repeated window is missed, the earliest
occurrence by (rank, id) stays, and the rest goes with its original offsets told.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orrery.llm.common import free_name, materialise, release, table

#: A passage of over 50 words holds a window of this many.
PASSAGE = 51
GRAM = 26
#: Polynomial hashes modulo 2^64 of word hashes; the factor is odd and so has an inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _WordHashes(dict):
    """64-bit hash of each word; the table is emptied before it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word).digest()[:8], "little")
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def segments_of(text: str | None, size: int = PASSAGE, gram: int = GRAM):
    """(at, n, shingle, digest, windows) of a text, or None where it has fewer than size words.

    The first four are arrays by segment: its first window, its number of windows, the
    hash of the shingle that these windows name, and the hash of all its words. windows
    has the hash of each window. Normal form: A-Z in lower case, runs of ASCII white space
    count as one space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return None
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    back = _powers(INVERSE, len(w))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(BASE, len(w)), dtype=np.uint64)])
    over = lambda at, stop: _mix((sums[stop] - sums[at]) * back[at])
    starts = np.arange(len(w) - gram + 1)
    grams, span = over(starts, starts + gram), size - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    named = np.arange(len(views)) + span - 1 - views[:, ::-1].argmin(1)  # of equal hashes the last
    at = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
    n = np.diff(np.append(at, len(named)))
    windows = over(np.arange(len(named)), np.arange(len(named)) + size)
    return at, n, grams[named[at]], _mix(over(at, at + n + size - 1) + n.astype(np.uint64)), windows


def _spread(batch: pa.RecordBatch, rows: list[int], parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """WHO of the batch's rows, repeated for their parts, and the parts as columns."""
    idx = pa.array(np.repeat(np.array(rows, np.int64), [len(p[0]) for p in parts]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32)) for c in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(idx) for i in range(len(WHO))), *arrays], names=[*WHO, *names])


def _cut_segments(batches):
    for batch in batches:
        found = [(i, s) for i, t in enumerate(batch.column(len(WHO)).to_pylist()) if (s := segments_of(t))]
        if found:
            yield _spread(batch, [i for i, _ in found], [list(s[:4]) for _, s in found], ["at", "n", "shingle", "digest"])


def _cut_windows(batches):
    for batch in batches:
        rows, parts = [], []
        for i, (text, wanted) in enumerate(zip(batch.column(len(WHO)).to_pylist(), batch.column(len(WHO) + 1).to_pylist(), strict=True)):
            if (s := segments_of(text)) is None:
                continue
            at, n, shingle, digest, windows = s
            keys = {(x["at"], x["digest"]) for x in wanted}
            pick = np.array([k in keys for k in zip(at.tolist(), digest.view(np.int64).tolist(), strict=True)])
            place = np.flatnonzero(np.repeat(pick, n))
            rows.append(i)
            parts.append([place, np.repeat(shingle, n)[place], windows[place]])
        if rows:
            yield _spread(batch, rows, parts, ["at", "shingle", "digest"])


#: What tells documents apart: rank, id, and a hash of the text for texts under one id.
WHO = ("rank", "doc_id", "key")


def _who(docs: DataFrame, rank_col: str, id_col: str, text_col: str) -> list[Column]:
    return [F.col(rank_col).alias("rank"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key")]


def _same(names: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(WHO, names, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _spans(found: DataFrame, length: Column) -> DataFrame:
    """The words [start, stop) of found; those that go lie beyond the first window, where the two overlap."""
    same = _same([f"first.{c}" for c in WHO])
    stays = same & (F.col("at") == F.col("first.at"))
    start = F.when(same & ~stays, F.greatest(F.col("at"), F.col("first.at") + PASSAGE)).otherwise(F.col("at"))
    return found.select(*WHO, start.cast("int").alias("start"), (F.col("at") + length).cast("int").alias("stop"), stays.alias("stays"))


def repeated_passages(docs: DataFrame, rank_col="doc_id", id_col="doc_id", text_col="text") -> DataFrame:
    """rank, doc_id, key, start, stop, stays: words (from 0, stop exclusive) of windows of PASSAGE words that occur again.

    stays marks occurrences that come first; the words of the others go. Spans of a
    document may overlap, also those that stay and those that go: what goes, goes.
    Windows are ranked by (rank, id, key, place), null first, and the first of each
    content stays, also within one document. key is a hash of the text: texts of one
    id are documents of their own, while rows that are equal in rank, id and text are
    one document and not held against each other. Null, empty and short texts have no
    windows; texts are taken whole, at any length. Other columns are ignored. An empty
    table gives no rows.
    """
    texts = docs.select(*_who(docs, rank_col, id_col, text_col), F.col(text_col).alias("text"))
    declared = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in WHO)
    place = F.struct(*WHO, "at")
    segments = materialise(texts.mapInArrow(_cut_segments, f"{declared}, at int, n int, shingle long, digest long"))
    kinds = materialise(segments.groupBy("shingle", "digest", "n").agg(F.min(place).alias("first"), F.count("*").alias("copies")))
    copies = segments.join(kinds.where("copies > 1").drop("copies"), ["shingle", "digest", "n"])
    whole = materialise(_spans(copies, F.col("n") + (PASSAGE - 1)).where("start < stop"))
    release(segments)
    mixed = kinds.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    owner = [F.col(f"first.{c}").alias(f"_{c}") for c in WHO]
    wanted = kinds.join(mixed, "shingle").select(*owner, F.struct(F.col("first.at").alias("at"), "digest").alias("w"))
    wanted = wanted.groupBy(*[f"_{c}" for c in WHO]).agg(F.collect_list("w").alias("wanted"))
    again = texts.join(wanted, _same([f"_{c}" for c in WHO])).select(*WHO, "text", "wanted")
    windows = materialise(again.mapInArrow(_cut_windows, f"{declared}, at int, shingle long, digest long"))
    release(kinds)
    firsts = materialise(windows.groupBy("shingle", "digest").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    parts = materialise(_spans(windows.join(firsts, ["shingle", "digest"]), F.lit(PASSAGE)).where("start < stop"))
    release(windows, firsts)
    return whole.unionByName(parts)


def _covered(spans, n: int) -> list[list[int]]:
    """The spans as far as there are words, without overlaps, in order."""
    merged: list[list[int]] = []
    for a, b in sorted((int(s["start"]), min(int(s["stop"]), n)) for s in spans if s["start"] < n):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def cut_words(text: str | None, spans) -> dict:
    """The text without the words of the spans that go, what was cut as offsets in code points, and counts of words."""
    if text is None:
        return {"text": None, "removed": [], "n_words": 0, "n_repeated": 0, "n_removed": 0}
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    solid = ~((code == 32) | ((code >= 9) & (code <= 13)))
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n, spans = len(starts), [] if spans is None else list(spans)
    gone, every = _covered((s for s in spans if not s["stays"]), n), _covered(spans, n)
    cuts = [{"start": int(starts[a]), "stop": int(ends[b - 1])} for a, b in gone]
    keep, at = [], 0
    for c in cuts:
        keep.append(text[at : c["start"]])
        at = c["stop"]
    return {"text": "".join([*keep, text[at:]]), "removed": cuts, "n_words": n, "n_repeated": sum(b - a for a, b in every), "n_removed": sum(b - a for a, b in gone)}


def remove_passages(docs: DataFrame, spans: DataFrame, rank_col="doc_id", id_col="doc_id", text_col="text") -> DataFrame:
    """docs without the words of the spans that go, and _cut: removed (original offsets, end exclusive), n_words, n_repeated, n_removed.

    One row for each row of docs. n_repeated counts the words of all spans, those that
    stay included. White space between two words goes if both do. Null stays null; a
    text that goes as a whole becomes empty. Columns of docs named _cut are replaced.
    """

    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_words(t, s) for t, s in zip(texts, spans, strict=True)], columns=["text", "removed", "n_words", "n_repeated", "n_removed"])

    kind = "text string, removed array<struct<start:int,stop:int>>, n_words long, n_repeated long, n_removed long"
    mark = free_name(docs)
    by_doc = spans.groupBy(*[F.col(c).alias(f"{mark}{c}") for c in WHO]).agg(F.collect_set(F.struct("start", "stop", "stays")).alias(f"{mark}spans"))
    on = F.lit(True)
    for own, c in zip([F.col(rank_col), F.col(id_col), F.xxhash64(text_col)], WHO, strict=True):
        on = on & own.eqNullSafe(F.col(f"{mark}{c}"))
    done = docs.drop("_cut").join(by_doc, on, "left").withColumn("_cut", pandas_udf(cut, kind)(F.col(text_col), F.col(f"{mark}spans")))
    done = done.withColumns({text_col: F.col("_cut.text"), "_cut": F.col("_cut").dropFields("text")})
    return done.drop(f"{mark}spans", *[f"{mark}{c}" for c in WHO])


def op2_passage_dedup(spark, sf_dir):
    """Each document without the passages of over 50 words that an earlier place holds, and what was cut.

    has_repeat: the document holds a passage that also stands elsewhere, here or in
    another document, whether this place is the first or not; removed: the offsets of
    what was cut in the original text, as start-stop, end exclusive.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_passages(docs, repeated_passages(docs))
    spans = F.array_join(F.transform("_cut.removed", lambda s: F.concat_ws("-", s["start"], s["stop"])), " ")
    return out.select("doc_id", "text", "_cut.n_words", "_cut.n_repeated", "_cut.n_removed", (F.col("_cut.n_repeated") > 0).alias("has_repeat"), spans.alias("removed"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^ 	-
]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i - 1 AS place, md5(array_to_string(list_slice(ws, i, i + {PASSAGE - 1}), ' ')) AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {PASSAGE - 2})) AS i FROM w)),
rep AS (SELECT * FROM (SELECT *, min({{'d': doc_id, 'p': place}}) OVER (PARTITION BY g) AS f, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
span AS (SELECT doc_id, place, place + {PASSAGE} AS stop, f.d = doc_id AND f.p = place AS stays,
    CASE WHEN f.d = doc_id THEN greatest(place, f.p + {PASSAGE}) ELSE place END AS start FROM rep),
edge AS (SELECT doc_id, k, sum(a) AS a, sum(b) AS b FROM (
    SELECT doc_id, place AS k, 1 AS a, 0 AS b FROM span UNION ALL SELECT doc_id, stop, -1, 0 FROM span
    UNION ALL SELECT doc_id, start, 0, 1 FROM span WHERE NOT stays AND start < stop UNION ALL SELECT doc_id, stop, 0, -1 FROM span WHERE NOT stays AND start < stop) GROUP BY doc_id, k),
piece AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[ 	-
]+|[^ 	-
]+') AS ps FROM documents)),
sorted AS (SELECT *, regexp_matches(piece, '^[^ 	-
]') AS word, sum(length(piece)) OVER o - length(piece) AS start FROM piece WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, count(*) FILTER (word) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM sorted),
marked AS (SELECT n.*, word AND sum(CASE WHEN word THEN coalesce(a, 0) ELSE 0 END) OVER o > 0 AS again, word AND sum(CASE WHEN word THEN coalesce(b, 0) ELSE 0 END) OVER o > 0 AS gone
    FROM numbered n LEFT JOIN edge e ON e.doc_id = n.doc_id AND e.k = n.k WINDOW o AS (PARTITION BY n.doc_id ORDER BY i)),
cut AS (SELECT *, gone OR (NOT word AND coalesce(lag(gone) OVER o, false) AND coalesce(lead(gone) OVER o, false)) AS goes FROM marked WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT *, CASE WHEN goes AND NOT coalesce(lag(goes) OVER o, false) THEN 1 ELSE 0 END AS opens FROM cut WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, r, min(start) AS x, max(start + length(piece)) AS y FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM runs) WHERE goes GROUP BY doc_id, r),
told AS (SELECT doc_id, string_agg(x::BIGINT || '-' || y::BIGINT, ' ' ORDER BY x) AS removed FROM run GROUP BY doc_id),
made AS (SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT goes), '') AS text, count(*) FILTER (word) AS n_words, count(*) FILTER (again) AS n_repeated, count(*) FILTER (gone) AS n_removed FROM cut GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN m.doc_id IS NULL THEN d.text ELSE m.text END AS text, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_repeated, 0)::BIGINT AS n_repeated,
    coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_repeated, 0) > 0 AS has_repeat, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN made m ON m.doc_id = d.doc_id LEFT JOIN told t ON t.doc_id = d.doc_id"""
