"""Quality rules: repetition coverage.

Words get numbers within their document; rolling hashes of several n-gram lengths
over those numbers are numpy arrays, each length from the one below. N-grams
that occur again are found by sorting the hashes, and the characters that they and
repeated lines cover are summed. One scan, no shuffle; a batch and one document's
arrays are all that is held.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from orrery.llm.common import free_name, table

#: Largest share of characters inside repeated n-grams (the first occurrence not
#: counted), by n. One repeated line in a short text stays below it.
MAX_NGRAM_SHARE = dict.fromkeys(range(5, 11), 0.20)
#: Largest share of characters in repeated lines. (Their count is no criterion: one
#: short repeated line of three says little about a text.)
MAX_LINE_CHARS = 0.30
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_chars long, dup_ngram_share array<double>, kept boolean"

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mixed(ids: np.ndarray) -> np.ndarray:
    """64 well-mixed bits for each number."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * _MULT
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _again(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose value occurs elsewhere too, and those where it has occurred before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    later = order[1:][same]
    return np.union1d(later, order[:-1][same]) if len(later) else later, later


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    marks = np.zeros(words + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + n, -1)
    return np.cumsum(marks[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The values of FIELDS for one text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in raw.split(b"\n"):
        if line.strip():
            if line in seen:
                dup_lines += 1
                dup_chars += len(line.decode("utf-8", "surrogatepass"))
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    shares = dict.fromkeys(MAX_NGRAM_SHARE, 0.0)
    repeat_words = 0
    if n > min(MAX_NGRAM_SHARE) and len(number) < n:
        values = mixed(ids)
        h, power, chars = values.copy(), _MULT, None
        with np.errstate(over="ignore"):
            for k in range(2, min(max(MAX_NGRAM_SHARE), n - 1) + 1):
                h = h[:-1] + power * values[k - 1 :]
                power = power * _MULT
                if k in shares or k == WINDOW:
                    both, later = _again(h)
                    if not len(later):
                        break  # a longer n-gram can't repeat either
                    if k == WINDOW:
                        repeat_words = int(_covered(both, k, n).sum())
                    if k in shares:
                        if chars is None:
                            chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
                        shares[k] = float(chars[_covered(later, k, n)].sum()) / word_chars
    failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    fine = all(shares[k] <= most for k, most in MAX_NGRAM_SHARE.items()) and dup_chars <= MAX_LINE_CHARS * len(text)
    return n, word_chars, symbols, dup_lines, repeat_words, failed, dup_chars, list(shares.values()), not failed and fine


def _measured(texts: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return pd.DataFrame([measure(t) for t in texts], columns=names)


def quality(text: Column) -> Column:
    """A struct of FIELDS: counts, the shares for each n, the verdicts base_failed and kept.

    Null, empty and blank texts have no words and are rejected. A text of any length is
    measured whole. Rows are judged one by one, so repeated rows, ties, other columns
    and empty tables need no rule.
    """
    return pandas_udf(_measured, FIELDS)(text)


def keep_good(docs: DataFrame, text_col="text") -> DataFrame:
    """The rows of docs that quality() keeps, with their columns, whatever their names. Null and empty texts have too few words and go."""
    mark = free_name(docs)
    return docs.withColumn(mark, quality(F.col(text_col))).where(F.col(mark)["kept"]).drop(mark)


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = docs.select("doc_id", quality(F.col("text")).alias("q"))
    return q.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept")


def quality_sql(docs: str = "documents") -> str:
    """WITH parts that end in q_rows: the rows of docs with the counts and verdicts."""
    lengths = ", ".join(map(str, MAX_NGRAM_SHARE))
    most = " OR ".join(f"(n = {k} AND share > {v}::DOUBLE)" for k, v in MAX_NGRAM_SHARE.items())
    return rf"""
q_doc AS (SELECT *, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
    coalesce(string_split(text, chr(10)), []) AS ls FROM {docs}),
q_base AS (SELECT *, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    coalesce(length(text) - length(translate(text, '{SYMBOLS}', '')), 0)::BIGINT AS n_symbols FROM q_doc),
q_line AS (SELECT rid, l, count(*) AS c FROM (SELECT rid, unnest(ls) AS l FROM q_doc) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l),
q_lines AS (SELECT rid, sum(c - 1)::BIGINT AS n_dup_lines, sum((c - 1) * length(l))::BIGINT AS dup_chars FROM q_line GROUP BY rid),
q_gram AS (SELECT rid, n, i, list_slice(ws, i, i + n - 1) AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM q_doc, (SELECT unnest([{lengths}]) AS n))),
q_dup AS (SELECT *, count(*) OVER p AS c, min(i) OVER p AS first FROM q_gram WINDOW p AS (PARTITION BY rid, n, g)),
q_pos AS (SELECT DISTINCT rid, n, i + unnest(range(0, n)) AS p, first < i AS later FROM q_dup WHERE c > 1),
q_rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_repeat_words FROM q_pos WHERE n = {WINDOW} GROUP BY rid),
q_share AS (SELECT rid, n, sum(length(ws[p]))::DOUBLE / any_value(word_chars) AS share FROM (SELECT DISTINCT rid, n, p FROM q_pos WHERE later) JOIN q_base USING (rid) GROUP BY rid, n),
q_bad AS (SELECT DISTINCT rid, true AS bad FROM q_share WHERE {most}),
q_all AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(bad, false) AS bad,
    coalesce(dup_chars, 0) AS dup_chars FROM q_base b LEFT JOIN q_lines USING (rid) LEFT JOIN q_rep USING (rid) LEFT JOIN q_bad USING (rid)),
q_rows AS (SELECT * EXCLUDE (rid, ws, ls, bad, dup_chars), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT base_failed AND NOT bad AND dup_chars <= {MAX_LINE_CHARS}::DOUBLE * coalesce(length(text), 0) AS kept FROM q_all)"""


OP4_SQL = f"WITH {quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_rows"
