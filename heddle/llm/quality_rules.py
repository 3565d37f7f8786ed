"""Host-level quality rules.

Rules are counted for every document, their failures summed by host, and each host's failure rate
shrunk towards an empirical beta prior, so that a host of few documents isn't judged by one of them.
Host verdicts are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from heddle.llm.common import EXACT, ODD, SPACES, append_columns, bounded_bytes, looked_up, materialise, mix_bits, word_hashes

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: list) -> int:
    """Words that lie in a window of WINDOW words found twice or more.

    Windows are numbered by ranking pairs, exactly: a window of k + 1 words is the number of its first k and its last word.
    Only windows whose first k words are found again go on.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    at, codes = np.arange(n), ids[:n]
    for k in range(1, WINDOW):
        codes = codes * len(numbers) + ids[at + k]
        order = np.argsort(codes)
        ranked = codes[order]
        new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        sizes = np.diff(np.r_[new, len(ranked)])
        again = np.repeat(sizes > 1, sizes)
        if not again.any():
            return 0
        at, codes = at[order[again]], np.repeat(np.arange(len(new)), sizes)[again]
    marked = np.zeros(len(words), bool)
    for k in range(WINDOW):
        marked[at + k] = True
    return int(marked.sum())


def _may_repeat(texts: list[bytes]) -> Iterator[bool]:
    """For each text, if two of its windows have one hash: where none have, none are equal."""
    ends = np.cumsum([0, *map(len, texts)])
    for lo, hi in bounded_bytes(ends):
        h, at = word_hashes(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), ends[lo : hi + 1] - ends[lo], EXACT)
        windows = np.zeros(max(0, len(h) - WINDOW + 1), np.uint64)
        for i in range(WINDOW):
            windows += h[i : i + len(windows)] * ODD[i]
        windows = mix_bits(windows)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            ranked = np.sort(windows[a : max(a, b - WINDOW + 1)])
            yield bool((ranked[1:] == ranked[:-1]).any())


def counts(text: str | None, may_repeat: bool = True) -> tuple[int, int, int, int, int]:
    """COUNTS of one text; none of a null text. Unless `may_repeat`, no window is looked for."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words) if may_repeat else 0


def _counts_of(texts: list[str | None]) -> Iterator[tuple]:
    """COUNTS of texts, a column each."""
    again = _may_repeat([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    return zip(*map(counts, texts, again), strict=True) if texts else iter([[]] * len(COUNTS))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the columns COUNTS appended (taking the place of columns so named)."""
    return append_columns(docs, [text_col], [StructField(c, LongType()) for c in COUNTS], lambda: _counts_of)


def base_failed(min_words: int = 10, max_repeat_percent: int = 20):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def any_rule_failed(max_symbol_percent: int = 30, max_dup_line_words: int = 10):
    """A document's rules, as summed by host: the base rules, many symbols, many repeated lines."""
    symbols = 100 * F.col("n_symbols") > max_symbol_percent * F.col("n_words")
    lines = F.col("n_dup_lines") * max_dup_line_words > F.col("n_words")
    return base_failed() | symbols | lines


def host_rates(counted: DataFrame, host_col: str = "source") -> DataFrame:
    """(host, n, failures, rate): the mean of each host's beta posterior.

    The prior's mean is the corpus rate and its weight comes from the spread of the hosts' rates
    beyond what chance gives (method of moments); with no such spread the prior outweighs any host.
    Documents without a host form no host. Sums are pre-aggregated, so a hot host costs one row a task.
    """
    hosts = counted.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(any_rule_failed().cast("long")).alias("failures"))
    totals = hosts.agg(F.sum("n").alias("all_n"), F.sum("failures").alias("all_k"), F.count(F.lit(1)).alias("n_hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n_squares"), F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("n")).alias("k_squares"))
    mu = F.col("all_k") / F.col("all_n")
    spread = F.col("k_squares") - F.col("all_n") * mu * mu - (F.col("n_hosts") - 1) * mu * (1 - mu)
    room = F.col("all_n") - F.col("n_squares") / F.col("all_n")
    between = F.when(room > 0, spread / F.when(room > 0, room))
    weight = F.when(between > 0, F.least(F.lit(1e6), F.greatest(F.lit(2.0), mu * (1 - mu) / F.when(between > 0, between) - 1))).otherwise(F.lit(1e6))
    prior = totals.where("all_n > 0").select(mu.alias("mu"), weight.alias("weight"))
    # the prior is one row
    return hosts.join(F.broadcast(prior), how="inner", on=F.lit(True)).select("host", "n", "failures", ((F.col("failures") + F.col("mu") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row a document: id, COUNTS, base_failed, kept.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most
    `max_rate`. Null and empty texts have no words and fail; a null host passes; repeated rows are
    judged and counted row by row; an empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    counted = materialise(with_counts(narrow, "__text").drop("__text"), "quality")
    joined = looked_up(counted, bad_hosts(counted, "__host", max_rate), {"__host": "__bad"}).withColumn("base_failed", base_failed())
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("__bad").isNull()).alias("kept"))


def bad_hosts(counted: DataFrame, host_col: str, max_rate: float) -> DataFrame:
    """(__bad): the hosts whose shrunk failure rate is over `max_rate`, stored."""
    return materialise(host_rates(counted, host_col).where(F.col("rate") > max_rate).select(F.col("host").alias("__bad")), "quality-hosts")


def keep_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of `docs`, with their columns, that quality_verdicts would keep.

    So null, empty and short texts go, rows without a host are judged by the base rules alone, repeated
    rows stay or go together, an empty table stays empty, and columns may have any names. Texts are
    counted once: the table between holds the rows with their counts, the texts of failed ones left out.
    """
    names = [f"__{i}" for i in range(len(docs.columns))]
    text, host = (names[docs.columns.index(c)] for c in (text_col, host_col))
    counted = with_counts(docs.toDF(*names), text)
    counted = materialise(counted.withColumn(text, F.when(~base_failed(), F.col(text))), "quality")
    kept = looked_up(counted.where(~base_failed()), bad_hosts(counted, host, max_rate), {host: "__bad"}).where("__bad is null")
    return kept.select(*[F.col(a).alias(c) for a, c in zip(names, docs.columns, strict=True)])


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base
), windows AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 6
), shingles AS (
  SELECT doc_id, i, w[i:i+4] AS s FROM windows
), found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM shingles
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM found, (SELECT unnest(range(0, 5)) AS k) WHERE c > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT words.doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id LEFT JOIN lines ON lines.doc_id = words.doc_id
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words OR 10 * n_dup_lines > n_words AS failed
  FROM counted
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM judged WHERE source IS NOT NULL GROUP BY source
), totals AS (
  SELECT sum(n) AS an, sum(k) AS ak, count(*) AS h, sum(n * n) AS nn, sum(k * k / n) AS kk FROM hosts
), spread AS (
  SELECT ak / an AS mu, (kk - ak * ak / an - (h - 1) * (ak / an) * (1 - ak / an)) / nullif(greatest(an - nn / an, 0), 0) AS b FROM totals
), prior AS (
  SELECT mu, CASE WHEN b > 0 THEN least(1e6, greatest(2.0, mu * (1 - mu) / b - 1)) ELSE 1e6 END AS m FROM spread
), bad AS (
  SELECT source FROM hosts, prior WHERE (k + mu * m) / (n + m) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM judged
"""


def op1_host_quality(spark, sf_dir):
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
