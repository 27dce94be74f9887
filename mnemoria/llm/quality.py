"""Quality rules: counts within a document, and how often its lines occur across the documents of a host.

DataFrame operations only. Texts are read once: counts and hashed lines go to a stored table, on which the line
frequencies are grouped and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.llm.common import WORD, documents, stored, text_or_empty, with_columns

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    most_repeat_share: float = 0.2
    #: Lines of fewer words are no evidence of copying, and are never removed.
    least_line_words: int = 4
    #: A line is removed if more documents of a host hold it than this many, however large the host is.
    most_docs: int = 10
    #: A document is depleted if fewer words stay than this, or than this share of its own.
    least_words_left: int = 5
    least_share_left: float = 0.2


# Words that lie in a 5-word window which occurs twice or more. ``wh`` has a hash per word, ``h`` one per window. Most
# texts repeat no window, which one pass over a hash set tells; for the others, windows are sorted by hash so that
# repeats are neighbours, and the words that the repeated windows cover are counted in order of place.
REPEATED_WORDS = """
transform(array(transform(words, w -> xxhash64(w))), wh -> if(size(wh) < 6, 0,
  transform(array(transform(sequence(0, size(wh) - 5), i -> xxhash64(wh[i], wh[i+1], wh[i+2], wh[i+3], wh[i+4]))), h ->
    if(size(array_distinct(h)) = size(h), 0,
      transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s ->
        aggregate(
          sort_array(transform(
            filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false)), x -> x.i)),
          named_struct('before', -5, 'total', 0),
          (a, i) -> named_struct('before', i, 'total', a.total + least(5, i - a.before)),
          a -> a.total
        )
      )[0]
    )
  )[0]
))[0]
"""


def hashed(line: Column) -> Column:
    """A line, given as its words, as (line, words): the hash in lower case, and their number."""
    return F.struct(F.xxhash64(F.lower(F.array_join(line, " "))).alias("line"), F.size(line).alias("words"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts of ``text`` (null: no words) and ``lines``, its lines as (hash, words)."""
    whole = text_or_empty(text)
    cut = docs.withColumn("__text", whole).withColumn(
        "__raw_lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ).withColumn("__words", F.transform("__raw_lines", lambda x: F.regexp_extract_all(x, F.lit(WORD), 0)))
    flat = cut.withColumn("words", F.flatten("__words"))

    out = with_columns(
        flat,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.translate("__text", SPACE, "")).cast("long"),
        n_symbols=(F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size("__raw_lines") - F.size(F.array_distinct("__raw_lines"))).cast("long"),
        n_repeat_words=F.expr(REPEATED_WORDS).cast("long"),
        lines=F.transform("__words", hashed),
    )
    return out.drop("__text", "__raw_lines", "__words", "words")


def frequent_lines(lines: DataFrame, rules: Rules) -> DataFrame:
    """(__host, __line): lines above the limit, from rows of (host, doc, line); a null host counts as one host."""
    # (host, line, document) first: a line that fills a third of all documents is then counted in parts.
    return stored(
        lines.groupBy("host", "line", "doc").agg(F.lit(1).alias("one"))
        .groupBy(F.col("host").alias("__host"), F.col("line").alias("__line")).agg(F.count("*").alias("docs"))
        .where(F.col("docs") > rules.most_docs).select("__host", "__line"),
        "quality-frequent",
    )


def is_frequent() -> Column:
    return (F.col("line") == F.col("__line")) & F.col("host").eqNullSafe(F.col("__host"))


def quality(docs: DataFrame, host: str = "source", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, host): its counts, ``base_failed``, ``lost_words`` and ``kept``.

    Lines are compared in lower case with white space collapsed. A host's documents are counted by distinct doc_id
    (rows without an id count singly, repeated rows once); rows without a host share one. ``lost_words`` counts words in lines
    above the limit. A document is kept unless its base rules fail or the lines left are too few. Other columns of ``docs``
    do not matter; an empty table gives none. ``without_frequent_lines`` gives the texts that are left.
    """
    narrow = docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text"))
    rows = stored(counted(narrow).drop("text").withColumn("row", F.monotonically_increasing_id()), "quality-counts")
    doc = F.coalesce(F.col("doc_id"), -1 - F.col("row"))
    lines = rows.select("row", "host", doc.alias("doc"), F.explode("lines").alias("l")).select(
        "row", "host", "doc", "l.line", "l.words"
    ).where(F.col("words") >= rules.least_line_words)
    lost = lines.join(frequent_lines(lines, rules), is_frequent()).groupBy("row").agg(F.sum("words").alias("lost_words"))
    left = F.col("n_words") - F.col("lost_words")
    base_failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > round(100 * rules.most_repeat_share) * F.col("n_words")
    )
    depleted = (F.col("lost_words") > 0) & (
        (left < rules.least_words_left) | (left < rules.least_share_left * F.col("n_words"))
    )
    return (
        rows.drop("lines").join(lost, "row", "left").fillna(0, ["lost_words"])
        .withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row")
    )


def without_frequent_lines(
    docs: DataFrame, host: str = "source", text: str = "text", rules: Rules = Rules(), id: str = "doc_id"
) -> DataFrame:
    """``docs`` with the lines above the limit cut out of ``text``; all other lines, their order and columns stay.

    The same lines go that ``quality`` counts as lost. A text that loses none is left as it is (null too); one that loses
    all becomes empty. Only texts that lose a line are taken apart; at most one text is put together in one place.
    """
    table = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "quality-texts")
    plain = table.select(F.col("__row").alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    cut = plain.select(
        "row", "host", F.coalesce("id", -1 - F.col("row")).alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("place", "raw")
    )
    lines = cut.withColumn("l", hashed(F.regexp_extract_all("raw", F.lit(WORD), 0))).select("row", "host", "doc", "place", "raw", "l.*")
    counted_lines = lines.where(F.col("words") >= rules.least_line_words).select("row", "host", "doc", "line")
    frequent = frequent_lines(counted_lines, rules)
    losing = stored(counted_lines.join(frequent, is_frequent(), "left_semi").select(F.col("row").alias("__row")).distinct(), "quality-losing")
    shown = F.when(F.col("words") >= rules.least_line_words, F.col("line"))
    left = (
        lines.join(losing, F.col("row") == F.col("__row"), "left_semi").withColumn("line", shown)
        .join(frequent, is_frequent(), "left_anti")
        .groupBy(F.col("row").alias("__kept_row")).agg(F.array_sort(F.collect_list(F.struct("place", "raw"))).alias("__left"))
    )
    rebuilt = F.when(F.col("__loses"), F.coalesce(F.array_join("__left.raw", "\n"), F.lit(""))).otherwise(F.col(f"`{text}`"))
    return (
        table.join(losing.withColumn("__loses", F.lit(True)), "__row", "left")
        .join(left, F.col("__row") == F.col("__kept_row"), "left")
        .select(*[rebuilt.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    got = quality(documents(spark, sf_dir))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"
    )


# The same rows in SQL: windows and lines as rows.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS r(i) WHERE len(w) >= 5
), hit AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, 5)) AS o(k) WHERE c > 1 GROUP BY doc_id
), raw AS (
  SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d
), line AS (
  SELECT doc_id, source, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line GROUP BY doc_id
), norm AS (
  SELECT doc_id, source, lower(array_to_string(w, ' ')) AS l, len(w) AS n FROM line WHERE len(w) >= 4
), freq AS (
  SELECT source, l FROM norm GROUP BY source, l HAVING count(DISTINCT doc_id) > 10
), lost AS (
  SELECT n.doc_id, sum(n.n) AS n FROM norm n JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.l = f.l GROUP BY n.doc_id
), base AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (lost_words > 0 AND (n_words - lost_words < 5 OR n_words - lost_words < 0.2 * n_words)) AS kept,
  lost_words
FROM base
"""
