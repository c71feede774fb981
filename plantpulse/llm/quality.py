"""Quality rules: a table of thresholds compiled into one Spark projection.

Every rule bounds one ratio of a text. All figures are built-in column functions over the whole text, so the
scan, the figures and the verdict are one stage without a shuffle and without user functions.

Defined cases: a null or empty text has no words, all its figures are 0 and it fails `min_words`. Ratios over
nothing are 0. Repeated rows are judged alike, each on its own. Columns of the input stay; a column that has
the name of a figure is replaced by the figure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import empty_if_null, word_array

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on with as are at by this from or be an a not "
    "le la les de du des et en un une que qui est dans pour par au aux sur pas avec "
    "der die das und den von zu mit ist im dem für ein eine als auf nicht sich auch "
    "el los las y del con una para se no es lo como").split()


@dataclass(frozen=True)
class Rule:
    """`figure` must lie in [low, high] in texts of at least `from_words` words; None leaves a side open."""
    name: str
    figure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("min_words", "n_words", low=10),
    Rule("repeated_words", "repeat_ratio", high=0.2),
    Rule("word_length", "mean_word_chars", low=2, high=12),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("stop_words", "stop_ratio", low=0.06, from_words=50),
)


def figures(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    body = empty_if_null(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    marked = df.withColumns({
        "__words": word_array(body), "__lines": lines,
        "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint")})
    marked = marked.withColumns({
        "n_words": F.size("__words").cast("bigint"), "n_lines": F.size("__lines").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_stop_words": F.size(F.filter(
            "__words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS))).cast("bigint"),
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w))})
    return _repeated(marked).drop("__words", "__lines", "__hashes")


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside windows that occur more than once.

    Windows are sorted by hash with their place; equal neighbours give the places of repeated windows, and in
    order of place each window adds the words up to the next one, at most its own five.
    """
    places = F.sequence(F.lit(0), F.size("__hashes") - WINDOW)

    def window(i: Column) -> Column:
        parts = [F.get("__hashes", i + k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*parts).alias("h"), i.alias("p"))

    none = F.array().cast("array<struct<h:bigint,p:int>>")
    sorted_windows = F.sort_array(F.when(F.size("__hashes") >= WINDOW, F.transform(places, window)).otherwise(none))
    out = df.withColumn("__windows", sorted_windows)
    same = lambda x, i, step: F.coalesce(x["h"] == F.get("__windows", i + step)["h"], F.lit(False))
    repeated = F.transform("__windows", lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["p"]))
    out = out.withColumn("__places", F.sort_array(F.array_compact(repeated)))
    covered = F.transform("__places", lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get("__places", i + 1) - p, F.lit(WINDOW))))
    return out.withColumn("n_repeat_words", F.aggregate(
        covered, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("__windows", "__places")


def ratios() -> dict[str, Column]:
    """What rules may bound, as columns over the figures."""
    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    return {
        "n_words": F.col("n_words"), "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"), "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"), "stop_ratio": share("n_stop_words", "n_words")}


def failed(rule: Rule) -> Column:
    value = ratios()[rule.figure]
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (value < F.lit(rule.low))
    if rule.high is not None:
        bad = bad | (value > F.lit(rule.high))
    return bad & (F.col("n_words") >= rule.from_words)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input with its figures, `failed_rules` (names, in table order) and `kept`."""
    names = F.array_compact(F.array(*[F.when(failed(r), r.name) for r in rules]))
    # the part number is never negative; it only stops the optimizer from copying all figures into a filter on `kept`
    # at every projection below, which takes longer than the filter itself
    kept = (F.size("failed_rules") == 0) & (F.spark_partition_id() >= 0)
    return figures(df, text).withColumn("failed_rules", names).withColumn("kept", kept)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass every rule."""
    return judge(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text")), "__text").filter(
        "kept").select("__row.*")


def query(spark, folder: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
           FROM documents),
wins AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) AS u(p)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM wins) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p + q) AS n FROM rep, unnest(range(0, 5)) AS v(q) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOP_SQL}))) AS n_stop,
        coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
g AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1
    AND n_dup_lines / greatest(len(lines), 1) <= 0.5 AND (n_words < 50 OR n_stop / n_words >= 0.06) AS kept
FROM g
"""
