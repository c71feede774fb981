"""Line deduplication by distinct-site spread.

A line that stands on at least `min_sites` different sites is boilerplate and is removed wherever it occurs.
The spread is first estimated: one HyperLogLog sketch of sites per line hash, merged by partial aggregation, so a
line in a third of all documents costs one sketch per task. Only lines whose estimate lies within `margin` of the
threshold are counted exactly. All steps are DataFrame functions.

A document that would lose more than half of the characters of its lines stays as it is if it is shown to be a copy:
its near copies (five-word Jaccard of at least 3/4, itself included) stand on `min_sites` sites by themselves, so that
its lines are spread by copying, which near-duplicate detection must decide. All others lose their spread lines,
whatever share that is. Near copies are looked for among such documents alone: each is compared in full with the pivots
of its least shingles, a pivot being one text for each shingle, so a group of copies costs no pairs.

Defined cases: lines are compared without surrounding ASCII white space; lines without a word are never removed.
A null site counts for no site. A null text stays null and has no lines. Repeated rows are treated alike, each on
its own. Input columns stay; a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import SPACE, maybe_in, saved, word_array

MIN_SITES = 8
LG_K = 12
# Over three standard errors of a sketch with 2^12 registers.
MARGIN = 0.06
MOST_REMOVED = 0.5
# Tasks over which the copies of one text are spread when they meet its hits.
SALTS = 8
# As in the Jaccard join that follows in the pipeline.
WIDTH, LEAST_JACCARD = 5, 0.75
# Pivots that a text is compared with; near copies that share none of so many least shingles are one in 4^8.
PIVOTS = 8


def _normal(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _line_hash(line: Column) -> Column:
    """Null for a line without a word."""
    return F.when(F.length(_normal(line)) > 0, F.xxhash64(_normal(line)))


def site_lines(df: DataFrame, text: str, site: str) -> DataFrame:
    """One row (site, line) per line with a word, lines as hashes."""
    rows = df.select(F.col(site).alias("site"), F.explode(F.split(F.col(text), "\n")).alias("raw"))
    return rows.select("site", _line_hash(F.col("raw")).alias("line")).filter("line IS NOT NULL")


def spread_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
                 margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """Hashes of the lines that stand on at least `min_sites` sites; exact."""
    rows = site_lines(df, text, site)
    estimated = saved(
        rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= F.lit(min_sites * (1 - margin))), "line-spread")
    sure = estimated.filter(F.col("sites") > F.lit(min_sites * (1 + margin))).select("line")
    near = estimated.filter(F.col("sites") <= F.lit(min_sites * (1 + margin))).select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites"))
    return saved(sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("line")), "boilerplate")


def _shingles(text: Column) -> Column:
    """The hashes of all runs of WIDTH words, sorted; a shorter text is one run."""
    words = word_array(text)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(WIDTH - 1), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WIDTH)))))


def copied_texts(rows: DataFrame, text: str, site: str, min_sites: int) -> DataFrame:
    """(__a, __b) of the texts of `rows` whose near copies among them stand on at least `min_sites` sites."""
    rows = rows.select("__a", "__b", F.xxhash64("__a", "__b").alias("node"), F.col(text).alias("text"),
                       F.col(site).alias("site"))
    stands = saved(rows.filter("site IS NOT NULL").select("node", "site").distinct(), "copy-sites")
    sets = saved(rows.groupBy("__a", "__b", "node").agg(F.first("text").alias("text")).select(
        "__a", "__b", "node", _shingles(F.col("text")).alias("shingles")), "copy-sets")
    least = sets.select("node", F.explode(F.slice("shingles", 1, PIVOTS)).alias("shingle"))
    pivots = least.groupBy("shingle").agg(F.min_by("node", F.xxhash64("shingle", "node")).alias("pivot"))
    pairs = saved(least.join(pivots, "shingle").select("node", "pivot").filter("node <> pivot").distinct(), "copy-pairs")
    other = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("others"))
    both = F.size(F.array_intersect("shingles", "others"))
    near = pairs.join(sets.select("node", "shingles"), "node").join(other, "pivot").filter(
        both >= F.lit(LEAST_JACCARD) * (F.size("shingles") + F.size("others") - both)).select("node", "pivot")
    near = saved(near.unionByName(sets.select("node", F.col("node").alias("pivot"))), "copy-links")
    wide = near.join(stands, "node").groupBy("pivot").agg(F.countDistinct("site").alias("sites")).filter(
        F.col("sites") >= min_sites).select("pivot")
    return sets.select("__a", "__b", "node").join(near.join(wide, "pivot", "left_semi"), "node", "left_semi").drop("node")


def remove_lines(df: DataFrame, lines: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
                 most_removed: float | None = None) -> DataFrame:
    """The input without the given lines, plus n_lines, n_removed and `copied` (kept whole).

    With `most_removed`, a document that would lose more than this share is kept whole without further evidence.

    Only hashes are shuffled to find the lines; each text then meets its own short list of hits. Texts are known
    by two hashes, so null and repeated ids need no care, and a text that is copied often is one entry.
    """
    keyed = df.withColumns({"__a": F.xxhash64(text), "__b": F.hash(F.lit(7), F.col(text))})
    raw = F.split(F.col(text), "\n")
    # written, so that the join below has a plain side that Spark may broadcast, and a copied text's rows be split
    hits = (keyed.select("__a", "__b", F.length(F.array_join(raw, "")).alias("whole"), F.posexplode(raw).alias("pos", "raw"))
            .select("__a", "__b", "whole", "pos", F.length("raw").alias("chars"), _line_hash(F.col("raw")).alias("line"))
            .join(lines, "line", "left_semi")
            .groupBy("__a", "__b").agg(F.max("whole").alias("whole"), F.collect_set(F.struct("pos", "chars", "line")).alias("at")))
    gone = F.aggregate("at", F.lit(0), lambda n, x: n + x["chars"])
    share = MOST_REMOVED if most_removed is None else most_removed
    found = saved(hits.select("__a", "__b", F.array_distinct(F.transform("at", lambda x: x["line"])).alias("__hits"),
                              (gone > F.lit(share) * F.col("whole")).alias("__copied")), "line-hits")
    if most_removed is None:
        large = found.filter("__copied").select("__a", "__b")
        asked = maybe_in(keyed, "__a", large).filter("__maybe").drop("__maybe").join(large, ["__a", "__b"], "left_semi")
        copies = saved(copied_texts(asked, text, site, min_sites), "copies").withColumn("__is", F.lit(True))
        found = saved(found.drop("__copied").join(copies, ["__a", "__b"], "left").select(
            "__a", "__b", "__hits", F.coalesce("__is", F.lit(False)).alias("__copied")), "line-hits")
    # texts without a hit stay where they are; the others meet their hits in the same way at every size, copies spread by salts
    marked = maybe_in(keyed, "__a", found)
    salted = marked.filter("__maybe").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    out = salted.join(found.withColumn("__salt", salts).hint("merge"), ["__a", "__b", "__salt"], "left").drop("__salt")
    out = out.unionByName(marked.filter(~F.col("__maybe")), allowMissingColumns=True).drop("__maybe")
    out = out.withColumn("__lines", F.split(F.col(text), "\n"))
    hit = F.coalesce(F.col("__hits"), F.array().cast("array<bigint>"))

    def is_hit(x):
        return F.coalesce(F.array_contains(hit, _line_hash(x)), F.lit(False))

    out = out.withColumn("__kept", F.when(F.size(hit) == 0, F.col("__lines")).otherwise(
        F.filter("__lines", lambda x: ~is_hit(x))))
    n_lines = F.coalesce(F.size(F.filter("__lines", lambda x: _line_hash(x).isNotNull())), F.lit(0))
    out = out.withColumn("copied", F.coalesce("__copied", F.lit(False)))
    return out.withColumns({
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n_lines).cast("bigint"),
        "n_removed": F.when(F.col("copied") | F.col(text).isNull(), F.lit(0)).otherwise(
            F.size("__lines") - F.size("__kept")).cast("bigint"),
        text: F.when(F.col("copied") | (F.size(hit) == 0), F.col(text)).otherwise(F.array_join("__kept", "\n")),
    }).drop("__a", "__b", "__hits", "__copied", "__lines", "__kept")


def dedup_lines(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
                margin: float = MARGIN, most_removed: float | None = None) -> DataFrame:
    return remove_lines(df, spread_lines(df, text, site, min_sites, margin), text, site, min_sites, most_removed)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, without the lines that many sites share."""
    return dedup_lines(docs).select(*docs.columns)


def query(spark, folder: str) -> DataFrame:
    """With the rule of its SQL, which keeps by the removed share alone; the pipeline's stage asks for evidence."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs, most_removed=MOST_REMOVED).select("doc_id", "n_lines", "n_removed", "copied", F.md5("text").alias("text_md5"))


_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH l AS (SELECT doc_id, source, pos, string_split(text, chr(10))[pos] AS line, trim(string_split(text, chr(10))[pos], {_TRIM}) AS norm
           FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(pos)),
b AS (SELECT norm FROM l WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.*, b.norm IS NOT NULL AS gone FROM l LEFT JOIN b ON l.norm = b.norm),
d AS (SELECT doc_id, count(*) FILTER (norm <> '') AS n_lines, count(*) FILTER (gone) AS n_gone,
        coalesce(sum(length(line)) FILTER (gone), 0) > {MOST_REMOVED} * sum(length(line)) AS copied,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, CASE WHEN coalesce(copied, false) THEN 0 ELSE coalesce(n_gone, 0) END::BIGINT AS n_removed,
  coalesce(copied, false) AS copied, md5(CASE WHEN coalesce(copied, false) OR coalesce(n_gone, 0) = 0 THEN text ELSE kept END) AS text_md5
FROM documents t LEFT JOIN d ON t.doc_id = d.doc_id
"""
