"""Line dedup by overlapping windows of three lines, over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAP_BITS, bits_for, fresh, keys_map, materialize, may_be_in_map

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(id, body, pos, w1, w2): every run of three lines, hashed to 96 bits."""
    hashed = docs.select("id", "body", F.transform(F.split("text", "\n"), lambda s: F.xxhash64(s)).alias("h"))
    runs = hashed.where(F.size("h") >= WINDOW).select(
        "id", "body", F.posexplode(F.arrays_zip(F.slice("h", 1, F.size("h") - 2).alias("a"), F.slice("h", 2, F.size("h") - 2).alias("b"), F.slice("h", 3, F.size("h") - 2).alias("c"))).alias("pos", "r")
    )
    return runs.select("id", "body", "pos", F.xxhash64("r.a", "r.b", "r.c").alias("w1"), F.hash("r.c", "r.a", "r.b").alias("w2"))


def repeated_line_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, ranges): the merged line ranges ``struct(lo, hi)``, both inclusive,
    that later occurrences of a repeated window cover. ``body`` hashes the
    text, so a row is known by its id and text even where ids are NULL or repeat."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("body", F.xxhash64("text"))
    runs = _windows(base)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "body", "pos")
    firsts = runs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("w1", "w2", "first")
    later = runs.join(firsts, ["w1", "w2"]).where(place != F.col("first")).select("id", "body", "pos").distinct()
    by_doc = Window.partitionBy("id", "body").orderBy("pos")
    apart = F.coalesce(F.col("pos") > F.lag("pos").over(by_doc) + WINDOW, F.lit(True))
    islands = later.withColumn("apart", apart).withColumn("island", F.sum(F.col("apart").cast("int")).over(by_doc))
    merged = islands.groupBy("id", "body", "island").agg(F.min("pos").alias("lo"), (F.max("pos") + WINDOW - 1).alias("hi"))
    return merged.groupBy("id", "body").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """``docs`` with later occurrences of repeated three-line windows cut out.

    Lines are what newlines part; three consecutive ones are hashed to 96 bits, and a
    window that occurs before (by id, then text hash, then position; NULL ids last)
    loses all three lines. Covered positions are merged, and what remains is joined
    again. Documents of fewer than three lines have no window and stay as they are,
    as do NULL texts; one that loses every line keeps its row with an empty text.
    Blank lines count as lines. Rows that repeat with both id and text count as one
    occurrence and fare alike. The rows returned are as many as those given, with all
    their columns; ``n_chars`` is brought up to date where the text changed.

    Only the hashes of all windows are shuffled, and the texts of documents that may
    lose lines (a bitmap tells, sized by how many they are); all other texts stay where they are.
    """
    flag, body, ranges, lines, kid, kbody = fresh(docs, "ld_flag", "ld_body", "ld_ranges", "ld_lines", "ld_kid", "ld_kbody")
    cuts = materialize(repeated_line_ranges(docs, id_col, text_col), "line-cuts")
    map_bits = bits_for(cuts.count(), map_bits)
    bitmap = keys_map(cuts, "body", map_bits)
    rows = may_be_in_map(docs.withColumn(body, F.xxhash64(text_col)), F.col(body), bitmap, flag, map_bits)
    same = rows.where(~F.col(flag)).select(*docs.columns)
    cuts = cuts.select(F.col("id").alias(kid), F.col("body").alias(kbody), F.col("ranges").alias(ranges))
    joined = rows.where(F.col(flag)).join(cuts, F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(body) == F.col(kbody)), "left")
    out = joined.withColumn(lines, F.split(text_col, "\n"))
    spans = F.col(ranges)
    # the gaps between the cut ranges: first line, how many
    lows = F.concat(F.array(F.lit(0)), F.transform(spans, lambda r: r["hi"] + 1))
    highs = F.concat(F.transform(spans, lambda r: r["lo"]), F.array(F.size(lines)))
    gaps = F.filter(F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))), lambda g: g["n"] > 0)
    text = F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice(F.col(lines), g["at"] + 1, g["n"]), "\n")), "\n")
    out = out.withColumn(text_col, F.when(spans.isNull(), F.col(text_col)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return same.unionByName(out.select(*docs.columns))


def op9_line_dedup(spark, sf_dir) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
with l as (select doc_id, lang, source, n_chars, text, string_split(text, chr(10)) as ls from documents),
p as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as p from l),
w as (select doc_id, p, row_number() over (partition by ls[p], ls[p + 1], ls[p + 2] order by doc_id, p) as nth from p where p + 2 <= len(ls)),
cov as (select distinct doc_id, p + i as p from w, range(3) t(i) where nth > 1),
hit as (select distinct doc_id from cov),
kept as (
    select p.doc_id, string_agg(p.ls[p.p], chr(10) order by p.p) filter (where cov.p is null) as text
    from p join hit using (doc_id) left join cov on cov.doc_id = p.doc_id and cov.p = p.p group by p.doc_id
)
select l.doc_id, case when kept.doc_id is null then l.text else coalesce(kept.text, '') end as text, l.lang, l.source,
    case when kept.doc_id is null then l.n_chars else length(coalesce(kept.text, '')) end as n_chars
from l left join kept on kept.doc_id = l.doc_id
"""
