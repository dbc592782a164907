"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.corpus import table, texts
from lectern.llm.bpe import token_ids
from lectern.llm.markup import analyse_markup, model
from lectern.llm.mixing import Mix
from lectern.llm.mojibake import Garbled
from lectern.llm.neardup import NearDuplicates, pairs_within
from lectern.llm.spans import FingerprintIndex, shared_spans
from lectern.llm.splitting import split_oversized
from lectern.session import materialize, spread


def _file_texts(spark: SparkSession, sf: str, *attrs: str) -> DataFrame:
    return texts(table(spark, sf, "files"), table(spark, sf, "file_text"), list(attrs))


def _near(spark: SparkSession, sf: str) -> DataFrame:
    rows = _file_texts(spark, sf, "name").filter(~F.col("content").rlike(r"^[\s\u0085   -     　]*$"))
    record = F.concat(F.coalesce("name", F.lit("")), F.lit("\n"), F.col("content"))
    return NearDuplicates(rows.select("file_id", record.alias("text")), threshold=0.6).groups()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of files in one group of versions."""
    return pairs_within(_near(spark, sf)).toDF("file_id_a", "file_id_b")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each file with a text, with its group and number of verified links; a file without links is its own group."""
    return _near(spark, sf).withColumnRenamed("id", "file_id")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of all files that are longer than the limit of their kind."""
    limits = table(spark, sf, "split_limits")
    least = limits.filter("max_chars > 0").agg(F.coalesce(F.min("max_chars"), F.lit(0))).first()[0]  # a settings table
    long = table(spark, sf, "file_text").filter(F.length("content") > least)  # before the text is shuffled
    return split_oversized(texts(table(spark, sf, "files"), long, ["kind"]), limits)


def p2_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The files in pieces put together again: the digest of their text, the longest piece, and the overlaps between pieces."""
    w = W.partitionBy("file_id").orderBy("piece_no")
    pieces = p2_pieces(spark, sf).withColumn("over", F.lag("end").over(w) - F.col("start"))
    new = F.expr("substring(piece, coalesce(over, 0) + 1)")
    parts = F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new"))))  # the pieces of one text
    out = pieces.groupBy("file_id").agg(parts.alias("parts"), F.max(F.length("piece")).alias("longest"), F.min("over").alias("least_over"), F.max("over").alias("most_over"))
    limits = table(spark, sf, "split_limits").groupBy("kind").agg(F.max("max_chars").alias("max_chars"))
    kinds = table(spark, sf, "files").filter("id is not null").groupBy(F.col("id").alias("file_id")).agg(F.max("kind").alias("kind"))
    out = out.join(kinds, "file_id").join(limits, "kind")
    return out.select("file_id", F.md5(F.array_join(F.transform("parts", lambda x: x["new"]), "")).alias("digest"), (F.col("longest") <= F.col("max_chars")).alias("within"), "least_over", "most_over")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that came out in pieces."""
    return p2_pieces(spark, sf).filter("piece_no = 1 and n_pieces > 1").select("file_id")


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Files with garbled passages, with their text as far as it can be restored."""
    return Garbled(_file_texts(spark, sf).select("file_id", "content")).restored().withColumnRenamed("id", "file_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold text decoded with a wrong charset."""
    return p4_restored(spark, sf).select("file_id")


#: Kinds of files whose texts are documents.
_DOCUMENTS = ["markdown", "html", "text", "pdf", "docx", "pptx"]


def _marked(spark: SparkSession, sf: str, with_text: bool) -> DataFrame:
    rows = _file_texts(spark, sf, "kind").filter(F.col("kind").isin(_DOCUMENTS)).select("file_id", "content")
    return analyse_markup(rows, model(), with_text)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The markup languages that occur in each document file."""
    return _marked(spark, sf, False).select(F.col("id").alias("file_id"), F.explode("markups").alias("markup"))


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text of the document files with markup."""
    return _marked(spark, sf, True).filter("clean is not null").select(F.col("id").alias("file_id"), "markups", "clean")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


def _mix(spark: SparkSession, sf: str) -> Mix:
    return Mix(spread(table(spark, sf, "documents").select("doc_id", "text", "source")), table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Each use of a document in the mix."""
    return _mix(spark, sf).rows()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, sf).report()


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """For each source with a target, whether the mix keeps its promises: no document over its cap, uses numbered without a gap, and the
    share reached but for half a block and one document."""
    mix = _mix(spark, sf)
    uses = materialize(mix.rows(), "mix")
    doc = uses.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("use_no").alias("u"), F.max("use_no").alias("most"), F.max("n_tokens").alias("t"))
    per = doc.groupBy("source").agg(F.max("n").alias("uses"), F.min((F.col("n") == F.col("u")) & (F.col("n") == F.col("most"))).alias("numbered"), F.sum(F.col("n") * F.col("t")).alias("tokens"), F.max("t").alias("longest"))
    total = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # over the settings' rows
    off = F.abs(F.col("tokens") - F.col("target_share") * total) <= F.col("longest") + F.lit(mix.block)
    want = spark.createDataFrame([(s, x, mix.repeats[s]) for s, x in mix.shares.items()], "source string, target_share double, max_repeats int")
    out = want.join(per, "source", "left").withColumn("share_kept", off)
    no = F.lit(False)
    return out.select("source", F.coalesce(F.col("uses") <= F.col("max_repeats"), no).alias("cap_kept"), F.coalesce("numbered", no).alias("numbered"), F.coalesce("share_kept", no).alias("share_kept"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of at least 200 characters that other documents have too."""
    return shared_spans(spread(table(spark, sf, "documents").select("doc_id", "text"))).withColumnRenamed("doc", "doc_id")


def p8_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that come in five batches: for each the spans that it shares with documents of its batch and of those before."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    index = FingerprintIndex(spark, fanout=3)
    out = []
    for i in range(5):
        index.add(docs.filter(F.pmod("doc_id", F.lit(5)) == i))
        out.append(materialize(index.new_spans(docs), "new_spans").withColumn("batch_no", F.lit(i)))
    return reduce(lambda a, b: a.union(b), out).withColumnRenamed("doc", "doc_id")


def p8_amount(spark: SparkSession, sf: str) -> DataFrame:
    """For each document with an id the number and characters of its shared spans, and their part of the text; 0 where nothing is shared.
    Rows that repeat an id are one document, as long as its longest row."""
    docs = table(spark, sf, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    spans = p8_found(spark, sf).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    zero = F.lit(0).cast("long")
    out = docs.join(spans, "doc_id", "left").withColumns({"spans": F.coalesce("spans", zero), "shared_chars": F.coalesce("shared_chars", zero)})
    return out.withColumn("part", F.coalesce(F.try_divide(F.col("shared_chars"), F.col("chars")), F.lit(0.0)))


def queries() -> dict[str, Callable]:
    return {
        "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_whole": p2_whole, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_clean": p5_clean, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_kept": p7_kept,
        "p8_found": p8_found, "p8_batches": p8_batches, "p8_amount": p8_amount,
    }


_SPANS_SQL = """WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT DISTINCT doc_id, i FROM w JOIN s USING (h)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS first FROM m),
n AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g)
SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM n GROUP BY doc_id, k"""
_BATCHES_SQL = """WITH d AS (SELECT doc_id, doc_id % 5 AS b, text FROM documents WHERE text IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, b, i, md5(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, b, text, unnest(range(length(text) - 199)) AS i FROM d)),
f AS (SELECT h, arg_min(doc_id, (b, doc_id)) AS doc, min(b) AS b1 FROM w GROUP BY h), s AS (SELECT w.h, min(w.b) AS b2 FROM w JOIN f USING (h) WHERE w.doc_id <> f.doc GROUP BY 1),
m AS (SELECT DISTINCT w.doc_id, w.b, i FROM w JOIN f USING (h) JOIN s USING (h) WHERE CASE WHEN w.doc_id = f.doc THEN b2 ELSE b1 END <= w.b),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS first FROM m),
n AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g)
SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end, CAST(any_value(b) AS INTEGER) AS batch_no FROM n GROUP BY doc_id, k"""
_GROUPS_SQL = """WITH RECURSIVE t AS (SELECT DISTINCT f.id AS file_id, lower(f.name || chr(10) || x.content) AS s FROM file_text x JOIN files f ON f.id = x.file_id WHERE x.content IS NOT NULL AND trim(x.content) <> ''),
k AS (SELECT file_id, regexp_extract_all(regexp_replace(s, '([\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}])', ' \\1 ', 'g'), '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]|[\\p{L}\\p{N}]+') AS a FROM t),
g AS (SELECT DISTINCT file_id, array_to_string(a[i:i + 4], ' ') AS s FROM (SELECT file_id, a, unnest(range(1, len(a) - 3)) AS i FROM k WHERE len(a) >= 5)),
n AS (SELECT file_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.file_id < b.file_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.file_id = a JOIN n y ON y.file_id = b WHERE c >= 0.6 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, b FROM u UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT x AS file_id_a, y AS file_id_b FROM r WHERE x < y"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _GROUPS_SQL,
        "p8_found": _SPANS_SQL,
        "p8_batches": _BATCHES_SQL,
        "p8_amount": f"""SELECT doc_id, coalesce(spans, 0) AS spans, coalesce(shared_chars, 0) AS shared_chars, chars, coalesce(shared_chars / nullif(chars, 0), 0.0) AS part
  FROM (SELECT doc_id, max(coalesce(length(text), 0)) AS chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
  LEFT JOIN (SELECT doc_id, count(*) AS spans, CAST(sum(span_end - span_start) AS BIGINT) AS shared_chars FROM ({_SPANS_SQL}) GROUP BY 1) USING (doc_id)""",
        "p2_whole": """SELECT t.file_id, md5(any_value(t.content)) AS digest, true AS within, any_value(l.overlap_chars) AS least_over, any_value(l.overlap_chars) AS most_over FROM file_text t
  JOIN (SELECT DISTINCT id, kind FROM files) f ON f.id = t.file_id JOIN split_limits l USING (kind) WHERE length(t.content) > l.max_chars GROUP BY 1""",
        "p7_kept": "SELECT DISTINCT source, true AS cap_kept, true AS numbered, true AS share_kept FROM mix_targets WHERE source IS NOT NULL AND target_share > 0",
        "p2_found": """SELECT DISTINCT t.file_id FROM file_text t JOIN (SELECT DISTINCT id, kind FROM files) f ON f.id = t.file_id
JOIN split_limits l USING (kind) WHERE length(t.content) > l.max_chars""",
    }
