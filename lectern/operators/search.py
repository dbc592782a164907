"""Ranked full-text search over a catalogue of texts.

A query is compiled on the driver into phrases. With a kept ``TextIndex`` a word costs the reading of its postings, a phrase the
postings of its words, a substring with CJK characters the postings of its trigrams and the texts of the candidates; without one
the same answers come from one scan of all texts. Statistics (number of texts, mean length, document frequencies) are global: they are taken
before any filter. Ranking carries ids and numbers only; texts are joined back for the page that is shown.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.commits import CommitLog
from lectern.functions.text import ascii_lower, fold, like_contains, occurrences, padded, snippet, tokens
from lectern.operators.catalog import ICONS, lookup
from lectern.operators.documents import locate_units, section_texts
from lectern.session import hash_ranges, materialize, remove, scratch

TERMS_MOST = 16
TOP_WORD, TOP_GRAM, TOP_LIKE, LIKE_BELOW = 300, 300, 500, 12
WEIGHTS = {"name": 10.0, "path": 4.0, "content": 1.0}
_RUN = re.compile(r"\w+")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")


def query_terms(q: str) -> list[str]:
    """The runs of word characters of a query, at most 16."""
    return _RUN.findall(q or "")[:TERMS_MOST]


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False

    @property
    def needle(self) -> str:
        return " " + "  ".join(self.words) + ("" if self.prefix else " ")


def _fold_literal(s: str) -> str:
    from lectern.functions.text import MARKED, PLAIN

    return s.lower().translate(str.maketrans(MARKED, PLAIN))


def compile_query(q: str, prefix_last: bool = True) -> list[Phrase]:
    """Each term a phrase of its index tokens; all must match. The last becomes a prefix if it is ASCII with 3 letters or more."""
    out = []
    terms = query_terms(q)
    for i, t in enumerate(terms):
        words = [w for w in re.findall(r"[^\W_]+", _fold_literal(t)) if w]
        if words:
            out.append(Phrase(words, prefix_last and i + 1 == len(terms) and t.isascii() and len(t) >= 3))
    return out


def engine_for(q: str, has_index: bool = True) -> tuple[str, bool, str]:
    """(engine, degraded, hint): like without an index or for CJK terms of one or two characters only; with any CJK the substring
    index too; else words."""
    terms = query_terms(q)
    if not has_index:
        return "like", True, "no index"
    cjk = [t for t in terms if _CJK.search(t)]
    if terms and len(cjk) == len(terms) and all(len(t) < 3 for t in cjk):
        return "like", True, "short terms"
    return ("word+gram" if cjk else "word"), False, ""


@dataclass
class Filters:
    """Conjunctive catalogue filters; what is empty doesn't filter. Times are epoch seconds, inclusive; what can't be parsed is
    ignored."""

    kb_id: int | None = None
    kinds: list[str] = field(default_factory=list)
    exts: list[str] = field(default_factory=list)
    since: float | str | None = None
    until: float | str | None = None
    prefix: str = ""

    def column(self) -> Column:
        parts = [~F.coalesce(F.col("is_deleted"), F.lit(False)), ~F.coalesce(F.col("is_dir"), F.lit(False))]
        if self.kb_id:
            parts.append(F.col("kb_id") == self.kb_id)
        if self.kinds:
            parts.append(F.col("kind").isin(self.kinds))
        if self.exts:
            parts.append(F.col("ext").isin(["." + e.lower().lstrip(".") for e in self.exts]))
        for value, op in ((self.since, "__ge__"), (self.until, "__le__")):
            try:
                if value not in (None, ""):
                    parts.append(getattr(F.col("mtime_ns"), op)(int(float(value) * 1e9)))
            except ValueError:
                pass
        if p := self.prefix.strip("/"):
            parts.append((F.col("rel_path") == p) | F.startswith("rel_path", F.lit(p + "/")))
        return reduce(lambda a, b: a & b, parts)


def _latest(texts: DataFrame, key: str, cols: list[Column]) -> DataFrame:
    """(key, cols) of the last indexed row of each text. The columns are computed before the shuffle, so that numbers travel and
    texts stay; without a column ``indexed_at`` the rows are taken as they are."""
    if "indexed_at" not in texts.columns:
        return texts.select(key, *cols)
    own = texts.filter(F.col(key).isNotNull()).select(key, F.struct("indexed_at", "name", "path", F.struct(*cols).alias("v")).alias("row"))
    return own.groupBy(key).agg(F.max("row").alias("row")).select(key, "row.v.*")


def bm25(texts: DataFrame, phrases: list[Phrase], key: str = "file_id", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(key, bm25): negative scores, the best lowest, of the texts that hold every phrase inside one field each.

    One scan: counts of the phrases and lengths, the counts only where the phrase's first word occurs at all; the statistics are
    one row, joined back. Null fields count as empty; with no phrase or an empty table the result is empty.
    """
    fields = [c for c in weights if c in texts.columns]
    if not phrases:
        return texts.select(key, F.lit(0.0).alias("bm25")).limit(0)
    cols = [reduce(lambda a, b: a + b, [F.coalesce(F.regexp_count(F.lower(c), F.lit(r"[\p{L}\p{N}]+")), F.lit(0)) for c in fields]).alias("len")]
    for i, p in enumerate(phrases):
        each = [F.when(F.contains(fold(F.col(c)), F.lit(p.words[0])), weights[c] * occurrences(padded(F.col(c)), p.needle)).otherwise(0.0) for c in fields]
        cols.append(reduce(lambda a, b: a + b, each).alias(f"f{i}"))
    rows = _latest(texts, key, cols)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(phrases))])
    both = rows.filter(reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(phrases))])).join(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(phrases)):
        raw = F.ln((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        f = F.col(f"f{i}")
        total = total + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    return both.select(key, (-total).alias("bm25"))


def grams(texts: DataFrame, phrases: list[str], key: str = "file_id", fields: tuple[str, ...] = ("name", "path", "content")) -> DataFrame:
    """(key): texts with every phrase as a substring of some field, whatever the case; phrases under three characters match
    nothing."""
    if not phrases or any(len(p) < 3 for p in phrases):
        return texts.select(key).limit(0)
    cond = [reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(p.lower())), F.lit(False)) for c in fields]) for p in phrases]
    return _latest(texts, key, [reduce(lambda a, b: a & b, cond).alias("hit")]).filter("hit").select(key)


def likes(files: DataFrame, texts: DataFrame, q: str, key: str = "file_id") -> DataFrame:
    """Catalogue rows (also without text) whose name, path or text contains the trimmed query, ASCII letters of either case."""
    q = q.strip()
    if not q:
        return files.limit(0)
    body = _latest(texts, key, [like_contains(F.col("content"), q).alias("_in")])
    return files.join(body, key, "left").filter(F.coalesce(like_contains(F.col("name"), q) | like_contains(F.col("rel_path"), q), F.lit(False)) | F.coalesce("_in", F.lit(False))).drop("_in")


def candidates(files: DataFrame, texts: DataFrame | TextIndex, q: str, filters: Filters, has_index: bool = True) -> DataFrame:
    """Catalogue rows with (source, base): words first, then substrings, then LIKE where the others found fewer than 12; an id
    keeps its first source."""
    engine, _, _ = engine_for(q, has_index)
    kept = files.filter(filters.column())
    index = texts if isinstance(texts, TextIndex) else None
    parts = []
    if engine != "like":
        hits = (index.bm25(compile_query(q)) if index else bm25(texts, compile_query(q))).join(kept, "file_id").orderBy("bm25", "file_id").limit(TOP_WORD)
        base = F.round(0.35 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.col("bm25") / 10)), 6)
        parts.append(hits.withColumns({"source": F.lit(1), "base": base}).drop("bm25"))
    if engine == "word+gram":
        hits = (index.grams(query_terms(q)) if index else grams(texts, query_terms(q))).join(kept, "file_id").orderBy("file_id").limit(TOP_GRAM)
        parts.append(hits.withColumns({"source": F.lit(2), "base": F.lit(0.05)}))
    found = reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    like = likes(kept, index.bodies() if index else texts, q).orderBy(F.desc("mtime_ns"), "file_id").limit(TOP_LIKE).withColumns({"source": F.lit(3), "base": F.lit(0.0)})
    if found is not None:
        found = materialize(found, "found")  # at most 600 rows, so that the count below costs no second search
        like = found if found.select("file_id").distinct().count() >= LIKE_BELOW else found.unionByName(like)
    first = W.partitionBy("file_id").orderBy("source")
    return like.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def rerank(rows: DataFrame, q: str, favorites: DataFrame, as_of: float) -> DataFrame:
    """Adds score: name and path matches of each term, the source's own score, favourites, recency (90-day decay)."""
    name, rel = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("rel_path", F.lit("")))
    score = F.col("base")
    for t in query_terms(q):
        t = t.lower()
        score = score + F.when(name == t, 4.0).when(F.startswith(name, F.lit(t)), 2.5).when(F.contains(name, F.lit(t)), 1.8).otherwise(0.0) + F.when(F.contains(rel, F.lit(t)), 0.9).otherwise(0.0)
    liked = favorites.filter("path is not null").select("path").distinct().withColumn("_fav", F.lit(True))
    rows = rows.join(liked, "path", "left")
    days = F.when(F.col("mtime_ns") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), as_of - F.col("mtime_ns") / 1e9) / 86400)
    score = score + F.when(F.col("_fav"), 0.4).otherwise(0.0) + F.least(F.lit(0.3), 0.3 * F.exp(-days / 90))
    return rows.withColumns({"favorite": F.coalesce("_fav", F.lit(False)), "score": F.round(score, 4)}).drop("_fav")


def order(sort: str) -> list[Column]:
    """Sort keys, ending in the id."""
    score, name, time = F.desc("score"), F.asc(F.lower("name")), F.desc("mtime_ns")
    return {"time": [time, score, F.asc("file_id")], "name": [name, score, F.asc("file_id")]}.get(sort, [score, name, F.asc("file_id")])


def search(files: DataFrame, texts: DataFrame | TextIndex, favorites: DataFrame, q: str, as_of: float, filters: Filters | None = None, sort: str = "relevance", offset: int = 0, limit: int = 40, favorites_only: bool = False, has_index: bool = True) -> DataFrame:
    """The page of hits: file_id, name, rel_path, kind, ext, size, icon, score, favorite, total, snippet, and the first unit of a Markdown file
    that holds all terms (unit_no, unit_label). ``total`` counts the candidates. Favourites are chosen before the best are."""
    limit, offset = max(1, min(200, limit)), max(0, min(100_000, offset))
    if favorites_only:
        files = files.join(favorites.filter("path is not null").select("path").distinct(), "path", "left_semi")
    rows = rerank(candidates(files, texts, q, filters or Filters(), has_index), q, favorites, as_of)
    rows = rows.withColumn("total", F.count("*").over(W.partitionBy(F.lit(1))))  # at most 1 100 candidates
    rows = rows.withColumn("icon", lookup(F.col("kind"), ICONS, "file"))
    page = rows.orderBy(*order(sort)).offset(offset).limit(limit).select("file_id", "name", "rel_path", "kind", "ext", "size", "icon", "score", "favorite", "total")
    page = materialize(page, "page")  # at most 200 rows
    if isinstance(texts, TextIndex):
        body = texts.bodies(page.select("file_id")).select("file_id", "content")
    else:
        body = _latest(texts.join(F.broadcast(page.select("file_id")), "file_id", "left_semi"), "file_id", [F.col("content")])
    body = materialize(body, "bodies")  # at most 200 texts
    headed = body.join(page.filter("kind = 'markdown'").select("file_id"), "file_id", "left_semi")
    units = locate_units(section_texts(headed), query_terms(q), limit).select("file_id", "unit_no", F.col("label").alias("unit_label"))
    page = page.join(units, "file_id", "left")
    return page.join(body, "file_id", "left").withColumn("snippet", snippet(F.col("content"), F.col("rel_path"), query_terms(q))).drop("content")


def envelope(hits: DataFrame, q: str, offset: int = 0, limit: int = 40, has_index: bool = True) -> DataFrame:
    """What goes with a page of hits: one row of query, terms, total, offset, limit, engine, degraded, hint."""
    engine, degraded, hint = engine_for(q, has_index)
    total = hits.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"))
    lit = {"query": q, "terms": query_terms(q), "offset": max(0, min(100_000, offset)), "limit": max(1, min(200, limit)), "engine": engine, "degraded": degraded, "hint": hint}
    return total.select("total", *[(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(k) for k, v in lit.items()])


def suggest(files: DataFrame, q: str, limit: int = 30, recents: DataFrame | None = None) -> DataFrame:
    """Quick open: names or paths that contain the query; names that start with it first, then the shorter. An empty query gives what was
    opened last (``recents``: path, name, last_opened), with rank -1; paths that the catalogue doesn't have are kept."""
    q = q.strip()
    if not q and recents is not None:
        last = recents.filter("path is not null").groupBy("path").agg(F.max(F.struct("last_opened", "name")).alias("r"))
        own = files.groupBy("path").agg(F.min(F.struct("file_id", "rel_path", "kind")).alias("f"))
        rows = last.join(own, "path", "left").orderBy(F.desc("r.last_opened"), "path").limit(limit)
        return rows.select("f.file_id", "r.name", F.coalesce("f.rel_path", F.lit("")).alias("rel_path"), F.coalesce("f.kind", F.lit("other")).alias("kind"), F.lit(-1).alias("rank"))
    rows = files.filter(Filters().column()).filter(like_contains(F.col("name"), q) | like_contains(F.col("rel_path"), q))
    low = q.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = F.when(F.startswith(ascii_lower(F.col("name")), F.lit(low)), 0).otherwise(1)
    return rows.select("file_id", "name", "rel_path", "kind", first.alias("rank")).orderBy("rank", F.length("name"), "name", "file_id").limit(limit)


def related(files: DataFrame, file_id: int, limit: int = 12) -> DataFrame:
    """Files related to one: same folder (3), a name token in common (2), same kind (1); the first reason wins. Name tokens
    include the extension."""
    live = files.filter(Filters().column())
    own = files.filter(F.col("file_id") == file_id).select("kb_id", "parent_rel", "kind", "name").limit(1)
    own = own.toDF("o_kb", "o_parent", "o_kind", "o_name").withColumn("o_tokens", F.filter(F.regexp_extract_all(F.lower("o_name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) > 1))
    rows = live.filter(F.col("file_id") != file_id).join(F.broadcast(own), F.col("kb_id") == F.col("o_kb"))  # one row
    name = F.exists("o_tokens", lambda t: F.contains(F.lower("name"), t))
    weight = F.when(F.col("parent_rel") == F.col("o_parent"), 3.0).when(name, 2.0).when(F.col("kind") == F.col("o_kind"), 1.0)
    rows = rows.withColumn("weight", weight).filter("weight is not null")
    return rows.select("file_id", "name", "rel_path", "weight", "mtime_ns").orderBy(F.desc("weight"), F.desc("mtime_ns"), "file_id").limit(limit)


def postings(texts: DataFrame, key: str = "file_id", fields: tuple[str, ...] = ("name", "path", "content")) -> DataFrame:
    """(term, key, field, tf): the inverted index as rows."""
    each = [texts.select(key, F.lit(c).alias("field"), F.explode(tokens(F.col(c))).alias("term")) for c in fields]
    return reduce(lambda a, b: a.union(b), each).groupBy("term", key, "field").agg(F.count("*").cast("int").alias("tf"))


class TextIndex:
    """An inverted index kept in the folder ``root``, with a log of commits; what no commit names was never added.

    ``add`` indexes new or changed texts (key, name, path, content) as a *part* and leaves all others as they are; rows of an older version
    of a text count as stale, and ``compact`` rewrites without them. Each part holds

    * postings: term, key, field, positions, length of the text; by bucket of the term's first three characters, so that a term or a
      prefix of three or more reads one bucket, and by slice of the key, so that a frequent term is spread;
    * grams: the trigrams with a CJK character of name, path and text, in the same way;
    * bodies: the texts by slice of the key, so that a page reads its slices only.

    Rows without a key are no texts; of a key that repeats, any row counts; null fields are empty.
    """

    FIELDS = ("name", "path", "content")

    def __init__(self, spark: SparkSession, root: str | None = None, key: str = "file_id", ranges: int | None = None, fanout: int = 8):
        self.spark, self.key, self.fanout = spark, key, fanout
        self.root = (root or scratch(spark, "index")).rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits")
        done = self.log.entries()
        self.state = done[-1] if done else {"number": 0, "parts": [], "stale": [], "side": ranges and max(1, round(ranges**0.5)), "texts": 0, "length": 0}

    @classmethod
    def build(cls, texts: DataFrame, key: str = "file_id", root: str | None = None) -> TextIndex:
        index = cls(texts.sparkSession, root, key)
        index.add(texts)
        return index

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(F.substring(term, 1, 3)), F.lit(self.state["side"])).cast("int")

    def _slice(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("long"), F.lit(1)), F.lit(self.state["side"])).cast("int")

    def _read(self, what: str) -> DataFrame | None:
        """Rows of all parts that are not stale."""
        if not self.state["parts"]:
            return None
        rows = reduce(lambda a, b: a.unionByName(b), [self._part(what, p) for p in self.state["parts"]])  # at most fanout
        if self.state["stale"]:
            old = self.spark.read.parquet(*[f"{self.root}/stale/{n}" for n in self.state["stale"]])
            rows = rows.join(old, [self.key, "version"], "left_anti")
        return rows

    def _part(self, what: str, part: str) -> DataFrame:
        """One part; a partitioned table without rows has no files, so the schema is kept."""
        return self.spark.read.schema(StructType.fromJson(json.loads(self.state["schemas"][what]))).parquet(f"{self.root}/{what}/p{part}")

    def _write(self, rows: DataFrame, what: str, part: str, by: list[str], sort: list[str]) -> None:
        self.state.setdefault("schemas", {})[what] = rows.schema.json()
        rows.sortWithinPartitions(*by, *sort).write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{what}/p{part}")

    def add(self, texts: DataFrame) -> None:
        """Indexes texts, new ones and new versions; compacts when ``fanout`` parts have gathered."""
        if len(self.state["parts"]) >= self.fanout:
            self.compact()
        key, number = self.key, self.state["number"] + 1
        if not self.state["side"]:
            self.state["side"] = max(1, round(hash_ranges(texts) ** 0.5))
        own = texts.filter(F.col(key).isNotNull()).select(key, *self.FIELDS).dropDuplicates([key]).withColumns({"version": F.lit(number), "slice": self._slice()})
        part = str(number)
        self._write(own.repartition("slice"), "bodies", part, ["slice"], [key])
        own = self._part("bodies", part)
        each = own.select(key, "version", "slice", F.posexplode(F.array(*[F.struct(F.lit(i).cast("byte").alias("field"), tokens(F.coalesce(c, F.lit(""))).alias("terms")) for i, c in enumerate(self.FIELDS)])).alias("_", "f"))
        length = F.aggregate(F.array(*[F.size(tokens(F.coalesce(c, F.lit("")))) for c in self.FIELDS]), F.lit(0), lambda a, x: a + x)
        docs = materialize(own.select(key, "version", length.alias("len")), "docs")
        each = each.select(key, "version", "slice", "f.field", F.posexplode("f.terms").alias("pos", "term")).withColumn("bucket", self._bucket(F.col("term")))
        rows = each.repartition("bucket", "slice").groupBy("bucket", "slice", "term", key, "version", "field").agg(F.sort_array(F.collect_list("pos")).alias("at"))  # positions in one field of one text
        self._write(rows.join(docs, [key, "version"]).repartition("bucket", "slice"), "postings", part, ["bucket", "slice"], ["term", key])
        low = F.concat_ws("\0", *[F.lower(F.coalesce(c, F.lit(""))) for c in self.FIELDS])
        some = own.select(key, "version", "slice", low.alias("low")).filter(F.col("low").rlike(_CJK.pattern))
        c = _CJK.pattern
        grams_ = F.array_distinct(F.regexp_extract_all("low", F.lit(f"(?s)(?=({c}..|.{c}.|..{c}))"), F.lit(1)))  # overlapping ones, in one pass
        rows = some.select(key, "version", "slice", F.explode(grams_).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        self._write(rows.repartition("bucket", "slice"), "grams", part, ["bucket", "slice"], ["gram", key])
        state = dict(self.state)
        new = docs.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        gone = [0, 0]
        if state["parts"]:
            old = self._docs().join(docs.select(key), key, "left_semi")
            old.write.mode("overwrite").parquet(f"{self.root}/stale_docs/{number}")
            old = self.spark.read.parquet(f"{self.root}/stale_docs/{number}")
            gone = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            if gone[0]:
                old.select(key, "version").write.mode("overwrite").parquet(f"{self.root}/stale/{number}")
                state["stale"] = [*state["stale"], number]
        docs.write.mode("overwrite").parquet(f"{self.root}/docs/p{part}")
        state["schemas"] = self.state["schemas"] | {"docs": docs.schema.json()}
        state |= {"number": number, "parts": [*state["parts"], part], "texts": state["texts"] + new[0] - gone[0], "length": state["length"] + new[1] - gone[1]}
        self.log.append(number, state)
        self.state = state

    def _docs(self) -> DataFrame:
        return self._read("docs").select(self.key, "version", "len")

    def remove(self, ids: DataFrame) -> None:
        """Takes texts (column key) out of the index."""
        if not self.state["parts"]:
            return
        number = self.state["number"] + 1
        old = materialize(self._docs().join(ids.select(self.key).distinct(), self.key, "left_semi"), "removed")
        gone = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        old.select(self.key, "version").write.mode("overwrite").parquet(f"{self.root}/stale/{number}")
        state = self.state | {"number": number, "stale": [*self.state["stale"], number], "texts": self.state["texts"] - gone[0], "length": self.state["length"] - gone[1]}
        self.log.append(number, state)
        self.state = state

    def compact(self) -> None:
        """One part in place of all, without stale rows."""
        if len(self.state["parts"]) < 2 and not self.state["stale"]:
            return
        number = self.state["number"] + 1
        part, by = str(number), ["bucket", "slice"]
        for what, at, sort in (("postings", by, ["term", self.key]), ("grams", by, ["gram", self.key]), ("bodies", ["slice"], [self.key])):
            self._write(self._read(what).repartition(*at), what, part, at, sort)
        self._docs().write.mode("overwrite").parquet(f"{self.root}/docs/p{part}")
        state = self.state | {"number": number, "parts": [part], "stale": []}
        gone = self.state["parts"]
        self.log.append(number, state)
        self.state = state
        for p in gone:
            for what in ("postings", "grams", "bodies", "docs"):
                remove(self.spark, f"{self.root}/{what}/p{p}")

    def bodies(self, ids: DataFrame | None = None) -> DataFrame:
        """(key, name, path, content) of all texts, or of some few (column key), of which only the slices are read."""
        rows = self._read("bodies")
        if rows is None:
            return self.spark.createDataFrame([], f"{self.key} long, name string, path string, content string")
        if ids is not None:
            rows = rows.join(ids.select(self.key).distinct().withColumn("slice", self._slice()), ["slice", self.key], "left_semi")
        return rows.select(self.key, *self.FIELDS)

    def _at(self, word: str) -> int:
        return self.spark.range(1).select(self._bucket(F.lit(word))).first()[0]

    def _phrase(self, p: Phrase) -> DataFrame:
        """(key, field, len, tf) of a phrase: the starts at which every word of it has its position."""
        parts = []
        rows = self._read("postings")
        for j, w in enumerate(p.words):
            last = p.prefix and j + 1 == len(p.words)
            own = rows.filter((F.col("bucket") == self._at(w)) & (F.startswith("term", F.lit(w)) if last else F.col("term") == w))
            parts.append(own.select(self.key, "field", "len", F.lit(j).alias("j"), F.transform("at", lambda x: x - j).alias("at")))  # noqa: B023
        if len(parts) == 1:
            return parts[0].groupBy(self.key, "field", "len").agg(F.sum(F.size("at")).alias("tf"))
        starts = reduce(lambda a, b: a.unionByName(b), [x.select(self.key, "field", "len", "j", F.explode("at").alias("s")) for x in parts])
        starts = starts.distinct().groupBy(self.key, "field", "len", "s").agg(F.count("*").alias("k")).filter(F.col("k") == len(parts))
        return starts.groupBy(self.key, "field", "len").agg(F.count("*").alias("tf"))

    def bm25(self, phrases: list[Phrase]) -> DataFrame:
        """As the function of that name; of a phrase that overlaps itself every start counts."""
        if not phrases or not self.state["texts"]:
            return self.spark.createDataFrame([], f"{self.key} long, bm25 double")
        weight = F.element_at(F.array(*[F.lit(WEIGHTS[c]) for c in self.FIELDS]), F.col("field") + 1)
        each = [self._phrase(p).select(self.key, "len", (F.col("tf") * weight).alias("f"), F.lit(i).alias("i")) for i, p in enumerate(phrases)]
        parts = range(len(phrases))
        rows = reduce(lambda x, y: x.unionByName(y), each).groupBy(self.key, "len").agg(*[F.sum(F.when(F.col("i") == i, F.col("f")).otherwise(0.0)).alias(f"f{i}") for i in parts])
        rows = materialize(rows, "phrases")
        stats = rows.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in parts])  # one row
        rows = rows.filter(reduce(lambda x, y: x & y, [F.col(f"f{i}") > 0 for i in parts])).join(F.broadcast(stats))
        n, mean, total = self.state["texts"], self.state["length"] / self.state["texts"] or 1.0, F.lit(0.0)
        for i in parts:
            raw = F.ln((n - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
            f = F.col(f"f{i}")
            total = total + F.when(raw <= 0, 1e-6).otherwise(raw) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("len") / mean))
        return rows.select(self.key, (-total).alias("bm25"))

    def grams(self, phrases: list[str]) -> DataFrame:
        """As the function of that name. Candidates have all trigrams with a CJK character of all phrases; their texts are then looked into.
        Where no phrase has one, all texts are."""
        none = self.spark.createDataFrame([], f"{self.key} long")
        if not phrases or any(len(p) < 3 for p in phrases) or not self.state["texts"]:
            return none
        wanted = sorted({p.lower()[i : i + 3] for p in phrases for i in range(len(p) - 2) if _CJK.search(p.lower()[i : i + 3])})
        if wanted:
            buckets = sorted({self._at(g) for g in wanted})
            own = self._read("grams").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
            met = own.groupBy(self.key).agg(F.count("*").alias("k")).filter(F.col("k") == len(wanted))
            rows = self.bodies(materialize(met.select(self.key), "met"))
        else:
            rows = self.bodies()
        return grams(rows, phrases, self.key)
