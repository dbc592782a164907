"""Incremental runs, catalogue, library, snapshots, search: small fixtures with nulls, repeats, ties and empty tables."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.corpus import current_files, texts
from lectern.operators import catalog, library, search, snapshot
from lectern.operators.incremental import IncrementalRun, listing, manifest_from_log, pending

IDENT = "file_id long, size long, mtime_ns long, ctime_ns long, inode long"


def test_current_row_is_greatest_generation_then_update(spark):
    rows = [(1, 2, "2024-01-02", "b"), (1, 2, "2024-01-01", "a"), (1, 1, "2025-01-01", "c"), (2, None, None, "x"), (2, None, None, "x"), (None, 9, "2024-01-01", "n")]
    df = spark.createDataFrame(rows, "id long, scan_gen long, updated_at string, name string")
    assert {tuple(r) for r in current_files(df, ["name"]).collect()} == {(1, "b"), (2, "x")}


def test_texts_count_repeated_rows_once(spark):
    files = spark.createDataFrame([(1, "a", "k"), (1, "a", "k"), (2, "b", None), (None, "c", "k")], "id long, name string, kind string")
    text = spark.createDataFrame([(1, "t", "u"), (1, "t", "u"), (2, None, ""), (3, "x", ""), (None, "y", "")], "file_id long, content string, encoding string")
    assert [tuple(r) for r in texts(files, text, ["name", "kind"]).collect()] == [(1, "t", "u", "a", "k")]


def test_pending_compares_identity_and_nulls_are_always_due(spark):
    listed = spark.createDataFrame([(1, 5, 5, 5, 5), (2, 5, 5, 5, 5), (3, 5, 5, None, 5), (4, 1, 1, 1, 1)], IDENT)
    known = spark.createDataFrame([(1, 5, 5, 5, 5), (2, 5, 6, 5, 5), (3, 5, 5, None, 5)], IDENT)
    assert {r.file_id for r in pending(listed, known).collect()} == {2, 3, 4}
    assert pending(listed.limit(0), known).count() == 0 and pending(listed, known.limit(0)).count() == 4


def test_manifest_takes_the_last_success_only(spark):
    log = spark.createDataFrame(
        [(1, 10, 5, 1, 1, 1, "done", "2024-01-03"), (1, 11, 6, 1, 1, 1, "failed", "2024-01-04"), (1, 12, 7, 1, 1, 1, "done", "2024-01-05"), (1, 9, 8, 1, 1, 1, "done", "2024-02-01"), (None, 10, 1, 1, 1, 1, "done", "2024-01-01")],
        "file_id long, job_id long, size long, mtime_ns long, ctime_ns long, inode long, state string, logged_at string",
    )
    jobs = spark.createDataFrame([(9, "completed"), (10, "completed"), (11, "completed"), (12, "canceled")], "id long, state string")
    assert [tuple(r) for r in manifest_from_log(log, jobs).collect()] == [(1, 5, 1, 1, 1)]
    assert manifest_from_log(log, jobs.limit(0)).count() == 0


def test_listing_leaves_out_folders_links_and_deleted(spark):
    cols = "id long, scan_gen long, updated_at string, size long, mtime_ns long, ctime_ns long, inode long, is_dir boolean, is_symlink boolean, is_deleted boolean"
    rows = [(i, 1, "t", 1, 1, 1, 1, *flags) for i, flags in enumerate([(False, False, False), (True, False, False), (False, True, False), (False, False, True), (None, None, None)])]
    assert {r.file_id for r in listing(spark.createDataFrame(rows, cols)).collect()} == {0, 4}


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    run = IncrementalRun(spark, f"file://{tmp_path}/inc", fanout=2)
    one = spark.createDataFrame([(1, 1, 1, 1, 1), (2, 1, 1, 1, 1), (2, 1, 1, 1, 1), (None, 1, 1, 1, 1)], IDENT)
    double = lambda d: d.select("file_id", (F.col("size") * 2).alias("v"))
    assert run.run(one.limit(0), double) is None and run.output() is None
    for crash in ("write", "manifest"):
        with pytest.raises(RuntimeError):
            IncrementalRun(spark, run.root).run(one, double, fail_after=crash)
        assert run.output() is None
    first = run.run(one, double)
    assert first and run.run(one, double) is None
    assert sorted(r.file_id for r in run.output().collect()) == [1, 2]
    two = spark.createDataFrame([(1, 1, 1, 1, 1), (2, 7, 1, 1, 1), (3, 1, 1, 1, 1)], IDENT)
    assert run.run(two, double) != first
    assert sorted(tuple(r)[:2] for r in run.output().select("file_id", "v").collect()) == [(1, 2), (2, 2), (2, 14), (3, 2)]
    for i in range(3):
        run.run(spark.createDataFrame([(9, i, 1, 1, 1)], IDENT), double)
    assert len(run.commits()) == 5 and len(run.commits()[-1]["parts"]) <= 2
    assert run.run(two, double) is None and {r.file_id: r.batch_no for r in run.manifest(two).collect()} == {1: 1, 2: 2, 3: 2, 9: 5}


def test_of_two_runs_with_one_number_the_second_fails(spark, tmp_path):
    one, other = (IncrementalRun(spark, f"file://{tmp_path}/inc") for _ in range(2))
    a, b = (spark.createDataFrame([(i, 1, 1, 1, 1)], IDENT) for i in (1, 2))
    late = other._commit
    other._commit = lambda *args: (one.run(b, lambda d: d.select("file_id")), late(*args))  # while the first is about to commit
    with pytest.raises(RuntimeError):
        other.run(a, lambda d: d.select("file_id"))
    assert [r.file_id for r in one.output().collect()] == [2] and one.run(a, lambda d: d.select("file_id"))
    assert sorted(r.file_id for r in one.output().collect()) == [1, 2]


def test_listing_takes_the_greatest_row_of_a_key_and_checksums(spark, tmp_path):
    cols = "file_id long, seen long, size long, sum string"
    run = IncrementalRun(spark, f"file://{tmp_path}/inc", identity=["size", "sum"], order=["seen"])
    listed = spark.createDataFrame([(1, 1, 9, "a"), (1, 2, 5, "b"), (2, 1, 5, "c")], cols)
    same = lambda d: d.select("file_id", "sum")
    run.run(listed, same)
    assert {tuple(r)[:2] for r in run.output().collect()} == {(1, "b"), (2, "c")}
    run.run(spark.createDataFrame([(1, 3, 5, "b"), (2, 1, 5, "changed")], cols), same)
    assert {tuple(r)[:2] for r in run.output().collect()} == {(1, "b"), (2, "c"), (2, "changed")}
    with pytest.raises(RuntimeError):
        run.adopt(listed.select("file_id", "size", "sum"))


def test_bm25_equals_sqlite(spark):
    docs = [(1, "Guide one", "a/guide", "alpha beta beta gamma"), (2, "beta", "b/x", "Größe der alpha"), (3, "x", "beta/y", None), (4, None, None, ""), (5, "notes", "c", "foo_bar foo bar alphabet")]
    df = spark.createDataFrame(docs, "file_id long, name string, path string, content string")
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(name, path, content, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine here")
    con.executemany("insert into t(rowid, name, path, content) values (?, ?, ?, ?)", docs)
    for q, match in (("beta", '"beta"*'), ("alpha beta", '"alpha" AND "beta"*'), ("foo_bar", '"foo_bar"*'), ("grosse", '"grosse"*'), ("größe", '"größe"'), ("zzz", '"zzz"*')):
        want = dict(con.execute("select rowid, bm25(t, 10.0, 4.0, 1.0) from t where t match ?", (match,)).fetchall())
        got = dict(search.bm25(df, search.compile_query(q)).collect())
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got), q
        index_got = dict(search.TextIndex.build(df).bm25(search.compile_query(q)).collect())
        assert index_got.keys() == want.keys() and all(math.isclose(index_got[k], want[k], rel_tol=1e-9) for k in want), q
    assert search.bm25(df, []).count() == 0 and search.bm25(df.limit(0), search.compile_query("beta")).count() == 0


FILES = "file_id long, kb_id long, parent_rel string, path string, rel_path string, name string, ext string, kind string, mtime_ns long, is_dir boolean, is_deleted boolean, size long, text_state string, text_bytes long, error string"


def catalogue(spark):
    rows = [
        (1, 1, "", "/r/a.md", "a.md", "a.md", ".md", "markdown", 10**18, False, False, 5, "ok", 4, None),
        (2, 1, "d", "/r/d/b.txt", "d/b.txt", "b.txt", ".txt", "text", 0, False, False, None, "pending", None, None),
        (3, 1, "", "/r/d", "d", "d", "", None, 10**18, True, False, 0, "pending", None, None),
        (4, 1, "", "/r/x%.md", "x%.md", "x%.md", ".md", "markdown", 10**18, False, True, 9, "ok", 4, None),
        (5, 2, "", "/r/d/z.md", "z.md", "Z.md", ".md", None, None, None, None, 3, None, None, "e"),
    ]
    return spark.createDataFrame(rows, FILES)


HOSTILE = ["", "   ", '"', "'", "(", ")", "*", "AND", "a OR b", "NEAR(", "\\", "%", "_", "a" * 500, "<script>", "日", "$1", "name:x", "-", "a^b|c?"]


def test_index_follows_changes(spark, tmp_path):
    cols = "file_id long, name string, path string, content string, extra int"
    root = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(1, "alpha", "a", "beta beta 打印机", 0), (2, "b", None, "beta gamma", 0), (3, "c", "c", None, 0), (None, "beta", "x", "beta", 0), (2, "b", None, "beta gamma", 0)], cols)
    search.TextIndex(spark, root, fanout=2).add(one)
    two = spark.createDataFrame([(1, "alpha", "a", "delta", 0), (4, "d", "d", "beta 打印机器", 0)], cols)
    search.TextIndex(spark, root, fanout=2).add(two)  # a later session
    index = search.TextIndex(spark, root, fanout=2)
    now = spark.createDataFrame([(1, "alpha", "a", "delta", 0), (2, "b", None, "beta gamma", 0), (3, "c", "c", None, 0), (4, "d", "d", "beta 打印机器", 0)], cols)
    for queries in (("delta", "beta gamma", "bet"), ("beta",)):
        for q in queries:
            got, want = (dict(x.bm25(search.compile_query(q)).collect()) if x is index else dict(search.bm25(now, search.compile_query(q)).collect()) for x in (index, None))
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got), q
        assert {r.file_id for r in index.grams(["打印机"]).collect()} == {4} and index.grams(["beta", "打印机器"]).count() == 1 and {r.file_id for r in index.grams(["gamma"]).collect()} == {2}
        assert sorted(r.file_id for r in index.bodies().collect()) == [1, 2, 3, 4]
        index.compact()
    index.remove(spark.createDataFrame([(2,), (77,)], "file_id long"))
    assert set(dict(index.bm25(search.compile_query("beta")).collect())) == {4} and (index.state["texts"], len(index.state["parts"])) == (3, 1)
    index.add(two)
    assert len(index.state["parts"]) == 2 and set(dict(index.bm25(search.compile_query("delta")).collect())) == {1}
    empty = search.TextIndex.build(one.limit(0))
    assert empty.bm25(search.compile_query("beta")).count() == empty.grams(["打印机"]).count() == empty.bodies().count() == 0


@pytest.mark.parametrize("q", HOSTILE)
def test_hostile_queries_never_fail(spark, q):
    texts_ = spark.createDataFrame([(1, "a.md", "a.md", "some $1 text <b> %_ 日本")], "file_id long, name string, path string, content string")
    favs = spark.createDataFrame([("/r/a.md",), (None,)], "path string")
    search.search(catalogue(spark), texts_, favs, q, 1.7e9).collect()
    search.suggest(catalogue(spark), q).collect()


def test_search_filters_snippets_and_favourites(spark):
    texts_ = spark.createDataFrame([(1, "a.md", "a.md", "x" * 100 + " needle <b> " + "y" * 300), (4, "x%.md", "x%.md", "needle")], "file_id long, name string, path string, content string")
    favs = spark.createDataFrame([("/r/a.md",), ("/r/a.md",)], "path string")
    got = search.search(catalogue(spark), texts_, favs, "needle", 1.7e9).collect()
    assert [r.file_id for r in got] == [1] and got[0].favorite and got[0].total == 1
    assert got[0].snippet.startswith("… ") and "<mark>needle</mark> &lt;b&gt;" in got[0].snippet
    assert search.search(catalogue(spark), texts_, favs.limit(0), "needle", 1.7e9, favorites_only=True).count() == 0
    assert search.search(catalogue(spark), texts_, favs, "needle", 1.7e9, filters=search.Filters(kinds=["text"])).count() == 0
    assert search.engine_for("書類")[0] == "like" and search.engine_for("書類検索 x")[0] == "word+gram" and search.engine_for("x")[0] == "word"


def test_catalogue_views(spark):
    files = catalogue(spark)
    kinds = {r.kind: (r.n, r.bytes, r.icon) for r in catalog.by_kind(files).collect()}
    assert kinds == {"markdown": (1, 5, "fileText"), "text": (1, 0, "fileText"), None: (1, 3, "file")}
    favs = spark.createDataFrame([("/r/a.md",)], "path string")
    assert [r.file_id for r in catalog.tree(files, favs, 1, "").collect()] == [3, 1]
    assert [(r.file_id, r.rel_path, r.name) for r in catalog.breadcrumbs(files).collect()] == [(2, "d", "d")]
    kbs = spark.createDataFrame([(1, "one", "/r", 0, 0), (2, "two", "/r/d/", 0, 0), (3, "three", "/q", 0, 0)], "id long, name string, root_path string, file_count long, total_bytes long")
    own = {r.path: r.owner for r in catalog.owners(files.select("path"), kbs).collect()}
    assert own["/r/a.md"] == 1 and own["/r/d/z.md"] == 2 and own["/r/d"] == 2
    assert {tuple(r) for r in catalog.overlaps(kbs).collect()} == {(1, 2)}
    one = catalog.counts(files, kbs).first()
    assert (one.files, one.folders, one.deleted, one.indexed, one.pending, one.knowledge_bases) == (3, 1, 1, 1, 1, 3)
    assert {r.kb_id: r.n for r in catalog.kb_live_counts(files, kbs).collect()} == {1: 2, 2: 1, 3: 0}
    assert catalog.by_kind(files.limit(0)).count() == 0 and catalog.timeline(files, "day").count() == 2


def test_upsert_keeps_resurrects_and_deletes(spark):
    cols = "id long, kb_id long, path string, size long, mtime_ns long, inode long, rel_path string, text_state string, error string, is_deleted boolean, scan_gen long"
    old = spark.createDataFrame([(1, 1, "a", 5, 5, 5, "old", "ok", None, False, 1), (2, 1, "b", 5, 5, 5, "b", "failed", "e", False, 1), (3, 1, "c", 5, None, 5, "c", "ok", None, True, 1), (4, 1, "d", 1, 1, 1, "d", "ok", None, False, 1)], cols)
    scan = spark.createDataFrame([(9, 1, "a", 5, 5, 5, "new", "x", None, False, 2), (9, 1, "b", 6, 5, 5, "b", "x", None, False, 2), (9, 1, "c", 5, None, 5, "c", "x", None, False, 2), (9, 1, "n", 1, 1, 1, "n", "x", None, False, 2)], cols)
    out = snapshot.upsert(old, scan)
    got = {r.path: (r.id, r.change, r.text_state, r.error, r.is_deleted, r.rel_path) for r in out.collect()}
    assert got == {
        "a": (1, "same", "ok", None, False, "old"), "b": (2, "changed", "pending", None, False, "b"), "c": (3, "back", "ok", None, False, "c"),
        "d": (4, "unseen", "ok", None, False, "d"), "n": (9, "new", "pending", None, False, "n"),
    }
    gone = {r.path: r.is_deleted for r in snapshot.soft_delete(out, 1, 2).collect()}
    assert gone == {"a": False, "b": False, "c": False, "d": True, "n": False}


def test_library_folds(spark):
    ev = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), (None, 5)], "path string, t long")
    assert {tuple(r) for r in library.toggles(ev, "path", "t").collect()} == {("q", 1, 1)}
    assert {tuple(r) for r in library.touches(ev, "path", "t").collect()} == {("p", 2, 2), ("q", 1, 1)}
    jobs = spark.createDataFrame([(i, "completed") for i in range(5)] + [(9, "running")], "id long, state string")
    assert {r.state: r.n for r in library.job_counts(jobs).collect()}["completed"] == 5 and library.job_counts(jobs).count() == 7
    assert {r.id for r in library.retention(jobs, 2).collect()} == {0, 1, 2}


def test_queue_survives_a_crash_and_claims_the_oldest(spark):
    cols = "id long, state string, attempts int, max_attempts int, cancel_requested boolean, pause_requested boolean, progress double, error string"
    rows = [(1, "running", 1, 3, False, False, 0.5, None), (2, "running", 3, 3, None, None, 0.1, None), (3, "paused", 1, None, True, True, 0.2, None), (4, "queued", 0, 3, None, None, 0.0, None), (5, "completed", 1, 3, None, None, 1.0, None), (6, "queued", None, None, None, True, 0.0, None)]
    jobs = spark.createDataFrame(rows, cols)
    got = {r.id: (r.state, r.progress, r.error) for r in library.requeue(jobs).collect()}
    assert got == {1: ("queued", 0.0, None), 2: ("failed", 0.1, "interrupted too often"), 3: ("canceled", 0.2, None), 4: ("queued", 0.0, None), 5: ("completed", 1.0, None), 6: ("queued", 0.0, None)}
    assert {r.id for r in library.claim(jobs, 3).collect() if r.state == "running"} == {1, 2, 4} and {r.id for r in library.claim(jobs, 2).collect() if r.state == "running"} == {1, 2}
    assert library.claim(jobs.limit(0)).count() == library.requeue(jobs.limit(0)).count() == 0
    assert [r.id for r in library.list_jobs(jobs, active_only=True, limit=2, offset=1).collect()] == [4, 3]


def test_icons_and_knowledge_bases(spark):
    icons = spark.createDataFrame([("/a", "builtin", "x", 1)], "path string, icon_type string, icon_value string, at long")
    changes = spark.createDataFrame([("/a", None, None, 2), ("/b", None, "y", 1), (None, "t", "z", 1)], icons.schema)
    kept = library.set_icons(icons, changes)
    assert [tuple(r)[:3] for r in kept.collect()] == [("/b", "builtin", "y")]
    rows = spark.createDataFrame([("/a",), ("/b",), (None,)], "path string")
    assert {r.path: r.icon for r in library.icons_of(rows, kept, F.lit("file")).collect()} == {"/a": "file", "/b": "y", None: "file"}
    kbs = spark.createDataFrame([(1, "one", "/v/one/", True), (2, None, None, None)], "id long, name string, root_path string, enabled boolean")
    new = spark.createDataFrame([(1, "one", "/v/one"), (5, "x" * 121, "/v/n"), (6, "six", "/v/one/in"), (7, "seven", "/v"), (8, "ok", "/v/oneother"), (9, "nine", "/w"), (10, "ten", None)], "id long, name string, root_path string")
    assert {r.id: r.problem for r in catalog.kb_checks(new, kbs, ["/v"]).collect()} == {1: None, 5: "name", 6: "overlaps 1", 7: "overlaps 1", 8: None, 9: "root", 10: "root"}
    edits = spark.createDataFrame([(1, "name", "new", 1), (1, "root_path", "/x", 1)], "id long, field string, value string, at long")
    assert {tuple(r) for r in catalog.kb_update(kbs, edits).select("id", "name", "root_path").collect()} == {(1, "new", "/v/one/"), (2, None, None)}
    assert library.tally(spark.createDataFrame([("ok", 5), ("odd", None)], "state string, chars long")).first().asDict() == {"total": 2, "indexed": 1, "empty": 0, "unsupported": 0, "failed": 1, "chars": 5}


def test_scratch_folders_are_released(spark):
    import os

    from lectern import session

    df = session.materialize(spark.range(3).toDF("id"), "probe")
    path = next(p for p in session._kept if "probe" in p)
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file:")) and session.release(spark) >= 1 and not os.path.exists(path.removeprefix("file:"))
