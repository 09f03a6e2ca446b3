"""File validation, parsing, idempotent ingestion, the store, and the stream."""

import io
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodestar.sources import catalog_tables, files, store, versions
from lodestar.streaming import ingest, listener

PDF = b"%PDF-1.4\n/Type /Page\n" + b"(Skills: Python and many other long words of text) Tj\n" * 5


def docx(*lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/></w:pPr>" if h else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for h, t in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def frame(spark, *rows):
    return spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in rows], "filename string, length long, content binary")


def test_validation_and_parsing(spark):
    rows = files.parse_files(frame(spark, ("a.pdf", b""), ("b.txt", b"x"), ("c", b"x"), ("d.pdf", b"nope"), ("e.docx", docx((True, "Skills"), (False, "Python"))), ("f.pdf", PDF), ("g.pdf", b"%PDF-1.4 dummy"), ("h.pdf", b"PK\x03\x04")))
    got = {r.filename: r for r in rows.collect()}
    assert "0 bytes" in got["a.pdf"].parse_error and "Unsupported file extension" in got["b.txt"].parse_error
    assert "valid extension" in got["c"].parse_error and "no known kind" in got["d.pdf"].parse_error and "another kind" in got["h.pdf"].parse_error
    assert got["e.docx"].cv_text == "## Skills\nPython" and got["f.pdf"].page_count == 1 and not got["f.pdf"].ocr_applied
    assert got["g.pdf"].ocr_applied and "No readable text" in got["g.pdf"].parse_error and got["g.pdf"].is_scanned
    assert got["e.docx"].structured_doc == {"Skills": "Python"}


def test_parser_has_a_time_limit(spark):
    import time

    def slow(name, content, ocr):
        time.sleep(5 if name == "a.docx" else 0)
        return files.Parsed("text enough to be read")

    began = time.time()
    rows = files.parse_files(files.spread(frame(spark, ("a.docx", docx((False, "x"))), ("b.docx", docx((False, "x")))), 2), slow, seconds=0.5)
    got = {r.filename: r for r in rows.collect()}
    assert "no result within" in got["a.docx"].parse_error and got["b.docx"].parse_error is None and time.time() - began < 30


def test_ingest_is_idempotent(spark):
    first = frame(spark, ("a.docx", docx((False, "one"))))
    empty = spark.createDataFrame([], ingest.RESULT_SCHEMA)
    stored = ingest.merged(empty, ingest.ingest(first, empty, now=F.lit("t1"))).cache()
    assert stored.first().status == "NEW_CV"
    assert ingest.ingest(first, stored).count() == 0
    assert ingest.decided(first, stored).first().status == "CACHE_HIT"
    changed = ingest.ingest(frame(spark, ("a.docx", docx((False, "two")))), stored, now=F.lit("t2")).first()
    assert (changed.status, changed.created_at, changed.updated_at, changed.markdown) == ("REPROCESSED", "t1", "t2", "two")
    assert ingest.ingest(first, stored, force=True).first().status == "REPROCESSED"
    old = stored.withColumn("schema_version", F.lit("0"))
    assert ingest.decided(first, old).first().change == "SCHEMA_CHANGED"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.DOCX").write_bytes(docx((False, name)))
    (tmp_path / "in" / "c.txt").write_text("no")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check"))
    ingest.ingest_stream(*args, progress_path=str(tmp_path / "progress")).awaitTermination()
    assert {r.markdown for r in ingest.read_store(spark, str(tmp_path / "store")).collect()} == {"a", "b"}
    (tmp_path / "in" / "d.docx").write_bytes(docx((False, "d")))
    ingest.ingest_stream(*args).awaitTermination()
    assert ingest.read_store(spark, str(tmp_path / "store")).count() == 3
    assert {r.status for r in spark.read.parquet(str(tmp_path / "progress")).collect()} == {"NEW_CV"}
    again = (*args[:3], str(tmp_path / "check2"))  # a new checkpoint: every file is seen again, and kept
    (tmp_path / "in" / "e.docx").write_bytes(docx((False, "e")))
    ingest.ingest_stream(*again, compact_every=1).awaitTermination()
    assert {r.markdown for r in ingest.read_store(spark, str(tmp_path / "store")).collect()} == {"a", "b", "d", "e"}
    seen = []
    follow = ingest.progress_stream(spark, str(tmp_path / "progress"), lambda batch, n: seen.extend(r.filename for r in batch.collect()), str(tmp_path / "follow"))
    follow.awaitTermination()
    assert sorted(seen) == ["a.DOCX", "b.DOCX"] and ingest.query_status(follow)["error"] is None and not ingest.query_status(follow)["running"]


def test_store_of_deltas(spark, tmp_path):
    path, kinds = str(tmp_path / "s"), "cv_key string, v int"
    for number, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2), ("c", 2)], [("c", 3)])):
        assert versions.append(spark.createDataFrame(rows, kinds), path) == number
    want = {"a": 2, "b": 1, "c": 3}
    read = lambda **more: {r.cv_key: r.v for r in versions.read(spark, path, "cv_key", **more).collect()}
    assert read() == want and read(before=1) == {"a": 1, "b": 1}
    assert versions.compact(spark, path, "cv_key") == 3 and versions.compact(spark, path, "cv_key") is None
    assert read() == want and read(before=3) == want and [e["kind"] for e in versions.snapshot(spark, path)] == ["base"]
    store.write_results(store.read_results(spark, path).withColumn("v", F.col("v") + 10), path)
    assert read() == {"a": 12, "b": 11, "c": 13}
    store.compact_results(spark, path)
    assert read() == {"a": 12, "b": 11, "c": 13} and [e["kind"] for e in versions.log(spark, path)] == ["base", "delta", "base"]
    assert len(list((tmp_path / "s" / "data").iterdir())) == 3
    assert versions.read(spark, str(tmp_path / "none"), "cv_key") is None
    assert versions.read(spark, str(tmp_path / "none"), "cv_key", "cv_key string").count() == 0
    versions.append(spark.createDataFrame([], kinds), path)
    assert read() == {"a": 12, "b": 11, "c": 13}


def test_batches_and_writes_in_turn_lose_nothing(spark, tmp_path):
    """A stream's batch 0, a write, and its batch 1; a repeat; a compaction, and a new stream's batch 0."""
    path = str(tmp_path / "s")
    one = lambda key: spark.createDataFrame([(key, 1)], "cv_key string, v int")
    keys = lambda: sorted(r.cv_key for r in versions.read(spark, path, "cv_key").collect())
    assert versions.append(one("a"), path, writer="w", batch=0) == 0
    store.write_results(one("b"), path)
    assert versions.append(one("c"), path, writer="w", batch=1) == 2 and keys() == ["a", "b", "c"]
    assert versions.append(one("x"), path, writer="w", batch=1) is None and keys() == ["a", "b", "c"]
    versions.compact(spark, path, "cv_key")
    assert versions.committed(spark, path, "w", 1) and not versions.committed(spark, path, "w", 2)
    assert versions.append(one("d"), path, writer="new", batch=0) is not None and keys() == ["a", "b", "c", "d"]
    for _ in range(2):
        versions.append(one("e"), path)
        versions.compact(spark, path, "cv_key")
    assert versions.committed(spark, path, "w", 1) and versions.committed(spark, path, "new", 0) and keys() == ["a", "b", "c", "d", "e"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Threads that append and one that compacts; every number is taken once."""
    path = str(tmp_path / "s")

    def add(k):
        return versions.append(spark.createDataFrame([(f"k{k}", k)], "cv_key string, v int"), path)

    with ThreadPoolExecutor(5) as pool:
        folded = pool.submit(lambda: [versions.compact(spark, path, "cv_key") for _ in range(2)])
        numbers = list(pool.map(add, range(8)))
        folded.result()
    assert len(set(numbers)) == 8
    assert sorted(r.v for r in versions.read(spark, path, "cv_key").collect()) == list(range(8))


def test_a_commit_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "s")
    versions.append(spark.createDataFrame([("a", 1)], "cv_key string, v int"), path)
    versions._write(spark.createDataFrame([("b", 1)], "cv_key string, v int"), path, "cv_key", 16)  # a writer that dies before its commit
    (tmp_path / "s" / "_log" / "000000000001.x.tmp").write_text("{")
    assert [r.cv_key for r in versions.read(spark, path, "cv_key").collect()] == ["a"]
    assert not versions.put_text(spark, f"{path}/_log/000000000000", "{}") and len(versions.log(spark, path)) == 1


def test_enriched_copies_are_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "t1"), ("b", "t2")], "cv_key string, markdown string").withColumn("match_analysis", F.lit("old"))
    store.write_results(rows, path)
    ids = spark.createDataFrame([("a",)], "cv_key string")
    for title in ("new", "newer"):
        copies = store.reanalyzed(store.read_results(spark, path), ids, ids.withColumn("match_analysis", F.lit(title)))
        assert copies.count() == 1
        store.write_results(copies, path)
        back = store.read_results(spark, path)
        assert sorted((r.cv_key, r.enriched, r.match_analysis) for r in back.collect()) == [("a", False, "old"), ("a", True, title), ("b", False, "old")]
    store.compact_results(spark, path)
    assert store.read_result(spark, path, "a").first().match_analysis == "old" and store.read_result(spark, path, "a_enriched.json").first().match_analysis == "newer"
    assert {(r.cv_key, r.enriched) for r in store.prefer_enriched(store.read_results(spark, path)).collect()} == {("a", True), ("b", False)}
    assert sorted(r.n for r in store.read_results(spark, path).select(store.name_of(store.read_results(spark, path)).alias("n")).collect()) == ["a", "a_enriched", "b"]
    assert store.detail(store.read_results(spark, path), "a").first().enriched is False and store.lookup_containing(store.read_results(spark, path), "_enr").count() == 1
    store.write_results(rows.where("cv_key = 'b'").withColumn("match_analysis", F.lit("third")), path)  # without a column enriched
    assert {(r.cv_key, r.enriched): r.match_analysis for r in store.read_results(spark, path).collect()} == {("a", False): "old", ("a", True): "newer", ("b", False): "third"}


def test_lookups_read_one_bucket(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(2000).select(F.concat(F.lit("cv_"), "id").alias("cv_key"), F.col("id").alias("v"))
    store.write_results(rows, path)
    store.write_results(rows.where("v < 500").withColumn("v", -F.col("v")), path)
    every = versions.read(spark, path, "cv_key")
    only = versions.buckets_of(spark, path, spark.createDataFrame([("cv_7",), ("cv_8",)], "k string"))
    some = versions.read(spark, path, "cv_key", only=only)
    assert len(only) <= 2 and {r.v for r in some.where("cv_key IN ('cv_7', 'cv_8')").collect()} == {-7, -8}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert len(every.inputFiles()) == 2 * versions.BUCKETS and "_bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert some.count() < every.count() / 4 and store.read_result(spark, path, "cv_9").first().v == -9


def test_json_results_and_examples(spark, tmp_path):
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"extracted": "content", "pages": 1}\nnot json\n')
    assert [(r.extracted, r.pages) for r in store.read_results(spark, str(tmp_path / "json")).collect()] == [("content", 1)]
    store.append_examples(spark.createDataFrame([(k, "x") for k in range(5)], "timestamp int, v string"), str(tmp_path / "log"))
    assert [r.timestamp for r in store.training_examples(spark, str(tmp_path / "log"), 2).collect()] == [3, 4]


def test_listing(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.DocX", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert {r.filename for r in files.list_files(spark, str(tmp_path)).collect()} == {"a.pdf", "b.PDF", "c.DocX"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("hello\nworld")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == [("x.txt", "hello\nworld")]


def test_store_lookups(spark, tmp_path):
    rows = spark.createDataFrame([("cv_a", "2026"), ("cv_ab", None)], "cv_key string, created_at string")
    store.write_results(rows, str(tmp_path / "r"))
    back = store.read_results(spark, str(tmp_path / "r"))
    assert store.exists(back, "cv_a.json") and not store.exists(back, "../cv_a")
    assert store.detail(back, "cv_a").first().cv_key == "cv_a" and store.detail(back, "_ab").first().cv_key == "cv_ab"
    assert [r.cv_key for r in store.newest_first(back).collect()] == ["cv_a", "cv_ab"]
    log = spark.createDataFrame([(k, f"x{k}") for k in range(9)], "timestamp int, v string")
    assert [r.timestamp for r in store.tail(log, 3).collect()] == [6, 7, 8]


def test_tables_by_ranges_of_a_key(spark):
    """An embedded database: partitions by key, pushed filters and columns, a query, and a table without rows."""
    jdbc = {"url": "jdbc:derby:memory:lodestar;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).selectExpr("id * 7 + 3 AS id", "'s' || id AS skills", "id % 2 = 0 AS active")
    for name, some in (("requests", rows), ("bare", rows.limit(0))):
        some.write.format("jdbc").options(**jdbc, dbtable=name).mode("overwrite").save()
    read = catalog_tables.read_table(spark, "requests", jdbc=jdbc, key="id", partitions=4)
    assert read.rdd.getNumPartitions() == 4 and sorted(read.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) == [250, 250, 250, 250]
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    some = read.where("id = 10").select("skills")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.first().skills == "s1" and "EqualTo(id,10)" in plan and "ReadSchema: struct<skills:string>" in plan
    assert catalog_tables.read_table(spark, "bare", jdbc=jdbc, key="id").count() == 0
    assert catalog_tables.read_query(spark, jdbc, "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").count() == 2


def test_query_log(spark, tmp_path):
    """A stream that ends and one whose batch fails, as rows."""
    log = listener.QueryLog(spark, str(tmp_path / "log"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    lines = spark.readStream.text(str(tmp_path / "in"))

    def fails(batch, number):
        raise ValueError("no room")

    spark.streams.addListener(log)
    try:
        for name, run in (("good", lambda b, n: b.count()), ("bad", fails)):
            query = lines.writeStream.queryName(name).foreachBatch(run).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except StreamingQueryException:
                pass
        for _ in range(100):
            told = listener.events(spark, str(tmp_path / "log")).collect() if (tmp_path / "log").exists() else []
            if {"ended", "failed"} <= {r.event for r in told}:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert [r.event for r in told].count("started") == 2 and {r.name for r in told if r.event == "started"} == {"good", "bad"}
    assert [(r.batch, r.rows) for r in told if r.event == "progress" and r.rows] == [(0, 2)]
    assert ["no room" in r.error for r in told if r.event == "failed"] == [True]


def test_catalogue_tables(spark, tmp_path):
    assert catalog_tables.healthy(spark) and catalog_tables.read_table(spark, "requests") is None
    spark.range(3).write.parquet(str(tmp_path / "requests.parquet"))
    assert catalog_tables.read_table(spark, "requests", str(tmp_path)).count() == 3
    catalog_tables.create_config_table(spark, "match_config_kv")
    try:
        catalog_tables.create_config_table(spark, "match_config_kv")
        assert catalog_tables.find_tables(spark, "CONFIG_K") == ["match_config_kv"]
        assert catalog_tables.columns_of(spark, "match_config_kv") == [("key", "string"), ("value", "string"), ("updated_at", "timestamp")]
    finally:
        spark.sql("DROP TABLE match_config_kv")
    stamp = spark.range(1).select(store.utc_now().alias("t")).first().t
    assert len(stamp) == 32 and stamp.endswith("+00:00") and stamp[10] == "T"
