"""Operators on small fixtures: chunking, globs, scans, version control, flow control, digests, commands."""

import json
import subprocess

import pytest

from weftline.engine import Engine
from weftline.extract.registry import extract_text, languages
from weftline.functions.blake3 import blake3_many
from weftline.functions.globs import glob_regex, ignore_patterns
from weftline.operators import chunking as ch
from weftline.options import ChunkingOptions, Config, FlowOptions, IndexOptions, ScanOptions
from weftline.sources.scan import NotARepository, git_diff, git_tracked, scan
from weftline.streaming.flow import flow_log, flow_step, new_state

SYMBOL = "file_path string, ord int, id string, name string, kind string, scope string, start_line int, end_line int, signature string"


def symbols(spark, rows, path="f.rs"):
    """rows: id, name, kind, scope, start, end[, signature]"""
    return spark.createDataFrame([(path, i, r[0], r[1], r[2], r[3], r[4], r[5], r[6] if len(r) > 6 else None) for i, r in enumerate(rows)], SYMBOL)


def files(spark, text, path="f.rs"):
    return spark.createDataFrame([(path, text, "rust")], "file_path string, text string, language string")


ABC = [("a", "a", "function", None, 1, 1), ("b", "b", "function", None, 2, 2), ("c", "c", "function", None, 3, 3)]


@pytest.mark.parametrize("rows,limit,groups", [(ABC, 4, [["a", "b", "c"]]), (ABC, 2, [["a", "b"], ["c"]]), ([("big", "big", "function", None, 1, 5)], 2, [["big"]]), (ABC, 0, [["a", "b", "c"]])])
def test_packing(spark, rows, limit, groups):
    text = "\n".join("x" * 3 for _ in range(6))
    for make in (ch.line_limited_chunks, ch.size_limited_chunks):
        out = make(files(spark, text), symbols(spark, rows), limit).orderBy("start_line").collect()
        assert [r["symbol_ids"] for r in out] == groups


def test_without_symbols_one_full_file(spark):
    for strategy in ("SymbolBoundary", "SizeLimited", "LineLimited", "Semantic"):
        out = ch.chunk_pipeline(files(spark, "a\nb\n"), None, ChunkingOptions(strategy=strategy)).collect()
        assert [(r["chunk_kind"], r["start_line"], r["end_line"], r["content"]) for r in out] == [("FullFile", 1, 2, "a\nb\n")]
    assert ch.full_file_chunks(files(spark, "")).first()["end_line"] == 1


def test_boundary_limit(spark):
    s = symbols(spark, [("l", "long", "function", None, 1, 4)])
    assert ch.boundary_chunks(files(spark, "a\nb\nc\nd"), s, 1).count() == 0
    assert ch.boundary_chunks(files(spark, "a\nb\nc\nd"), s, 0).first()["content"] == "a\nb\nc\nd\n"


SEMANTIC = [("s", "Db", "struct", None, 1, 3), ("i", "unknown", "impl", None, 5, 12, "impl Db { }"), ("m", "get", "method", "Db", 6, 8), ("n", "put", "method", "Db", 10, 12), ("f", "free", "function", None, 15, 15)]
CLASS = [("c", "Database", "class", None, 1, 7), ("m", "a", "method", "Database", 2, 2), ("n", "b", "method", "Database", 4, 6)]


@pytest.mark.parametrize("rows,limit,groups", [(SEMANTIC, 0, [["s", "i", "m", "n"], ["f"]]), ([ABC[0], ("c", "c", "function", None, 3, 3)], 0, [["a"], ["c"]]), (CLASS, 0, [["c", "m", "n"]]), (CLASS, 4, [["c"], ["m"], ["n"]])])
def test_semantic(spark, rows, limit, groups):
    out = ch.semantic_chunks(files(spark, "\n".join("x" for _ in range(20))), symbols(spark, rows), limit).orderBy("start_line", "end_line").collect()
    assert sorted(r["symbol_ids"] for r in out) == sorted(groups)
    if rows is CLASS and not limit:
        assert out[0]["metadata"]["semantic_key"] == "database"


def test_overlap(spark):
    s = symbols(spark, [("a", "a", "function", None, 1, 2), ("b", "b", "function", None, 4, 5)])
    f = files(spark, "1\n2\n3\n4\n5")
    base = ch.boundary_chunks(f, s)
    out = ch.overlap_chunks(f, base, 1).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in out] == [(1, 3), (3, 5)]
    assert out[0]["metadata"]["next_chunk_id"] == base.orderBy("start_line").collect()[1]["id"]
    assert ch.overlap_chunks(f, base.where("start_line = 1"), 1).first()["id"] == base.where("start_line = 1").first()["id"]


def test_context(spark):
    f = files(spark, "use a;\nuse a;\nuse b;\n\nfn x() {}\n")
    s = symbols(spark, [("x", "x", "function", " Scope ", 5, 5)])
    r = ch.context_chunks(f, ch.boundary_chunks(f, s), s).first()
    assert r["content"] == "use a;\nuse b;\n\n\nscope: Scope\n\nfn x() {}\n"
    assert r["metadata"]["context_import_count"] == 2


def test_globs():
    import re

    assert re.match(glob_regex("**/*.rs"), "main.rs") and re.match(glob_regex("**/*.rs"), "a/b.rs") and not re.match(glob_regex("**/*.rs"), "README.md")
    assert re.match(glob_regex("target/**"), "target/x/y") and re.match(glob_regex("*.rs"), "a/b.rs") and re.match(glob_regex("[!a]?.{go,py}"), "bc.py")
    with pytest.raises(ValueError):
        glob_regex("[")
    assert ignore_patterns(["# c", "", " x.rs "]) == ["x.rs"]


def test_scan_and_index(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/lib.rs").write_text("use std::io;\n\npub fn run() {\n    go(1);\n    println!(\"x\");\n}\n")
    (tmp_path / "a.py").write_text("import os\n\ndef f():\n    return os.getcwd()\n")
    (tmp_path / "bad.go").write_bytes(b"\xff\xfe")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "target/secret.rs").write_text("fn s() {}")
    (tmp_path / "hidden.rs").write_text("fn h() {}")
    (tmp_path / ".gitignore").write_text("# x\nhidden.rs\n")
    got = {r["path"]: r for r in scan(spark, str(tmp_path), ScanOptions(ignore=("target/**",))).collect()}
    assert sorted(got) == ["a.py", "bad.go", "src/lib.rs"] and got["bad.go"]["text"] == ""
    engine = Engine(spark)
    result = engine.index_path(str(tmp_path), IndexOptions(scan=ScanOptions(include=("**/*.rs",), ignore=("target/**",))))
    assert [r["path"] for r in result.files.collect()] == ["src/lib.rs"]
    assert {r["callee_name"] for r in result.calls.collect()} == {"go", "println"}
    assert [(r["to_module"], r["imported_symbol"]) for r in result.imports.collect()] == [("std", "io")]
    events = [json.loads(r["value"])["event"] for r in engine.event_log(result, "j").collect()]
    assert {"job_started", "file_listed", "chunk_emitted", "import_edge", "call_edge", "job_completed"} == set(events)


def test_git(spark, tmp_path):
    with pytest.raises(NotARepository):
        git_tracked(str(tmp_path))
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "a.rs").write_text("fn a() {}\n")
    run("add", ".")
    run("commit", "-m", "one")
    run("tag", "v1")
    (tmp_path / "a.rs").write_text("fn a() {}\nfn b() {}\n")
    run("commit", "-am", "two")
    assert git_tracked(str(tmp_path)) == ["a.rs"] and git_diff(str(tmp_path), "v1", "HEAD") == ["a.rs"]
    out = Engine(spark).incremental_index(str(tmp_path), use_git=True, git_range="v1..HEAD")
    assert out.chunks.count() >= 1


def test_flow(spark):
    with pytest.raises(ValueError):
        FlowOptions(max_queue_size=9)
    with pytest.raises(ValueError):
        FlowOptions(threshold_percent=79)
    o = FlowOptions(max_queue_size=10, threshold_percent=80, pause_timeout_secs=5)
    step, st = flow_step(o), new_state()
    sent = [step(st, "emit", None, float(i))[2] for i in range(10)]
    assert sent == [None] * 9 + ["pause"]
    assert [step(st, "ack", 1, 9.0)[2] for _ in range(3)] == [None, None, "resume"]
    st = new_state()
    for i in range(10):
        step(st, "emit", None, float(i))
    assert step(st, "emit", None, 20.0)[:4] == (1, False, "resume", "pause_timeout")
    log = spark.createDataFrame([("j", i, "emit", None, None) for i in range(12)], "job_id string, seq long, action string, count long, ts double")
    assert [r["emitted"] for r in flow_log(log, o).orderBy("seq").collect()].count("pause") == 1


def test_flow_stream_equals_batch(spark, tmp_path):
    from weftline.streaming.flow import flow_stream

    schema = "job_id string, seq long, action string, count long, ts double"
    rows = [(f"j{i % 2}", i, ("emit", "emit", "emit", "ack")[i % 4], 2, None) for i in range(120)]
    log = spark.createDataFrame(rows, schema).coalesce(1)
    log.write.parquet(str(tmp_path / "log"))
    o = FlowOptions(max_queue_size=10, threshold_percent=80)
    q = flow_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), o).writeStream.format("memory").queryName("flow").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["job_id"], r["seq"], r["queue_size"], r["paused"], r["emitted"]) for r in df.collect())
    assert key(spark.table("flow")) == key(flow_log(log, o))


def test_blake3():
    assert blake3_many([b"", b"abc"]) == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"]
    data = bytes(i % 251 for i in range(5000))
    many = [data[:n] for n in (1, 64, 1023, 1024, 1025, 2048, 3072, 3073, 5000)]
    assert blake3_many(many) == [blake3_many([m])[0] for m in many]
    assert blake3_many([data[:1024]])[0] == "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"
    assert blake3_many([data[:1025]])[0] == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


def test_adapters():
    assert languages() == ["go", "java", "javascript", "python", "rust", "typescript"]
    s, i, c = extract_text("rust", "struct A;\nenum B { X }\ntrait T { fn sig(&self); }\nmod m { const K: u8 = 1; }\nstatic G: u8 = 2;\n// fn no() {}\nfn f() { let s = \"fn q() {}\"; v[0](1); m!(2); }\n")
    assert [x["kind"] for x in s] == ["struct", "enum", "trait", "mod", "const", "static", "function"] and {x["scope"] for x in s} == {None}
    s, i, c = extract_text("typescript", "export class A { m() { new B(); } }\nconst x = () => 1;\ninterface I { a: string }\ntype T = string;\nenum E { A }\n")
    assert {"export", "class", "method", "variable", "function", "interface", "type", "enum"} <= {x["kind"] for x in s} and [x["callee_name"] for x in c] == ["B"]
    s, _, c = extract_text("python", "@d\nclass C:\n    x = 1\n    def f(self): return g()(1)\n")
    assert [(x["kind"], x["name"], x["scope"]) for x in s] == [("decorated", "C", None), ("class", "C", "C"), ("variable", "x", "C"), ("function", "f", "C")]
    assert extract_text("python", "def f(:\n  pass\nimport os\n")[0][0]["name"] == "f"
    assert extract_text("cobol", "x")[0] is None and extract_text("go", "")[0] == []


def test_commands_and_rpc(spark, tmp_path):
    e = Engine(spark)
    code = lambda line: json.loads(e.run(line).first()["value"])["payload"].get("code")
    assert code("{") == "INVALID_COMMAND" and code('{"command":"nope"}') == "INVALID_COMMAND" and code('{"command":"ack","job_id":"j"}') == "JOB_NOT_FOUND"
    assert e.run('{"command":"ack"}').count() == 0  # without a job there is nothing to answer
    assert code('{"command":"index_path","payload":{}}') == "INVALID_PAYLOAD" and code('{"command":"index_path","payload":{"path":"/no/such"}}') == "WALKER_ERROR"
    bad = json.dumps({"command": "index_path", "payload": {"path": str(tmp_path), "backpressure": {"max_queue_size": 1}}})
    assert code(bad) == "BACKPRESSURE_CONFIG"
    git = json.dumps({"command": "incremental_index", "payload": {"path": str(tmp_path), "use_git": True}})
    assert code(git) == "GIT_ERROR"
    assert json.loads(e.run('{"command":"list_languages"}').first()["value"])["event"] == "capabilities"
    assert e.rpc("[")["error"]["code"] == -32600 and e.rpc('{"id":7,"method":"unknown_method"}') == {"jsonrpc": "2.0", "id": 7, "error": {"code": -32601, "message": "unknown method unknown_method"}}
    assert e.rpc('{"id":1,"method":"index_path","params":{"path":"/no/such"}}')["error"]["code"] == -32603
    lines = spark.createDataFrame([(' {"command":"ack","job_id":"j","seq":3} ',), ("",), ("no",)], "value string")
    assert [(r["command"], r["seq"]) for r in e.commands(lines).collect()] == [("ack", 3), (None, None)]


def test_config(tmp_path):
    assert Config.load(str(tmp_path), {"MAX_CONCURRENCY": "3"}) == Config(3, 100)
    (tmp_path / "config.json").write_text('{"max_concurrency": 2, "max_queue_size": 50}')
    assert Config.load(str(tmp_path), {}) == Config(2, 50)


def payloads(df):
    return [(v["event"], v["payload"]) for v in (json.loads(r["value"]) for r in df.collect())]


def test_flow_in_a_job(spark, tmp_path):
    (tmp_path / "a.py").write_text("\n".join(f"def f{i}():\n    return {i}\n" for i in range(40)))
    e = Engine(spark)
    line = {"command": "index_path", "job_id": "j", "payload": {"path": str(tmp_path), "chunking": {"strategy": "SymbolBoundary", "max_lines": 0}, "backpressure": {"max_queue_size": 10, "threshold_percent": 80}}}
    log = payloads(e.run(json.dumps(line)))
    passed = sum(n in ("job_started", "file_listed", "chunk_emitted") for n, _ in log)
    assert passed == 42 and [n for n, _ in log].count("pause") == [n for n, _ in log].count("resume") == 4
    assert next(p for n, p in log if n == "pause") == {"output_queue_full": None, "threshold": 10, "current_size": 10, "backpressure_active": True}
    assert next(p for n, p in log if n == "file_listed")["file"]["path"] == "a.py"
    assert payloads(e.run('{"command":"ack","job_id":"j"}')) == [("ack", {"status": "ok", "count": 1, "current_queue_size": 1, "paused": False})]
    assert payloads(e.run('{"command":"ack","job_id":"j","payload":{"count":9}}')) == [("ack", {"status": "ok", "count": 9, "current_queue_size": 0, "paused": False})]
    assert payloads(e.run('{"command":"resume","job_id":"j"}')) == [("ack_resume", {"status": "ok", "queue_size": 0, "paused": False})]


def test_one_parse_a_job(spark, tmp_path):
    """The log's plan reads no source and runs no scanner; both were done once."""
    (tmp_path / "a.rs").write_text("use a::b;\nfn f() { g(); }\n")
    (tmp_path / "big.bin").write_bytes(b"x" * 100_000)
    e = Engine(spark)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")  # what the globs leave out is not read
    try:
        result = e.index_path(str(tmp_path))
        plan = e.event_log(result, "j")._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and "MapInPandas" not in plan and result.invalid.count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_unreadable_files_are_invalid(spark, tmp_path, monkeypatch):
    from weftline.sources import scan as source

    (tmp_path / "a.rs").write_text("fn a() {}\n")
    (tmp_path / "b.rs").write_text("fn b() {}\n")
    whole = source.contents
    monkeypatch.setattr(source, "contents", lambda s, paths: whole(s, [p for p in paths if not p.endswith("b.rs")]))
    e = Engine(spark)
    result = e.index_path(str(tmp_path))
    assert [r["path"] for r in result.files.collect()] == ["a.rs"] and ("file_invalid", {"path": "b.rs", "reason": "io_error"}) in payloads(e.event_log(result, "j"))
    assert [r["path"] for r in result.ordered().files.collect()] == ["a.rs"]
    assert {r["file_path"]: r["text"] for r in source.read_texts(spark, str(tmp_path), ["a.rs", "gone.rs"]).collect()} == {"a.rs": "fn a() {}\n", "gone.rs": ""}


def test_context_only_beside_symbols(spark):
    f = spark.createDataFrame([("a.py", "import os\nx = 1\n", "python"), ("b.py", "import os\ndef f(): pass\n", "python")], "file_path string, text string, language string")
    s = symbols(spark, [("f", "f", "function", "A", 2, 2), ("g", "g", "function", "B", 2, 2)], "b.py")
    out = ch.chunk_pipeline(f, s, ChunkingOptions("SymbolBoundary", overlap_lines=0)).collect()
    assert [r["content"] for r in out if r["file_path"] == "a.py"] == ["import os\nx = 1\n"]
    assert {r["symbol_id"]: r["content"] for r in out if r["file_path"] == "b.py"} == {k: f"import os\n\nscope: {v}\n\ndef f(): pass\n" for k, v in (("f", "A"), ("g", "B"))}


def test_own_strategy_and_token_counts(spark):
    import public_tokenizers

    f = files(spark, "one two\nthree\n")
    own = {"Whole": lambda files, symbols, most, kind: ch.full_file_chunks(files, "own-", kind, "whole", most)}
    options = ChunkingOptions("Whole", token_counting=True, tokenizer=public_tokenizers.path("word_bpe_49k.json"), own_strategies=("Whole",))
    r = ch.chunk_pipeline(f, None, options, "sha256", own).first()
    assert r["id"].startswith("own-") and r["metadata"]["chunk_strategy"] == "whole" and r["metadata"]["token_count"] == 3


def test_enclosing_sweep_against_brute_force():
    import random

    from weftline.extract.registry import Enclosing, Node

    def brute(nodes, start, end, own=None):
        best = None
        for n in nodes:
            if n is not own and n.start <= start and end <= n.end and (own is None or n.end - n.start > end - start) and (best is None or n.end - n.start <= best.end - best.start):
                best = n
        return best

    rng = random.Random(7)
    for _ in range(300):
        nodes = []
        for i in range(rng.randint(1, 25)):
            a = rng.randint(0, 40)
            nodes.append(Node("k", str(i), a, a + rng.randint(1, 20)))
        nodes.sort(key=lambda n: (n.start, -n.end))
        sweep = Enclosing(nodes)
        for n in nodes:
            got, want = sweep.around(n.start, n.end, n), brute(nodes, n.start, n.end, n)
            assert (got and (got.start, got.end)) == (want and (want.start, want.end))
        sweep = Enclosing(nodes)
        for start, end in sorted((a := rng.randint(0, 50), a + rng.randint(1, 5)) for _ in range(20)):
            got, want = sweep.around(start, end), brute(nodes, start, end)
            assert (got and got.name) == (want and want.name)


def test_extraction_is_linear():
    import time

    def seconds(n):
        text = "".join(f"function f{i}() {{\n  const x = [1, 2];\n  return new A(x).b(g(x));\n}}\n" for i in range(n))
        began = time.process_time()
        extract_text("typescript", text)
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 4 * max(seconds(4000), 0.1)


def test_tools_and_notifications(spark, tmp_path):
    from weftline.engine import tool_schemas

    (tmp_path / "a.rs").write_text("")
    assert [t["name"] for t in tool_schemas()] == ["list_languages", "index_path", "stop", "status"] and tool_schemas()[1]["inputSchema"]["properties"]["path"]["type"] == "string"
    lines = Engine(spark).rpc_lines(json.dumps({"id": 1, "method": "index_path", "params": {"path": str(tmp_path)}}))
    assert [x.get("method") for x in lines] == ["indexing/start", "indexing/file", "indexing/complete", None] and lines[2]["params"] == {"files": 1} and lines[3]["result"]["status"] == "started"


def test_few_input_tasks_do_not_bound_extraction(spark):
    """A corpus of one task, as a small Parquet file is, is parsed by several, whose number does not follow from the file's bytes."""
    from pyspark.sql import functions as F

    from weftline.extract.registry import extract, symbols_of

    corpus = spark.range(4_000, numPartitions=1).select(F.concat(F.lit("f"), "id").alias("file_path"), F.lit("fn f() {}\n").alias("text"), F.lit("rust").alias("language"))
    found = extract(corpus, False, False)
    sizes = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 1_000
    assert found.columns == ["file_path", "language", "symbols"] and symbols_of(found).count() == 4_000
    assert extract(corpus, True, False, symbols=False).columns == ["file_path", "language", "imports"]


def test_one_parse_a_text(monkeypatch):
    """Symbols, imports and calls of a text come from one parse, and one blanked text."""
    import ast

    from weftline.extract import braces

    seen, parse, find = [], ast.parse, braces.TypeScript._ITEM
    monkeypatch.setattr(ast, "parse", lambda text: seen.append("python") or parse(text))
    monkeypatch.setattr(braces.TypeScript, "_ITEM", type("Counted", (), {"finditer": lambda self, text: seen.append("typescript") or find.finditer(text)})())
    assert all(extract_text("python", "import os\ndef one_parse(): os.getcwd()\n"))
    assert all(extract_text("typescript", 'import { a } from "one";\nfunction f() { a(1); }\n'))
    assert seen == ["python", "typescript"]


def test_import_rules_stay_small(spark):
    """Parts of a statement are computed once; written out they grew the plan, and what each task compiles, to hundreds of kilobytes."""
    from pyspark.sql import functions as F

    from weftline.functions.imports import normalize_import

    plan = spark.range(1).select(normalize_import(F.lit("use a;"), F.col("id").cast("string")).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 20_000, len(plan)


def test_tasks_follow_the_input(spark, tmp_path):
    """Steps have a number of tasks in proportion to their rows and bytes, which Spark does not join by their compressed bytes."""
    import __spark_entry__ as entry
    from pyspark.sql import functions as F

    from weftline.operators.dealing import BYTES, ROWS, source_bytes, tasks
    from weftline.operators.symbols import symbol_index

    spark.range(3_000_000).withColumn("x", F.rand(1)).coalesce(1).write.parquet(str(tmp_path / "big"))
    big = spark.read.parquet(str(tmp_path / "big"))
    assert source_bytes(big) > 16 * BYTES / 4 and tasks(big.unionByName(big), rows=0) == max(16, -(-2 * source_bytes(big) // BYTES)) and tasks(big, rows=100 * ROWS) == 100
    assert source_bytes(spark.createDataFrame([(1,)], "a int")) < BYTES
    n = spark.range(2_000).select(F.concat(F.lit("f"), F.col("id") % 9).alias("file_path"), F.col("id").cast("string").alias("id"), F.lit(0).alias("ord"))
    assert symbol_index(n).rdd.getNumPartitions() >= 16
    plan = entry.queries()["symbol_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_texts_are_not_broadcast(spark):
    """A plan that makes texts of a few columns looks small, whatever it makes."""
    import __spark_entry__ as entry

    c = entry.queries()["composed_chunks"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in c._jdf.queryExecution().executedPlan().toString()
