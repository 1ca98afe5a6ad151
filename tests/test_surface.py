"""Settings, files, streams, SQL functions, tools and the command line."""

import io as text_io
import json
import warnings

import pytest
from pyspark.sql import functions as F

from condensa import __main__ as cli
from condensa import lexicons as lx
from condensa import schemas, service, sql
from condensa.config import EngineConfig
from condensa.functions import segment as sg
from condensa.functions import tokens as tk
from condensa.operators import engines as en
from condensa.operators import metrics as me
from condensa.operators import rules as rl
from condensa.operators import vectors as ve
from condensa.sources import io
from condensa.streaming import streams

TEXT = "And the purchase order came with the temperature report and the quarterly report from the order desk"


@pytest.fixture(scope="module")
def rules(spark):
    return rl.starter_rules(spark).cache()


def test_nested_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"compression": {"default_level": "light", "semantic_threshold": 0.7, "odd": 1}, "vector": {"max_results": 3}, "max_chars": 5}))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        c = EngineConfig.load(path=str(tmp_path / "c.json"))
    assert (c.level, c.semantic_threshold, c.max_results, c.max_chars) == ("light", 0.7, 3, 5)
    assert "compression.odd" in str(said[0].message)


def test_hooks_and_levels(spark, rules):
    docs = spark.createDataFrame([(1, TEXT, "light"), (2, TEXT, "aggressive"), (3, TEXT, "none"), (4, None, "balanced"), (5, " ", "light"), (6, TEXT, "odd")], "doc_id long, text string, level string")
    rows = {r["doc_id"]: r for r in en.batch_compress(docs, rules).collect()}
    assert [rows[i]["engine_used"] for i in (1, 2, 3, 5)] == ["semantic", "extreme", "none", "none"] and rows[4]["compressed_text"] is None
    for level, i in (("light", 1), ("aggressive", 2), ("balanced", 6)):
        alone = en.compress(docs.where(f"doc_id = {i}").drop("level"), rules, EngineConfig(level=level)).first()
        assert (alone["compressed_text"], alone["engine_used"]) == (rows[i]["compressed_text"], rows[i]["engine_used"])
    out = en.compress(docs.where("doc_id = 1"), rules, EngineConfig(level="aggressive"), hooks=[lambda d: d.withColumn("seen", F.lit(1))], before=[lambda d: d.withColumn("text", F.upper("text"))]).first()
    assert out["seen"] == 1 and out["text"] == TEXT.upper()


def test_optimise(spark, rules):
    docs = spark.createDataFrame([(1, TEXT * 3), (2, "short")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in en.optimise(docs, rules, max_tokens=60).collect()}
    assert out[2]["level"] == "light" and out[2]["fits"] and out[1]["engine_used"] == "extreme" and out[1]["fits"]
    assert not en.optimise(docs, rules, max_tokens=3).where("doc_id = 1").first()["fits"]
    assert {r["level"] for r in en.optimise(docs, rules, "small").collect()} == {"light"}


def test_too_many_reversible_rules(spark, monkeypatch):
    monkeypatch.setattr(en, "MAX_FOLDED_RULES", 2)
    with pytest.raises(ValueError, match="over 2"):
        en.decompress(spark.createDataFrame([("a",)], "compressed_text string"), rl.starter_rules(spark))


def test_sql_functions(spark, rules):
    sql.register(spark, rules)
    spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string").createOrReplaceTempView("surface_docs")
    rows = {r["doc_id"]: r for r in spark.sql("SELECT doc_id, condensa_tokens(text) t, condensa_ratio(text, 'ab') r, condensa_redundancy(text) d, condensa_compress(text, 'aggressive') c, condensa_compress(text, 'none') n FROM surface_docs").collect()}
    assert (rows[1]["t"], rows[2]["t"], rows[1]["n"], rows[3]["c"]) == (len(TEXT) // 4, 1, TEXT, None)
    assert rows[1]["r"] == pytest.approx(2 / len(TEXT)) and 0 < rows[1]["d"] < 1
    assert rows[1]["c"] == en.compress(spark.table("surface_docs").where("doc_id = 1"), rules, EngineConfig(level="aggressive")).first()["compressed_text"]
    found = spark.sql("SELECT doc_id, m.* FROM surface_docs, LATERAL condensa_matches(text) m").collect()
    assert {(r["original_text"], r["compressed_text"]) for r in found} >= {("purchase order", "purch ord"), ("quarterly report", "Q-rpt")}
    assert all(TEXT[r["position"] : r["position"] + r["size"]] == r["original_text"] for r in found)


def test_tools(spark, rules):
    s = service.Service(spark, rules)
    out = s.call("compress", text=TEXT, level="aggressive")
    assert out["success"] and out["engine_used"] == "extreme" and out["compression_ratio"] < 1
    assert s.call("analyse", text=TEXT)["analysis"]["strategy"]["level"] in ("light", "balanced", "aggressive")
    assert s.call("compare", text=TEXT)["best"] in ("semantic", "hybrid", "extreme")
    assert s.call("patterns", action="search", search="ORD")["patterns"][0]["id"] == 3
    assert s.call("patterns", action="add", original="warehouse", compressed="whse")["added"] and not s.call("patterns", action="add", original="order", compressed="o")["added"]
    assert s.call("stats")["statistics"]["rules"]["total"] == len(lx.RULES) + 1
    assert s.call("health")["health"]["overall"] == "healthy"
    assert s.call("optimise", text=TEXT, max_tokens=5)["optimisation"]["fits"] is False
    assert s.call("nothing") == {"success": False, "error": "ValueError: unknown tool: nothing"}
    assert not s.call("compress", text=TEXT, level="odd")["success"]
    assert service.health(rules.select("id").where("nonsense(1)") if False else rules, None)["components"]["vectors"] == {"status": "healthy", "enabled": False, "total": 0}


def test_health_of_broken_parts():
    class Broken:
        def limit(self, n):
            raise OSError("gone")

    out = service.health(Broken())
    assert out["overall"] == "degraded" and out["components"]["rules"] == {"status": "unhealthy", "error": "OSError: gone"}


def test_command_line(spark, tmp_path):
    run = lambda *a, stdin="": cli.run(cli.parser().parse_args(a), spark, text_io.StringIO(stdin))
    assert run("compress", TEXT, "--level", "aggressive")[0]["engine_used"] == "extreme"
    (tmp_path / "t.txt").write_text(TEXT)
    assert run("analyse", "--input", str(tmp_path / "t.txt"))[0]["success"] and run("compare", stdin=TEXT)[0]["best"]
    assert run("patterns", "--limit", "2")[0]["patterns"][0]["id"] == 3 and run("stats")[0]["success"] and run("health")[0]["success"]
    path = str(tmp_path / "rules")
    rl.starter_rules(spark).write.parquet(path)
    assert run("--rules", path, "add", "warehouse", "whse")[0]["added"]
    assert run("--rules", path, "patterns", "--search", "wareh")[0]["patterns"][0]["compressed"] == "whse"
    spark.createDataFrame([(i, "the blue order " * 3) for i in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert [r["engine"] for r in run("benchmark", str(tmp_path / "d"))] == ["extreme", "hybrid", "semantic"]
    assert run("learn", str(tmp_path / "d"), "--least", "5")[0]["frequency"] >= 5
    assert cli.main(["--output", str(tmp_path / "o"), "compress", TEXT]) == 0 and json.loads((tmp_path / "o").read_text())["success"]


def metrics(spark, n=50):
    rows = [(f"s{i % 3}", float(i * 60), 100, 50, 40, 20 + i % 7, 0.5 + i % 5 / 10, 7.0, 10, ["semantic", "hybrid"][i % 2], ["a", None][i % 2], "light", 2, i % 9 != 0) for i in range(n)]
    return spark.createDataFrame(rows, schemas.METRICS)


def test_exports_and_stores(spark, tmp_path):
    m = metrics(spark)
    io.export_metrics(m, str(tmp_path / "json"), minutes=10)
    series = spark.read.json(str(tmp_path / "json" / "series"))
    assert series.count() == 5 and series.agg(F.sum("n")).first()[0] == 50
    io.export_metrics(m, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 50
    assert io.read_metrics(spark, str(tmp_path / "json" / "raw")).count() == 50
    store = str(tmp_path / "store")
    for part in range(3):
        io.append_retained(m.where(F.col("timestamp") % 3 == 0).withColumn("timestamp", F.col("timestamp") + part * 10_000), store, "timestamp", "session_id", most=70)
    kept = spark.read.parquet(store)
    assert kept.count() == 70 and kept.agg(F.min("timestamp")).first()[0] >= 1000
    results = spark.createDataFrame([(1, "a", "x", 0.5, 3, 2, ["w"]), (2, "b", "x", 0.5, 3, 2, []), (3, None, "x", None, 3, 2, [])], "doc_id long, compressed_text string, engine_used string, compression_ratio double, original_tokens long, compressed_tokens long, warnings array<string>")
    io.write_log(results, str(tmp_path / "log"), "warn")
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted((x["level"], x["doc_id"]) for x in lines) == [("error", 3), ("warn", 1)]
    assert "compressions: 50" in me.report(m).first()["report"]
    assert me.session_details(m, 1).where("kind = 'domain'").count() == 3


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, float(i), f"2024-01-01 00:{i:02d}:00") for i in range(30)], "k long, v double, t string").select("k", "v", F.to_timestamp("t").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    source = lambda: streams.read(spark, str(tmp_path / "in"), events.schema)

    def last(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(90)
        return spark.table(name).collect()

    rows = last(streams.tumbling(source(), "ts", "10 minutes", aggregates={"n": F.count("*"), "total": F.sum("v")}), "tumbled", "complete")
    assert sorted((r["n"], r["total"]) for r in rows) == [(10, 45.0), (10, 145.0), (10, 245.0)]
    rows = last(streams.running_counters(source(), "k", "v"), "counted", "update")
    assert sorted((r["k"], r["n"], r["total"]) for r in rows) == [(0, 10, 135.0), (1, 10, 145.0), (2, 10, 155.0)]
    rows = last(streams.expiring_cache(source(), "k", "v"), "cached", "update")
    assert {r["k"]: r["updates"] for r in rows} == {0: 10, 1: 10, 2: 10}
    rows = last(streams.sessions(source(), "k", "ts", "5 minutes"), "sessioned", "complete")
    assert sorted((r["k"], r["n"]) for r in rows) == [(0, 10), (1, 10), (2, 10)]
    assert len(last(streams.first_of_each(source(), "k", "ts", "1 hour"), "firsts", "append")) == 3


def test_prompts(spark, rules):
    rows = [(TEXT, "s", ["a.py"], None, {"k": "v"}), (None, "s", None, None, None)]
    out = streams.answer_prompts(spark.createDataFrame(rows, schemas.PROMPTS), rules, EngineConfig(level="aggressive")).collect()
    done = next(r for r in out if r["prompt"])
    assert done["metadata"]["k"] == "v" and done["metadata"]["engine"] == "extreme" and len(done["prompt"]) < len(TEXT)
    assert next(r for r in out if not r["prompt"])["metadata"] == {}


def test_vocabularies(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    want = len(tokenizers.Tokenizer.from_file(path).encode("hello world", add_special_tokens=False).ids)
    assert [r[0] for r in df.select(tk.exact_count(path)("t")).collect()] == [want, 0, 0]
    own = df.limit(1).select(tk.pseudo_ids("t").alias("ids"), F.split("t", " ").alias("w"))
    back = own.select(tk.pseudo_decode(F.col("ids"), F.map_from_arrays("ids", "w")).alias("b"), tk.pseudo_decode(F.col("ids"), F.create_map(F.lit(0), F.lit("x"))).alias("m")).first()
    assert back["b"] == "hello world" and back["m"].startswith("<")
    assert df.limit(1).select(tk.supported_models(F.array(F.lit("words"), F.lit("a")))).first()[0] == ["a", "adjusted", "chars", "patterns", "words"]


def test_extraction_places(spark):
    text = "`a` see http://x.y/z and\n```py\nb `c`\n```\nhttp://q `d`"
    row = spark.createDataFrame([(text,)], "t string").select(sg.code_blocks("t").alias("b"), sg.url_places("t").alias("u")).first()
    assert [(text[b["position"] : b["position"] + len(b["code"])] == b["code"], b["fenced"]) for b in row["b"]] == [(True, True), (True, False), (True, False)]
    assert [text[u["position"] :][: len(u["text"])] for u in row["u"]] == ["http://x.y/z", "http://q"]
    split = spark.createDataFrame([(["recon", "ciliation", "x", "notwith", "standing", "standing"],)], "t array<string>").select(sg.split_words(F.col("t"))).first()[0]
    assert split == ["reconciliation", "notwithstanding"]


def test_rule_search_blocks_and_explanation(spark, rules, monkeypatch):
    texts = spark.createDataFrame([(1, "purchase order"), (2, "quarterly report due"), (3, "zzz")], "doc_id long, text string")
    found = sorted(map(tuple, ve.search_rules(texts, rules).select("doc_id", "id", "rank").collect()))
    assert found and found[0][:2] == (1, 3)
    told = ve.explain_search(ve.search_rules(texts, rules), rules).where("doc_id = 1 and rank = 1").first()
    assert sum(told["added"].values()) == pytest.approx(told["score"]) and told["strongest"] == "semantic"
    monkeypatch.setattr(ve, "RULE_BLOCK", 4)
    assert sorted(map(tuple, ve.search_rules(texts, rules).select("doc_id", "id", "rank").collect())) == found


def test_cross_domain_and_versions(spark):
    rules = rl.starter_rules(spark, [(1, "a b c d e", "x", "phrase", 1, "general", 0, 0.0), (2, "a b c d e", "y", "phrase", 1, "other", 0, 0.0), (3, "a z", "q", "phrase", 1, "other", 0, 0.0)])
    assert [tuple(r) for r in rl.cross_domain(rules).collect()] == [(1, 2)]
    versions = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "c", "d")], "pattern_id int, version int, original string, compressed string")
    assert rl.latest_versions(versions).first()["original"] == "c"
