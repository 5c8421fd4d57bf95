"""Readers, writers and the live stream on real folders."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalspark.operators import summary
from evalspark.schemas import EXPERIMENTS, MODEL_CONFIGS
from evalspark.session import fresh_path, shared_dir
from evalspark.sources import readers, sinks
from evalspark.streaming import live


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_a_cluster_has_to_name_its_shared_dir():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_source_tree(spark, tmp_path):
    files = {"a.v": "module a;\nendmodule\n", "deep/er/b.sv": "x\r\n", "c.txt": "no", "d.vh": "no"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    found = readers.read_source_tree(spark, str(tmp_path))
    rows = {r["file_name"]: r for r in found.collect()}
    assert {n: r["contents"] for n, r in rows.items()} == {
        "a.v": files["a.v"], "b.sv": files["deep/er/b.sv"],
    }
    assert rows["b.sv"]["file_path"].endswith("/deep/er/b.sv")
    size = readers.tree_size(spark, str(tmp_path)).first()
    assert size["total_bytes"] == sum(len(t) for t in files.values())
    assert size["file_count"] == len(files)


def test_jsonl(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"task_id":"a","detail_description":"x"}\nbroken\n{"task_id":"b"}\n')
    schema = readers.PROBLEM_DESCRIPTIONS
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        readers.read_jsonl(spark, str(log), schema).collect()
    kept = readers.read_jsonl(spark, str(log), schema, keep_corrupt=True)
    assert {(r["task_id"], r["_corrupt_record"]) for r in kept.collect()} == {
        ("a", None), (None, "broken"), ("b", None),
    }


def test_unknown_fields_do_not_vanish(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"task_id":"a","error":"x","n":{"m":1}}\n\n{"task_id":"b"}\n')
    schema = readers.PROBLEM_DESCRIPTIONS
    with pytest.raises(Exception, match="unknown fields: error, n"):
        readers.read_jsonl(spark, str(log), schema).collect()
    copy = readers.read_parquet(spark, sinks.compact_jsonl(spark, str(log), schema))
    assert {r["task_id"]: r["unknown_fields"] for r in copy.collect()} == {
        "a": {"error": "x", "n": '{"m":1}'}, "b": None,
    }


def test_model_configs(spark, tmp_path):
    path = tmp_path / "models.jsonl"
    rows = [
        {"llm_class": "MockLlm", "configured_llm_name": "mock", "is_stable": True},
        {"llm_class": "OllamaLlm", "configured_llm_name": "lama", "model_name": "llama2:7b",
         "option_seed": 1, "other_model_file_options": {"num_ctx": "10"}},
        {"llm_class": "ChatGptLlm", "configured_llm_name": "gpt", "model_name": "gpt-4"},
    ]
    path.write_text("\n".join(json.dumps(r) for r in rows))
    got = {r["configured_llm_name"]: r for r in readers.read_model_configs(spark, str(path)).collect()}
    assert got["mock"]["does_respond_to_test_queries"] and got["mock"]["response_delay_seconds"] == 0.01
    assert got["lama"]["parameter_count_billions"] == 7.0 and not got["lama"]["is_stable"]
    assert got["gpt"]["parameter_count_billions"] is None
    bad = [
        ({"llm_class": "Other", "configured_llm_name": "x"}, "unknown class: Other"),
        ({"llm_class": "OllamaLlm", "configured_llm_name": "x", "model_name": "llama"}, "release tag"),
        ({"llm_class": "OllamaLlm", "configured_llm_name": "x", "model_name": "l:latest"}, "count"),
        ({"llm_class": "ChatGptLlm", "configured_llm_name": "x"}, "no model name"),
        ({"llm_class": "MockLlm"}, "no configured name"),
    ]
    for row, problem in bad:
        table = readers.rows_to_table(spark, [row], MODEL_CONFIGS)
        assert problem in readers.validated_configs(table).first()["problem"]
        with pytest.raises(Exception, match=problem):
            readers.require_valid_configs(table).collect()


def test_model_configs_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "models.yaml"
    path.write_text(
        '- configured_llm_name: "mock"\n  llm_class: "MockLlm"\n  response_delay_seconds: 1\n\n'
        '- configured_llm_name: "lama"\n  llm_class: "OllamaLlm"\n  model_name: "llama2:13b"\n'
        "  option_temperature: 0 # none\n  other_model_file_options: {num_ctx: 10}\n"
    )
    rows = {r["configured_llm_name"]: r for r in readers.read_model_configs(spark, str(path)).collect()}
    assert rows["mock"]["response_delay_seconds"] == 1.0
    assert rows["lama"]["option_temperature"] == 0.0
    assert rows["lama"]["parameter_count_billions"] == 13.0
    assert rows["lama"]["other_model_file_options"] == {"num_ctx": "10"}
    path.write_text("- configured_llm_name: x\n  llm_class: MockLlm\n  colour: red\n")
    with pytest.raises(ValueError, match="unknown config fields: \\['colour'\\]"):
        readers.read_model_configs(spark, str(path))


def _experiments(spark, stages):
    rows = [
        {"experiment_execution_uuid": f"e{i}", "llm_provider_name": "p",
         "configured_llm_name": f"m{i % 2}", "latest_exit_stage": s, "was_testbench_passed": False}
        for i, s in enumerate(stages)
    ]
    rows.append({"latest_exit_stage": "exception", "error": "boom"})
    return readers.rows_to_table(spark, rows, EXPERIMENTS)


def test_log_to_parquet_to_summaries(spark, tmp_path):
    log = str(tmp_path / "experiment_data.jsonl")
    for stages in (["60_tb_failed", "80_tb_passed"], ["80_tb_passed"]):
        sinks.append_jsonl(_experiments(spark, stages), log)
    target = sinks.compact_jsonl(spark, log, EXPERIMENTS, partitions=1)
    assert target == str(tmp_path / "experiment_data.pq")
    back = readers.read_parquet(spark, target)
    assert back.count() == 5 and back.where("error = 'boom'").count() == 2
    one = summary.stages_by_model(back, "latest_exit_stage")
    first = readers.read_parquet(spark, sinks.write_summary(one, str(tmp_path), 1))
    assert sum(r["count"] for r in first.collect()) == 5
    assert Path(tmp_path, "experiment_summary_type_1.pq").is_dir()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.compact_jsonl(spark, str(tmp_path / "none.jsonl"), EXPERIMENTS)
    with pytest.raises(ValueError):
        sinks.compact_jsonl(spark, log, EXPERIMENTS, ".csv")


@pytest.fixture
def messages(spark):
    return spark.sql(
        """select * from values
        (1, 1, 'u1', timestamp'2024-01-01', 'user', 'designer', 'b', null),
        (1, 0, 'u0', timestamp'2024-01-01', 'system', null, 'a', null),
        (1, 2, 'u2', timestamp'2024-01-02', 'assistant', 'debugger', 'c', '{"n":1}')
        as t(conv_id, seq, uuid, timestamp, role, agent_name, text, metadata)"""
    )


def _log(spark, path):
    return spark.read.json(path).orderBy("seq").collect()


def test_conversations(spark, messages, tmp_path):
    folder = str(tmp_path / "over")
    for _ in range(2):
        sinks.overwrite_conversations(messages, ["conv_id"], folder)
    everything = _log(spark, f"{folder}/all")
    assert [json.loads(r["json"])["uuid"] for r in everything] == ["u0", "u1", "u2"]
    assert everything[1]["text"].split("\n")[2] == "b"
    assert sorted(p.name for p in Path(folder, "by_agent").glob("agent=*")) == [
        "agent=debugger", "agent=designer",
    ]
    folder = str(tmp_path / "more")
    for _ in range(2):
        sinks.append_conversations(messages, ["conv_id"], folder)
    assert len(_log(spark, f"{folder}/all")) == 6
    assert len(_log(spark, f"{folder}/by_agent/agent=None")) == 2


def test_written_conversations_are_in_order(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "id % 3 as conv_id", "id as seq", "concat('u', id) as uuid",
        "timestamp_seconds(10000 - id div 2) as timestamp", "'user' as role",
        "case id % 5 when 0 then 'designer' when 1 then 'debugger' when 2 then null else 'x' end "
        "as agent_name", "'t' as text", "cast(null as string) as metadata",
    ).repartition(7)
    folder = str(tmp_path / "log")
    sinks.overwrite_conversations(rows, ["conv_id"], folder)
    sizes = {}
    for log in (Path(folder, "all"), *Path(folder, "by_agent").glob("agent=*")):
        lines = [
            json.loads(line)
            for part in sorted(log.glob("part-*.json"))
            for line in part.read_text().splitlines()
        ]
        order = [(r["conv_id"], json.loads(r["json"])["timestamp"], r["seq"]) for r in lines]
        assert order == sorted(order)
        sizes[log.name] = len(order)
    assert sizes == {"all": 3000, "agent=designer": 600, "agent=debugger": 600, "agent=x": 1200}


def test_step_outputs(spark, tmp_path):
    results = spark.createDataFrame(
        [("e", "compile", 0, "out", "err"), ("f", "execute", None, "late", "")],
        "experiment_id string, step string, return_code int, stdout string, stderr string",
    )
    folder = str(tmp_path / "steps")
    sinks.write_step_outputs(results, ["experiment_id"], folder)
    got = {(r["experiment_id"], r["output_name"]): r["content"] for r in spark.read.json(folder).collect()}
    assert got == {
        ("e", "cmd_compile_stdout_ret0"): "out",
        ("e", "cmd_compile_stderr_ret0"): "err",
        ("f", "cmd_execute_stdout_retNone"): "late",
        ("f", "cmd_execute_stderr_retNone"): "",
    }


def test_row_snapshot(spark, tmp_path):
    folder = str(tmp_path / "snap")
    sinks.write_row_snapshots(_experiments(spark, ["80_tb_passed"]), ["problem_id"], folder)
    texts = [r["snapshot"] for r in spark.read.parquet(folder).collect()]
    assert all(list(json.loads(t)) == EXPERIMENTS.fieldNames() and "\n" in t for t in texts)


def test_stream_goes_on_where_it_stopped(spark):
    work = fresh_path(spark, "stream")
    parts = [["60_tb_failed", "80_tb_passed"], ["80_tb_passed"] * 3]
    seen = []
    for stages in parts:
        sinks.append_jsonl(_experiments(spark, stages), f"{work}/log")
        log = live.stream_log(spark, f"{work}/log", EXPERIMENTS)
        counts = live.drain_counts(log, "latest_exit_stage", f"{work}/state", f"{work}/counts")
        batch = summary.stages_by_model(
            readers.read_jsonl(spark, f"{work}/log", EXPERIMENTS), "latest_exit_stage"
        )
        as_set = {tuple(r) for r in counts.select(batch.columns).collect()}
        assert as_set == {tuple(r) for r in batch.collect()}
        seen.append(counts.agg(F.sum("count")).first()[0])
    assert seen == [3, 7]
