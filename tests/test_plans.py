"""Physical plans: what has to hold when the tables are large."""

import re

import pytest
from pyspark.sql import functions as F

from evalspark.operators import history, summary
from evalspark.plans import inputs
from evalspark.plans.catalog import QUERIES
from evalspark.sources import readers

SF_DIR = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"udf_batch_score", "txt_chunk_blank_lines"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they come out for sides too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_plan(no_broadcast, name):
    plan = plan_of(QUERIES[name](no_broadcast, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_QUERIES:
        assert not re.search(r"Python|Pandas|InArrow", plan)
    # windows over everything would run in one task
    assert not re.search(r"Exchange SinglePartition.*\n.*Window|Window.*\n.*Exchange SinglePartition", plan)


def test_rollup_is_one_shuffle_of_hash_aggregates(no_broadcast):
    plan = plan_of(summary.rollup_cycles(inputs.cycles(no_broadcast, SF_DIR)))
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    assert "Sort" not in plan and "Window" not in plan
    scanned = re.search(r"FileScan parquet \[(.*?)\]", plan).group(1)
    assert {c.split("#")[0] for c in scanned.split(",")} == {"event_id", "event_type"}


def test_scans_read_only_what_is_asked_for(spark):
    """Columns are pruned and filters reach the Parquet reader through the readers."""
    log = readers.read_parquet(spark, f"{SF_DIR}/events.parquet")
    plan = plan_of(log.where("value > 10").select("event_id"))
    assert re.search(r"PushedFilters: \[IsNotNull\(value\), GreaterThan\(value,10.0\)\]", plan)
    assert re.search(r"ReadSchema: struct<event_id:bigint,value:double>", plan)


def test_results_are_attached_without_sorting_texts(no_broadcast):
    """Left joins of the rows as they are: no aggregate that would sort and drag texts along."""
    names = ["join_results_to_cycle", *(n for n in QUERIES if n.startswith("exp_"))]
    for name in names:
        assert "SortAggregate" not in plan_of(QUERIES[name](no_broadcast, SF_DIR)), name
    plan = plan_of(QUERIES["join_results_to_cycle"](no_broadcast, SF_DIR))
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 3
    for name, keys in (("exp_single_shot", 1), ("exp_cycle_loop", 2)):
        plan = plan_of(QUERIES[name](no_broadcast, SF_DIR))
        found = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
        assert sum(len(k.split(",")) == keys for k in found) >= 3, name


def test_bug_scan_moves_contents_once_and_as_they_are(no_broadcast):
    plan = plan_of(QUERIES["exp_bug_scan"](no_broadcast, SF_DIR))
    assert plan.count("SortMergeJoin") == 1
    assert plan.index("Generate") < plan.index("SortMergeJoin")  # the prompt is made above the join


@pytest.fixture
def even_partitions(no_broadcast):
    """As many output partitions as shuffle partitions, so that their sizes can be compared."""
    no_broadcast.conf.set("spark.sql.adaptive.enabled", "false")
    yield no_broadcast
    no_broadcast.conf.unset("spark.sql.adaptive.enabled")


def test_a_hot_conversation_is_spread(even_partitions):
    """One conversation holds a third of all messages; no task gets near a third of the rows."""
    spark = even_partitions
    hot = spark.range(4000).selectExpr("-1L as conv_id", "id as seq")
    cold = spark.range(8000).selectExpr("id div 8 as conv_id", "id % 8 as seq")
    messages = hot.unionAll(cold).selectExpr(
        "conv_id", "seq", "case when seq % 2 = 0 then 'user' else 'assistant' end as role",
        "repeat('x', 5) as text", "seq as timestamp",
    )
    for made in (
        history.with_positions(messages, ["conv_id"]),
        history.truncate_context(messages, ["conv_id"], 100, block=16),
        history.ordered_conversation(messages, ["conv_id"], "timestamp", "seq"),
    ):
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 7 and max(sizes) < 0.25 * sum(sizes), sizes


def test_truncation_hands_no_conversation_to_one_task(no_broadcast):
    """The only shuffle by conversation alone is that of the block totals."""
    plan = plan_of(QUERIES["win_context_truncate"](no_broadcast, SF_DIR))
    keys = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ENSURE", plan)
    alone = [k for k in keys if len(set(re.findall(r"\w+#\d+", k))) == 1]
    assert len(alone) == 1 and len(keys) >= 5


@pytest.mark.parametrize(
    "name",
    ["pmt_debugger", "pmt_retry", "pmt_designer", "cls_exit_stage_cycle", "asr_extract_ratio",
     "exp_single_shot", "exp_cycle_log", "exp_validate_testbenches"],
)
def test_texts_are_searched_once(no_broadcast, name):
    """No optimizer rule copies the extraction or the log search to a second place."""
    plan = plan_of(QUERIES[name](no_broadcast, SF_DIR))
    assert plan.count(", ```, -1)") == 1
    assert plan.count(" out of (\\d+) samples, 0)") <= 1


def test_grid_is_narrow(no_broadcast):
    plan = plan_of(QUERIES["join_cross_models"](no_broadcast, SF_DIR))
    assert "Generate explode" in plan and "Exchange" not in plan and "Join" not in plan


def test_text_queries_do_not_shuffle(no_broadcast):
    for name in QUERIES:
        if name.startswith(("txt_", "cls_", "pmt_", "dt_", "prj_")) and name not in (
            "txt_render_transcript", "prj_problem_build", "prj_keep_keys",
        ):
            assert "Exchange" not in plan_of(QUERIES[name](no_broadcast, SF_DIR)), name
