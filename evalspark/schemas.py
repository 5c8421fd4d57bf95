"""Table schemas and closed vocabularies shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _ddl(ddl: str) -> T.StructType:
    """Schema from ``name type`` pairs; unlike the DDL parser it needs no running session."""
    pairs = [field.strip().split(" ") for field in ddl.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PROBLEM_DESCRIPTIONS = _ddl("task_id string, detail_description string")
PROBLEM_SOLUTIONS = _ddl("task_id string, prompt string, canonical_solution string, test string")
PROBLEMS = _ddl(
    "problem_id string, problem_description string, module_header string, testbench_code string, "
    "canonical_solution string, code_language string, other_data map<string,string>"
)
MODEL_CONFIGS = _ddl(
    "llm_class string, configured_llm_name string, is_stable boolean, model_name string, "
    "option_seed int, option_temperature double, other_model_file_options map<string,string>, "
    "does_respond_to_test_queries boolean, response_delay_seconds double"
)
AGENT_VARIANTS = _ddl(
    "name string, max_conversation_cycles int, repeat_last_attempt boolean, "
    "add_line_number_prefixes boolean, phrasing string, instruction_location string, "
    "wrap_in_md boolean, enable_debugger_agent boolean"
)
MESSAGES = _ddl(
    "experiment_id string, seq int, uuid string, timestamp timestamp, role string, "
    "agent_name string, text string, metadata string"
)
COMMAND_RESULTS = _ddl(
    "experiment_id string, cycle_num int, step string, stdout string, stderr string, "
    "return_code int, duration_sec double, timed_out boolean"
)
CYCLE_LOG = _ddl(
    "experiment_execution_uuid string, cycle_uuid string, cycle_num int, llm_prompt string, "
    "llm_response string, llm_response_metadata string, extracted_generated_code string, "
    "compile_result_return_code int, compile_result_stdout string, compile_result_stderr string, "
    "was_compile_success boolean, execute_result_return_code int, execute_result_stdout string, "
    "execute_result_stderr string, was_execute_success boolean, was_testbench_passed boolean, "
    "testbench_stats string, exit_stage string"
)
EXPERIMENTS = _ddl(
    "experiment_group_start_timestamp timestamp, experiment_execution_uuid string, "
    "llm_provider_name string, configured_llm_name string, llm_configuration string, "
    "problem_id string, problem_description string, problem_module_header string, "
    "testbench_code string, experiment_save_dir string, used_cycle_count int, "
    "max_cycle_count int, latest_exit_stage string, was_testbench_passed boolean, error string"
)
BUG_SCANS = _ddl(
    "experiment_group_start_timestamp timestamp, experiment_execution_uuid string, "
    "llm_provider_name string, configured_llm_name string, target_file_path string, "
    "target_file_name string, llm_configuration string, llm_prompt string, llm_response string, "
    "llm_response_metadata string, experiment_save_dir string, bug_found_status string, "
    "error string"
)
TESTBENCH_STATS = "mismatch_sample_count bigint, total_sample_count bigint"

# Outcome vocabularies.
CYCLE_STAGES = [
    "20_code_extraction_error",
    "25_iverilog_compile_timeout",
    "30_iverilog_compile_error",
    "35_iverilog_execute_timeout",
    "40_iverilog_execute_error",
    "60_tb_failed",
    "80_tb_passed",
    "end",
    "exception",
]
ONESHOT_STAGES = [
    "code_extraction_error",
    "end",
    "exception",
    "iverilog_compile_error",
    "iverilog_execute_error",
    "tb_fail",
    "tb_pass",
    "tb_stats_not_found",
]
BUG_STATUSES = ["BUG FOUND", "BUG NOT FOUND", "UNKNOWN", "exception"]
PASS_STAGE = "80_tb_passed"
# What ends an experiment before its last cycle.
END_STAGES = (PASS_STAGE, "exception")
CODE_LANGUAGES = ["verilog", "systemverilog", "vhdl"]
MODEL_CLASSES = ["MockLlm", "OllamaLlm", "ChatGptLlm"]

# The named prompt strategies, in the column order of AGENT_VARIANTS.
AGENT_VARIANT_ROWS = [
    ("v1", 5, False, False, "basic", "bottom", False, True),
    ("repeat_last_attempt", 5, True, False, "basic", "bottom", True, True),
    ("add_line_nums", 5, False, True, "basic", "bottom", True, True),
    ("be_specific", 5, False, False, "be_specific", "bottom", True, True),
    ("top_instructions", 5, False, False, "basic", "top", True, True),
    ("v2", 5, True, True, "be_specific", "top", True, True),
    ("v3", 5, False, True, "be_specific", "bottom", True, True),
]
