"""Golden cases and comparison with plain Python models on random text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.functions import extract, messages, times, toolout
from evalspark.functions.strings import strip

FENCE = "`" * 3


def random_texts(pieces, count, seed, length=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, length))) for _ in range(count)]


# -- extraction ------------------------------------------------------------------------------

CODE = "module my_module;\n    Some code here.\nendmodule"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Here is some text with no code blocks.", None),
        (f"\nHere is some Verilog code:\n{FENCE}verilog\n{CODE}\n{FENCE}", CODE),
        (f"{FENCE}\n12345\n{FENCE}", None),
        (f"{FENCE}\n123456\n{FENCE}", "123456"),
        (f"{FENCE}{FENCE}", None),
        (f"{FENCE}verilog\nnever closed, long enough", None),
        (f"a {FENCE}v\nfirst one\n{FENCE} b {FENCE}\nsecond one\n{FENCE}", "first one\n\nsecond one"),
    ],
)
def test_fenced(values, text, expected):
    assert values([text], extract.fenced_code) == [expected]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("This is a plain text with no Verilog modules.", None),
        ("Here is some Verilog code:\nmodule my_module;\nendmodule", "my_module;"),
        ("module        endmodule", ""),
        ("submodule abcdefgh; endmodule", None),
    ],
)
def test_module(values, text, expected):
    assert values([text], extract.module_code) == [expected]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Just some random text.", None),
        (
            f"{FENCE}verilog\nmodule markdown_module;\nendmodule\n{FENCE}"
            "Random text module my_module;\nendmodule",
            "module markdown_module;\nendmodule",
        ),
        ("Random text module my_module;\nendmodule", "my_module;"),
    ],
)
def test_extract_code(values, text, expected):
    assert values([text], extract.extract_code) == [expected]


def test_extract_rejects_other_code():
    with pytest.raises(ValueError):
        extract.extract_code("t", "python")


def model_bodies(text, pattern, group):
    """What the text patterns say, in Python's own regex engine."""
    found = [m.group(group) for m in re.finditer(pattern, text, re.DOTALL)]
    kept = [body.strip() for body in found if len(body) > 5]
    return "\n\n".join(kept) if kept else None


def test_extraction_equals_python_on_random_text(values):
    pieces = [
        FENCE, "`", "``", "verilog", "v", " ", "\n", "\t", "\u00a0", "\x1f", "é", "_", "module",
        "endmodule", "module m;", " endmodule", "assign a = b;", "abc", "\r\n", "日本", "\u2003",
        FENCE, FENCE, FENCE, " module ", " endmodule", "abcdefg",
    ]
    texts = random_texts(pieces, 4000, seed=7, length=18)
    fenced = [model_bodies(t, FENCE + r"[ ]*(\w*)\s*(.*?)\s*" + FENCE, 2) for t in texts]
    module = [model_bodies(t, r"\bmodule\b(.*?)\bendmodule\b", 1) for t in texts]
    assert sum(f is not None for f in fenced) > 300
    assert sum(m is not None for m in module) > 100
    assert values(texts, extract.fenced_code) == fenced
    assert values(texts, extract.module_code) == module
    both = [f if f is not None else m for f, m in zip(fenced, module)]
    assert values(texts, extract.extract_code) == both


def test_extraction_time_grows_with_the_text_only(values):
    """Many openings without an end would make a search for whole blocks quadratic."""
    long = "module m; endmodule " + "module x; " * 200_000
    assert values([long], extract.module_code) == [None]
    assert values([long + "endmodule"], extract.module_code) == [("x; " + "module x; " * 199_999).strip()]
    assert values([FENCE + " abc " * 200_000], extract.fenced_code) == [None]


def test_strip_equals_python(values):
    texts = random_texts([" ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u3000", "a", "é "], 500, 3)
    assert values(texts, lambda c: strip(F.col(c))) == [t.strip() for t in texts]


# -- lines and chunks ------------------------------------------------------------------------


def test_line_numbers(values):
    text = "a\r\n\nb\n"
    assert values([text], extract.number_lines) == ["1: a\n2: \n3: b\n4: "]
    behind = values([text], lambda t: extract.number_lines(t, "postfix", 0))
    assert behind == ["a :0\n :1\nb :2\n :3"]
    with pytest.raises(ValueError):
        extract.number_lines("t", "infix")


def test_line_numbers_can_be_taken_off(values):
    texts = random_texts(["a", "1: ", "\n", " "], 200, 5)
    numbered = values(texts, extract.number_lines)
    bare = ["\n".join(re.sub(r"^\d+: ", "", x, count=1) for x in t.split("\n")) for t in numbered]
    assert bare == texts


def model_chunks(text, low, high):
    """Greedy cutting at pairs of blank lines; a short tail joins the last chunk."""
    lines = text.replace("\r", "").split("\n")
    begins = [0]
    for i in range(len(lines) - 1):
        if not lines[i].strip() and not lines[i + 1].strip() and i - begins[-1] >= low:
            begins.append(i)
    if len(begins) > 1 and len(lines) - begins[-1] < low:
        begins.pop()
    out = []
    for a, b in zip(begins, begins[1:] + [len(lines)]):
        step = high or (b - a)
        out += [(p + 1, lines[p : min(p + step, b)]) for p in range(a, b, step)]
    return out


@pytest.mark.parametrize("low, high", [(1, None), (2, None), (3, 4), (8, 20)])
def test_chunks_equal_model(spark, low, high):
    texts = random_texts(["x\n", "\n", " \n", "\r\n", "yy", "\n\n\n"], 400, low, length=40)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {}
    for r in extract.split_into_chunks(df, "t", low, high).orderBy("i", "chunk_no").collect():
        found.setdefault(r["i"], []).append(r)
    for i, text in enumerate(texts):
        expected = model_chunks(text, low, high)
        assert [r["chunk_no"] for r in found[i]] == list(range(len(expected)))
        assert [(r["start_line"], r["chunk_text"].split("\n")) for r in found[i]] == expected
        assert [r["line_count"] for r in found[i]] == [len(lines) for _, lines in expected]
        assert "\n".join(r["chunk_text"] for r in found[i]) == text.replace("\r", "")


def test_chunks_of_a_large_file(spark):
    text = ("some code;\n" * 9 + "\n\n") * 20_000
    df = spark.createDataFrame([(1, text)], "i int, t string")
    chunks = extract.split_into_chunks(df, "t", 8).collect()
    assert len(chunks) == 20_000
    assert sum(r["line_count"] for r in chunks) == text.count("\n") + 1
    assert "\n".join(r["chunk_text"] for r in sorted(chunks, key=lambda r: r["chunk_no"])) == text


def test_chunk_limits_are_checked(spark):
    with pytest.raises(ValueError):
        extract.split_into_chunks(spark.range(0).selectExpr("'a' as t"), "t", 0)


# -- paths -----------------------------------------------------------------------------------

RUN = "working/run_2024-05-13_04-16-53L/experiments_x-3.5/problem_e8508505-0538-4398/cycle_002"


@pytest.mark.parametrize(
    "text, expected",
    [
        (f'$dumpvar("/home/some_user/{RUN}/project/wave.vcd");', '$dumpvar("/project/wave.vcd");'),
        (f'$dumpvar("/home/some user/{RUN}/project/wave.vcd");', '$dumpvar("/project/wave.vcd");'),
        (
            '$dumpvar("C:\\Users\\some user\\more\\cycle_002\\project\\wave.vcd");',
            '$dumpvar("C:/project/wave.vcd");',
        ),
        ("/project/wave.vcd", "/project/wave.vcd"),
        (
            f"VCD info: dumpfile /some/file/{RUN}/project/wave.vcd opened for output.\n"
            f"/some/file/{RUN}/project/testbench_code.sv:52: $finish called at 1001 (1ps)\n"
            "Hint: Output 'Y0' has no mismatches.\n\nMismatches: 0 in 200 samples",
            "VCD info: dumpfile /project/wave.vcd opened for output.\n"
            "/project/testbench_code.sv:52: $finish called at 1001 (1ps)\n"
            "Hint: Output 'Y0' has no mismatches.\n\nMismatches: 0 in 200 samples",
        ),
    ],
)
def test_strip_paths(values, text, expected):
    assert values([text], extract.strip_paths) == [expected]


def test_strip_paths_equals_python_on_random_text(values):
    pieces = ["/", "\\", "project", "a", " ", '"', "(", ";", "\n", "//", "/project/", "\\project\\"]
    texts = random_texts(pieces, 3000, seed=11, length=12)
    pattern = r"([\\/][^\\/\"();\n]+)+[\\/]project[\\/]"
    expected = [re.sub(pattern, "/project/", t) for t in texts]
    assert sum(a != b for a, b in zip(texts, expected)) > 200
    assert values(texts, extract.strip_paths) == expected


def test_strip_paths_on_very_long_lines(values):
    """Neither a deep path nor a slash-rich line beside one costs more than its length."""
    deep = "/a" * 200_000 + "/project/x"
    blob = "ab/c" * 300_000 + "\n/home/x/project/y"
    after = "/home/x/project/y " + "ab/c" * 300_000
    assert values([deep, blob, after], extract.strip_paths) == [
        "/project/x", "ab/c" * 300_000 + "\n/project/y", "/project/y " + "ab/c" * 300_000,
    ]


# -- tool output -----------------------------------------------------------------------------


def test_testbench(spark):
    texts = [
        "Hint: Total mismatched samples is 0 out of 439 samples",
        "x\nhint: total MISMATCHED samples is 007 out of 9 samples\n"
        "Total mismatched samples is 0 out of 9 samples",
        "no such line",
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", toolout.testbench_result("t").alias("r")).orderBy("i").collect()
    got = [tuple(r["r"]) if r["r"] else None for r in rows]
    assert got == [
        ('{"mismatch_sample_count":0,"total_sample_count":439}', True),
        ('{"mismatch_sample_count":7,"total_sample_count":9}', False),
        None,
        None,
    ]
    with pytest.raises(Exception, match="mismatched sample count"):
        df.select(toolout.testbench_result("t", strict=True)).collect()


# The banners of the four tools.
def test_tool_versions(values):
    banner = """
Icarus Verilog version 13.0 (devel) (s20221226-516-g615a01c6c)

An invented line in between, of no version

Icarus Verilog Preprocessor version 13.0 (devel) (s20221226-516-g615a01c6c)

Icarus Verilog Parser/Elaborator version 13.0 (devel) (s20221226-516-g615a01c6c)

 FLAGS DLL vvp.tgt
vvp.tgt: Icarus Verilog VVP Code Generator 13.0 (devel) (s20221226-516-g615a01c6c)
"""
    full = "13.0 (devel) (s20221226-516-g615a01c6c)"
    names = [
        "Icarus Verilog",
        "Icarus Verilog Preprocessor",
        "Icarus Verilog Parser/Elaborator",
        "vvp.tgt: Icarus Verilog VVP Code Generator",
    ]
    found = values([banner, "none"], toolout.tool_versions)
    assert [tuple(v) for v in found[0]] == [(n, "13.0", full) for n in names]
    assert found[1] == []
    blank = "\n" * 2_000_000
    assert len(values([blank + banner + blank], toolout.tool_versions)[0]) == 4


def test_server_version(values):
    texts = ["ollama version is 0.1.32", "Version IS 1.2.\n", "version is 1..2", "none", "version is x"]
    pattern = re.compile(r"version is ((\d+\.?)+)", re.IGNORECASE)
    expected = [m.group(1) if (m := pattern.search(t)) else None for t in texts]
    assert values(texts, toolout.server_version) == expected
    assert values(["version is " + "1." * 100_000], toolout.server_version) == ["1." * 100_000]


def test_parameter_count(values):
    tags = ["llama2:7b", "tinyllama:1.1b", "mixtral-8x7b:latest", "gpt-4"]
    assert values(tags, toolout.parameter_count) == [7.0, 1.1, 7.0, None]
    with pytest.raises(Exception, match="no parameter count"):
        values(tags, lambda t: toolout.parameter_count(t, strict=True))


def test_command_summary(spark):
    path = "/home/u/run/project/a.v"
    rows = [
        (1, 0, False, "out", ""),
        (2, 1, False, "", f"{path}: error"),
        (3, None, True, "a", "b"),
        (4, None, False, None, None),
        (5, 2, True, "", ""),
    ]
    df = spark.createDataFrame(rows, "i int, rc int, late boolean, o string, e string")
    got = df.select(toolout.command_summary("rc", "late", "o", "e").alias("s")).collect()
    assert [r["s"] for r in got] == [
        "Command return code: 0 (success)\n\nCommand stdout:\nout",
        "Command return code: 1 (failed)\n\nCommand stderr:\n/project/a.v: error",
        "Command return code: None (failed, timed out)\n\nCommand stdout:\na\n\nCommand stderr:\nb",
        "Command return code: None (failed)",
        "Command return code: 2 (failed, timed out)",
    ]


def test_timescale(values):
    line = "`timescale 1 ps/1 ps\n\n"
    assert values(["x", "`timescale y"], toolout.with_timescale) == [line + "x\n", "`timescale y\n"]
    always = values(["`timescale y"], lambda t: toolout.with_timescale(t, always=True))
    assert always == [line + "`timescale y\n"]


# -- banners, self-checks, times -------------------------------------------------------------


@pytest.mark.parametrize(
    "label, width, fill, expected",
    [
        ("Start Prompt", 54, ">", ">" * 20 + " Start Prompt " + ">" * 20),
        ("TEST", 10, "=", "== TEST =="),
        ("TEST", 9, "=", "= TEST =="),
        ("TEST1", 10, "=", "= TEST1 =="),
        ("TEST1", 11, "=", "== TEST1 =="),
    ],
)
def test_header_line(values, label, width, fill, expected):
    assert values([label], lambda t: messages.header_line(t, width, fill)) == [expected]


def test_header_line_limits(values):
    with pytest.raises(ValueError):
        messages.header_line("t", 10, "==")
    with pytest.raises(Exception, match="too long"):
        values(["12345678"], lambda t: messages.header_line(t, 10))
    assert values(["12345678"], lambda t: messages.header_line(t, 10, strict=False)) == [None]
    assert values(["1234567"], lambda t: messages.header_line(t, 10)) == [" 1234567 ="]


def test_render_message(spark):
    df = spark.createDataFrame(
        [("user", None, "u1", "hi"), ("assistant", "bot", "u2", "yo")],
        "role string, agent string, uuid string, text string",
    )
    got = [
        r[0].split("\n")
        for r in df.select(messages.render_message("role", "agent", "uuid", "text")).collect()
    ]
    assert [line.strip("<> ") for line in got[0]] == [
        "Start Prompt (User)", "(agent=None, uuid=u1)", "hi", "End Prompt (User)",
    ]
    assert [line.strip("<> ") for line in got[1]] == [
        "Start Response", "(agent=bot, uuid=u2)", "yo", "End Response",
    ]
    assert all(len(x) == 80 for rows in got for x in (rows[0], rows[1], rows[3]))
    long = df.limit(1).withColumn("agent", F.lit("a" * 90))
    with pytest.raises(Exception, match="too long"):
        long.select(messages.render_message("role", "agent", "uuid", "text")).collect()
    lenient = messages.render_message("role", "agent", "uuid", "text", strict=False)
    lines = long.select(lenient).first()[0].split("\n")
    assert lines[1] == "> (agent=" + "a" * 90 + ", uuid=u1) >" and lines[2] == "hi"


def test_mock_answers_pass_the_self_checks(values):
    orders = [
        "Write me 10 sentences ending with the word 'apple'.",
        "Write me a list of numbers from 1 to 10 as a JSON list of integers. "
        "Do not write anything else. Respond with only the JSON list.",
        "Please Write me 10 sentences ending with apple",
    ]
    answers = values(orders, messages.mock_answer)
    assert answers[0].startswith("This is sentence 1 ending with apple. This is sentence 2 ")
    assert answers[0].endswith("This is sentence 10 ending with apple.")
    assert answers[1] == "[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]"
    assert answers[2].endswith("The text I was given as input was:\n" + orders[2])
    assert values(answers, lambda t: messages.answer_passes(t, "apple_test")) == [True, False, False]
    assert values(answers, lambda t: messages.answer_passes(t, "count_to_10")) == [
        False, True, False,
    ]


def test_mock_rules_equal_python_on_random_text(values):
    pieces = ["Write", " list ", "numbers", "7", "10 ", "sentences", "ending", "apple", "\n", " ",
              "\u2028", "x", "10 sentences", "1\nsentences", "ending", "apple"]
    texts = ["Write" + t for t in random_texts(pieces, 8000, seed=2, length=16)]
    apple = re.compile(r"Write.*(\d+)\s*sentences.*ending.*apple")
    numbers = re.compile(r"Write.*list.*numbers.*(\d+).*()")
    expected = [
        messages.APPLE_ANSWER if apple.match(t)
        else messages.NUMBERS_ANSWER if numbers.match(t)
        else messages.ECHO_PREFIX + t
        for t in texts
    ]
    assert len([e for e in expected if e == messages.APPLE_ANSWER]) > 20
    assert len([e for e in expected if e == messages.NUMBERS_ANSWER]) > 100
    assert values(texts, messages.mock_answer) == expected


def test_mock_rules_on_a_long_line(values):
    text = "Write " + "list numbers sentences ending " * 30_000
    assert values([text], messages.mock_answer) == [messages.ECHO_PREFIX + text]


def test_count_to_ten(values):
    texts = [
        "[1,2,3,4,5,6,7,8,9,10]", " [1, 2,3,4,5,6,7,8,9 , 10.0 ]\n", "[1,2,3,4,5,6,7,8,9]",
        "[1,2,3,4,5,6,7,8,9,10] ", "[1,2,3,4,5,6,7,8,9,10] x", '["1",2,3,4,5,6,7,8,9,10]', "",
    ]
    got = values(texts, lambda t: messages.answer_passes(t, "count_to_10"))
    assert got == [True, True, False, True, False, False, False]


def test_stamps_and_durations(spark):
    df = spark.sql("select timestamp'2024-05-13 04:16:53.123987' as t")
    got = {
        p: df.select(times.file_stamp("t", p)).first()[0]
        for p in ("date", "datetime", "datetime_ms", "datetime_us")
    }
    assert got == {
        "date": "2024-05-13L",
        "datetime": "2024-05-13_04-16-53L",
        "datetime_ms": "2024-05-13_04-16-53-123L",
        "datetime_us": "2024-05-13_04-16-53-123987L",
    }
    import datetime

    micros = [0, 1, 1_500_000, 86_400_000_000, 180_000_000_000_001, -1, -86_400_000_000]
    rows = spark.createDataFrame([(m,) for m in micros], "m bigint")
    texts = [r[0] for r in rows.select(times.duration_text(F.col("m"))).collect()]
    assert texts == [str(datetime.timedelta(microseconds=m)) for m in micros]


def test_message_json(spark):
    import json

    df = spark.sql(
        """select * from values
        ('user', 'a', 'u1', timestamp'2024-01-01 00:00:01', 'say "hi"\n', null),
        ('assistant', null, 'u2', timestamp'2024-01-01 00:00:01.5', 'yo', '{"n":1}'),
        ('assistant', null, 'u3', timestamp'2024-01-01 00:00:02', 'yo', null)
        as t(role, agent, uuid, ts, text, meta)"""
    )
    got = [
        r[0] for r in df.select(messages.message_json(*df.columns)).collect()
    ]
    assert [list(json.loads(g).items()) for g in got] == [
        [("prompt_text", 'say "hi"\n'), ("role", "user"), ("agent_name", "a"), ("uuid", "u1"),
         ("timestamp", "2024-01-01T00:00:01+00:00")],
        [("response_text", "yo"), ("metadata", {"n": 1}), ("role", "assistant"),
         ("agent_name", None), ("uuid", "u2"), ("timestamp", "2024-01-01T00:00:01.500000+00:00")],
        [("response_text", "yo"), ("metadata", None), ("role", "assistant"),
         ("agent_name", None), ("uuid", "u3"), ("timestamp", "2024-01-01T00:00:02+00:00")],
    ]
