"""Oracle-side SQL for the text functions, in the oracle's own regex dialect."""

from __future__ import annotations

from evalspark.plans.inputs import quoted

_TRIM = r"'^\s+|\s+$'"


def bodies(text: str, pattern: str, group: int) -> str:
    kept = f"list_filter(regexp_extract_all({text}, '{pattern}', {group}), lambda z: length(z) > 5)"
    joined = (
        f"array_to_string(list_transform({kept}, lambda z: regexp_replace(z, {_TRIM}, '', 'g')), "
        "chr(10) || chr(10))"
    )
    return f"case when len({kept}) > 0 then {joined} end"


def fenced(text: str) -> str:
    return bodies(text, r"(?s)```[ ]*(\w*)\s*(.*?)\s*```", 2)


def module(text: str) -> str:
    return bodies(text, r"(?s)\bmodule\b(.*?)\bendmodule\b", 1)


def code(text: str) -> str:
    return f"coalesce({fenced(text)}, {module(text)})"


def trim(text: str) -> str:
    return f"regexp_replace({text}, {_TRIM}, '', 'g')"


def numbered(text: str, start: int = 1, prefix: bool = True) -> str:
    lines = f"string_split(replace({text}, chr(13), ''), chr(10))"
    one = (
        f"cast(i + {start} - 1 as varchar) || ': ' || z"
        if prefix
        else f"z || ' :' || cast(i + {start} - 1 as varchar)"
    )
    return f"array_to_string(list_transform({lines}, lambda z, i: {one}), chr(10))"


def stripped_paths(text: str) -> str:
    return (
        f"regexp_replace({text}, "
        r"""'([\\/][^\\/"();\n]+)+[\\/]project[\\/]', '/project/', 'g')"""
    )


def mismatch(text: str, group: int) -> str:
    pattern = r"(?i)Total mismatched samples is (\d+) out of (\d+) samples"
    return f"try_cast(regexp_extract({text}, '{pattern}', {group}) as bigint)"


def summary(code_: str, late: str, out: str, err: str) -> str:
    return (
        f"'Command return code: ' || coalesce(cast({code_} as varchar), 'None') || "
        f"case when {code_} is not distinct from 0 then ' (success)' "
        f"when {late} then ' (failed, timed out)' else ' (failed)' end || "
        f"case when {out} <> '' then chr(10) || chr(10) || 'Command stdout:' || chr(10) || "
        f"{stripped_paths(out)} else '' end || "
        f"case when {err} <> '' then chr(10) || chr(10) || 'Command stderr:' || chr(10) || "
        f"{stripped_paths(err)} else '' end"
    )


def header(label: str, fill: str, width: int = 80) -> str:
    room = f"({width - 2} - length({label}))"
    return (
        f"repeat('{fill}', cast({room} // 2 as bigint)) || ' ' || {label} || ' ' || "
        f"repeat('{fill}', cast({room} - {room} // 2 as bigint))"
    )


def rendered() -> str:
    who = "('(agent=' || coalesce(agent_name, 'None') || ', uuid=' || uuid || ')')"
    title = "(upper(substr(role, 1, 1)) || substr(role, 2))"

    def lines(start: str, end: str, fill: str) -> str:
        return (
            f"{header(start, fill)} || chr(10) || {header(who, fill)} || chr(10) || text || "
            f"chr(10) || {header(end, fill)}"
        )

    answer = lines("'Start Response'", "'End Response'", "<")
    prompt = lines(f"('Start Prompt (' || {title} || ')')", f"('End Prompt (' || {title} || ')')", ">")
    return f"case when role = 'assistant' then {answer} else {prompt} end"


def js(value: str) -> str:
    return f"coalesce(cast(to_json({value}) as varchar), 'null')"


def iso(timestamp: str) -> str:
    return (
        f"strftime({timestamp}, '%Y-%m-%dT%H:%M:%S') || case when strftime({timestamp}, '%f') = "
        f"'000000' then '' else '.' || strftime({timestamp}, '%f') end || '+00:00'"
    )


def message_json() -> str:
    return (
        "'{' || case when role = 'assistant' then '\"response_text\":' || "
        f"{js('text')} || ',\"metadata\":' || coalesce(metadata, 'null') "
        f"else '\"prompt_text\":' || {js('text')} end || ',\"role\":' || {js('role')} || "
        f"',\"agent_name\":' || {js('agent_name')} || ',\"uuid\":' || {js('uuid')} || "
        f"',\"timestamp\":\"' || {iso('timestamp')} || '\"}}'"
    )


def join_parts(separator: str, *parts: str) -> str:
    """Join SQL texts, leaving out null ones."""
    return f"concat_ws({quoted(separator)}, {', '.join(parts)})"
