"""Rendering of chat messages as banner text and as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.strings import ColumnOrName, as_col, int_div, json_fields
from evalspark.functions.times import iso_timestamp

ASSISTANT = "assistant"


def header_line(
    label: ColumnOrName, width: int = 80, fill: str | Column = "=", strict: bool = True
) -> Column:
    """A label centred in a line of fill characters; an odd remainder goes to the right.

    A label too long for the line raises, or gives null when not strict.
    """
    if isinstance(fill, str):
        if len(fill) != 1:
            raise ValueError("fill must be a single character")
        fill = F.lit(fill)
    label = as_col(label)
    room = F.lit(width - 2) - F.length(label)
    left = int_div(room, 2).cast("int")
    line = F.concat(
        F.repeat(fill, left), F.lit(" "), label, F.lit(" "), F.repeat(fill, room - left)
    )
    if not strict:
        return F.when(room > 0, line)
    problem = F.concat(F.lit("label is too long for its line: "), label)
    return F.when(room > 0, line).otherwise(F.raise_error(problem).cast("string"))


def render_message(
    role: ColumnOrName,
    agent: ColumnOrName,
    uuid: ColumnOrName,
    text: ColumnOrName,
    strict: bool = True,
) -> Column:
    """A message between two banner lines above and one below.

    An agent name too long for its line raises; if not strict it makes that line longer.
    """
    role, text = as_col(role), as_col(text)
    who = F.concat(
        F.lit("(agent="),
        F.coalesce(as_col(agent), F.lit("None")),
        F.lit(", uuid="),
        as_col(uuid),
        F.lit(")"),
    )
    is_answer = role == ASSISTANT
    fill = F.when(is_answer, "<").otherwise(">")
    kind = F.when(is_answer, "Response").otherwise(
        F.concat(F.lit("Prompt ("), F.initcap(role), F.lit(")"))
    )

    def banner(label: Column) -> Column:
        line = header_line(label, fill=fill, strict=strict)
        if strict:
            return line
        return F.coalesce(line, F.concat(fill, F.lit(" "), label, F.lit(" "), fill))

    line_break = F.lit("\n")
    return F.concat(
        banner(F.concat(F.lit("Start "), kind)),
        line_break,
        banner(who),
        line_break,
        text,
        line_break,
        banner(F.concat(F.lit("End "), kind)),
    )


def message_json(
    role: ColumnOrName,
    agent: ColumnOrName,
    uuid: ColumnOrName,
    timestamp: ColumnOrName,
    text: ColumnOrName,
    metadata: ColumnOrName,
) -> Column:
    """JSON object of a message; answers also carry their metadata object."""
    role, text = as_col(role), as_col(text)
    common = json_fields(
        role.alias("role"),
        as_col(agent).alias("agent_name"),
        as_col(uuid).alias("uuid"),
        iso_timestamp(timestamp).alias("timestamp"),
    )
    prompt = json_fields(text.alias("prompt_text"))
    answer = F.concat(
        json_fields(text.alias("response_text")),
        F.lit(',"metadata":'),
        F.coalesce(as_col(metadata), F.lit("null")),
    )
    return F.concat(
        F.lit("{"),
        F.when(role == ASSISTANT, answer).otherwise(prompt),
        F.lit(","),
        common,
        F.lit("}"),
    )


# Fixed value: the list a model is asked to count.
_COUNTED = r"[ \t\r\n]*,[ \t\r\n]*".join(rf"{n}(?:\.0+)?" for n in range(1, 11))
_COUNT_TO_TEN = rf"^[ \t\r\n]*\[[ \t\r\n]*{_COUNTED}[ \t\r\n]*\][ \t\r\n]*\z"


def answer_passes(response: ColumnOrName, check: str) -> Column:
    """Self-checks of a model: ``apple_test`` and ``count_to_10``."""
    response = as_col(response)
    if check == "apple_test":
        rest = F.replace(response, F.lit("apple"), F.lit(""))
        return (F.length(response) - F.length(rest)) >= 3 * len("apple")
    if check == "count_to_10":
        return response.rlike(_COUNT_TO_TEN)
    raise ValueError(f"unknown check: {check}")


# The rules and answers of the offline responder. The words of a rule have to follow
# each other in one line; atomic groups take each at its first place, which needs no way back.
APPLE_RULE = r"^Write.*?\d\s*sentences(?>.*?ending)(?>.*?apple)"
NUMBERS_RULE = r"^Write(?>.*?list)(?>.*?numbers).*?\d"
APPLE_ANSWER = " ".join(f"This is sentence {i} ending with apple." for i in range(1, 11))
NUMBERS_ANSWER = "[" + ", ".join(str(i) for i in range(1, 11)) + "]"
ECHO_PREFIX = 'I am an "AI" "language" "model" (MockLlm). The text I was given as input was:\n'


def mock_answer(prompt: ColumnOrName) -> Column:
    """Deterministic answer of the offline responder, as a plain column expression."""
    prompt = as_col(prompt)
    return (
        F.when(prompt.rlike("(?Ud)" + APPLE_RULE), APPLE_ANSWER)
        .when(prompt.rlike("(?Ud)" + NUMBERS_RULE), NUMBERS_ANSWER)
        .otherwise(F.concat(F.lit(ECHO_PREFIX), prompt))
    )
