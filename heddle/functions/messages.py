"""Conversations as ``array<struct<role,content>>``: roles, structure, documents, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which roles come, and the role each stands for. Fixed values.
ALIASES = {
    "human": "user",
    "prompter": "user",
    "user": "user",
    "gpt": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "assistant": "assistant",
    "system": "system",
    "tool": "tool",
    "tool_response": "tool",
    "tool_call": "tool_call",
}
TURN_END = "\n\n<TURN_END>\n\n"


def role(c: Column) -> Column:
    """The role a name stands for; null if it is none."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.trim(c)))


def conversations(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation of a table of turns (turn, role, text), its messages in order."""
    messages = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy(conv_id).agg(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def normalized(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content")))


def invalid_reason(messages: Column) -> Column:
    """Why a conversation is not a valid training sample; null if it is. The first check that fails counts.

    Tool turns are allowed anywhere after the first user turn and excuse a repeated user or assistant turn.
    Empty user turns are valid.
    """
    roles = F.transform(messages, lambda m: m["role"])
    dialog = F.filter(roles, lambda r: r != "system")
    blank = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "") == ""
    state = F.struct(F.lit(None).cast("string").alias("last"), F.lit(False).alias("tool"), F.lit(None).cast("string").alias("reason"))

    def step(s: Column, m: Column) -> Column:
        r = m["role"]
        is_tool = r.isin("tool", "tool_call")
        repeats = (s["last"] == r) & ~s["tool"]
        found = (
            F.when((r == "system") & s["last"].isNotNull(), "system_not_at_prefix")
            .when((r == "assistant") & blank(m["content"]), "empty_assistant")
            .when((r == "assistant") & repeats, "assistant_not_alternating")
            .when((r == "user") & repeats, "user_not_alternating")
        )
        speaks = r.isin("user", "assistant")
        return F.struct(F.when(speaks, r).otherwise(s["last"]).alias("last"), F.when(speaks, F.lit(False)).otherwise(s["tool"] | is_tool).alias("tool"), F.coalesce(s["reason"], found).alias("reason"))

    walked = F.aggregate(messages, state, step, lambda s: s["reason"])
    known = lambda m: F.coalesce(m["role"].isin(*sorted(set(ALIASES.values()))), F.lit(False))
    fault = lambda m: F.when(m.isNull(), "message_not_object").when(~known(m), "invalid_role").when(m["content"].isNull(), "content_not_string")
    first_bad = F.try_element_at(F.filter(F.transform(messages, fault), lambda x: x.isNotNull()), F.lit(1))
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "empty_messages")
        .when(first_bad.isNotNull(), first_bad)
        .when(~(F.coalesce(F.try_element_at(dialog, F.lit(1)), F.lit("")) == "user"), "first_non_system_not_user")
        .when(F.element_at(roles, -1) != "assistant", "last_role_not_assistant")
        .when(walked.isNotNull(), walked)
        .when(~F.array_contains(roles, "assistant"), "no_assistant")
    )


def document(messages: Column) -> Column:
    """One text of a conversation: each turn under its role, a mark between turns."""
    turn = lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), F.regexp_replace(m["content"], r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.transform(messages, turn), TURN_END)


def flat(messages: Column, by: str = "") -> Column:
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), by)


def first_user_prompt(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"], F.lit(""))


def key(messages: Column) -> Column:
    """A hash that equal conversations share."""
    return F.sha2(F.to_json(messages), 256)


def pairs(messages: Column) -> Column:
    """Turns 1, 3, 5 … with their answers; a last turn without one gets the empty answer."""
    at = lambda i: F.coalesce(F.try_element_at(messages, i)["content"], F.lit(""))
    made = F.transform(F.sequence(F.lit(1), F.size(messages), F.lit(2)), lambda i: F.struct(at(i).alias("instruction"), at(i + 1).alias("response")))
    return F.when(F.size(messages) > 0, made).otherwise(F.array().cast("array<struct<instruction:string,response:string>>"))


def sft_spans(messages: Column) -> Column:
    """Where each turn stands in the flat text and whether loss is taken there (assistant turns only)."""
    length = lambda m: F.length(F.coalesce(m["content"], F.lit("")))
    before = lambda i: F.aggregate(F.slice(messages, F.lit(1), i), F.lit(0), lambda a, m: a + length(m))
    return F.transform(messages, lambda m, i: F.struct(before(i).alias("start"), (before(i) + length(m)).alias("end"), (m["role"] == "assistant").alias("trained")))


#: How the common chat formats write a turn: fixed values.
TEMPLATES = {
    "plain": {"user": "USER: {}", "assistant": "ASSISTANT: {}", "system": "{}", "sep": "\n"},
    "chatml": {"user": "<|im_start|>user\n{}<|im_end|>", "assistant": "<|im_start|>assistant\n{}<|im_end|>", "system": "<|im_start|>system\n{}<|im_end|>", "sep": "\n"},
    "alpaca": {"user": "### Instruction:\n{}", "assistant": "### Response:\n{}", "system": "{}", "sep": "\n\n"},
}


def rendered(messages: Column, template: str = "chatml") -> Column:
    """A conversation in one of the TEMPLATES; roles it does not name are left out."""
    form = TEMPLATES[template]

    def turn(m: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in ("user", "assistant", "system"):
            a, b = form[name].split("{}")
            out = F.when(m["role"] == name, F.concat(F.lit(a), F.coalesce(m["content"], F.lit("")), F.lit(b))).otherwise(out)
        return out

    return F.array_join(F.transform(messages, turn), form["sep"])


def appended(messages: Column, role_: str, content: Column) -> Column:
    """One more turn at the end."""
    turn = F.struct(F.lit(role_).alias("role"), content.cast("string").alias("content"))
    return F.concat(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")), F.array(turn))


def with_last(messages: Column, content: Column) -> Column:
    """The content of the last turn replaced; no turns stay none."""
    n = F.size(messages)
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == n - 1, content).otherwise(m["content"]).alias("content")))


def length_by_parity(messages: Column, part: str = "all") -> Column:
    """Characters of even turns (instruction), odd turns (response) or all turns."""
    rest = {"instruction": 0, "response": 1}.get(part)
    if rest is None and part != "all":
        raise ValueError(part)
    kept = messages if rest is None else F.filter(messages, lambda m, i: i % 2 == rest)
    return F.aggregate(kept, F.lit(0), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit(""))))


def answers(messages: Column, by: str = "\n") -> Column:
    """The second, fourth … turns in one text, as input of an embedder."""
    return F.array_join(F.transform(F.filter(messages, lambda m, i: i % 2 == 1), lambda m: F.coalesce(m["content"], F.lit(""))), by)


def preference(prompt: Column, chosen: Column, rejected: Column, template: str = "claude") -> Column:
    """prompt, chosen and rejected as texts: the prompt rendered with its answer open, each answer as its last turn.

    ``chosen`` and ``rejected`` are conversations whose last turn is the answer.
    """
    from . import templates

    opened = appended(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))), "assistant", F.lit(None))
    last = lambda c: F.coalesce(F.try_element_at(c, F.lit(-1))["content"], F.lit(""))
    return F.struct(templates.render(opened, template).alias("prompt"), last(chosen).alias("chosen"), last(rejected).alias("rejected"))


def last_tokens(tokens: Column, n: int) -> Column:
    """Left truncation: the last n."""
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def first_tokens(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def scored(data: DataFrame, scores: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Scores per turn (key, turn, one column per name) as arrays by turn on each conversation; none gives empty ones."""
    row = F.sort_array(F.collect_list(F.struct("turn", *names)))
    per = scores.groupBy(key).agg(row.alias("_s")).select(key, *[F.col(f"_s.{n}").cast("array<double>").alias(n) for n in names])
    out = data.join(per, key, "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<double>")) for n in names})


def token_spans(messages: Column, size) -> Column:
    """start, end and masked of each message in tokens, from the lengths of all before it; ``size`` gives a text's length, and all but answers are masked."""
    first = F.array().cast("array<struct<start:int,end:int,masked:boolean>>")

    def add(done, m):
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))
        return F.concat(done, F.array(F.struct(start.alias("start"), (start + size(m["content"])).cast("int").alias("end"), (~m["role"].eqNullSafe(F.lit("assistant"))).alias("masked"))))

    return F.aggregate(messages, first, add)
